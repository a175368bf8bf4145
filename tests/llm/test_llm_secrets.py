"""Layers of the secret scan: a plain decoder over whole tables and random nests, hostile inputs, bounded memory."""

from __future__ import annotations

import base64
import bz2
import gzip
import lzma
import random
import re
import subprocess
import sys
import time
import urllib.parse
import zlib

import pyarrow as pa
import pytest

from tagstream.llm import secrets

SECRET = b'token = "abcdefgh12345678"'
KIND = {
    "assign": re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I),
    "access": re.compile(rb"(AKIA[A-Z0-9]+)"),
    "hex": re.compile(rb"([0-9a-f]+)"),
}
LEAST = {"assign": 8, "access": 16, "hex": 32}
UNPACK = {b"\x1f\x8b\x08": ("gzip", gzip.decompress), b"BZh": ("bzip2", bz2.decompress), b"\xfd7zXZ\x00": ("xz", lzma.decompress), **{b"\x78" + c: ("zlib", zlib.decompress) for c in (b"\x01", b"\x5e", b"\x9c", b"\xda")}}


def b64(data: bytes) -> str:
    return base64.b64encode(data).decode()


def spans(text):
    return secrets.scan_kernel(pa.array([text]))[4][0].as_py()


def layers_of(text):
    return [s.rsplit(":", 2) for s in spans(text).split(",") if "+" in s]


def plain_layers(data: bytes, path: str):
    """(data, for each byte its range in the parent and whether it was decoded, path) of the layers right inside, one byte at a time."""
    for name, pattern, value in (("url", rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)])), ("unicode", rb"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)).encode() if m[1] else bytes([int(m[2], 16)]))):
        out, come, at = b"", [], 0
        for m in re.finditer(pattern, data):
            out += data[at : m.start()] + value(m)
            come += [(i, i + 1, False) for i in range(at, m.start())] + [(*m.span(), True)] * len(value(m))
            at = m.end()
        if at:
            yield out + data[at:], come + [(i, i + 1, False) for i in range(at, len(data))], f"{path}+{name}"
    for m in re.finditer(rb"[A-Za-z0-9+/_-]{19,}", data):
        run, end = m[0].replace(b"-", b"+").replace(b"_", b"/"), m.end()
        while end < m.end() + 2 and data[end : end + 1] == b"=":
            end += 1
        for skip in range(4):
            bits = "".join(f"{b'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/'.index(c):06b}" for c in run[skip:])
            out = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits) - 7, 8))
            yield out, [(m.start() + skip + i // 3 * 4, min(m.start() + skip + i // 3 * 4 + 4, end), True) for i in range(len(out))], path + "+base64"
    if path:
        at = 0
        for m in re.finditer(b"|".join(re.escape(sign) for sign in UNPACK), data):
            name, unpack = UNPACK[m[0]]
            for end in range(m.end(), len(data) + 1) if m.start() >= at else ():
                try:
                    out = unpack(data[m.start() : end])
                except (OSError, EOFError, zlib.error, lzma.LZMAError, ValueError):
                    continue
                yield out, [(m.start(), end, True)] * len(out), f"{path}+{name}"
                at = end  # what lies in a whole stream is no other stream
                break


def plain_findings(data: bytes, path: str = "", come: list | None = None, depth: int = 0) -> set:
    """(kind, start, end) in the text of what its layers hold; ``come``: for each byte its range in the text, and whether any step decoded it."""
    found = set()
    if path:
        for name, pattern in KIND.items():
            for m in pattern.finditer(data):
                part = come[m.start() : m.end()]
                if len(m[1]) >= LEAST[name] and any(t for _, _, t in part):
                    found.add((name, min(x for x, _, _ in part), max(y for _, y, _ in part)))
    if depth < 7:
        for inner, own, name in plain_layers(data, path):
            outer = own if come is None else [(min(x for x, _, _ in come[a:b]), max(y for _, y, _ in come[a:b]), t or any(u for _, _, u in come[a:b])) for a, b, t in own]
            found |= plain_findings(inner, name, outer, depth + 1)
    return found


def nested(draw: random.Random) -> str:
    text = draw.choice(['password: "hunter2hunter2"', "AKIA" + "Q7Z" * 5, "deadbeef" * 5, "nothing at all here"])
    for _ in range(draw.randint(0, 3)):
        before, behind = draw.choice(["", "x ", "a/b/", "key=", "é "]), draw.choice(["", " y", ";", "\nz"])
        raw = (before + text + behind).encode()
        text = draw.choice(
            [
                lambda: b64(raw),
                lambda: urllib.parse.quote(raw, safe=""),
                lambda: "".join(f"\\u{ord(c):04x}" if ord(c) < 0x10000 and draw.random() < 0.3 else c for c in raw.decode()),
                lambda: b64(draw.choice([lambda x: gzip.compress(x, mtime=0), zlib.compress, bz2.compress, lzma.compress])(raw)),
                lambda: urllib.parse.quote(draw.choice([lambda x: gzip.compress(x, mtime=0), zlib.compress])(raw)),
            ]
        )()
    return draw.choice(["", "see ", "https://h/p/"]) + text + draw.choice(["", " end", ", and"])


def test_random_nests_against_a_plain_decoder():
    draw = random.Random(5)
    for _ in range(250):
        text = " ".join(nested(draw) for _ in range(draw.randint(1, 2)))
        raw = text.encode()
        assert {(secrets.KINDS[k], a, b) for k, a, b, _ in secrets.layer_findings(raw)} == plain_findings(raw), text


def test_layers_of_the_table_against_a_plain_decoder(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    for r in secrets.scan(docs.select("text")).collect():
        got = {x.rsplit(":", 2)[0].split("+")[0] + ":" + x.split(":", 1)[1] for x in r["spans"].split(",") if "+" in x}
        raw = r["text"].encode()
        at = [0]
        for c in r["text"]:
            at.append(at[-1] + len(c.encode()))
        point = {b: i for i, b in enumerate(at)}
        assert got == {f"{k}:{point[a]}:{point[b]}" for k, a, b in plain_findings(raw)}


@pytest.mark.parametrize("before", ["", "x", "x/", "ab/", "abc/", "https://h/p/", "AAAA"])
def test_base64_behind_other_characters(before):
    got = layers_of(f"é {before}{b64(SECRET)} z")
    assert [g[0] for g in got] == ["assign+base64"]


def test_shortest_finding_in_base64():
    assert spans(b64(b"token=12345678")) == "assign+base64:0:20"


@pytest.mark.parametrize("line", ["\n", "\r\n", "\n    "])
def test_wrapped_base64(line):
    wrapped = lambda data: base64.encodebytes(data).decode().rstrip("\n").replace("\n", line)
    padded = b"lorem ipsum dolor sit amet " * 7 + SECRET + b" x" * 60
    assert [g[0] for g in layers_of("x\n" + wrapped(padded))] == ["assign+base64"]
    text = "x\n" + wrapped(gzip.compress(bytes(range(256)) * 3 + SECRET)) + " y"
    assert [(g[0], text[int(g[1]) : int(g[2])]) for g in layers_of(text)] == [("assign+base64+gzip", text[2:-2])]


def test_streams_anywhere_and_all_members():
    assert [g[0] for g in layers_of(b64(gzip.compress(b"hello") + gzip.compress(SECRET)))] == ["assign+base64+gzip"]
    assert [g[0] for g in layers_of("data=" + urllib.parse.quote(gzip.compress(SECRET)))] == ["assign+url+gzip"]
    many = b64(b"data:" + zlib.compress(SECRET) + b"tail" + bz2.compress(SECRET) + lzma.compress(SECRET) + SECRET)
    assert {g[0] for g in layers_of(many)} == {"assign+base64+zlib", "assign+base64+bzip2", "assign+base64+xz", "assign+base64"}
    cut = b64(gzip.compress(SECRET * 50 + random.Random(1).randbytes(500))[:300])
    assert [g[0] for g in layers_of(cut)] == ["assign+base64+gzip"]  # broken streams are read as far as they go


@pytest.mark.parametrize("noise", [" 　", "\x1b\x00", "﻿", b"\xff\xfe"])
def test_layers_need_not_be_readable(noise):
    noise = noise if isinstance(noise, bytes) else noise.encode()
    assert [g[0] for g in layers_of(b64(noise + SECRET + noise))] == ["assign+base64"]


def test_chains_of_escapes_take_linear_time():
    for chain in ("%" + "25" * 200_000 + "41KIAABCDEFGHIJKLMNOP", "\\x5c" + "x5c" * 100_000 + "x41KIAABCDEFGHIJKLMNOP"):
        began = time.time()
        got = layers_of(chain)
        assert time.time() - began < 20 and [(g[0].split("+")[0], *g[1:]) for g in got] == [("access", "0", str(len(chain)))]


def test_a_stream_that_holds_itself_ends():
    inner = SECRET
    for _ in range(60):
        inner = gzip.compress(inner)
    assert layers_of(b64(inner))[0][0] == "assign+base64" + "+gzip" * 60
    assert layers_of("%25" * 50 + b64(b64(SECRET).encode()))[0][0].endswith("+base64+base64")


BOMBS = """
import base64, gzip, resource, sys, bz2
import pyarrow as pa
from tagstream.llm import secrets

def bomb(n):
    parts, block = [], b"\\0" * (1 << 20)
    import zlib
    c = zlib.compressobj(9, zlib.DEFLATED, 31)
    for _ in range(n):
        parts.append(c.compress(block))
    parts.append(c.compress(b'token = "abcdefgh12345678"'))
    return base64.b64encode(b"".join(parts) + c.flush()).decode()

text = " ".join([bomb(40), bomb(41), bomb(42)])
secrets.scan_kernel(pa.array(["token=abcdefgh " + base64.b64encode(gzip.compress(b"password=12345678")).decode()]))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
got = secrets.scan_kernel(pa.array([text]))[4][0].as_py()
print(got.count("assign+base64+gzip"), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_bombs_are_scanned_whole_in_bounded_memory():
    """Three streams of 40 MB and more in one text, the secret behind all of it."""
    found, grown = subprocess.run([sys.executable, "-c", BOMBS], capture_output=True, text=True, check=True).stdout.split()
    assert int(found) == 3 and int(grown) < 200


def test_streams_in_windows(monkeypatch):
    """Windows of a few bytes: the same findings, also in streams that begin in one window and end in another."""
    inner = gzip.compress(random.Random(1).randbytes(3000) + SECRET, 0)
    texts = [b64(gzip.compress(b"\0" * 6000 + SECRET + b"\0" * 700)), b64(gzip.compress(b"z " * 2000 + inner + b" z" * 2000 + bz2.compress(SECRET))), b64(zlib.compress(b"x" * 900 + b64(SECRET).encode() + b" " * 5000 + b"%41KIA" + b"B" * 20))]
    want = [sorted({x.rsplit(":", 2)[0] for x in spans(t).split(",")}) for t in texts]
    monkeypatch.setattr(secrets, "WINDOW", 1500)
    monkeypatch.setattr(secrets, "OVERLAP", 300)
    monkeypatch.setattr(secrets, "STEP", 128)
    assert [sorted({x.rsplit(":", 2)[0] for x in spans(t).split(",")}) for t in texts] == want and all(want)
