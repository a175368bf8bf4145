"""Secret scans with a recursive decoding worklist.

Base patterns, in bytes of the UTF-8 text (all their classes are ASCII), leftmost
and non-overlapping for each kind: ``assign`` (a key word, ``:`` or ``=``, a value
of 8 or more characters), ``access`` (``AKIA...``, 16 or more) and ``hex`` (a run
of 32 or more).  Each text is the first item of a worklist.  From an item come new
ones, until none is left:

- the item with its percent escapes replaced, and with its backslash escapes replaced;
- each run of ``MIN_BASE64`` or more base64 characters, and each sequence of such runs
  wrapped over lines, decoded from each of its first four characters on, as a path or
  a word may stand before the encoded part;
- each gzip, zlib, bzip2 or xz stream that begins anywhere in a decoded item, one
  after the other.

All items are scanned, whatever their bytes are.  One whose bytes have been seen at
the same place of the text is not taken up again, so cycles (a stream that unpacks
to itself) end.  Escapes that are still there after ``LEVELS`` rounds are a chain
(``%252525...``) and are resolved to the end in one linear pass.  Each item keeps
the ranges that it came from, so what is found inside is reported where it stands
in the text.

Kinds of findings in a layer carry its path, such as ``access+base64`` or
``assign+base64+gzip``, the shortest of several.  A finding of which no step decoded a part
is left to the layer it came from.  Positions are code points, ends
exclusive; a finding in a stream stands where the stream does.

Memory.  A stream that unpacks to more than ``WINDOW`` bytes is scanned in windows of
that size which share ``OVERLAP`` bytes, so a bomb takes time in proportion to what it
holds, but no more memory than a window does.  A stream inside such a stream is read to
its own end.  Base64 runs there are decoded window by window.

Defined results: null and empty texts have no findings, and the digest of the
empty string.  Texts are read whole.  A broken stream is scanned as far as it can be
read, stands for all behind its start, and others are looked for behind what was read of it; an xz stream that asks for a dictionary
above ``XZ_MEMORY`` counts as broken.  ``redact`` replaces each maximal union of
findings by ``[secret]`` and keeps null.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesops as B
from .frames import append_columns

KINDS = ("assign", "access", "hex")
MIN_BASE64 = 19  # the shortest base finding has 14 bytes
LEVELS = 8
WINDOW, OVERLAP = 4 << 20, 1 << 20
STEP = 1 << 18  # bytes that a decompressor gives at a time
HEADER = 1 << 17  # bytes without content after which a stream counts as broken
FIRST = 1 << 10  # bytes that it is given first
XZ_MEMORY = 128 << 20  # the largest preset asks for 65 MB
MARK = b"[secret]"
OUTPUT = T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX_RUN = re.compile(rb"[0-9a-f]{32,}+")
_SIX = rb"A-Za-z0-9+/_-"
_RUN = re.compile(rb"[%s]{%d,}+={0,2}" % (_SIX, MIN_BASE64))
_WRAP = re.compile(rb"[ \t]*+\r?\n[ \t]*+([%s]++)={0,2}" % _SIX)
_STANDARD = bytes.maketrans(b"-_", b"+/")
_PERCENT_END = re.compile(rb"%([0-9A-Fa-f]{2})\Z")
_ESCAPE = re.compile(rb"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\}")
_ESCAPE_END = re.compile(rb"(?:%s)\Z" % _ESCAPE.pattern)
#: How compressed streams begin.
_STREAMS = ((b"\x1f\x8b\x08", "gzip"), *((b"\x78" + level, "zlib") for level in (b"\x01", b"\x5e", b"\x9c", b"\xda")), (b"BZh", "bzip2"), (b"\xfd7zXZ\x00", "xz"))
_SIGNS = (b"passw", b"secret", b"token", b"api", b"akia", b"%", b"\\", *(sign.lower() for sign, _ in _STREAMS))

_HEX = np.zeros(256, dtype=bool)
_HEX[list(b"0123456789abcdef")] = True
_SIXTY_FOUR = np.zeros(256, dtype=bool)
_SIXTY_FOUR[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_")] = True
_NIBBLE = np.full(256, 255, dtype=np.uint8)
for _k, _c in enumerate(b"0123456789abcdef"):
    _NIBBLE[[_c, ord(chr(_c).upper())]] = _k

Found = list[tuple[int, int, int]]  # kind, start, end in bytes


def runs(member: np.ndarray, least: int) -> np.ndarray:
    """(start, end) of the maximal runs of at least ``least`` members."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], member, [False]]).view(np.int8))).reshape(-1, 2)
    return edges[edges[:, 1] - edges[:, 0] >= least]


def places(data: bytes, word: bytes) -> Iterator[int]:
    at = data.find(word)
    while at >= 0:
        yield at
        at = data.find(word, at + 1)


def base_findings(data: bytes, view: np.ndarray | None = None) -> Found:
    """The base patterns' matches, by start and kind."""
    found: Found = []
    low = data.lower()
    done = 0
    for at in sorted(p for w in _WORDS for p in places(low, w)):
        if at >= done and (m := _ASSIGN.match(data, at)):
            done = m.end()
            if m.end(2) - m.start(2) >= 8:
                found.append((0, at, done))
    done = 0
    for at in places(data, b"AKIA"):
        if at >= done and (m := _ACCESS.match(data, at)):
            done = m.end()
            if done - at >= 16:
                found.append((1, at, done))
    if view is None:
        found += [(2, *m.span()) for m in _HEX_RUN.finditer(data)]
    else:
        found += [(2, int(a), int(b)) for a, b in runs(_HEX[view], 32)]
    return sorted(found, key=lambda f: (f[1], f[0]))


def may_hold(data: bytes) -> bool:
    """Whether there can be a finding or another layer in a layer."""
    low = data.lower()
    return any(sign in low for sign in _SIGNS) or _RUN.search(data) is not None


class Layer:
    """Decoded bytes.  ``source`` gives the range of the parent that a range came from, and whether the last step decoded any of it.

    ``more`` gives what follows the data, where they are a window; streams that begin before ``until`` have been dealt with.
    """

    __slots__ = ("data", "path", "parent", "source", "more", "until")

    def __init__(self, data: bytes, path: str = "", parent: Layer | None = None, source: Callable[[int, int], tuple[int, int, bool]] | None = None, more: Callable[[], Iterator[bytes]] | None = None, until: int = 0) -> None:
        self.data, self.path, self.parent, self.source, self.more, self.until = data, path, parent, source, more, until

    def outward(self, a: int, b: int) -> tuple[int, int] | None:
        """The range of the first layer that a range came from; None if no step decoded any of it."""
        layer, decoded = self, False
        while layer.parent is not None:
            a, b, here = layer.source(a, b)
            layer, decoded = layer.parent, decoded or here
        return (a, b) if decoded or self.parent is None else None


class Unpacked:
    """What a compressed stream holds, in blocks; afterwards how many bytes of the input it took, and whether it ended well."""

    def __init__(self, name: str, source: Iterator[bytes]) -> None:
        self.name, self.source, self.taken, self.ended, self.broken = name, source, 0, False, False
        self.good = 0  # bytes of the pieces that were read to their end

    def __iter__(self) -> Iterator[bytes]:
        try:
            if self.name in ("gzip", "zlib"):
                yield from self.deflated(zlib.decompressobj(31 if self.name == "gzip" else 15))
            else:
                yield from self.others(bz2.BZ2Decompressor() if self.name == "bzip2" else lzma.LZMADecompressor(memlimit=XZ_MEMORY))
        except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, MemoryError):
            self.broken = True

    def pieces(self) -> Iterator[bytes]:
        for block in self.source:
            for at in range(0, len(block), STEP):
                piece = block[at : at + STEP]
                self.good = self.taken
                self.taken += len(piece)
                yield piece

    def deflated(self, d) -> Iterator[bytes]:
        begun = False
        for piece in self.pieces():
            if not begun and self.good > HEADER:
                raise ValueError("a header without an end")
            while piece and not d.eof:
                if out := d.decompress(piece, STEP):
                    begun = True
                    yield out
                piece = d.unconsumed_tail
            while not d.eof and (out := d.decompress(b"", STEP)):
                yield out
            if d.eof:
                self.taken, self.ended = self.taken - len(d.unused_data), True
                return

    def others(self, d) -> Iterator[bytes]:
        for piece in self.pieces():
            out = d.decompress(piece, STEP)
            while True:
                if out:
                    yield out
                if d.eof or d.needs_input:
                    break
                out = d.decompress(b"", STEP)
            if d.eof:
                self.taken, self.ended = self.taken - len(d.unused_data), True
                return


def replaced(layer: Layer, at: np.ndarray, ends: np.ndarray, sizes: np.ndarray, values: np.ndarray, path: str) -> Layer:
    """A layer with ranges replaced by values (their bytes one after the other, their sizes)."""
    view = np.frombuffer(layer.data, np.uint8)
    gone = ends - at
    out_at = at - (np.cumsum(gone) - gone) + (np.cumsum(sizes) - sizes)
    keep = np.ones(len(view), bool)
    keep[np.repeat(at - (np.cumsum(gone) - gone), gone) + np.arange(int(gone.sum()))] = False
    own = np.ones(len(view) - int(gone.sum()) + int(sizes.sum()), bool)
    own[np.repeat(out_at - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))] = False
    out = np.empty(len(own), np.uint8)
    out[own], out[~own] = view[keep], values

    def source(a: int, b: int) -> tuple[int, int, bool]:
        first, last = (int(np.searchsorted(out_at, x, side="right")) - 1 for x in (a, b - 1))
        into = first >= 0 and a < out_at[first] + sizes[first]
        start = at[first] if into else a if first < 0 else ends[first] + a - out_at[first] - sizes[first]
        end = b if last < 0 else ends[last] if b - 1 < out_at[last] + sizes[last] else ends[last] + b - out_at[last] - sizes[last]
        return int(start), int(end), into or first < last

    return Layer(out.tobytes(), path, layer, source)


def settled(layer: Layer, ending: re.Pattern, value: Callable[[re.Match], bytes], path: str) -> Layer:
    """A layer with all escapes resolved, and those that come about by it, from left to right on a stack."""
    out, low, high, made = bytearray(), array("q"), array("q"), bytearray()
    closes = frozenset(b"0123456789abcdefABCDEF}")
    for i, c in enumerate(layer.data):
        out.append(c)
        low.append(i)
        high.append(i + 1)
        made.append(0)
        while out and out[-1] in closes and (m := ending.search(out, max(0, len(out) - 10))):
            at, got = m.start(), value(m)
            a, b = low[at], high[-1]
            del m, out[at:], low[at:], high[at:], made[at:]
            out += got
            low.extend([a] * len(got))
            high.extend([b] * len(got))
            made += b"\1" * len(got)
    return Layer(bytes(out), path, layer, lambda a, b: (low[a], high[b - 1], any(made[a:b])))


def escaped(m: re.Match) -> bytes:
    if m[3]:
        return bytes([int(m[3], 16)])
    code = int(m[1] or m[2] or m[4], 16)
    return chr(code).encode("utf-8", "replace") if code < 0x110000 else b"?"


def deep(path: str, step: str) -> bool:
    return path.endswith(step * LEVELS)


def percent_layer(layer: Layer) -> Layer | None:
    if b"%" not in layer.data:
        return None
    view = np.frombuffer(layer.data, np.uint8)
    at = np.flatnonzero(view[:-2] == 37)
    high, low = _NIBBLE[view[at + 1]], _NIBBLE[view[at + 2]]
    good = (high < 16) & (low < 16)
    if not good.any():
        return None
    if deep(layer.path, "+url"):
        return settled(layer, _PERCENT_END, lambda m: bytes([int(m[1], 16)]), layer.path + "+url")
    at = at[good]
    return replaced(layer, at, at + 3, np.ones(len(at), np.int64), high[good] << 4 | low[good], layer.path + "+url")


def escape_layer(layer: Layer) -> Layer | None:
    if b"\\" not in layer.data:
        return None
    at, ends, sizes, values = array("q"), array("q"), array("q"), bytearray()
    for m in _ESCAPE.finditer(layer.data):
        got = escaped(m)
        at.append(m.start())
        ends.append(m.end())
        sizes.append(len(got))
        values += got
    if not at:
        return None
    if deep(layer.path, "+unicode"):
        return settled(layer, _ESCAPE_END, escaped, layer.path + "+unicode")
    return replaced(layer, *(np.array(x, np.int64) for x in (at, ends, sizes)), np.frombuffer(bytes(values), np.uint8), layer.path + "+unicode")


def encoded_runs(layer: Layer) -> Iterator[tuple[int, bytes, np.ndarray | None]]:
    """Start, characters and, for sequences wrapped over lines, places of all runs that may be base64."""
    data, end, open_ = layer.data, -1, []

    def sequence(pieces: list[tuple[int, int]]) -> tuple[int, bytes, np.ndarray]:
        places = np.concatenate([np.arange(a, b) for a, b in pieces])
        return pieces[0][0], b"".join(data[a:b] for a, b in pieces), places

    for m in _RUN.finditer(data):
        a, b = m.span()
        if layer.parent is None or layer.source(a, b)[2]:  # else the layer around it has the same run
            yield a, m[0], None
        if a != end:  # it does not go on from the line before
            if len(open_) > 1:
                yield sequence(open_)
            open_ = []
        open_.append((a, b))
        on = _WRAP.match(data, b) if data[b - 1] != 61 else None  # behind padding nothing goes on
        end = on.start(1) if on else -1
        if on and on.end(1) - end < MIN_BASE64:  # a short last line
            yield sequence([*open_, (end, on.end())])
            open_, end = [], -1
    if len(open_) > 1:
        yield sequence(open_)


def base64_layers(layer: Layer) -> Iterator[Layer]:
    """Each run, and each wrapped sequence of runs, decoded from its first four characters on."""
    for first, run, places in encoded_runs(layer):
        body = run.rstrip(b"=").translate(_STANDARD)
        coded = [body[skip : len(body) - ((len(body) - skip) % 4 == 1)] for skip in range(4)]
        decoded = [binascii.a2b_base64(c + b"=" * (-len(c) % 4)) for c in coded]
        if not may_hold(b"\0".join(decoded)):
            continue
        for skip, got in enumerate(decoded):

            def source(i: int, j: int, first: int = first, n: int = len(run), skip: int = skip, places: np.ndarray | None = places) -> tuple[int, int, bool]:
                x, y = skip + i // 3 * 4, min(skip + (j - 1) // 3 * 4 + 3, n - 1)
                return (first + x, first + y + 1, True) if places is None else (int(places[x]), int(places[y]) + 1, True)

            yield Layer(got, layer.path + "+base64", layer, source)


def stream_starts(layer: Layer) -> Iterator[tuple[int, str]]:
    """Where streams may begin, from ``until`` on, which may move meanwhile."""
    ahead = {sign: -1 for sign, _ in _STREAMS}
    while True:
        for sign, at in ahead.items():
            if 0 <= at < layer.until or at == -1:
                found = layer.data.find(sign, layer.until)
                ahead[sign] = len(layer.data) if found < 0 else found
        at, name = min((ahead[sign], name) for sign, name in _STREAMS)
        if at >= len(layer.data):
            return
        yield at, name


def stream_at(layer: Layer, start: int, name: str) -> Unpacked:
    """The compressed stream that begins at a place; where the data are a window, it is read on behind it."""
    near = start + FIRST  # most that look like a stream are none, and fail on their first bytes
    rest = (layer.data[at : at + STEP] for at in range(near, len(layer.data), STEP))
    return Unpacked(name, chain([layer.data[start:near]], rest, layer.more() if layer.more else ()))


def explore(root: Layer, around: tuple[bytes, ...] = ()) -> set[tuple[int, int, int, str]]:
    """(kind, start, end, path) of what the layers inside ``root`` hold, in its own positions; ``around``: digests of the streams it is a window of."""
    found: set[tuple[int, int, int, str]] = set()
    seen, told = {hashlib.sha256(root.data).digest()}, set()

    def within(layer: Layer) -> Iterator[Layer]:
        for make in (percent_layer, escape_layer):
            if (made := make(layer)) is not None:
                yield made
        yield from base64_layers(layer)
        if layer.parent is not None or layer.more is not None or around:  # a text itself is no stream
            yield from unpacked(layer)

    def unpacked(layer: Layer) -> Iterator[Layer]:
        for start, name in stream_starts(layer):
            stream = stream_at(layer, start, name)
            blocks, held, size = iter(stream), [], 0
            for block in blocks:
                held.append(block)
                size += len(block)
                if size >= WINDOW:
                    break
            window = b"".join(held)
            del held
            if len(window) >= WINDOW:
                kinds = windows(layer, start, name, blocks, window)
            else:
                kinds = set()
            end = start + stream.taken if stream.ended or layer.more else len(layer.data)
            to = min(end, len(layer.data))
            if kinds:
                place = layer.outward(start, to) if layer.parent is not None else (start, to)
                if place is not None:
                    found.update((kind, *place, f"{layer.path}+{stream.name}{path}") for kind, path in kinds)
            elif 0 < len(window) < WINDOW:
                yield Layer(window, f"{layer.path}+{stream.name}", layer, lambda a, b, s=start, e=to: (s, e, True))
            layer.until = end if window and not stream.broken else start + max(1, stream.good if window else 0)

    def windows(layer: Layer, start: int, name: str, blocks: Iterator[bytes], window: bytes) -> set[tuple[int, str]]:
        """Kinds and paths of what a stream of more than one window holds."""
        key = hashlib.sha256(window).digest()
        kinds: set[tuple[int, str]] = set()
        if key in around:  # it holds itself
            return kinds
        base = until = 0
        while True:
            block = next(blocks, None)

            def more(seen: int = base + len(window)) -> Iterator[bytes]:
                for part in stream_at(layer, start, name):
                    if seen < len(part):
                        yield part[seen:]
                    seen = max(0, seen - len(part))

            here = Layer(window, more=None if block is None else more, until=max(0, until - base))
            kinds.update((kind, "") for kind, _, _ in base_findings(window))
            kinds.update((kind, path) for kind, _, _, path in explore(here, (*around, key)))
            if block is None:
                return kinds
            until, base = base + here.until, base + len(window) - OVERLAP
            held, size = [window[-OVERLAP:], block], OVERLAP + len(block)
            del here, window
            while size < WINDOW and (block := next(blocks, None)) is not None:
                held.append(block)
                size += len(block)
            window = b"".join(held)
            del held

    stack = [within(root)]
    while stack:
        layer = next(stack[-1], None)
        if layer is None:
            stack.pop()
            continue
        place = layer.outward(0, len(layer.data)) if layer.data else None
        key = hashlib.sha256(layer.data + b"\0%d:%d" % (place or (-1, -1))).digest()
        if place is None or key in seen or not may_hold(layer.data):
            continue
        seen.add(key)
        for kind, a, b in base_findings(layer.data):
            if around and (kind, layer.path) in told:  # one is enough: all stand where the stream does
                continue
            if (where := layer.outward(a, b)) is not None:
                found.add((kind, *where, layer.path))
                told.add((kind, layer.path))
        stack.append(within(layer))
    return found


def layer_findings(data: bytes) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, path) of what the decoded layers of a text hold, in bytes of the text; of several paths to a finding the shortest."""
    least: dict[tuple[int, int, int], str] = {}
    for kind, a, b, path in explore(Layer(data)):
        held = least.get((kind, a, b))
        if held is None or (path.count("+"), path) < (held.count("+"), held):
            least[kind, a, b] = path
    return sorted(((*k, path) for k, path in least.items()), key=lambda f: (f[1], f[0], f[2], f[3]))


def scan_rows(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, Found, list[tuple[int, int, int, str]]]]:
    """(row, base findings, findings in layers) of the rows that have any, in bytes."""
    for first, end, data, off in B.chunks(raw, offsets):
        joined = np.zeros(len(data) + end - first, np.uint8)  # a zero byte, which no pattern crosses, behind each row
        joined[np.arange(len(data)) + np.repeat(np.arange(end - first), np.diff(off))] = data
        whole = joined.tobytes()
        starts = off[:-1] + np.arange(end - first)
        base: dict[int, Found] = {}
        for kind, a, b in base_findings(whole, joined):
            row = int(np.searchsorted(starts, a, side="right")) - 1
            base.setdefault(row, []).append((kind, a - int(starts[row]), b - int(starts[row])))
        hints = [runs(_SIXTY_FOUR[joined], MIN_BASE64)[:, 0], np.flatnonzero(joined == 92)]
        percent = np.flatnonzero(joined[:-2] == 37) if len(joined) > 2 else np.zeros(0, np.int64)
        letter = (joined | 32) - 97 < 6
        hexes = letter | (joined - 48 < 10)
        hints.append(percent[hexes[percent + 1] & hexes[percent + 2]])
        rows = set(np.unique(np.searchsorted(starts, np.concatenate(hints), side="right") - 1).tolist())
        for row in sorted(rows | base.keys()):
            more = layer_findings(data[off[row] : off[row + 1]].tobytes()) if row in rows else []
            if more or row in base:
                yield first + row, base.get(row, []), more


def named(kind: int, path: str) -> str:
    return KINDS[kind] + path


def in_points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def points(at: np.ndarray, data: np.ndarray, a: int, b: int) -> tuple[int, int]:
    """A byte span in code points; an end inside a code point takes in the whole of it."""
    return int(at[a]) - (a < len(data) and (data[a] & 0xC0) == 0x80), int(at[b])


def scan_kernel(text: pa.Array) -> list[pa.Array]:
    raw, offsets = B.string_buffers(text)
    n = len(offsets) - 1
    counts, empty = np.zeros((3, n), np.int64), hashlib.sha256(b"").hexdigest()
    digest, spans = [empty] * n, [""] * n
    for row, base, more in scan_rows(raw, offsets):
        data = raw[offsets[row] : offsets[row + 1]]
        at = in_points(data)
        plain = [(k, *points(at, data, a, b)) for k, a, b in base]
        for k, _, _ in plain:
            counts[k, row] += 1
        digest[row] = hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in plain).encode()).hexdigest()
        every = [(a, k, "", b) for k, a, b in plain] + [(s, k, path, e) for k, a, b, path in more for s, e in [points(at, data, a, b)]]
        spans[row] = ",".join(f"{named(k, path)}:{a}:{b}" for a, k, path, b in sorted(set(every)))
    return [*map(pa.array, counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())]


def redact_kernel(text: pa.Array) -> list[pa.Array]:
    raw, offsets = B.string_buffers(text)
    changed: dict[int, str] = {}
    for row, base, more in scan_rows(raw, offsets):
        data = raw[offsets[row] : offsets[row + 1]]
        inside = np.zeros(len(data) + 1, bool)
        for _, a, b, *_ in [*base, *more]:
            while a > 0 and data[a] & 0xC0 == 0x80:
                a -= 1
            inside[a:b] = True
        pieces, done, whole = [], 0, data.tobytes()
        for a, b in runs(inside[:-1], 1):
            pieces += [whole[done:a], MARK]
            done = b
        changed[row] = b"".join([*pieces, whole[done:]]).decode("utf-8", "replace")
    if not changed:
        return [text]
    values = text.to_pylist()
    for row, value in changed.items():
        values[row] = value
    return [pa.array(values, pa.string())]


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with counts of base findings, their digest, and all findings."""
    return append_columns(docs, [text_col], OUTPUT, lambda: scan_kernel)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every finding, in the text or in a layer of it, replaced in the text; column order is kept."""
    out = append_columns(docs, [text_col], T.StructType([T.StructField(text_col, T.StringType())]), lambda: redact_kernel)
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs.select("doc_id", F.col("text"))).select("doc_id", *OUTPUT.names)
