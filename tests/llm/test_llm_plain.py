"""Language ID and quality against plain implementations, one text and one token at a time, over the whole table."""

from __future__ import annotations

import collections
import math
import re
import zlib

import pytest

from tagstream.llm import langid, quality

MASK = (1 << 64) - 1


@pytest.fixture(scope="module")
def table(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()


def held_out(i) -> bool:
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def plain_grams(text: str) -> list[int]:
    raw = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode())
    raw = b"  " + re.sub(b" +", b" ", raw) + b"  "
    return [int.from_bytes(raw[i : i + 4], "little") for i in range(len(raw) - 3) if not (raw[i : i + 2] == b"  " and raw[i + 2 : i + 4] == b"  ")]


def plain_slots(gram: int, size: int) -> list[int]:
    shift = 64 - size.bit_length() + 1
    return [((gram * odd & MASK ^ gram << 29 & MASK) * 0xA0761D6478BD642F & MASK) >> shift for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def test_language_id_against_a_plain_one(spark, sf_dir, table):
    counts: dict[str, collections.Counter] = collections.defaultdict(collections.Counter)
    for r in table:
        if r["text"] is not None and r["lang"] is not None and not held_out(r["doc_id"]):
            counts[r["lang"]].update(plain_grams(r["text"]))
    kept = {lang: [g for g, n in c.items() if n >= max(1.0, c.total() * langid.MIN_SHARE)] for lang, c in counts.items()}
    size = 1 << max(10, (max(map(len, kept.values())) * langid.BITS_EACH - 1).bit_length())
    bits = {lang: {s for g in grams for s in plain_slots(g, size)} for lang, grams in kept.items()}
    rate = {lang: (len(b) / size) ** langid.HASHES for lang, b in bits.items()}
    got = {r["doc_id"]: r for r in langid.query(spark, sf_dir).collect()}
    assert len(got) == len(table)
    for r in table:
        grams = plain_grams(r["text"] or "")
        places = [plain_slots(g, size) for g in grams]
        hits = {lang: max(0.0, (sum(all(s in b for s in p) for p in places) - len(grams) * rate[lang]) / (1 - rate[lang])) for lang, b in bits.items()}
        best = min(sorted(hits), key=lambda lang: -hits[lang])
        letters = any(c.isalpha() for c in r["text"] or "")
        want = (best, min(1.0, hits[best] / max(1, len(grams)))) if letters and hits[best] > 0 else (None, 0.0) if letters else ("und", 0.0)
        assert got[r["doc_id"]]["lang_pred"] == want[0] or want[0] is None
        assert got[r["doc_id"]]["score"] == pytest.approx(want[1], abs=1e-9) and got[r["doc_id"]]["held_out"] == held_out(r["doc_id"])


def mix(x: int) -> int:
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def plain_hash(token: bytes) -> int:
    import hashlib

    if len(token) > 64:
        return int.from_bytes(hashlib.blake2b(token, digest_size=8).digest(), "little")
    h = mix(len(token) * 0xD6E8FEB86659FD93 & MASK)
    for i in range(0, len(token), 8):
        h = mix(h ^ int.from_bytes(token[i : i + 8], "little"))
    return h


def plain_features(text: str | None) -> tuple[collections.Counter, int]:
    hashes = [plain_hash(t) for t in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+", (text or "").encode())]
    out = collections.Counter(h >> 64 - quality.BITS for h in hashes)
    out.update(quality.REPEAT if a == b else mix((a * 0x9E3779B97F4A7C15 + b) & MASK) >> 64 - quality.BITS for a, b in zip(hashes, hashes[1:]))
    return out, len(hashes)


def test_quality_against_plain_ftrl(spark, sf_dir, table):
    from pyspark.sql import functions as F

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    turns = {r["doc_id"]: r["turn"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.xxhash64("doc_id").alias("turn")).collect()}
    made = {r["doc_id"]: plain_features(r["text"]) for r in table}
    z, n = collections.Counter(), collections.Counter()

    def weight(i):
        return 0.0 if abs(z[i]) <= quality.L1 else -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    learned = sorted((turns[r["doc_id"]], r["doc_id"]) for r in table if r["text"] is not None and not held_out(r["doc_id"]) and labels.get(r["doc_id"]) is not None)
    for _ in range(quality.EPOCHS):
        for _, i in learned:
            counts, size = made[i]
            x = {**{s: c * quality.SCALE / max(1, size) for s, c in counts.items()}, "intercept": 1.0}
            w = {s: weight(s) for s in x}
            p = 1 / (1 + math.exp(-max(-60, min(60, sum(w[s] * v for s, v in x.items())))))
            for s, v in x.items():
                g = (p - labels[i]) * v
                z[s] += g - (math.sqrt(n[s] + g * g) - math.sqrt(n[s])) / quality.ALPHA * w[s]
                n[s] += g * g
    got = {r["doc_id"]: r["score"] for r in quality.query(spark, sf_dir).collect()}
    for r in table:
        counts, size = made[r["doc_id"]]
        total = weight("intercept") + sum(weight(s) * c for s, c in counts.items()) * quality.SCALE / max(1, size)
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-max(-60, min(60, total)))), abs=1e-3)


def test_quality_of_several_texts_and_bounds(spark):
    """Of several texts for an id the smallest counts; labels without a text do not use up the bound."""
    docs = [(i, "good words here" if i % 2 else "bad *** words !!") for i in range(100)]
    more = docs + [(i, "zzz " + t) for i, t in docs]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1000)], "doc_id long, quality int")
    one, two = (quality.fit(spark.createDataFrame(d, "doc_id long, text string"), labels, max_rows=m) for d, m in ((docs, 1000), (more, 100)))
    assert (one.weights == two.weights).all() and one.intercept == two.intercept and one.weights.any()


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    rows = [(f"l{k}", "some words") for k in range(4)]
    with pytest.raises(ValueError, match="distinct values"):
        langid.train(spark.createDataFrame(rows, "lang string, text string"))
    assert len(langid.train(spark.createDataFrame(rows[:3], "lang string, text string")).languages) == 3
