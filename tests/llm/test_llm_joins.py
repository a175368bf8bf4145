"""Top-k, n-gram join, audio, mixing, pieces and the pipeline against brute force."""

from __future__ import annotations

import collections
import io
import random
import re
import wave

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tagstream.llm import audio, mixing, ngramjoin, pieces, queries, topk


def sets_of(rows, words):
    out = collections.defaultdict(list)
    for i, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = [x for x in re.split("[\x20\x09-\x0d]+", low) if x]
        out[i].append(frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset())
    return out


def brute_classes(rows, words, percent):
    sets = sets_of(rows, words)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def family(rng, base, size, edits):
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
        yield " ".join(copy)


def corpus(seed):
    rng = random.Random(seed)
    line = "all rights reserved by the owner of this very common line"
    texts = [" ".join(f"w{rng.randrange(4000)}" for _ in range(rng.randint(1, 60))) + (" " + line if rng.random() < 0.4 else "") for _ in range(60)]
    for edits in (1, 3, 6):
        texts += family(rng, [f"w{rng.randrange(4000)}" for _ in range(80)], 40, edits)
    texts += [texts[0]] * 20 + ["", "   ", "one", "ONE", "one two", line, line.upper()]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("words,percent,small,block,hot", [(4, 85, 128, 512, 1 << 16), (5, 80, 6, 7, 3), (2, 60, 4, 5, 0)])
def test_ngram_join_against_brute_force(spark, monkeypatch, words, percent, small, block, hot):
    monkeypatch.setattr(ngramjoin, "HOT", hot)
    monkeypatch.setattr(ngramjoin, "SIFTED", hot)
    monkeypatch.setattr(ngramjoin, "SMALL", small)
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    rows = corpus(words)
    got = ngramjoin.classes(spark.createDataFrame(rows, "doc_id long, text string"), words, percent).collect()
    want, sets = brute_classes(rows, words, percent), sets_of(rows, words)
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == want[r["doc_id"]] and r["n_shingles"] == len(sets[r["doc_id"]][0])


@pytest.mark.parametrize("small", [1, 2])
def test_ngram_join_pairs_whose_own_first_large_shingles_differ(spark, monkeypatch, small):
    """x and y link; each also shares shingles with texts of its own, and what they have in common is headed by other texts."""
    monkeypatch.setattr(ngramjoin, "SMALL", small)
    monkeypatch.setattr(ngramjoin, "BLOCK", 2)
    rows = []
    for k in range(12):
        part = lambda name, n: [f"{name}{k}w{i}" for i in range(n)]
        base, one, two = part("base", 70), part("one", 5), part("two", 5)
        texts = [w[i : i + 4] for w in (base, one, two) for i in range(len(w) - 3)] + [base + one, base + two]
        rows += [(100 * k + i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["component_id"] for r in ngramjoin.classes(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    want = brute_classes(rows, 4, 85)
    assert got == want and all(want[100 * k + 72] == 100 * k + 71 for k in range(12))


def test_ngram_join_tells_regular_patterns_apart(spark):
    """A polynomial hash modulo a power of two gives the two Thue-Morse words one value."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [word, other, f"u v w x {word}", f"u v w x {other}"]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngramjoin.classes(docs, 4, 85).collect()} == {k: k for k in range(4)}
    data = np.frombuffer(f"{word} {other} {word} {word[:64]} {other[:64]} {word[:64]}".encode(), np.uint8)
    starts, ends, _ = ngramjoin.B.word_spans(data > 32, np.array([0, len(data)]))
    h = ngramjoin.B.span_hashes(data, starts, ends).tolist()
    assert h[0] == h[2] and h[3] == h[5] and len(set(h)) == 4


def test_ngram_join_leaves_only_its_result_behind(spark):
    from tagstream.llm.frames import Scratch

    scratch = Scratch(spark, "test")
    docs = spark.createDataFrame([(k, f"a b c d e f {k % 3}") for k in range(9)], "doc_id long, text string")
    out = ngramjoin.classes(docs, 4, 85, scratch=scratch)
    assert sum(table is not None for table, _ in scratch.paths.values()) == 1 and out.count() == 9


def test_ngram_join_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b c d e f", "x"), (3, "a b c d e f", "x"), (4, "A b c d e F", "x"), (4, "A b c d e F", "x"), (5, "other words stand here now", "x"), (5, "a b c d e f", "x"), (6, "long " * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngramjoin.classes(docs, 4, 85).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (None, 3, None), (3, 3, 3), (4, 3, 3), (4, 3, 3), (5, 2, 3), (5, 3, 3), (6, 1, 6)], key=str)
    kept = ngramjoin.keep_first(docs, 4, 85)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, None, 3, 6], key=str) and kept.columns == docs.columns
    assert ngramjoin.classes(docs.limit(0)).count() == 0


def test_components_of_long_chains(spark):
    edges = [(i + 1, i) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    scratch = ngramjoin.Scratch(spark, "test")
    got = {r["id"]: r["c"] for r in ngramjoin.components(spark.createDataFrame(edges, "x long, y long"), scratch).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_topk_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = con.sql(topk.SQL).fetchall()
    got = queries.QUERIES["op1_topk_search"](spark, sf_dir).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want) and want


@pytest.mark.parametrize("block,ask,group", [(64, 4096, 3), (100_000, 7, 4096)])
def test_topk_with_ties_edges_and_blocks(spark, monkeypatch, block, ask, group):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", ask)
    monkeypatch.setattr(topk, "GROUP", group)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in (centres[i % 6] + 0.05 * rng.normal(size=8) if i % 3 else centres[i % 6])]) for i in range(400)]
    odd = [(400, None), (450, [None] * 8), (500, [float("nan")] * 8), (550, [1.0, 2.0]), (551, [1.0, 3.0]), (None, [0.0] * 8), (600, []), (650, [float("inf")] + [0.0] * 7)]
    got = topk.top(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 50 == 0).collect()
    whole = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows + odd[3:5]}
    want = []
    for q in (i for i in whole if i % 50 == 0):
        near = sorted((-int(v @ whole[q]), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:5]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(near, 1)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)


def plain_top(queries, data, ids, names, k=5):
    out = []
    for q, name in zip(queries.astype(int).astype(object), names):
        scores = sorted((-sum(x * y for x, y in zip(q, p)), i) for p, i in zip(data.astype(int).astype(object), ids) if i != name)
        out.append([(-s, int(i)) for s, i in scores[:k]])
    return out


def found_by_tree(queries, data, ids, names):
    best = topk.Best(names, 5)
    for lo in range(0, len(data), 300):
        topk.search(best, np.arange(len(queries)), queries, data[lo : lo + 300], ids[lo : lo + 300])
    return [[(int(s), int(i)) for s, i in zip(a, b) if s > topk.LEAST] for a, b in zip(best.score, best.found)], best


@pytest.mark.parametrize("kind", ["clusters", "random", "line", "equal", "few values", "large"])
def test_topk_trees_against_every_pair(monkeypatch, kind):
    """Small leaves, so that trees are deep; whatever is pruned, the result is that of all pairs."""
    for name, value in (("FEW", 50), ("LEAF", 2), ("FAN", 4), ("PAYS", 0.01), ("COLUMNS", 16)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 6))
    made = {
        "clusters": lambda n: centres[rng.integers(0, 12, n)] + 0.01 * rng.normal(size=(n, 6)),
        "random": lambda n: rng.normal(size=(n, 6)),
        "line": lambda n: np.outer(rng.normal(size=n), np.ones(6)),
        "equal": lambda n: np.ones((n, 6)),
        "few values": lambda n: rng.integers(-1, 2, (n, 6)) / 256,
        "large": lambda n: 1e6 * rng.normal(size=(n, 6)),
    }[kind]
    q, p = np.floor(256 * made(60)), np.floor(256 * made(700))
    ids, names = rng.permutation(700), rng.permutation(700)[:60]
    got, best = found_by_tree(q, p, ids, names)
    assert got == plain_top(q, p, ids, names)
    if kind == "clusters":
        assert best.scored < 0.5 * best.asked == 0.5 * 60 * 700


def test_topk_prunes_clusters_and_costs_little_where_it_cannot():
    rng = np.random.default_rng(1)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(n, 64)))
    centres = unit(40)
    near = lambda n: np.floor(256 * (centres[rng.integers(0, 40, n)] + 0.02 * rng.normal(size=(n, 64))))
    best = topk.Best(np.arange(2000) + 10**6, 5)
    topk.search(best, np.arange(2000), near(2000), near(8192), np.arange(8192))
    assert best.scored < 0.1 * best.asked == 0.1 * 2000 * 8192
    best = topk.Best(np.arange(4000) + 10**6, 5)
    topk.search(best, np.arange(4000), np.floor(256 * unit(4000)), np.floor(256 * unit(8192)), np.arange(8192))
    assert best.scored == best.asked and best.measured < 0.05 * best.asked  # one level, then one product
    best = topk.Best(np.arange(40) + 10**6, 5)
    topk.search(best, np.arange(40), np.floor(256 * unit(40)), np.floor(256 * unit(2000)), np.arange(2000))
    assert best.measured == 0  # so small a block is one leaf


def test_topk_of_huge_components(spark):
    rows = [(50 * k, [float(x), float(y)]) for k, (x, y) in enumerate([(2.0**40, 1.0), (2.0**40, 2.0), (-(2.0**40), 3.0), (1e300, 0.0)])]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()}
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    for q in whole:
        scores = sorted((-min(max(sum(a * b for a, b in zip(whole[q], v)), -(2**63) + 1), 2**63 - 1), i) for i, v in whole.items() if i != q)
        assert [got[q, k] for k in (1, 2, 3)] == [(i, -s) for s, i in scores]


def test_topk_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top(empty, F.col("vec_id") % 50 == 0).count() == 0


def wav(samples, rate=audio.RATE):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_audio_of_shifted_noisy_copy_aligns(spark):
    rng = np.random.default_rng(5)
    tunes = [audio.render((rng.normal(size=64) * 0.2).tolist()) for _ in range(6)]
    shifted = np.concatenate([np.zeros(9 * audio.HOP), tunes[0]]) + rng.normal(0, 0.005, len(tunes[0]) + 9 * audio.HOP)
    media = [(20 * i, wav(t)) for i, t in enumerate(tunes)] + [(7, wav(shifted)), (8, wav(tunes[1])), (9, b"not audio"), (10, None), (11, wav(np.zeros(40_000))), (11, wav(np.zeros(40_000)))]
    rows = spark.createDataFrame([(i, bytearray(m) if m is not None else None) for i, m in media], "id long, audio binary")
    prints = audio.fingerprint(rows, "audio")
    out = audio.align(prints.select("id", "codes"), F.col("id") % 20 == 0).collect()
    matches = {(r["id"], r["class_id"]): r for r in out if r["kind"] == "match"}
    members = collections.Counter((r["id"], r["class_id"]) for r in out if r["kind"] == "member")
    assert (0, 7) in matches and abs(matches[0, 7]["offset"] - 9) <= 1 and matches[0, 7]["overlap"] >= audio.MIN_OVERLAP
    assert set(matches) == {(0, 7)}
    assert members[20, 8] == members[8, 8] == 1 and members[11, 11] == 2 and sum(members.values()) == len(media)
    assert audio.align(prints.limit(0).select("id", "codes"), F.col("id") % 20 == 0).count() == 0


def test_audio_recall_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    rng = np.random.default_rng(1)
    vectors = [(r["vec_id"], np.array(r["embedding"])) for r in rows[:300]]
    vectors += [(10_000 + i, v + rng.normal(0, 0.01, 64)) for i, v in vectors[::20]]
    ids, made = np.array([i for i, _ in vectors]), audio.codes_of([audio.render(v.tolist()) for _, v in vectors])
    picture = np.stack(made).view(np.uint32)
    n, truth = picture.shape[1], set()
    asked = np.flatnonzero(ids % 20 == 0)
    for q in asked:
        for o in range(audio.MIN_OVERLAP - n, n - audio.MIN_OVERLAP + 1):
            a, b = max(0, -o), min(n, n - o)
            wrong = np.bitwise_count(picture[q][None, a:b] ^ picture[:, a + o : b + o]).sum(axis=1)
            truth |= {(ids[q], ids[j]) for j in np.flatnonzero(wrong <= audio.MAX_ERROR * 32 * (b - a)) if j != q}
    bounds = np.arange(len(made) + 1) * n
    index = audio.Index(ids[asked], np.concatenate([made[q] for q in asked]), np.arange(len(asked) + 1) * n)
    found = {(q, i) for got in index.matches(ids, np.concatenate(made), bounds) for q, i in zip(got[0], got[1])}
    assert found <= truth and len(truth) >= 10 and len(found) >= 0.9 * len(truth)


def test_audio_of_odd_files():
    tone = np.sin(np.arange(60_000) * 0.3)
    for rate in (0, 1, 999, 2**31 - 1):
        assert audio.decode_wav(wav(tone, 8000)[:24] + rate.to_bytes(4, "little") + wav(tone, 8000)[28:]) is None
    whole = wav(tone, 8000)
    assert all(audio.decode_wav(whole[:n]) is None or len(audio.decode_wav(whole[:n])) <= n for n in range(0, 200, 7))
    made = audio.codes_of([audio.decode_wav(whole), None, np.zeros(5), np.interp(np.arange(0, 60_000, 8000 / audio.RATE), np.arange(60_000), tone)])
    assert len(made[0]) == len(made[3]) > 0 == len(made[1]) == len(made[2])


@pytest.mark.parametrize("rate", [4000, 5512, 8000, 44100])
def test_audio_is_resampled_alike_in_blocks_and_at_once(monkeypatch, rate):
    data = wav(np.sin(np.arange(20_000) * 0.11), rate)
    monkeypatch.setattr(audio, "DECODE", 1 << 30)
    once = audio.decode_wav(data)
    monkeypatch.setattr(audio, "DECODE", 777)
    assert len(once) == int(np.ceil(20_000 * audio.RATE / rate)) or abs(len(once) - 20_000 * audio.RATE / rate) <= audio.RATE / rate + 1
    assert audio.decode_wav(data) == pytest.approx(once, abs=1e-6)


def test_mixing_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = mixing.query(spark, sf_dir).select("doc_id", "copy", "source", "lang", "text").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(mixing.sql()).fetchall()) and got


def test_mixing_reaches_its_weights(spark):
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 30 == 1, "rare").when(F.col("id") % 30 == 2, F.lit(None)).otherwise("x").alias("source"), F.lit(1).alias("_turn"), F.lit(2).alias("COPY"))
    out = mixing.mix(rows, {"hot": 0.1, "rare": 0.4, "absent": 0.1})
    assert out.columns == ["doc_id", "source", "_turn", "copy"]
    counts = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    total = 30_000
    assert counts["hot"] == pytest.approx(0.1 * total, rel=0.1) and counts["rare"] == pytest.approx(0.4 * total, rel=0.1)
    assert counts["x"] + counts[None] == pytest.approx(0.4 * total, rel=0.1)
    copies = out.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("m")).where("n <> m + 1")
    assert copies.count() == 0
    again = mixing.mix(rows.repartition(7), {"hot": 0.1, "rare": 0.4, "absent": 0.1})
    assert again.exceptAll(out).count() == 0 == out.exceptAll(again).count()
    assert "Python" not in out._jdf.queryExecution().toString()
    order = [r["doc_id"] for r in out.collect()]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.05


def test_mixing_edges(spark):
    rows = spark.createDataFrame([(1, "a", None), (1, "a", None), (None, "b", "s")], "doc_id long, text string, source string")
    out = mixing.mix(rows, {"s": 0.5}, size=300).collect()
    counts = collections.Counter((r["doc_id"], r["copy"]) for r in out)
    assert set(counts.values()) <= {1, 2} and {r["doc_id"] for r in out} == {1, None}
    assert mixing.mix(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(rows, {"s": 1.5})


@pytest.mark.parametrize("key,text", [("null", "id"), ("7", "id"), ("id % 10", "id"), ("7", "0"), ("null", "0")])
def test_mixing_of_null_and_repeated_keys(spark, key, text):
    """Rows without a key of their own reach the target like others and are spread, even if they are equal."""
    rows = spark.range(0, 20_000, 1, 8).selectExpr("CASE WHEN id % 2 = 0 THEN id ELSE CAST(" + key + " AS LONG) END AS doc_id", f"CAST({text} AS STRING) AS text", "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS source")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    out = mixing.mix(rows, {"b": 0.3})
    made = out.withColumn("part", F.spark_partition_id()).where("source = 'b'").groupBy("part").count().collect()
    total = sum(r["count"] for r in made)
    assert total == pytest.approx(6000, rel=0.06)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in made) < 0.5 * total
    again = mixing.mix(rows, {"b": 0.3})
    assert again.exceptAll(out).count() == 0 == out.exceptAll(again).count()
    assert "Python" not in out._jdf.queryExecution().toString()


TEXTS = ["Hello  world  \n▁x", "", None, "é漢字😀\x00\t a", "   ", "x" * 3000, "naïve tokenisation of unbelievable 123 words\r\n", "́​…"]


def test_pieces_are_lossless_reproducible_and_the_librarys(spark):
    import sentencepiece

    rows = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(TEXTS)] + [(None, "a b", "kept")], "doc_id long, text string, _row_key string")
    one = pieces.encode(rows)
    got = {r["doc_id"]: r for r in one.collect()}
    other = {r["doc_id"]: r for r in pieces.encode(rows.repartition(5)).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for i, text in enumerate(TEXTS):
        assert got[i]["lossless"] and got[i]["ids"] == other[i]["ids"] and got[i]["n_tokens"] == len(got[i]["ids"]) and got[i]["_row_key"] == "kept"
        assert model.decode(got[i]["ids"]) == (text or "")
    back = {r["doc_id"]: r["decoded"] for r in pieces.decode(one).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))
    assert pieces.encode(rows.limit(0)).count() == 0


def test_sampling_follows_the_path_weights():
    """Drawn segmentations of one word against the exact distribution over all its paths."""
    vocabulary = pieces.Vocabulary([b" ", b"a", b"b", b"ab", b" a", b" ab", *[None] * 256], np.arange(6, 262).astype(np.int32))
    lattice = pieces.Lattice(vocabulary, alpha=1.0, seed=9)
    text, usable = b" abab", {p: 1 / (r + 2.7) for r, p in enumerate(vocabulary.pieces[:6])}

    def paths(at):
        if at == len(text):
            yield (), 1.0
        for p, w in usable.items():
            if text.startswith(p, at):
                for rest, v in paths(at + len(p)):
                    yield (p, *rest), w * v

    every = dict(paths(0))
    total = sum(every.values())
    n = 20_000
    data = np.frombuffer(text[1:] * n, np.uint8)
    ids, at = lattice.encode(data, np.arange(n + 1) * 4, np.arange(n))
    drawn = collections.Counter(tuple(vocabulary.pieces[i] for i in ids[a:b]) for a, b in zip(at, at[1:]))
    assert set(drawn) <= set(every)
    for path, w in every.items():
        assert drawn[path] / n == pytest.approx(w / total, abs=0.015)


def test_long_units_in_logarithms_give_the_same_paths(monkeypatch):
    data = np.frombuffer(("abcdefgh" * 5).encode(), np.uint8)
    vocabulary = pieces.Vocabulary.read()
    drawn = []
    for limit in (48, 0):
        monkeypatch.setattr(pieces, "LINEAR", limit)
        drawn.append(pieces.Lattice(vocabulary).encode(data, np.array([0, 40]), np.array([3]))[0].tolist())
    assert drawn[0] == drawn[1]


def test_pipeline_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept, at = docs, []
    for name, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.Scratch(spark, "t").keep(stage(spark, kept, sf_dir))
        at.append(kept)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "secret_scan", "source_mixing", "sentencepiece"]
    assert all(f.columns == docs.columns for f in at[:4])
    first = {r["doc_id"] for r in at[0].collect()}
    assert {i for i, r in rows.items() if any(c.isalpha() for c in r["text"])} == first
    classes = brute_classes([(i, rows[i]["text"]) for i in sorted(first)], 5, 80)
    second = {r["doc_id"] for r in at[1].collect()}
    assert second == {i for i, c in classes.items() if i == c}
    third = {r["doc_id"]: r for r in at[2].collect()}
    assert set(third) == second and all(r["n_chars"] == len(r["text"]) for r in third.values())
    assert not any(re.search(r"AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}", r["text"]) for r in third.values())
    assert {r["doc_id"] for r in at[3].collect()} <= second
    last = at[4].collect()
    assert len(last) == at[3].count() and all(r["lossless"] for r in last)
    assert corpus_pipeline.run(spark, sf_dir).count() == len(last)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, Copy string, _gone long"


def test_pipeline_of_odd_and_of_no_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows and clashing names pass through; an empty table stays empty."""
    plain = "the quick brown fox jumps over the lazy dog and runs into the deep dark wood again "
    rows = [(i, f"{plain} number {i} {chr(97 + i % 26) * 5} {i * i} {plain[: i % 40]} {i} {i + 1} {i + 2}", "en", f"src{i % 5}", 1, "c", 1) for i in range(60)]
    rows += [(None, None, None, None, None, None, None), (None, plain * 3, "en", None, None, None, None), (100, "", "en", "src0", 0, "c", 1), (101, None, "en", "src0", 0, "c", 1)]
    rows += [(102, "long words of a text " * 20_000, None, "src1", 1, "c", 1), rows[3], rows[3], (103, rows[4][1], "en", "src4", 1, "c", 1), (104, f"{plain} token = abcdefgh12345678 that is what it says here", "en", "src2", 1, "c", 1)]
    for name, some in (("odd", rows), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame(some, DOCUMENTS).write.parquet(str(folder / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(folder)).collect()
        assert bool(out) == bool(some)
        assert all(r["lossless"] and r["n_tokens"] == len(r["ids"]) for r in out)
        assert not {r["doc_id"] for r in out} & {100, 101, 103}  # no language, or a copy of a smaller id


def test_registered():
    names = sorted(queries.QUERIES, key=lambda n: int(re.match(r"op(\d+)_", n)[1]))
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 11))
