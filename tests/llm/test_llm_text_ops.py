"""Language ID, quality, licenses, secrets and pages: brute force, edge rows, held-out accuracy."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re
import urllib.parse
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagstream.llm import extract, langid, licenses, quality, secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, in0 string, `_words` string"
LONG = "The quick token = \"abcdefgh\" thing of the and. " * 20_000
EDGES = [
    (1, None, "en", None, None, 1.0, "a", "b"),
    (2, "", None, "s", 0, None, None, None),
    (None, "text under the MIT license", "en", "s", 1, 2.0, "x", "y"),
    (3, "12 !! ··", "en", "s", 1, 2.0, "x", "y"),
    (4, LONG, "en", "s", 1, 2.0, "x", "y"),
    (4, LONG, "en", "s", 1, 2.0, "x", "y"),
    (5, "漢字 и été", None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_language_accuracy_on_held_out_rows(docs):
    model = langid.train(docs.where(~langid.held_out()))
    rows = langid.detect(docs, model).where(langid.held_out()).select("lang", "lang_pred", "score").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows) > 0
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_bloom_filters_hold_what_was_learned():
    import numpy as np

    sets = {f"l{k}": np.arange(k * 1000, k * 1000 + 500, dtype=np.uint32) for k in range(70)}  # more than one table
    model = langid.Model.build(sets, dict.fromkeys(sets, 500))
    for k, lang in enumerate(model.languages):
        hits = model.hits(sets[lang], np.array([0, 500]))
        assert hits[0].argmax() == k and hits[0, k] == pytest.approx(500)


def test_grams_of_a_row_do_not_depend_on_its_neighbours():
    texts = ["Ab  c", "", "é!x", " ", "the end"]
    apart = [langid.grams(*langid.B.string_buffers(pa.array([t])))[0].tolist() for t in texts]
    packed, bounds = langid.grams(*langid.B.string_buffers(pa.array(texts)))
    assert [packed[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == apart


def test_language_edges(edges, docs):
    model = langid.train(docs)
    got = langid.detect(edges, model)
    assert set(got.columns) == {*edges.columns, "lang_pred"}  # an output replaces the column of its name
    rows = got.select("doc_id", "lang_pred", "score").collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(EDGES) and by[1]["lang_pred"] == by[2]["lang_pred"] == by[3]["lang_pred"] == "und" and by[4]["lang_pred"] == "en" and by[5]["lang_pred"] != "und"
    none = langid.train(docs.limit(0))
    assert {r["lang_pred"] for r in langid.detect(edges, none).collect()} == {"und"}
    assert langid.detect(edges.limit(0), model).count() == 0


def test_quality_on_held_out_rows(spark, sf_dir, docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs.where(~langid.held_out()), labels.where(~langid.held_out()))
    rows = quality.score(docs.where(langid.held_out()).select("doc_id", "text"), model).join(labels, "doc_id").collect()
    assert rows and sum(r["predicted"] == r["quality"] for r in rows) >= 0.8 * len(rows)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_quality_learns_a_plain_rule_and_edges(spark, edges):
    rows = [(i, "good words here" if i % 2 else "bad *** words !!") for i in range(200)]
    model = quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (7, None)], "doc_id long, quality int"))
    got = {r["text"]: r["score"] for r in quality.score(spark.createDataFrame([("good things here",), ("*** !!",)], "text string"), model).collect()}
    assert got["good things here"] > 0.5 > got["*** !!"]
    assert all(0 <= r["score"] <= 1 for r in quality.score(edges, model).collect())
    nothing = quality.fit(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality.score(edges, nothing).collect()} == {0.5}


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def base_licenses(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, at, labels = WORD.findall(low), [], set()
    for phrase, label in licenses.BASE:
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def license_row(r):
    return r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]


def test_license_base_against_brute_force(docs):
    for r in licenses.scan(docs).select("text", *["n_words", "n_base", "first_word", "last_word", "base_labels"]).collect():
        assert license_row(r) == base_licenses(r["text"])


LICENSED = [
    ("Under the MIT License. under-the mit/license", "mit", "mit"),
    ("Apache License, Version 2.0 and apache license version 2", "apache-2", "apache-2"),
    ("Licensed under CC BY-NC-SA 4.0", "cc-by-nc", "cc-by-nc,cc-by-nc-sa"),
    ("SPDX-License-Identifier: BSD-3-Clause", "", "bsd-3-clause"),
    ("This work is licensed under the GNU General Public License, version 3.", "", "gpl-3"),
    ("All rights reserved.", "", "all-rights-reserved"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "", "mit"),
    ("mit der Lizenz", "", ""),
    ("", "", ""),
    (None, "", ""),
]


def test_license_labels(spark, edges):
    rows = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(LICENSED)], "i int, text string")
    got = {r["i"]: r for r in licenses.scan(rows).collect()}
    for i, (text, base, labels) in enumerate(LICENSED):
        assert (got[i]["base_labels"], got[i]["labels"]) == (base, labels)
        assert license_row(got[i]) == base_licenses(text) and 0 <= got[i]["score"] <= 1
    assert len(licenses.rules()) >= 300
    out = licenses.scan(edges)
    assert out.count() == len(EDGES) and "_words" in out.columns and licenses.scan(edges.limit(0)).count() == 0
    assert "Python" not in out._jdf.queryExecution().toString()


def samples(pattern):
    """A shortest text for each alternative of a pattern."""

    def walk(tree):
        out = [""]
        for op, value in tree:
            name = str(op)
            if name == "LITERAL":
                made = [chr(value)]
            elif name == "ANY":
                made = ["x"]
            elif name == "IN":
                made = [chr(value[0][1] if str(value[0][0]) == "LITERAL" else value[0][1][0])]
            elif name == "BRANCH":
                made = [t for part in value[1] for t in walk(part)]
            elif name == "SUBPATTERN":
                made = walk(value[3])
            else:
                made = [t * value[0] for t in walk(value[2])[:1]]
            out = [a + b for a in out for b in made]
        return out

    return walk(re._parser.parse(pattern))


def test_license_keywords_stand_in_every_alternative():
    for first, keywords, pattern, *_ in licenses.rules():
        for text in samples(pattern):
            assert first in text and any(k in f" {text} " for k in keywords), (pattern, text)


ALTERNATIVES = [
    ("Licensed under Creative Commons Attribution ShareAlike 4.0", "cc-by-sa"),
    ("released under CC0 1.0, see the license", "cc0"),
    ("the Expat license", "mit"),
    ("the FreeBSD license", "bsd-2-clause"),
    ("the 0BSD license", "bsd-0-clause"),
    ("the PSF License license", "python-2"),
    ("licensed under do what the fuck you want to public license", "wtfpl"),
    ("licensed under GNU GPL v1", "gpl-1"),
    ("Licensed under a Creative Commons Attribution-ShareAlike 4.0 License", "cc-by-sa"),
    ("Apache Software License 1.1", "apache-1.1"),
    ("PSF license", "python-2"),
    ("Licensed under Creative Commons Attribution 4.0 International", "cc-by"),
    ("Permission\nis hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
    ("distributed under BSD 3 clause", "bsd-3-clause"),
    ("Licensed under the Expat license", "mit"),
    ("see eclipse.org/legal/epl-2.0", "epl"),
]


def test_license_alternatives(spark):
    rows = spark.createDataFrame([(t, want) for t, want in ALTERNATIVES], "text string, want string")
    for r in licenses.scan(rows).collect():
        assert r["want"] in r["labels"].split(","), (r["text"], r["labels"])


def test_license_gate_passes_every_rule(spark):
    texts = [(t,) for _, _, pattern, *_ in licenses.rules() for t in samples(pattern)]
    texts += [("released under the 3-clause BSD",), ("distributed under the ISC",), ("released under the MIT",), ("https://www.mozilla.org/MPL/2.0/",), ("Neither the name of X nor the names of its contributors may be used to endorse or promote products",)]
    missed = licenses.scan(spark.createDataFrame(texts, "text string")).where("labels = ''")
    assert [r["text"] for r in missed.collect()] == []
    begins = licenses.stems()
    assert all(any(f" {begins[k]}" in f" {t} " for k in keywords) for _, keywords, pattern, *_ in licenses.rules() for t in samples(pattern))
    found = sorted(set(begins.values()))
    assert not any(b.startswith(a) for a, b in zip(found, found[1:])) and re.findall(f" (?=({licenses.any_of(set(found))}))", " " + " ".join(found)) == found


def plain_labels(text):
    """Labels and score by every rule in turn, without any prefilter."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    held, base = " ".join(words), set()
    for phrase, label in licenses.BASE:
        if f" {phrase} " in f" {held} ":
            base.add(label)
    found = []
    for _, _, pattern, label, priority, sure in licenses.rules():
        for m in re.finditer(f"(?<![^ ])(?:{pattern})(?![^ ])", held):
            found.append((held[: m.start()].count(" "), -held[: m.end()].count(" ") - 1, priority, label, sure))
    kept = []
    for d in sorted(found):
        if not any(k[1] <= d[1] and k[2] <= d[2] for k in kept):
            kept.append(d)
    return ",".join(sorted(base | {d[3] for d in kept})), 1.0 if base else max((d[4] for d in kept), default=0.0)


def test_license_scan_with_and_without_prefilter_and_against_a_plain_scan(docs, spark):
    draw = random.Random(3)
    every = [t for _, _, pattern, *_ in licenses.rules() for t in samples(pattern)] + [t for t, *_ in ALTERNATIVES] + [t for t, *_ in LICENSED if t]
    texts = every + [", ".join(draw.choice(every) + draw.choice(["", " or later", " license", " x"]) for _ in range(3)) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").unionByName(docs.select("text"))
    got = [licenses.scan(rows, prefilter=p).select("text", "labels", "score").collect() for p in (True, False)]
    for a, b in zip(*got):
        assert a == b and (a["labels"], a["score"]) == plain_labels(a["text"]), a
    assert sum(r["labels"] != "" for r in got[0]) > 400


def test_license_scan_against_sql(docs, spark):
    import duckdb

    draw = random.Random(4)
    every = [t for _, _, pattern, *_ in licenses.rules() for t in samples(pattern)] + [t for t, *_ in ALTERNATIVES] + [t for t, *_ in LICENSED]
    texts = every + [", ".join((draw.choice(every) or "") + draw.choice(["", " or later", " license", " x"]) for _ in range(4)) for _ in range(100)]
    table = pa.table({"doc_id": list(range(10_000, 10_000 + len(texts))), "text": texts})
    con = duckdb.connect()
    con.register("documents", pa.concat_tables([table, docs.select("doc_id", "text").toArrow().cast(table.schema)]))
    rows = spark.createDataFrame(table.to_pandas(), "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({licenses.sql()})").fetchall()
    got = [tuple(r) for r in licenses.scan(rows).select(*columns).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(r[6] != "" for r in got) > 400


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    found.sort()
    joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in found)
    return [sum(k == kind for _, k, _ in found) for kind in range(3)], hashlib.sha256(joined.encode()).hexdigest(), joined


TRICKY = ["tokentoken=abcdefgh", "token = short token:12345678", "é password='pässword1' passwd=\"a.b-c_d=e\"", "AKIA" + "A" * 12 + "x" + "AKIA123", "f" * 31 + " " + "0" * 32 + "g" + "a" * 40, "API_KEY: 12345678 apikey==12345678", "secret=password=12345678"]


def test_secret_base_against_brute_force(docs, spark):
    rows = spark.createDataFrame([(t,) for t in TRICKY], "text string").unionByName(docs.select("text"))
    for r in secrets.scan(rows).collect():
        counts, digest, joined = base_secrets(r["text"])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == counts and r["base_sha256"] == digest
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))


def spans(text):
    return secrets.scan_kernel(pa.array([text]))[4][0].as_py()


def test_secrets_in_layers():
    secret = 'token = "abcdefgh12345678"'
    coded = base64.b64encode(secret.encode()).decode()
    for text, path in [
        (f"é {coded} z", "assign+base64"),
        ("é " + base64.b64encode(gzip.compress(secret.encode())).decode() + " z", "assign+base64+gzip"),
        ("é " + base64.b64encode(zlib.compress(secret.encode())).decode() + " z", "assign+base64+zlib"),
        ("é " + base64.b64encode(coded.encode()).decode() + " z", "assign+base64+base64"),
        ("é " + urllib.parse.quote(coded[:20] + "%" + coded, safe="") + " z", None),
    ]:
        got = [s.rsplit(":", 2) for s in spans(text).split(",") if s]
        if path:
            assert [(g[0], text[int(g[1]) : int(g[2])]) for g in got if "+" in g[0]] == [(path, text[2:-2])]
    assert spans("\\u0041KIAABCDEFGHIJKLMNOP z").startswith("access+unicode:0:")
    assert "assign+url:0:" in spans("password%3D%61bcdefgh")
    nested = secret
    for _ in range(6):
        nested = base64.b64encode(nested.encode()).decode()
    assert "assign" + "+base64" * 6 in spans(nested)


def test_secret_edges_and_redaction(edges, spark):
    rows = {r["doc_id"]: r for r in secrets.scan(edges).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert rows[1]["base_sha256"] == rows[2]["base_sha256"] == empty and rows[1]["spans"] == ""
    assert rows[4]["n_assign"] == 20_000
    texts = [None, "", "ä token=abcdefgh é", base64.b64encode(b"password: 0123456789abcdef").decode()]
    got = [r["text"] for r in secrets.redact(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)).collect()]
    assert got == [None, "", "ä [secret] é", "[secret]"]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1></header>
<div class="cookie-notice">We use cookies on this site</div><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy this now, it is very cheap and very good</div>
%s<aside><p>Popular posts of the week, all of them</p></aside><form><label>Search</label><input></form>
<section id="comments"><h3>Comments</h3><p>First! I read all of it and want to say a few words about it here.</p></section><footer>&copy; Site</footer></body></html>"""
BODY = "<h1>A  title &amp; more</h1><p><b>First paragraph with some&nbsp;words in it, long enough to count.<br><p>Second &lt;one&gt;\n is here, with <a href=x>a link</a> in it as well.</p><p>Short.</p>"
WANT = "A title & more\n\nFirst paragraph with some words in it, long enough to count.\n\nSecond <one> is here, with a link in it as well.\n\nShort."


@pytest.mark.parametrize("open_, close", [("<article>", "</article>"), ("<main>", "</main>"), ("<article>", ""), ("<div id=content>", "</div>")])
def test_main_text(open_, close):
    assert extract.main_text(PAGE % (open_ + BODY + close)) == WANT


def test_page_edges(spark):
    html = [None, "", "<p>", "<![bad]>", "plain", "<article>x", "<p>a</p>" * 2000]
    rows = extract.extract(spark.createDataFrame([(i, h, "kept") for i, h in enumerate(html)], "page_id int, html string, out0 string")).collect()
    got = {r["page_id"]: r["text"] for r in rows}
    assert got[0] == got[1] == got[2] == "" and got[4] == "plain" and got[5] == "x" and got[6].count("a") == 2000
    assert all(r["n_chars"] == len(r["text"]) and r["out0"] == "kept" for r in rows)


def test_pages_of_the_table(spark, sf_dir):
    rows = extract.query(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").select("html", "text", F.length("text").alias("n"), "n_chars").collect()
    for r in rows:
        inside = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        import html

        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?p>|</?h1>", inside)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n"] == r["n_chars"]
