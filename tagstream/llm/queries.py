"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, extract, langid, licenses, mixing, ngramjoin, pieces, quality, secrets, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk_search": topk.query,
    "op2_language_id": langid.query,
    "op3_html_extraction": extract.query,
    "op4_quality_classifier": quality.query,
    "op5_source_mixing": mixing.query,
    "op6_license_scan": licenses.query,
    "op7_sentencepiece": pieces.query,
    "op8_audio_fingerprints": audio.query,
    "op9_ngram_jaccard_join": ngramjoin.query,
    "op10_secret_scan": secrets.query,
}

SQL: dict[str, str] = {
    "op1_topk_search": topk.SQL,
    "op5_source_mixing": mixing.sql(),
    "op6_license_scan": licenses.sql(),
    "op9_ngram_jaccard_join": ngramjoin.SQL,
}
