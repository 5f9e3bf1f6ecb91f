"""Columns of the input that are named like those used inside stay as they are."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import bpe, classifier, extraction, minhash, mixing, quality, simhash

NAMES = [
    "_row", "_row_", "_nth_", "nth", "row", "key", "_copies", "_copy", "col", "html", "html_", "TEXT_", "_html", "_text", "ids_", "_ids", "_key", "id", "hash",
    "size", "copies", "host", "u", "v", "k", "set", "grams", "a.b",
]


def _docs(spark):
    docs = spark.createDataFrame([(1, "one two " * 20, "s"), (2, "one two " * 20, "s"), (3, "three four five " * 30, None), (None, None, "t")], "doc_id long, text string, source string")
    return docs.select("*", *[F.concat(F.lit("kept "), F.coalesce(F.col("doc_id"), F.lit(0)).cast("string")).alias(n) for n in NAMES if n != "text_"])


@pytest.mark.parametrize("stage", ["rules", "scores", "minhash", "simhash", "mix"])
def test_stages(spark, sf, stage):
    docs = _docs(spark)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = {
        "rules": lambda: quality.keep_good(docs), "scores": lambda: classifier.keep_good(docs, labels, 0.0), "minhash": lambda: minhash.keep_one(docs),
        "simhash": lambda: simhash.keep_one(docs), "mix": lambda: mixing.mix(docs),
    }[stage]()
    assert out.columns == docs.columns
    rows = [r.asDict() for r in out.collect()]
    assert stage == "rules" or rows
    assert all(r[n] == f"kept {r['doc_id'] or 0}" for r in rows for n in NAMES)


def test_pages_and_tokens(spark):
    docs = _docs(spark)
    pages = docs.withColumn("html", F.lit("<article><p>Some text.</p></article>"))
    out = extraction.extract(pages)
    assert out.columns == [c for c in pages.columns if c not in ("html", "text")] + ["text"]
    assert all(r["text"] == "Some text." and all(r[n] == f"kept {r['doc_id'] or 0}" for n in NAMES if n != "html") for r in out.collect())
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = bpe.encode(docs, path).join(docs.select("doc_id", *[f"`{n}`" for n in NAMES]), "doc_id")
    for r in bpe.decode(ids, path).collect():
        assert r["text"].split()[0] in ("one", "three") and all(r[n] == f"kept {r['doc_id']}" for n in NAMES)
