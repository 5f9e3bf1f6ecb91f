"""Periodic runs against all periods tried one after the other."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np

from corpusmill.llm import runs
from corpusmill.llm.queries import QUERIES

from .data import awkward, awkward_rows, empty


def _plain_runs(words):
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - at + q
            if end > at and length >= max(6, 4 * q):
                stretch = words[at : at + length]
                if not any(stretch[d:] == stretch[:-d] for d in range(1, q)):
                    out.append((at, length, q))
            at = max(end, at) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def _plain(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = _plain_runs(words)
    drop = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    text = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *tail, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def _periodic(some):
    """Words of few kinds, with repeated pieces of pieces."""
    words = []
    while len(words) < some.randint(0, 160):
        piece = [some.choice("abc") for _ in range(some.randint(1, 9))]
        if some.random() < 0.5:
            piece = piece * some.randint(1, 6) + [some.choice("abc")]
        words += piece * some.randint(1, 7)
    return words


def test_all_runs_of_random_words():
    for seed in range(600):
        words = _periodic(random.Random(seed))
        assert runs.find_runs(np.array([ord(w) for w in words], np.int64)) == _plain_runs(words), seed


def test_runs_of_fibonacci_and_equal_words():
    a, b = "a", "ab"
    while len(b) < 700:
        a, b = b, b + a
    for word in (b, "a" * 500, "ab" * 250, "x" + "a" * 5, "a" * 6, ("a" * 10 + "b") * 9):
        assert runs.find_runs(np.array([ord(w) for w in word], np.int64)) == _plain_runs(word)


def test_long_text_is_found_fast_and_whole():
    words = [f"w{i % 5003}" for i in range(400_000)]
    (made,) = list(runs._grouped([[w.encode() for w in words]]))
    assert made[0] == [(0, 400_000, 5003)]


def test_texts_of_a_batch_do_not_mix():
    lists = [[b"a"] * 4, [b"a"] * 4, [], [b"a"] * 9, [b"b", b"a"] * 5]
    assert [found for found, _ in runs._grouped(lists)] == [[], [], [], [(0, 9, 1)], [(0, 10, 2)]]


def _rows(df):
    columns = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_query_against_all_periods(spark, tmp_path):
    some = random.Random(5)
    rows = [(i, some.choice([" ", "\n", "\x0b "]).join(_periodic(some))) for i in range(400)]
    rows += [(None, "a b " * 9), (7, None), (7, ""), (7, "a b c " * 8), (7, "a b c " * 8)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(400)) > 10
    assert _rows(QUERIES["op12_periodic_runs"](spark, str(tmp_path))) == sorted((_plain(*r) for r in rows), key=str)


def test_query_on_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    # Trying all periods of a text of thousands of words takes too long.
    short = {r.doc_id: r.text for r in docs.collect() if len((r.text or "").split()) < 500}
    made = QUERIES["op12_periodic_runs"](spark, sf)
    assert made.count() == docs.count()
    assert _rows(made.where(made.doc_id.isin(list(short)))) == sorted((_plain(*r) for r in short.items()), key=str)


def test_awkward_and_no_documents(spark):
    from pyspark.sql import functions as F

    docs = awkward(spark).withColumn("runs", F.lit("x")).withColumn("_text", F.lit(1)).withColumn("collapsed", F.lit(2)).withColumn("starts", F.lit(2))
    made = runs.collapsed(docs).collect()
    assert len(made) == len(awkward_rows())
    assert sorted(str([tuple(x) for x in r.runs]) for r in made) == sorted(str(_plain_runs((r[1] or "").encode().split()) if len(r[1] or "") < 9999 else []) for r in awkward_rows())
    assert runs.collapsed(empty(spark)).collect() == []
