"""Cached answers against a comparison of every lookup with every entry."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import answer_cache as A

now = lambda: F.timestamp_seconds(F.lit(1000))


def _frames(spark, entries, asked):
    cache = spark.createDataFrame(entries, "filter_key string, embedding array<double>, response string, s bigint").repartition(4)
    lookups = spark.createDataFrame(asked, "lookup_id bigint, filter_key string, embedding array<double>").repartition(3)
    return cache.withColumn("stored_at", F.timestamp_seconds("s")).drop("s"), lookups


def _cosine(a, b):
    if not a or not b or len(a) != len(b):
        return 0.0
    norm = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    return round(sum(x * y for x, y in zip(a, b)) / norm, 9) if norm else 0.0


def _plain(entries, asked, ttl, threshold):
    hits = {i: [(s, r) for k, v, r, s in entries if k is not None and k == key and 1000 - s <= ttl and _cosine(v, x) >= threshold] for i, key, x in asked}
    return {i: max(h)[1] for i, h in hits.items() if h}


@pytest.fixture(scope="module")
def busy():
    """A third of all entries and of all lookups has one key, with copies and equal times."""
    some = random.Random(5)
    key = lambda i: "hot" if i % 3 == 0 else f"k{i % 7}"
    vector = lambda: [some.gauss(0, 1) for _ in range(3)]
    entries = [(key(i), vector(), f"r{i % 211}", some.randrange(400, 1000)) for i in range(900)]
    entries += [entries[0]] * 50 + [("hot", None, "none", 999), ("hot", [0.0, 0.0, 0.0], "zero", 999), ("hot", [1.0], "short", 999), (None, [1.0, 0.0, 0.0], "nokey", 999)]
    asked = [(i, key(i), vector()) for i in range(120)] + [(500, "hot", None), (501, None, [1.0, 0.0, 0.0]), (502, "absent", vector()), (503, "hot", [2.0])]
    return entries, asked


def test_newest_near_entry_of_the_key(spark, busy, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 8)
    cache, lookups = _frames(spark, *busy)
    for threshold in (0.9, 0.999):
        found = A.newest_answers(cache, lookups, now(), 450, threshold, entry_lane=40, lookup_lane=9)
        assert {r.lookup_id: r.response for r in found.collect()} == _plain(*busy, 450, threshold)


def test_rows_given_out_grow_with_lanes_not_with_entries(spark, busy):
    cache, lookups = _frames(spark, *busy)
    hot = lookups.where("filter_key = 'hot'")
    live = cache.where("filter_key = 'hot'").distinct().count()
    for lane in (40, 4000):
        rows = A._lane_hits(cache, hot, now(), 10_000, 0.5, lane, 9)
        assert rows.count() <= hot.count() * math.ceil(live / lane)


def test_no_entries_and_no_lookups(spark, busy):
    cache, lookups = _frames(spark, *busy)
    assert A.newest_answers(cache.limit(0), lookups, now()).count() == 0 == A.newest_answers(cache, lookups.limit(0), now()).count()
    with pytest.raises(ValueError):
        A.newest_answers(cache, lookups, now(), threshold=0.0)
