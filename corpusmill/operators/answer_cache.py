"""Look up many questions in a table of cached answers: the newest one of the same filter key that is near enough.

Entries and lookups of a filter key are dealt into lanes of bounded size. A task holds one lane of entries beside one lane of lookups,
scores blocks of entries from the newest to the oldest and leaves out the lookups that have been answered. It gives out one row at most for each of its
lookups, so lookups x lanes of entries rows travel, never pairs of lookups and entries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import SIMILARITY_DIGITS
from .vector_index import _rows

#: Entries and lookups in one task, and entries that are scored together.
ENTRY_LANE, LOOKUP_LANE, BLOCK = 32_768, 4096, 1024
KEY, ENTRIES, LOOKUPS = "filter_key", "__entry_lane", "__lookup_lane"


def _dealt(df: DataFrame, key: Column, lane: str, lanes: str, other: str, others: str) -> DataFrame:
    """Each row in its own lane, once for every lane of the other side."""
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(others) - 1))
    return df.withColumn(lane, F.pmod(key, F.col(lanes))).withColumn(other, every).drop(lanes, others)


def _hits(entries: pa.Table, lookups: pa.Table, threshold: float) -> tuple[list[int], list[int]]:
    """Places of lookups and of the first entry near each; entries are in order, newest first."""
    asked = lookups.column("embedding").combine_chunks()
    lengths = np.asarray(asked.value_lengths().fill_null(0))
    answered, by = [], []
    for dim in np.unique(lengths[lengths > 0]).tolist():
        open_ = np.flatnonzero(lengths == dim)
        vectors = _rows(asked, dim)
        for start in range(0, entries.num_rows, BLOCK):
            if not len(open_):
                break
            rows = _rows(entries.column("embedding").slice(start, BLOCK).combine_chunks(), dim)
            near = np.round(rows @ vectors[open_].T, SIMILARITY_DIGITS) >= threshold
            hit = near.any(axis=0)
            answered += open_[hit].tolist()
            by += (start + near[:, hit].argmax(axis=0)).tolist()
            open_ = open_[~hit]
    return answered, by


def newest_answers(cache: DataFrame, lookups: DataFrame, now: Column, ttl_seconds: int = 1800, threshold: float = 0.95,
                   entry_lane: int = ENTRY_LANE, lookup_lane: int = LOOKUP_LANE) -> DataFrame:
    """(lookup_id, response): the newest response of the same filter key stored within the time limit whose cosine reaches the threshold; of
    equally new ones the largest.

    cache(filter_key, embedding, response, stored_at), lookups(lookup_id, filter_key, embedding); ids of lookups should be unique. Null
    keys, and vectors that are null, zero, undefined or of another length than the asked one, are no hit. Equal entries count once.
    """
    found = _lane_hits(cache, lookups, now, ttl_seconds, threshold, entry_lane, lookup_lane)
    newest = found.groupBy("lookup_id").agg(F.max(F.struct("stored_at", "response")).alias("hit"))
    return newest.select("lookup_id", "hit.response")


def _lane_hits(cache: DataFrame, lookups: DataFrame, now: Column, ttl_seconds: int, threshold: float, entry_lane: int, lookup_lane: int) -> DataFrame:
    """(lookup_id, response, stored_at): the newest hit of each lookup in each lane of entries."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    live = cache.where(F.unix_timestamp(now) - F.unix_timestamp("stored_at") <= ttl_seconds).select(KEY, "embedding", "response", "stored_at")
    live = live.join(lookups.select(KEY).distinct(), KEY, "left_semi").distinct()
    lanes = lambda df, size, name: df.groupBy(KEY).agg(F.ceil(F.count(F.lit(1)) / size).alias(name))
    sizes = lanes(live, entry_lane, "__entries").join(lanes(lookups, lookup_lane, "__asked"), KEY)
    entries = _dealt(live.join(sizes, KEY), F.xxhash64("response", "stored_at", "embedding"), ENTRIES, "__entries", LOOKUPS, "__asked")
    asked = _dealt(lookups.select("lookup_id", KEY, "embedding").join(sizes, KEY), F.xxhash64("lookup_id"), LOOKUPS, "__asked", ENTRIES, "__entries")

    def task(held: pa.Table, sought: pa.Table) -> pa.Table:
        order = pc.sort_indices(held, sort_keys=[("stored_at", "descending"), ("response", "descending")])
        held = held.take(order)
        lookup, entry = _hits(held, sought, threshold)
        places = pa.array(entry, pa.int64())
        return pa.table({
            "lookup_id": sought.column("lookup_id").take(pa.array(lookup, pa.int64())), "response": held.column("response").take(places),
            "stored_at": held.column("stored_at").take(places),
        })

    schema = T.StructType([lookups.schema["lookup_id"], cache.schema["response"], cache.schema["stored_at"]])
    group = KEY, ENTRIES, LOOKUPS
    return entries.groupBy(*group).cogroup(asked.groupBy(*group)).applyInArrow(task, schema)
