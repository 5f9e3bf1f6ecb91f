"""SimHash fingerprints, and groups of fingerprints within a Hamming radius by covering locality-sensitive hashing.

A random projection may miss a pair; here the bit masks have a structure that cannot. Every bit position gets a nonzero
vector of r + 1 bits, and table v (also such a vector) keeps the positions whose vector has an odd product with v. For
at most r differing positions some v has even products with all of them, so in that table the two keys are equal. A
table keeps about 34 of 64 bits. A key with many fingerprints is dealt out again by the same construction over its
other bits, after which at most 2^14 different fingerprints can share a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from corpusmill.session import cut_lineage

from .arrow import map_texts
from .common import keep_rows, keyed_join
from .components import components

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
#: Keys with more fingerprints than this are dealt out a second time.
DEAL_AGAIN = 2048
_CHUNK = 1 << 15


def _fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit SimHash: lower-cases A-Z, splits at ASCII white space, counts repeated shingles."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = iter([b" ".join(words)])
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    n = max(1, len(words) - shingle + 1)
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for start in range(0, n, _CHUNK):
        some = min(_CHUNK, n - start)
        hashes = np.fromiter((digest(next(grams), seed) for _ in range(some)), "<u8", some)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key (hash of the text), fp (signed long) per row. Null and empty texts and texts without words: 0."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("key"), F.col(text).cast("binary").alias("_text"))
    return map_texts(rows, "_text", "fp long", lambda texts: {"fp": pa.array(map(_fingerprint, texts), pa.int64())})


def covering_masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over `positions` such that any `radius` of them lie outside at least one mask."""
    vectors = (1 << (radius + 1)) - 1
    of = {p: i % vectors + 1 for i, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (of[p] & v).bit_count() & 1) for v in range(1, vectors + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _forest(found: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links that span the groups of `found` (different fingerprints), searched breadth first; each is compared once with all not yet reached."""
    a, b, rest = [], [], found.view(np.uint64)
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            near = np.bitwise_count(rest ^ one) <= radius
            if near.any():
                new = rest[near]
                a += [int(one.view(np.int64))] * len(new)
                b += new.view(np.int64).tolist()
                queue += list(new)
                rest = rest[~near]
    return a, b


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """u, v: links within the radius that join exactly the groups that all such links would join. `distinct`: fp, no repeats."""
    masks = covering_masks(list(range(BITS)), radius)
    inner = [covering_masks([p for p in range(BITS) if not m >> p & 1], radius) for m in masks]
    first = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(masks)])
    keyed = distinct.select("fp", F.explode(first).alias("_a")).select("fp", "_a.t", "_a.k")
    shared = keyed.withColumn("_n", F.count("*").over(Window.partitionBy("t", "k"))).where("_n > 1")
    table = F.element_at(F.array(*[F.array(*[F.lit(_signed(m)) for m in ms]) for ms in inner]), F.col("t") + 1)
    again = F.transform(table, lambda m, i: F.struct((i + 1).alias("t2"), F.col("fp").bitwiseAND(m).alias("k2")))
    once = F.array(F.struct(F.lit(0).alias("t2"), F.lit(0).cast("long").alias("k2")))
    dealt = shared.withColumn("_b", F.explode(F.when(F.col("_n") > DEAL_AGAIN, again).otherwise(once))).select(
        "t", "k", "_b.t2", "_b.k2", "fp"
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, members in _runs(batches):
            a, b = [], []
            for start, end in keys:
                u, v = _forest(members[start:end], radius)
                a += u
                b += v
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["u", "v"])

    keys = ["t", "k", "t2", "k2"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(search, "u long, v long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[int, int]], np.ndarray]]:
    """Complete runs of equal keys in rows sorted by key, as (start, end) with the fingerprints; a run may span batches."""
    held = None

    def columns(batch):
        return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)])

    def cut(rows, last):
        edge = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
        starts = [0, *edge.tolist()]
        ends = [*edge.tolist(), len(rows)]
        spans = list(zip(starts, ends, strict=True))
        return spans if last else spans[:-1]

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = columns(batch)
        rows = rows if held is None else np.concatenate([held, rows])
        spans = cut(rows, False)
        done = spans[-1][1] if spans else 0
        if spans:
            yield [s for s in spans if s[1] - s[0] > 1], rows[:, 4].copy()
        held = rows[done:]
    if held is not None and len(held) > 1:
        yield [s for s in cut(held, True) if s[1] - s[0] > 1], held[:, 4].copy()


def near_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, key, fp, component_id and component_key for every row: the smallest doc_id reachable over fingerprints at
    most `radius` bits apart, and the smallest text hash among the rows of that id that are reachable.

    Equal texts share a fingerprint and meet before any search, so a group of copies counts once. Null, empty and
    wordless texts have fingerprint 0 and are linked like any other. Rows with a null id take part; a component
    whose ids are all null has a null component_id. Repeated rows stay. Other columns are ignored. Empty table: no rows.
    """
    rows = cut_lineage(fingerprints(docs, id_column, text))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key"))
    distinct = cut_lineage(rows.groupBy("fp").agg(first.alias("least"), F.count("*").alias("n")))
    roots = components(links(distinct.select("fp"), radius)).select(F.col("node").alias("_node"), "root")
    classes = cut_lineage(distinct.join(roots, F.col("fp") == F.col("_node"), "left").select(
        "fp", "least", "n", F.coalesce("root", "fp").alias("root")
    ))
    least = classes.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("first"))
    known = classes.join(least, F.col("root") == F.col("_root")).select(
        "fp", "n", F.col("first.doc_id").alias("component_id"), F.col("first.key").alias("component_key")
    )
    return keyed_join(rows, cut_lineage(known), "fp", "n", rows.count()).drop("n")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each group of `near_groups`, the one of the smallest id, with all its columns."""
    own = (F.col("doc_id").eqNullSafe(F.col("component_id"))) & (F.col("key") == F.col("component_key"))
    kept = near_groups(docs, id_column, text, radius).where(own).select(F.struct(F.col("doc_id").alias("id"), F.col("key").alias("hash")).alias("_row"))
    return keep_rows(docs, kept.distinct(), id_column, text, once=True)
