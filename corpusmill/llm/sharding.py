"""Minimax contiguous partition of ordered atomic groups into shards.

Groups (rows of equal text) are ordered by a 128-bit hash of their text. The smallest capacity for which a greedy walk
over the order needs no more shards than there are is found by binary search, and the order is cut there.

The order is never in one place. The driver holds a bounded outline: intervals of the order with their bytes and their
largest group. Read as divisible, the intervals give a capacity that the answer cannot be below; read as atomic, one
that it cannot be above. Intervals in which a cut may lie for a capacity between the two are asked for in finer parts
until both bounds agree, so an outline of some ten thousands of intervals serves any number of groups.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from corpusmill.session import cut_lineage

from .common import keyed_join, text_of

#: Bits of the hash that the first outline looks at, and that each refinement adds.
FIRST_BITS, MORE_BITS = 12, 8
HASH_BITS = 128
#: Sorts after every hash.
BEYOND = "g"
#: Hash digits of the cells inside which rows are numbered, and rows that a cell should not exceed by much.
CELL_DIGITS, CELL_ROWS = 4, 1 << 20


@dataclass(frozen=True)
class Interval:
    """Groups whose hash starts with `prefix` (`bits` long): how many, their bytes, and the largest."""

    prefix: int
    bits: int
    groups: int
    size: int
    largest: int

    @property
    def start(self) -> int:
        return self.prefix << (HASH_BITS - self.bits)

    @property
    def digits(self) -> str:
        return f"{self.prefix:0{self.bits // 4}x}"


def _reach(edges: list[int], start: int, capacity: int) -> int:
    """The last of the ascending `edges` that is no more than `capacity` after `start`."""
    return edges[bisect_right(edges, start + capacity) - 1]


def _walk(edges: list[int], capacity: int, shards: int) -> list[int]:
    """Greedy cuts: where each shard ends if it takes as much as fits."""
    cuts, at = [], edges[0]
    for _ in range(shards):
        at = max(at, _reach(edges, at, capacity))
        cuts.append(at)
    return cuts


def _least(low: int, high: int, fits) -> int:
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


def smallest_capacity(edges: list[int], shards: int, least: int) -> int:
    """The smallest capacity, `least` or more, with which a greedy walk over `edges` (running totals from 0) ends within `shards`."""
    return _least(least, max(edges[-1], least), lambda c: _walk(edges, c, shards)[-1] == edges[-1])


def _split(outline: list[Interval], chosen: set[int], groups: DataFrame) -> list[Interval]:
    """The outline with the chosen intervals replaced by their parts, in one aggregate over their groups."""
    if not chosen:
        return outline
    by_bits: dict[int, list[int]] = {}
    for i in chosen:
        by_bits.setdefault(outline[i].bits, []).append(outline[i].prefix)
    parts: list[Interval] = []
    for bits, prefixes in by_bits.items():
        wide = bits + MORE_BITS
        digits = lambda n: F.substring("hash", 1, n // 4)
        wanted = groups.sparkSession.createDataFrame([(f"{p:0{bits // 4}x}",) for p in prefixes], "_p string")
        # No more rows than intervals in the outline.
        rows = groups.join(F.broadcast(wanted), digits(bits) == F.col("_p")).groupBy(digits(wide).alias("p")).agg(
            F.count("*"), F.sum("size"), F.max("size")
        ).collect()
        parts += [Interval(int(p, 16), wide, n, s, m) for p, n, s, m in rows]
    kept = [x for i, x in enumerate(outline) if i not in chosen]
    return sorted(kept + parts, key=lambda x: x.start)


def _edges(outline: list[Interval]) -> list[int]:
    edges = [0]
    for x in outline:
        edges.append(edges[-1] + x.size)
    return edges


def cut_points(groups: DataFrame, shards: int) -> tuple[list[str], list[str]]:
    """Hash prefixes of giants, and those at which each shard of the rest but the first starts, for `groups` (hash: 32 hex digits, size).

    A group larger than an equal share of what is left is a giant and gets a shard of its own; the others share the
    remaining shards in order. Their capacity is the smallest possible. With it, the cuts nearest to equal shares are
    taken where they keep to it, otherwise the greedy ones.
    """
    rows = groups.groupBy(F.substring("hash", 1, FIRST_BITS // 4).alias("p")).agg(F.count("*"), F.sum("size"), F.max("size")).collect()
    outline = sorted((Interval(int(p, 16), FIRST_BITS, n, s, m) for p, n, s, m in rows), key=lambda x: x.start)
    giants: list[Interval] = []
    while True:
        left, slots = sum(x.size for x in outline), shards - len(giants)
        found = {i for i, x in enumerate(outline) if slots > 1 and x.largest * slots > left}
        single = {i for i in found if outline[i].groups == 1}
        if not found:
            break
        if single:
            one = max(single, key=lambda i: outline[i].size)
            giants.append(outline[one])
            outline = outline[:one] + outline[one + 1 :]
        else:
            outline = _split(outline, found, groups)
    slots = shards - len(giants)
    while True:
        edges = _edges(outline)
        total, largest = edges[-1], max((x.largest for x in outline), default=0)
        low = max(-(-total // slots), largest)
        stuck = {i for i, x in enumerate(outline) if x.size > low and x.groups > 1}
        if stuck:
            outline = _split(outline, stuck, groups)
            continue
        high = smallest_capacity(edges, slots, low)
        # For any capacity between the two, cut j lies from where the atomic walk has come with the smaller one to where
        # the divisible order has come with the larger one.
        near, far, open_ = _walk(edges, low, slots), [min(total, high * (j + 1)) for j in range(slots)], set()
        marks = [total * (j + 1) // slots for j in range(slots)]
        for a, b in [*zip(near, far, strict=True), *zip(marks, marks, strict=True)]:
            first, last = max(0, bisect_right(edges, a) - 1), bisect_left(edges, b)
            open_ |= {i for i in range(first, min(last, len(outline))) if outline[i].groups > 1}
        if low == high:
            open_ &= {i for m in marks for i in range(max(0, bisect_right(edges, m) - 1), min(bisect_left(edges, m), len(outline))) if outline[i].groups > 1}
        if not open_:
            break
        outline = _split(outline, open_, groups)
    cuts = _walk(edges, high, slots)
    even, at = [], 0
    for mark in marks:
        before = edges[bisect_right(edges, mark) - 1]
        after = edges[min(bisect_left(edges, mark), len(edges) - 1)]
        at = max(at, before if mark - before <= after - mark else after)
        even.append(at)
    if all(b - a <= high for a, b in zip([0, *even], even, strict=False)):
        cuts = even
    starts = []
    for cut in cuts[:-1]:
        i = bisect_left(edges, cut)
        starts.append(outline[i].digits if i < len(outline) else BEYOND)
    return [x.digits for x in giants], starts


def shard_rows(
    docs: DataFrame, shards: int = 16, id_column: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row; size is the UTF-8 bytes of the text plus 1.

    Rows of equal text share a shard, and the largest shard is as small as that allows. Slots number the rows of a
    shard from 0 without gaps, by hash and then id. Rows are numbered inside cells of the order (hash digits, and for
    a group with many rows a share of its ids), and a cell starts after all rows of the cells before it.

    Null text: size 1, a group with the empty text. Null ids come first in their cell; rows that repeat both id and
    text are alike and take neighbouring slots. Other columns are ignored. Empty table: no rows; more shards than
    groups: some stay empty.
    """
    body = text_of(text).cast("binary")
    rows = cut_lineage(docs.select(
        F.col(id_column).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"), F.md5(body).alias("hash"),
    ))
    groups = cut_lineage(rows.groupBy("hash").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    giants, starts = cut_points(groups, shards)
    bounds = F.array(*map(F.lit, starts)).cast("array<string>")
    shard = F.size(F.filter(bounds, lambda b: b <= F.col("hash")))
    for i, digits in enumerate(giants):
        # No other group starts with a giant's digits.
        shard = F.when(F.col("hash").startswith(digits), shards - len(giants) + i).otherwise(shard)
    known = groups.select("hash", "n", shard.cast("int").alias("shard"))
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") / CELL_ROWS))
    placed = keyed_join(rows, known, "hash", "n", rows.count()).withColumn(
        "_salt", F.when(salts > 1, F.pmod(F.xxhash64("doc_id"), salts)).otherwise(F.lit(0).cast("long"))
    ).withColumn("_hot", F.when(salts > 1, F.col("hash")).otherwise(F.lit(""))).withColumn("_cell", F.substring("hash", 1, CELL_DIGITS))
    cell = ["shard", "_cell", "_hot", "_salt"]
    placed = cut_lineage(placed.drop("n"))
    counts = placed.groupBy(*cell).agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy("shard").orderBy("_cell", "_hot", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*cell, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    order = Window.partitionBy(*cell).orderBy("hash", "doc_id")
    numbered = placed.withColumn("_row", F.row_number().over(order) - 1)
    return numbered.join(offsets, cell).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_offset") + F.col("_row")).cast("long").alias("slot")
    )

