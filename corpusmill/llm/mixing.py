"""Mixing sources to target weights: repetition rates from token totals, then whole copies and one seeded coin per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from corpusmill.session import cut_lineage

from .common import WORD, keyed_join, packed, row_key, text_of, unpacked

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _numbered(sources: DataFrame) -> DataFrame:
    """Adds `position`, 0 upwards in code point order of the source, null last, without one task seeing all sources.

    The sorted table is written down; a row's position is its place in its part plus the rows of all earlier parts.
    """
    placed = cut_lineage(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")
    )
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(
        "position", F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1)
    ).drop("_part", "_start", "_id")


def source_rates(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, n_docs, source_size, weight, target, rate for `sized` (source, size).

    Weights follow the sources in code point order (null last), repeating. Together the targets are the sum of all
    sizes. A target above `cap` times its source's size stops there and what is over goes to the others by weight,
    until none is above: with level L a target is min(weight x L, cap x size), and L rises until no further source
    reaches its cap. Each round is one small aggregate over sources.
    """
    totals = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int"))
    sources = cut_lineage(_numbered(totals).withColumn("weight", weight).drop("position"))
    limit = F.col("source_size") * cap

    def shares(level: float | None):
        full = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= limit
        row = sources.agg(
            F.sum("source_size"), F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1)),
        ).first()
        return [x or 0 for x in row]

    total, _, free, _ = shares(None)
    level, before = (total / free if free else 0.0), 0
    while free:
        _, held, free, full = shares(level)
        if full == before or not free:
            break
        level, before = (total - held) / free, full
    target = F.least(F.col("weight") * F.lit(float(level)), limit.cast("double"))
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    return sources.withColumn("target", target).withColumn("rate", rate)


def coin(id_column: str, seed: str = SEED) -> Column:
    """A number from 0 to 1 (52 bits) that only the seed and the id decide."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def copy_counts(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED,
) -> DataFrame:
    """doc_id, key (hash of the text), size, source_size, target, rate, copies: how often the mix takes each document.

    A document comes floor(rate) times plus once more if its coin is below the fraction of the rate. Only ids,
    sources and sizes are kept; texts are read once and not shuffled.

    Null text: size 0. Null source: a source of its own, last. Sources without words: target, rate and copies 0. Null
    ids share one coin; repeated ids get the same coin. Other columns are ignored. Empty table: no rows.
    """
    sized = cut_lineage(docs.select(
        F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("key"), F.col(source).alias("source"), word_count(text_of(text)).alias("size")
    ))
    rates = source_rates(sized, weights, cap)
    extra = F.when(coin("doc_id", seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return keyed_join(sized, rates, "source", "n_docs", sized.count()).select(
        "doc_id", "key", "size", "source_size", "target", "rate", (F.floor("rate") + extra).cast("long").alias("copies")
    )


def mix(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The mixed documents: every row of `docs` as often as `copy_counts` says, all columns kept.

    Rows that repeat id and text have one count, the largest. Cases as in `copy_counts`.
    """
    counts = copy_counts(docs, id_column, text, **options).where("copies > 0")
    counts = counts.groupBy(F.struct(F.col("doc_id").alias("id"), F.col("key").alias("hash")).alias("_row")).agg(F.max("copies").alias("_copies"))
    rows = packed(docs, key=row_key(id_column, text)).join(counts, F.col("key") == F.col("_row"))
    return unpacked(rows.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))))
