"""Top-k per key, ranks and rank fusion without ever sorting a whole key in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import rounded

FAN = 256


#: Rows of two ids and a key (some 100 bytes each) that may be broadcast.
MAX_BROADCAST = 100_000


def beside(df: DataFrame, one: DataFrame) -> DataFrame:
    """Columns of a one-row aggregate next to every row, as a scalar subquery."""
    packed = one.select(F.struct(*one.columns)).scalar()
    return df.withColumn("__one", packed).select(*df.columns, "__one.*")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each key with their rank.

    Two rounds: each group of input partitions keeps its own first k per key, then the key
    keeps the first k of those. A key that holds most rows is cut down in many tasks before
    one task sees at most ``FAN * k`` of its rows.
    """
    lane = "__lane"
    first = Window.partitionBy(*keys, lane).orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn(lane, F.pmod(F.spark_partition_id(), F.lit(FAN)))
        .withColumn(rank, F.row_number().over(first))
        .where(F.col(rank) <= k)
        .withColumn(rank, F.row_number().over(final))
        .where(F.col(rank) <= k)
        .drop(lane)
    )


def top_k_global(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Spark keeps k rows per task and merges them; no full sort."""
    return df.orderBy(*order).limit(k)


def fuse_ranks(lists: list[tuple[DataFrame, float]], query: str, item: str, k: int, rrf_k: int = 60,
               digits: int = 6) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query, item, rank, ...).

    A repeated item in one list counts once, at its best rank; the repeats still occupy the
    positions they hold. Ties go to the smaller item key.
    """
    if k <= 0 or rrf_k <= 0 or not lists:
        raise ValueError("fusion needs at least one list and positive k")
    parts = []
    for number, (ranked, weight) in enumerate(lists):
        if not 0 <= weight < float("inf"):
            raise ValueError("fusion weights must be finite and non-negative")
        parts.append(ranked.select(query, item, F.lit(number).alias("list"), "rank", F.lit(float(weight)).alias("weight")))
    fused = fused_scores(reduce(DataFrame.unionByName, parts), query, item, len(lists), rrf_k)
    best = top_k(fused, [query], [F.desc("raw"), F.asc(item)], k)
    return with_fusion_scores(best, query, digits)


def fused_scores(entries: DataFrame, query: str, item: str, lists: int, rrf_k: int = 60) -> DataFrame:
    """(query, item, raw) from (query, item, list, rank, weight).

    The parts are added in list order, so the sum does not depend on how rows were shuffled.
    """
    best = [F.max(F.when(F.col("list") == n, F.col("weight") / (F.lit(rrf_k) + F.col("rank")))) for n in range(lists)]
    columns = entries.groupBy(query, item).agg(*[b.alias(f"__p{n}") for n, b in enumerate(best)])
    total = reduce(lambda a, b: a + b, [F.coalesce(f"__p{n}", F.lit(0.0)) for n in range(lists)])
    return columns.select(query, item, total.alias("raw"))


def with_fusion_scores(best: DataFrame, query: str, digits: int = 6) -> DataFrame:
    """``rrf_score`` and the 0..1 ``combined_score`` relative to the query's best hit."""
    top = F.max("raw").over(Window.partitionBy(query))
    return best.select(
        "*",
        rounded("raw", digits).alias("rrf_score"),
        F.when(top > 0, rounded(F.col("raw") / top, 4)).otherwise(0.0).alias("combined_score"),
    ).drop("raw")


def exact_ranks(scored: DataFrame, wanted: DataFrame, query: str, item: str, order: Column) -> DataFrame:
    """1-based rank within the whole of ``scored`` for a bounded number of wanted items.

    ``order`` is a struct that sorts ascending into rank order and is unique per query. Every
    scored row is compared with its query's few wanted keys and only counts are shuffled, so
    no query is sorted as a whole. The wanted items are broadcast where there are at most
    ``MAX_BROADCAST`` of them and shuffled otherwise.
    """
    keyed = scored.select(query, item, order.alias("key"))
    pairs = wanted.select(query, item).distinct()
    few = pairs.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    side = F.broadcast if few else (lambda df: df)
    marks = (
        keyed.join(side(pairs), [query, item], "left_semi")
        .groupBy(query)
        .agg(F.sort_array(F.collect_list(F.struct("key", item))).alias("marks"))
    )
    position = F.size(F.filter("marks", lambda m: m["key"] <= F.col("key")))
    counts = (
        keyed.join(side(marks), query)
        .groupBy(query, position.alias("position"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    upto = Window.partitionBy(query).orderBy("position")
    running = counts.withColumn("before", F.sum("n").over(upto))
    expanded = marks.select(query, F.posexplode("marks").alias("index", "mark"))
    # Rows at position p sort below every mark from index p on.
    best = (
        expanded.join(running, query, "left")
        .where(F.col("position") <= F.col("index"))
        .groupBy(query, F.col("mark")[item].alias(item))
        .agg(F.max("before").alias("before"))
    )
    listed = expanded.select(query, F.col("mark")[item].alias(item))
    return listed.join(best, [query, item], "left").select(
        query, item, (F.coalesce("before", F.lit(0)) + 1).alias("rank")
    )


def u_shape_order(rank: Column) -> list[Column]:
    """Sort keys that place rank 1 first, then even ranks falling, then odd ranks rising."""
    even = rank % 2 == 0
    return [
        F.when(rank == 1, 0).when(even, 1).otherwise(2),
        F.when(even, -rank).otherwise(rank),
    ]


def min_max(score: Column, query: str) -> Column:
    """Score scaled to 0..1 within its query; 0 where all are equal."""
    window = Window.partitionBy(query)
    low, high = F.min(score).over(window), F.max(score).over(window)
    return F.when(high > low, (score - low) / (high - low)).otherwise(0.0)
