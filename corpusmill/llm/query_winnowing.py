"""op1: fingerprints of all documents, of their edited texts and of the documents that follow them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import read, text_of
from .registry import query
from .winnowing import hashes, likeness, with_fingerprint, written

#: Rows that share a task when each is given the next one, and how many such groups are told apart at most by quantiles.
GROUP_ROWS, GROUPS = 1024, 16384


def _group(bounds: list[int], column: str) -> Column:
    """How many of the ascending bounds are no larger than the value, by binary search; -1 for null."""
    if not bounds:
        return F.when(F.col(column).isNull(), -1).otherwise(0)
    table, steps = F.array(*map(F.lit, bounds)), len(bounds).bit_length()
    found = F.aggregate(
        F.array(*[F.lit(1 << k) for k in reversed(range(steps))]), F.lit(0),
        lambda at, step: F.when(
            (at + step <= len(bounds)) & (F.element_at(table, F.least(at + step, F.lit(len(bounds)))) <= F.col(column)), at + step
        ).otherwise(at),
    )
    return F.when(F.col(column).isNull(), -1).otherwise(found)


def with_next(docs: DataFrame, id_column: str, text: str, payload: str, paid: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds `payload`, which `paid` makes of the text, and `_next` (struct of text and payload): the next row by descending id, the
    first again after the last.

    Null ids come last; rows that repeat an id follow each other by a hash of their text. Ids are cut at quantiles into groups that
    one task orders; the last row of a group is given the first row of the next one, of which there is one a group.
    """
    n = docs.count()
    parts = max(1, min(GROUPS, n // GROUP_ROWS))
    shares = [i / parts for i in range(1, parts)]
    bounds = sorted(set(docs.agg(F.percentile_approx(id_column, F.array(*map(F.lit, shares)), F.lit(10 * parts))).first()[0] or [])) if shares else []
    tie = F.xxhash64(text)
    # Texts move before they are worked on, so that only they do.
    rows = paid(docs.withColumn("_group", _group(bounds, id_column)).withColumn("_tie", tie).repartition("_group"))
    order = Window.partitionBy("_group").orderBy(F.col(id_column).desc_nulls_last(), "_tie")
    rows = rows.withColumn("_next", F.lead(F.struct(F.col(text).alias("text"), F.col(payload).alias("payload"))).over(order))
    ids = docs.select(F.col(id_column).alias("_id")).withColumn("_of", _group(bounds, "_id"))
    around = Window.orderBy("_of")
    heads = ids.groupBy("_of").agg(F.max("_id").alias("_first"))
    linked = heads.withColumn("_after", F.coalesce(F.lead("_of").over(around), F.min("_of").over(around))).drop("_of")
    # One row a group, at most GROUPS + 1.
    opening = docs.join(F.broadcast(linked), F.col(id_column).eqNullSafe(F.col("_first"))).groupBy("_after").agg(
        F.min(F.struct(tie.alias("t"), F.col(text).alias("text"))).alias("_o")
    ).select("_after", F.col("_o.text").alias(text))
    opening = paid(opening).select("_after", F.struct(F.col(text).alias("text"), F.col(payload).alias("payload")).alias("_opening"))
    return rows.join(opening.hint("merge"), F.col("_group") == F.col("_after")).withColumn(
        "_next", F.coalesce("_next", "_opening")
    ).drop("_group", "_tie", "_after", "_opening")


@query("op1_winnowing")
def winnowing(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", text_of("text").alias("text"))
    rows = with_next(docs, "doc_id", "text", "own", lambda df: with_fingerprint(df, "text", "own"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left(F.col("_next.text"), half))
    rows = rows.select("doc_id", "text", "own", F.col("_next.payload").alias("next"), edited.alias("edited"))
    rows = with_fingerprint(rows, "edited", "changed").withColumn("_own", F.array_distinct(hashes("own")))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written("own").alias("fingerprint"), written("changed").alias("edited_fingerprint"),
        likeness("_own", F.array_distinct(hashes("changed"))).alias("near_edited"),
        likeness("_own", F.array_distinct(hashes("next"))).alias("near_next"),
    )
