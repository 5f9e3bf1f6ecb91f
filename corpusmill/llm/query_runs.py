"""op12: periodic runs of all documents, some of them made periodic, and their words without the repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fold, read, text_of
from .registry import query
from .runs import collapsed


def repeated_tails(docs: DataFrame) -> DataFrame:
    """doc_id, text: in one of ten documents by crc32 of the id the words from place a on repeat with period p."""
    h = fold("doc_id", 1 << 32)
    rows = docs.select("doc_id", "text", h.alias("_h")).withColumn(
        "_w", F.when(F.col("_h") % 10 == 0, F.regexp_extract_all(text_of("text"), F.lit(WORD), F.lit(0)))
    ).withColumn("_n", F.size("_w")).withColumn("_g", F.floor(F.col("_h") / 10)).withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    rows = rows.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    tail = F.transform("_w", lambda w, i: F.when(i < F.col("_a"), w).otherwise(
        F.get("_w", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))
    ))
    return rows.select("doc_id", F.when(F.col("_a").isNotNull(), F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


def _longest(runs: str) -> Column:
    """The run of greatest length, of these the one of smallest start, then period; null without runs."""
    least = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    return F.struct(least["s"].alias("start"), (-least["l"]).alias("length"), least["p"].alias("period"))


@query("op12_periodic_runs")
def periodic_runs(spark, folder):
    rows = collapsed(repeated_tails(read(spark, folder, "documents"))).withColumn("_best", _longest("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", *[r[part].cast("string") for part in ("start", "length", "period")]), F.lit("\n")
    )), "")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
