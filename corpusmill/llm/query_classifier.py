"""op6: quality scores of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .classifier import scored
from .common import read
from .registry import query


@query("op6_quality_scores")
def quality_scores(spark, folder):
    rows = scored(read(spark, folder, "documents"), read(spark, folder, "labels"))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
