"""Comparison of an original document with its cleaned version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_col, rounded


def rule_changes(original: Column | str, cleaned: Column | str, comparable: Column) -> Column:
    """STRUCT(resolved, introduced, remaining, unmeasured) of sorted rule ids."""
    a, b = F.array_distinct(as_col(original)), F.array_distinct(as_col(cleaned))
    none = F.array().cast("array<string>")
    measured = lambda value: F.when(comparable, F.array_sort(value)).otherwise(none)
    return F.struct(
        measured(F.array_except(a, b)).alias("resolved"), measured(F.array_except(b, a)).alias("introduced"),
        measured(F.array_intersect(a, b)).alias("remaining"),
        F.when(comparable, none).otherwise(F.array_sort(F.array_union(a, b))).alias("unmeasured"),
    )


def compare_documents(original: DataFrame, cleaned: DataFrame, key: str = "document_id") -> DataFrame:
    """Join both versions on their id; deltas only where the same parser read the same format.

    Each side: key, extension, parser, ocr_version, score, issues (rule ids), char_count.
    """
    names = ["extension", "parser", "ocr_version", "score", "issues", "char_count"]
    side = lambda df, p: df.select(key, *[F.col(n).alias(f"{p}_{n}") for n in names])
    both = side(original, "original").join(side(cleaned, "cleaned"), key)
    same = lambda n: F.col(f"original_{n}").eqNullSafe(F.col(f"cleaned_{n}"))
    comparable = same("extension") & same("parser") & same("ocr_version")
    work = both.withColumn("comparable", comparable).withColumn(
        "changes", rule_changes("original_issues", "cleaned_issues", F.col("comparable"))
    )
    delta = lambda n: F.when(F.col("comparable"), F.col(f"cleaned_{n}") - F.col(f"original_{n}"))
    return work.select(
        key, "comparable", F.when(F.col("comparable"), "measured").otherwise("unmeasured").alias("status"),
        rounded(delta("score").cast("double"), 1).alias("score_delta"), delta("char_count").alias("extracted_character_delta"),
        F.when(F.col("comparable"), F.size("cleaned_issues") - F.size("original_issues")).alias("issue_count_delta"),
        "changes.*",
    )


def matching_blocks(original: DataFrame, cleaned: DataFrame, key: str = "document_id") -> DataFrame:
    """Multiset overlap of structure blocks (key, kind, text) of the two versions per document."""
    count = lambda df, n: df.groupBy(key, "kind", "text").agg(F.count(F.lit(1)).alias(n))
    both = count(original, "o").join(count(cleaned, "c"), [key, "kind", "text"], "full")
    o, c = F.coalesce("o", F.lit(0)), F.coalesce("c", F.lit(0))
    return both.groupBy(key).agg(
        F.sum(o).alias("original_candidate_count"), F.sum(c).alias("cleaned_candidate_count"),
        F.sum(F.least(o, c)).alias("exact_matching_candidate_count"),
        F.sum(o - F.least(o, c)).alias("removed_candidate_count"),
        F.sum(c - F.least(o, c)).alias("introduced_candidate_count"),
    )
