"""Structural quality of a table of any width, in two aggregations over one unpivoted pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import rounded, strip, valid_calendar_date
from .ranking import beside, top_k

# Value shapes, domain labels, null spellings.
DATE = r"^\d{4}([-/.])\d{2}\1\d{2}$"
PHONE = r"^01[016789]-?\d{3,4}-?\d{4}$"
EMAIL = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"
PLAIN_NUMBER = r"^(?=.*\d)\d*\.?\d*$"
DOMAINS = {"date": "날짜 (YYYY-MM-DD)", "phone": "연락처 (전화번호)", "email": "이메일", "number": "숫자형 도메인"}
OTHER_DOMAIN = "일반 텍스트"
NULL_WORDS = ["null", "none", "nan", "-"]
GRADES = [(95, "로컬 1단계 (참고)"), (80, "로컬 2단계 (참고)")]
LOWEST_GRADE = "로컬 3단계 (참고)"


def is_null_value(value: Column) -> Column:
    return value.isNull() | (strip(value) == "") | F.lower(value).isin(NULL_WORDS)


def is_valid_value(value: Column) -> Column:
    """Not the complement of the null test: it trims and is case-sensitive."""
    return value.isNotNull() & ~strip(value).isin(["", *NULL_WORDS])


def cells(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """One row per cell: column position and name, value, row order key."""
    pairs = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"))
        for i, c in enumerate(columns)
    ])
    return df.select(F.struct(*order).alias("row"), F.inline(pairs))


def column_profile(df: DataFrame, order: list[str], columns: list[str] | None = None, sample: int | None = None) -> DataFrame:
    """(column, null_count, null_ratio, unique_count, detected_domain, invalid_format_count).

    The domain is decided by all valid values, or by the first ``sample`` in the row order that
    the columns ``order`` fix.

    Cells are counted by trimmed value before anything else, so shapes are tested once per
    distinct value and a value that fills a third of a column is one row after the map side.
    """
    columns = columns or df.columns
    all_cells = cells(df, columns, order)
    valid = is_valid_value(F.col("value"))
    trimmed = F.col("trimmed")
    shapes = {"date": trimmed.rlike(DATE), "phone": trimmed.rlike(PHONE), "email": trimmed.rlike(EMAIL), "number": trimmed.rlike(PLAIN_NUMBER)}
    fits = {**shapes, "date": valid_calendar_date(trimmed)}

    def counts(n: Column) -> list[Column]:
        votes = [F.sum(F.when(test, n).otherwise(0)).alias(f"votes_{name}") for name, test in shapes.items()]
        return [F.sum(F.when(trimmed.isNotNull(), n).otherwise(0)).alias("voters"), *votes]

    # Values that differ only by outer white space are one valid value.
    merged = all_cells.groupBy("column", F.when(valid, strip("value")).alias("trimmed")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_null_value(F.col("value"))).alias("nulls")
    )
    n = F.col("n")
    found = merged.groupBy("column").agg(
        F.sum("n").alias("total"), F.sum("nulls").alias("null_count"), F.count("trimmed").alias("unique_count"), *counts(n),
        *[F.sum(F.when(trimmed.isNotNull() & ~test, n).otherwise(0)).alias(f"misfits_{name}") for name, test in fits.items()],
    )
    if sample:
        voters = top_k(all_cells.where(valid), ["column"], [F.asc("row")], sample).withColumn("trimmed", strip("value"))
        said = voters.groupBy("column").agg(*counts(F.lit(1)))
        found = found.drop("voters", *[f"votes_{name}" for name in shapes]).join(F.broadcast(said), "column", "left")
    domain = F.lit(None)
    for name in ("number", "email", "phone", "date"):
        votes = F.col(f"votes_{name}")
        enough = votes == F.col("voters") if name == "number" else votes >= F.col("voters") * 0.7
        domain = F.when((F.col("voters") > 0) & enough, name).otherwise(domain)
    found = found.withColumn("domain", domain)
    misfits = [F.when(F.col("domain") == name, F.col(f"misfits_{name}")) for name in fits]
    return found.select(
        "column", "null_count", rounded(F.col("null_count") / F.col("total"), 4).alias("null_ratio"), "unique_count",
        F.coalesce(*[F.when(F.col("domain") == k, v) for k, v in DOMAINS.items()], F.lit(OTHER_DOMAIN)).alias("detected_domain"),
        F.coalesce(*misfits, F.lit(0)).alias("invalid_format_count"), "total",
    )


def key_duplicates(df: DataFrame, key: str) -> DataFrame:
    """(pk_duplicate_count): used key values minus distinct ones; empty, 0 and null are skipped."""
    raw = F.col(f"`{key}`")
    numeric = dict(df.dtypes)[key] not in ("string",)
    used = raw.isNotNull() & ((raw != 0) if numeric else (raw != ""))
    counted = df.where(used).groupBy(strip(raw.cast("string")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return counted.agg((F.coalesce(F.sum("n"), F.lit(0)) - F.count(F.lit(1))).alias("pk_duplicate_count"))


def mismatched_rows(records: DataFrame, keys: Column, order: list[Column]) -> DataFrame:
    """(row_schema_mismatch_count): rows whose key set differs from the first row's."""
    own = F.array_sort(keys)
    first = records.agg(F.min_by(own, F.struct(*order)).alias("expected"))
    return beside(records.select(own.alias("own")), first).agg(
        F.count_if(F.col("own") != F.col("expected")).alias("row_schema_mismatch_count")
    )


def dataset_summary(profile: DataFrame) -> DataFrame:
    """One row of totals and the two penalties that come from single columns."""
    cell_count, nulls = F.sum("total"), F.sum("null_count")
    return profile.agg(
        F.max("total").alias("total_rows"),
        F.count(F.lit(1)).alias("total_columns"),
        rounded(nulls / cell_count, 4).alias("overall_null_ratio"),
        F.greatest(F.lit(0), F.lit(100) - F.floor(nulls / cell_count * 200)).alias("completeness"),
        F.sum(F.least(F.lit(20), F.col("invalid_format_count") * 2)).alias("validity_penalty"),
    )


def evaluate_dataset(df: DataFrame, order: list[str], primary_key: str | None = None,
                     mismatches: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    """One row: score, grade, totals, duplicate keys and rows of another shape."""
    one = dataset_summary(column_profile(df, order, columns))
    for side, name in ((key_duplicates(df, primary_key) if primary_key in df.columns else None, "pk_duplicate_count"),
                       (mismatches, "row_schema_mismatch_count")):
        one = one.withColumn(name, F.lit(0)) if side is None else beside(one, side)
    raw = (
        F.col("completeness") - F.col("validity_penalty") - F.least(F.lit(30), F.col("pk_duplicate_count") * 5)
        - F.least(F.lit(20), F.col("row_schema_mismatch_count") * 2)
    )
    grade = F.lit(LOWEST_GRADE)
    for bound, label in reversed(GRADES):
        grade = F.when(F.col("score") >= bound, label).otherwise(grade)
    return one.withColumn("score", F.least(F.lit(100), F.greatest(F.lit(0), raw))).withColumn("grade", grade).select(
        "score", "grade", "total_rows", "total_columns", "overall_null_ratio", "pk_duplicate_count",
        "row_schema_mismatch_count",
    )
