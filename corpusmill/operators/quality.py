"""Text quality scores per document; no shuffle, everything is computed within the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pii import masked_text, pii_spans, scan_pii
from ..functions.terms import replace_terms, term_counts
from ..functions.text import SPACE_CLASS, as_col, let, lines, non_empty_lines, normalize_text, rounded, strip

RULES_TEXT = "baseline-text-v1"
RULES_ENTERPRISE = "enterprise-local-v1"
# Grades, issue codes and their severity.
ENTERPRISE_GRADES = ["로컬 1단계 (참고)", "로컬 2단계 (참고)", "로컬 3단계 (참고)"]
ISSUES = {
    "EMPTY_DOCUMENT": "error", "SHORT_DOCUMENT": "warning", "ENCODING_REPLACEMENT": "warning",
    "CONTROL_CHARACTERS": "warning", "DUPLICATED_LINES": "warning", "REPEATED_LINES": "info",
    "MISSING_SOURCE_NAME": "warning",
}
CONTROL = r"[\x00-\x08\x0b-\x1f]"


def text_measures(value: Column | str) -> Column:
    """STRUCT of counts and ratios of one text; the text is split into lines once."""
    value = as_col(value)

    def of_text(text: Column) -> Column:
        def of_lines(split: Column) -> Column:
            def of_kept(kept: Column) -> Column:
                line_count = F.when(text == "", 0).otherwise(F.size(split))
                kept_count = F.size(kept)
                repeats = kept_count - F.size(F.array_distinct(kept))
                return F.struct(
                    F.length(text).alias("char_count"),
                    line_count.alias("line_count"),
                    kept_count.alias("non_empty_line_count"),
                    F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")).alias("word_count"),
                    F.regexp_count(text, F.lit("�")).alias("replacement_count"),
                    F.regexp_count(text, F.lit(CONTROL)).alias("control_count"),
                    F.coalesce((line_count - kept_count) / F.nullif(line_count, F.lit(0)), F.lit(0.0)).alias("blank_ratio"),
                    F.coalesce(repeats / F.nullif(kept_count, F.lit(0)), F.lit(0.0)).alias("duplicate_ratio"),
                )

            return let(non_empty_lines(split), of_kept)

        return let(lines(text), of_lines)

    return let(value, of_text)


def text_quality(df: DataFrame, text: str = "text", source: str = "source_name", normalized: bool = False) -> DataFrame:
    """Adds score, status, the measures and the issue codes of the normalized text."""
    base = F.col(text) if normalized else normalize_text(text)
    m = df.withColumn("m", text_measures(base))
    f = lambda name: F.col(f"m.{name}")
    unnamed = strip(F.coalesce(F.col(source), F.lit(""))) == ""
    empty = f("char_count") == 0
    present = ~empty
    tests = {
        "EMPTY_DOCUMENT": empty,
        "SHORT_DOCUMENT": present & (f("char_count") < 100),
        "ENCODING_REPLACEMENT": present & (f("replacement_count") > 0),
        "CONTROL_CHARACTERS": present & (f("control_count") > 0),
        "DUPLICATED_LINES": present & (f("duplicate_ratio") >= 0.25),
        "REPEATED_LINES": present & (f("duplicate_ratio") >= 0.10) & (f("duplicate_ratio") < 0.25),
        "MISSING_SOURCE_NAME": present & unnamed,
    }
    penalty = (
        F.when(f("char_count") < 100, 15).otherwise(0)
        + F.least(F.lit(30), f("replacement_count") * 2)
        + F.least(F.lit(20), f("control_count") * 2)
        + F.when(f("duplicate_ratio") >= 0.25, 20).when(f("duplicate_ratio") >= 0.10, 8).otherwise(0)
        + F.when(unnamed, 5).otherwise(0)
    )
    score = F.when(empty, 0).otherwise(F.greatest(F.lit(0), F.lit(100) - penalty))
    return (
        m.withColumn("score", score)
        .withColumn("status", F.when(F.col("score") >= 90, "pass").when(F.col("score") >= 70, "warn").otherwise("fail"))
        .withColumn("issues", F.array_compact(F.array(*[F.when(test, code) for code, test in tests.items()])))
        .withColumn("rule_set_version", F.lit(RULES_TEXT))
        .select(
            *df.columns, "score", "status", "issues", "rule_set_version",
            *[f(n).alias(n) for n in ("char_count", "line_count", "non_empty_line_count", "word_count", "replacement_count", "control_count")],
            rounded(f("blank_ratio"), 4).alias("blank_line_ratio"),
            rounded(f("duplicate_ratio"), 4).alias("duplicate_line_ratio"),
        )
    )


def issue_structs(codes: Column | str) -> Column:
    """Issue codes with their severity."""
    severity = F.create_map(*[F.lit(x) for pair in ISSUES.items() for x in pair])
    return F.transform(as_col(codes), lambda c: F.struct(F.element_at(severity, c).alias("severity"), c.alias("code")))


def enterprise_quality(df: DataFrame, text: str = "text", mask: bool = True, replace: bool = True) -> DataFrame:
    """Adds five 20-point pillars, total, grade, personal-data and term findings, cleaned text."""
    scanned = df.withColumn("__scan", scan_pii(text))
    masked = masked_text(F.col("__scan"), text) if mask else F.col(text)
    work = (
        scanned.withColumn("__spans", pii_spans(F.col("__scan")))
        .withColumn("__masked", masked)
        .withColumn("standardized_terms", term_counts("__masked"))
        .withColumn("cleaned_text", replace_terms("__masked") if replace else F.col("__masked"))
        .withColumn("m", text_measures("cleaned_text"))
    )
    f = lambda name: F.col(f"m.{name}")
    found = F.size("__spans")
    pillars = {
        "completeness": F.lit(20) - F.when(f("char_count") < 100, 10).otherwise(0) - F.when(f("blank_ratio") > 0.4, 5).otherwise(0),
        "validity": F.lit(20) - F.least(F.lit(10), f("control_count")),
        "consistency": F.lit(20) - F.when(f("duplicate_ratio") >= 0.25, 12).when(f("duplicate_ratio") >= 0.10, 5).otherwise(0),
        "integrity": F.lit(20) - (F.least(F.lit(5), found) if mask else F.least(F.lit(15), found * 5)),
        "accuracy": F.lit(20) - F.least(F.lit(15), f("replacement_count") * 3),
    }
    total = sum(pillars.values(), F.lit(0))
    score = F.when(f("char_count") == 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), total)))
    by_score = lambda top, middle, low: F.when(F.col("score") >= 90, top).when(F.col("score") >= 70, middle).otherwise(low)
    term_total = F.aggregate(F.map_values("standardized_terms"), F.lit(0), lambda a, n: a + n)
    return (
        work.withColumn("score", score)
        .withColumn("pii_detected_count", found)
        .withColumn("standardized_terms_count", term_total)
        .select(
            *df.columns, "score", by_score(*ENTERPRISE_GRADES).alias("grade"), by_score("pass", "warn", "fail").alias("status"),
            *[p.alias(name) for name, p in pillars.items()],
            "pii_detected_count", F.col("__spans").alias("pii_details"),
            "standardized_terms_count", "standardized_terms",
            (F.lit(mask) & (F.col("pii_detected_count") > 0)).alias("pii_masking_applied"),
            (F.lit(replace) & (F.col("standardized_terms_count") > 0)).alias("standardization_applied"),
            (f("duplicate_ratio") >= 0.15).alias("repeated_paragraphs"),
            f("replacement_count").alias("replacement_count"),
            "cleaned_text", F.lit(RULES_ENTERPRISE).alias("rule_set_version"),
        )
    )


def recommendations(df: DataFrame) -> Column:
    """Codes of what to review, from an ``enterprise_quality`` result."""
    return F.array_compact(F.array(
        F.when(F.col("pii_detected_count") > 0, F.when(F.col("pii_masking_applied"), "PII_MASKED").otherwise("PII_FOUND")),
        F.when(F.size("standardized_terms") > 0, "TERM_CANDIDATES"),
        F.when(F.col("replacement_count") > 0, "ENCODING_REPLACEMENT"),
        F.when(F.col("repeated_paragraphs"), "REPEATED_PARAGRAPHS"),
    ))
