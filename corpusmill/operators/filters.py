"""Search and table predicates; each is a plain Column so that it reaches the scan."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import as_col

# Fixed value: the department whose documents everyone may read.
SHARED_DEPARTMENT = "전사공통"


@dataclass(frozen=True)
class SearchScope:
    """Which chunks a search may return; None leaves a field unrestricted."""

    document_id: object = None
    document_ids: tuple = ()
    min_quality: int | None = None
    project: str | None = None
    department: str | None = None
    max_security: int | None = None
    strict_department: bool = False


def security_level(value: Column | str) -> Column:
    return F.coalesce(as_col(value).try_cast("int"), F.lit(1))


def department_allowed(value: Column | str, department: str, strict: bool = False) -> Column:
    """Unlabelled and shared chunks pass; ``strict`` asks for equality, unlabelled being shared."""
    value = as_col(value)
    if strict:
        return F.coalesce(value, F.lit(SHARED_DEPARTMENT)) == department
    return value.isNull() | value.isin(department, SHARED_DEPARTMENT)


def in_scope(df: DataFrame, scope: SearchScope, department: str = "department", security: str = "security_level",
             quality: str = "quality_score", project: str = "project_name") -> DataFrame:
    if scope.document_id is not None:
        df = df.where(F.col("document_id") == scope.document_id)
    elif scope.document_ids:
        df = df.where(F.col("document_id").isin(*scope.document_ids))
    if scope.min_quality is not None:
        df = df.where(F.coalesce(F.col(quality), F.lit(0)) >= scope.min_quality)
    if scope.project is not None:
        df = df.where(F.col(project) == scope.project)
    if scope.department is not None:
        df = df.where(department_allowed(department, scope.department, scope.strict_department))
    if scope.max_security is not None:
        df = df.where(security_level(security) <= scope.max_security)
    return df


def search_documents(df: DataFrame, pattern: str, name: str = "source_name", content: str = "content") -> DataFrame:
    """Case-insensitive substring search; % and _ in the pattern stay wild cards."""
    like = f"%{pattern}%"
    return df.where(F.col(name).ilike(like) | F.col(content).ilike(like))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def redact_query(value: Column | str) -> Column:
    value = as_col(value)
    return F.when(value.startswith("omitted;"), value).otherwise("legacy_query_redacted")


def without_fields(struct: Column, names: list[str]) -> Column:
    return struct.dropFields(*names)


# Normalized key names that never leave a report.
OMITTED_KEYS = [
    "sampletext", "sourcetext", "rawtext", "textexcerpt", "originalfilename", "uploadedfilename",
    "rawbytes", "datafiedtext", "extractedtext", "content", "suggestion", "linenumber",
    "uploadedpath", "filepath",
]
OMITTED_DETAIL_KEYS = ["snippet", "original", "matched_text"]


def _is_omitted(key: str) -> bool:
    return re.sub("[_-]", "", key.lower()) in OMITTED_KEYS


def _cleaned(value):
    """A JSON value without omitted keys at any depth."""
    if isinstance(value, dict):
        return {k: _cleaned(v) for k, v in value.items() if not _is_omitted(k)}
    return [_cleaned(v) for v in value] if isinstance(value, list) else value


def _cleaned_text(text: str) -> str | None:
    try:
        return json.dumps(_cleaned(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
    except ValueError:
        return None if any(_is_omitted(k) for k in re.findall(r"[A-Za-z_-]+", text)) else text


@F.pandas_udf(T.ArrayType(T.StringType()))
def _cleaned_values(values: pd.Series) -> pd.Series:
    return values.map(lambda some: [None if v is None else _cleaned_text(v) for v in some], na_action="ignore")


def drop_source_keys(mapping: Column | str) -> Column:
    """Map of strings without keys whose lower-case form, dashes and underscores removed, is on the list.

    Values that are JSON objects or arrays lose such keys at every depth; one that looks like
    JSON but cannot be read becomes null if it names such a key. Maps without a nested value
    do not reach Python.
    """
    kept = F.map_filter(as_col(mapping), lambda k, _v: ~F.regexp_replace(F.lower(k), "[_-]", "").isin(OMITTED_KEYS))
    nested = F.exists(F.map_values(kept), lambda v: v.rlike(r"^\s*[\[{]"))
    values = _cleaned_values(F.when(nested, F.map_values(kept)))
    return F.when(nested, F.map_from_arrays(F.map_keys(kept), values)).otherwise(kept)


def safe_report(report: Column | str, details: str | None = "pii_details") -> Column:
    """Quality report struct without the cleaned text, and its findings without the text that was found.

    ``details`` names the array of findings; None for reports that have none.
    """
    report = as_col(report)
    safe = report.dropFields("cleaned_text")
    if details is None:
        return safe
    return safe.withField(details, F.transform(report[details], lambda d: d.dropFields(*OMITTED_DETAIL_KEYS)))


def source_metadata(metadata: Column | str) -> Column:
    return F.map_filter(as_col(metadata), lambda k, _v: k != "parent_text")


def app_response(df: DataFrame, mask) -> DataFrame:
    """Answer projection for an application: masked again, cut to its limits, score in 0..1."""
    out = df
    for name, limit in (("answer", 4000), ("text", 1200), ("source_name", 256)):
        if name in df.columns:
            out = out.withColumn(name, F.substring(mask(F.col(name)), 1, limit))
    if "score" in df.columns:
        out = out.withColumn("score", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)))
    return out
