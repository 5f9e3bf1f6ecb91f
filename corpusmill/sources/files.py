"""Files to text and tables: binary files, delimited files, Markdown tables, JSON records."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import as_col
from . import formats

PARSED_TYPE = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("mime_type", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("error", T.StringType()),
])


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(name, payload) of every file below a folder."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return raw.select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").alias("payload")
    )


def parse_documents(df: DataFrame, name: str = "name", payload: str = "payload", mime: str | None = None) -> DataFrame:
    """Adds ``parsed``: text, MIME type, metadata, or the error of a file that cannot be read."""

    @F.pandas_udf(PARSED_TYPE)
    def parse(names: pd.Series, payloads: pd.Series, mimes: pd.Series) -> pd.DataFrame:
        rows = []
        for n, data, m in zip(names, payloads, mimes):
            try:
                body, kind, metadata = formats.parse_document(n, bytes(data), m)
                rows.append((body, kind, {k: str(v) for k, v in metadata.items()}, None))
            except Exception as problem:
                rows.append((None, None, None, str(problem)))
        return pd.DataFrame(rows, columns=[f.name for f in PARSED_TYPE])

    kind = F.col(mime) if mime else F.lit(None).cast("string")
    return df.withColumn("parsed", parse(F.col(name), F.col(payload), kind))


IMAGES = "array<struct<page:int,image_index:int,name:string,data_size:int>>"


def pdf_images(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per image embedded in a PDF; files without any yield none."""

    @F.pandas_udf(IMAGES)
    def scan(payloads: pd.Series) -> pd.Series:
        names = ("page", "image_index", "name", "data_size")
        return payloads.map(lambda p: [dict(zip(names, row)) for row in formats.pdf_images(bytes(p))], na_action="ignore")

    keep = [c for c in df.columns if c != payload]
    return df.select(*keep, F.inline(scan(F.col(payload))))


@F.pandas_udf(T.StringType())
def _decode(payloads: pd.Series) -> pd.Series:
    return payloads.map(lambda p: formats.decode_bytes(bytes(p)), na_action="ignore")


def decode_bytes(payload: Column) -> Column:
    return _decode(payload)


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """A CSV or TSV file as a table of strings; a row of another width fails the read."""
    if delimiter not in (",", "\t"):
        raise ValueError("delimiter is a comma or a tab")
    df = spark.read.csv(path, header=True, sep=delimiter, inferSchema=False, mode="FAILFAST", escape='"', multiLine=True,
                        enforceSchema=False)
    check_header(df.columns)
    return df.where(~F.forall(F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in df.columns]), lambda v: F.trim(v) == ""))


def check_header(columns: list[str]) -> None:
    bare = [c.strip() for c in columns]
    if not bare or any(not c or len(c) > 128 or min(map(ord, c)) < 32 for c in bare):
        raise ValueError("header names must be 1 to 128 printable characters")
    if len({c.casefold() for c in bare}) != len(bare):
        raise ValueError("header names repeat when case is ignored")


def records_table(df: DataFrame, key: str, record: str, columns: list[str] | None = None) -> DataFrame:
    """Map records as a table; without a column list, the union of the keys in sorted order.

    A table holds its column names on the driver in any case.
    """
    if columns is None:
        keys = df.select(F.explode(F.map_keys(record)).alias("k")).distinct().orderBy("k")
        columns = [r["k"] for r in keys.collect()]
    check_header(columns)
    return df.select(key, *[F.try_element_at(F.col(record), F.lit(c)).alias(c) for c in columns])


TABLE_ROWS = T.ArrayType(T.StructType([
    T.StructField("table_index", T.IntegerType()), T.StructField("row_index", T.IntegerType()),
    T.StructField("cells", T.ArrayType(T.StringType())),
]))
# A table row stands between bars; a rule row holds dashes alone and is no row of the table.
_ROW = re.compile(r"\s*\|(?P<cells>.*)\|\s*|\s*\|\s*", re.S)
_RULES = re.compile(r"(?:\s*:?-{3,}:?\s*\|)*\s*:?-{3,}:?\s*")


def _table_blocks(text: str) -> Iterator[list[list[str]]]:
    """Runs of lines that are table rows, as cells, without rule rows."""
    for is_row, run in groupby(map(_ROW.fullmatch, text.splitlines()), key=bool):
        inner = [m["cells"] or "" for m in run if not _RULES.fullmatch(m["cells"] or "")] if is_row else []
        if inner:
            yield [[cell.strip().replace("\\|", "|") for cell in line.split("|")] for line in inner]


def markdown_tables(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table_index, row_index, cells) of every Markdown table with two or more even rows."""

    @F.pandas_udf(TABLE_ROWS)
    def scan(texts: pd.Series) -> pd.Series:
        def rows(value: str) -> list[dict]:
            good = [b for b in _table_blocks(value) if len(b) >= 2 and len({len(r) for r in b}) == 1]
            return [
                {"table_index": t, "row_index": i, "cells": cells} for t, block in enumerate(good) for i, cells in enumerate(block)
            ]

        return texts.map(rows, na_action="ignore")

    piped = df.where(F.col(text).contains("|"))
    return piped.select(key, F.inline(scan(F.col(text))))


def schema_fields(answer: Column | str, fields: dict[str, str]) -> Column:
    """STRUCT of fixed fields read from a JSON answer: "string" or "list" of strings."""
    kinds = {"string": "string", "list": "array<string>"}
    schema = ", ".join(f"`{name}` {kinds[kind]}" for name, kind in fields.items())
    return F.from_json(as_col(answer), schema)


# Extraction schemas of documents.
EXTRACTION_SCHEMAS = {
    "공문서_메타데이터": {
        "문서번호": "string", "시행일자": "string", "발신기관": "string", "수신기관": "string", "문서제목": "string",
        "담당부서": "string", "담당자": "string", "핵심요약": "string", "주요키워드": "list",
    },
    "행정처분_요약": {
        "대상자_또는_업체명": "string", "처분종류": "string", "위반법령": "string", "위반일자": "string", "처분일자": "string",
        "주요위반내용": "string", "이행기한_또는_정지기간": "string",
    },
    "사업계획_요약": {
        "사업명": "string", "총사업예산": "string", "사업기간": "string", "주관부서": "string", "추진목적": "string",
        "주요과업목록": "list", "기대효과": "string",
    },
}


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Instruction samples: one JSON object per line, or an array or single object in a file."""
    return spark.read.json(path, multiLine=not path.endswith(".jsonl"))


GOLDEN_ACTIONS = ["allow", "mask", "flag", "block"]


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden questions with ``valid``: a question, a truth unless unscored, a known action."""
    schema = (
        "query string, ground_truth string, expected_sources array<string>, expected_guardrail_action string, evaluate_answer boolean"
    )
    df = spark.read.schema(schema).json(path)
    scored = F.coalesce("evaluate_answer", F.lit(True))
    ok = (
        (F.trim(F.coalesce("query", F.lit(""))) != "")
        & (~scored | (F.trim(F.coalesce("ground_truth", F.lit(""))) != ""))
        & (F.col("expected_guardrail_action").isNull() | F.col("expected_guardrail_action").isin(GOLDEN_ACTIONS))
    )
    return df.withColumn("valid", ok)
