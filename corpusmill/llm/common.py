"""Shared pieces: words, empty texts, and the join of many rows with one row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: A key is hot when it holds more than one in HOT_SHARE of all rows, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def keyed_join(rows: DataFrame, keys: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of `rows` with `keys`, which has one row per key and in `n` how many rows that key has.

    Keys with more than a thousandth of `total` rows are broadcast: there can be no more than a thousand of them.
    All others meet in a shuffle, in which no key is large. Null keys match null keys.
    `rows` is read twice and should be narrow and written down before.
    """
    right = keys.withColumnRenamed(key, "_key")
    hot, cold = (right.where(F.col(n) * HOT_SHARE > total), right.where(F.col(n) * HOT_SHARE <= total))
    same = F.col(key).eqNullSafe(F.col("_key"))
    matched = rows.join(F.broadcast(hot), same)
    rest = rows.join(F.broadcast(hot.select("_key")), same, "left_anti").join(cold.hint("shuffle_merge"), same)
    return matched.unionByName(rest).drop("_key")


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id written as text (null: empty), modulo `modulus`: deals rows into folds that do not depend on the table."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def row_key(id_column: str = "doc_id", text: str = "text") -> Column:
    """What tells rows apart: the id and a hash of the text. Nulls are values like others in it."""
    return F.struct(F.col(id_column).alias("id"), F.xxhash64(text).alias("hash"))


def unused(name: str, columns: list[str]) -> str:
    """`name`, with as many underscores behind it as no column has, in capitals or not."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def packed(docs: DataFrame, **parts: Column) -> DataFrame:
    """`parts` as columns of their own and all columns of `docs` in one struct `row`, so that no name of theirs can clash; see `unpacked`."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(name) for name, c in parts.items()])


def unpacked(rows: DataFrame) -> DataFrame:
    """The columns that `packed` put into `row`."""
    return rows.select("row.*")


def keep_rows(docs: DataFrame, keys: DataFrame, id_column: str = "doc_id", text: str = "text", once: bool = False) -> DataFrame:
    """The rows of `docs` whose `row_key` is in `keys` (column `_row`, no repeats), all columns kept; `once`: the first of each key."""
    out = packed(docs, key=row_key(id_column, text)).join(keys, F.col("key") == F.col("_row"), "left_semi")
    if once:
        out = out.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("key"))).where("nth = 1")
    return unpacked(out)
