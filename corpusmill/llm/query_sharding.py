"""op2: all documents in sixteen shards of near equal bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import read
from .registry import query
from .sharding import shard_rows


@query("op2_minimax_shards")
def minimax_shards(spark, folder):
    return shard_rows(read(spark, folder, "documents"), 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
