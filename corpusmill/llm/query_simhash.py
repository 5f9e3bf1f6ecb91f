"""op8: near-duplicate groups of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import read
from .registry import query
from .simhash import near_groups


@query("op8_simhash_groups")
def simhash_groups(spark, folder):
    return near_groups(read(spark, folder, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
