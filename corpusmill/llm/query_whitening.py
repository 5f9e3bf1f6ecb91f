"""op13: whitened embeddings, one row for each vector and component."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import read
from .registry import query
from .whitening import whiten


@query("op13_whitened_embeddings")
def whitened_embeddings(spark, folder):
    rows, model, error = whiten(read(spark, folder, "embeddings"))
    shares = [float(v / model.trace) for v in model.values] if model else []
    return rows.select("vec_id", "deviation", F.posexplode("z").alias("_i", "whitened")).select(
        "vec_id", (F.col("_i") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(F.array(*map(F.lit, shares)).cast("array<double>"), F.col("_i")).alias("explained"), F.lit(error).alias("identity_error"),
    )
