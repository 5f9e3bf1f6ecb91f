"""Running request counters and the audit sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.filters import redact_query


def running_requests(requests: DataFrame) -> DataFrame:
    """Counts and seconds per method, endpoint and status since the start; complete mode."""
    return requests.groupBy(F.upper("method").alias("method"), "endpoint", "status").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("seconds").alias("seconds")
    )


def audit_sink(entries: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append redacted audit rows batch by batch; a repeated batch replaces its own folder."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.withColumn("query", redact_query("query")).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = entries.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()
