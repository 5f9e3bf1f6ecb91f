"""Writing traces, curated samples and metric lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.samples import CURATED_INSTRUCTION


def append_traces(traces: DataFrame, path: str) -> None:
    """One JSON object per trace."""
    traces.write.mode("append").json(path)


def export_curated(samples: DataFrame, path: str) -> None:
    """Curated (input, output) pairs as instruction samples, one JSON object per line."""
    samples.select(F.lit(CURATED_INSTRUCTION).alias("instruction"), "input", "output").write.mode("overwrite").json(path)


def export_conversations(samples: DataFrame, path: str) -> None:
    """Instruction samples as two-turn conversations."""
    turn = lambda who, text: F.struct(F.lit(who).alias("from"), text.alias("value"))
    user = F.when(F.col("input") == "", F.col("instruction")).otherwise(F.concat_ws("\n\n", "instruction", "input"))
    samples.select(F.array(turn("human", user), turn("gpt", F.col("output"))).alias("conversations")).write.mode("overwrite").json(path)


def write_metric_lines(lines: DataFrame, path: str) -> None:
    """Exposition text; the rows are one per label set, so one sorted file is small."""
    lines.orderBy("section", "sort_key", "position").select("line").coalesce(1).write.mode("overwrite").text(path)
