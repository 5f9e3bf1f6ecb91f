"""Traces, feedback, audit and request counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import rounded
from .ranking import beside


def spans(names: list[str], durations: list[Column], metadata: list[Column] | None = None) -> Column:
    """ARRAY of STRUCT(name, duration_ms, metadata) for one trace."""
    metadata = metadata or [F.create_map().cast("map<string,string>")] * len(names)
    return F.array(*[
        F.struct(F.lit(n).alias("name"), rounded(d.cast("double"), 2).alias("duration_ms"), m.alias("metadata"))
        for n, d, m in zip(names, durations, metadata)
    ])


def trace_summary(traces: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    blocked = F.count_if(F.col("guardrail_action") == "block")
    return traces.agg(
        n.alias("total_queries"), rounded(F.coalesce(F.avg("total_latency_ms"), F.lit(0.0)), 1).alias("avg_latency_ms"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"), F.lit(0.0).alias("estimated_cost_usd"),
        rounded(blocked / F.greatest(F.lit(1), n), 3).alias("guardrail_block_rate"),
        F.count_if(F.col("hallucination_risk") == "high").alias("high_hallucination_count"),
    )


def feedback_summary(feedback: DataFrame) -> DataFrame:
    return feedback.agg(
        F.count(F.lit(1)).alias("feedback_count"),
        rounded(F.coalesce(F.avg("rating"), F.lit(0.0)), 2).alias("avg_rating"),
        F.count_if(F.col("thumbs") > 0).alias("thumbs_up"), F.count_if(F.col("thumbs") < 0).alias("thumbs_down"),
    )


def metrics_summary(traces: DataFrame, feedback: DataFrame) -> DataFrame:
    """Both summaries in one row."""
    return beside(trace_summary(traces), feedback_summary(feedback))


def recent(df: DataFrame, limit: int, key: str, action: str | None = None) -> DataFrame:
    """Newest rows; equal times by key."""
    if action is not None:
        df = df.where(F.col("guardrail_action") == action)
    return df.orderBy(F.desc("created_at"), F.asc(key)).limit(limit)


def request_metrics(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Request counts per (method, endpoint, status) and duration sum and count per (method, endpoint)."""
    method = F.upper("method").alias("method")
    counts = requests.groupBy(method, "endpoint", "status").agg(F.count(F.lit(1)).alias("requests"))
    durations = requests.groupBy(method, "endpoint").agg(
        F.sum("seconds").alias("seconds"), F.count(F.lit(1)).alias("requests")
    )
    return counts, durations


def prometheus_lines(requests: DataFrame) -> DataFrame:
    """(section, line) in exposition order when sorted; labels are few, rows are already aggregated."""
    counts, durations = request_metrics(requests)
    total, seconds = "rag_http_requests_total", "rag_http_request_duration_seconds"
    heads = requests.sparkSession.createDataFrame(
        [
            (0, "", 0, f"# HELP {total} Total number of HTTP requests processed by endpoint and status."),
            (0, "", 1, f"# TYPE {total} counter"),
            (1, "", 0, f"# HELP {seconds} HTTP request duration in seconds."),
            (1, "", 1, f"# TYPE {seconds} summary"),
        ], "section int, sort_key string, position int, line string")
    labels = F.format_string('{endpoint="%s",method="%s"', "endpoint", "method")
    rows = counts.select(
        F.lit(0).alias("section"), F.concat_ws("\x01", "method", "endpoint", F.lpad(F.col("status").cast("string"), 6, "0")).alias("sort_key"),
        F.lit(2).alias("position"),
        F.concat(F.lit(total), labels, F.format_string(',status="%s"} %d', F.col("status").cast("string"), "requests")).alias("line"),
    )
    key = F.concat_ws("\x01", "method", "endpoint")
    for position, suffix, value in ((2, "_sum", F.format_string("} %.6f", "seconds")), (3, "_count", F.format_string("} %d", "requests"))):
        rows = rows.unionByName(durations.select(
            F.lit(1).alias("section"), key.alias("sort_key"), F.lit(position).alias("position"),
            F.concat(F.lit(seconds + suffix), labels, value).alias("line"),
        ))
    return heads.unionByName(rows)


def curated_samples(traces: DataFrame, feedback: DataFrame, min_rating: int = 4) -> DataFrame:
    """(input, output) of well-rated or corrected answers."""
    good = (F.col("thumbs") > 0) | (F.col("rating") >= min_rating) | F.col("corrected_answer").isNotNull()
    joined = traces.where(F.col("answer_text").isNotNull()).join(
        feedback.where(good), traces["id"] == feedback["trace_id"]
    )
    return joined.select(
        F.col("trace_id"), F.col("query_text").alias("input"), F.coalesce("corrected_answer", "answer_text").alias("output")
    ).where((F.col("input") != "") & (F.col("output") != ""))
