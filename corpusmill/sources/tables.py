"""Parquet tables and their reading as documents, questions, traces and requests.

The bindings are ours: they let each computation run over tables of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.vectors import hash_embedding
from ..session import fan_out


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """document_id, source_name, project_name, text; spread over the cores for per-row work."""
    raw = fan_out(table(spark, folder, "documents"), "doc_id")
    return raw.select(
        F.col("doc_id").alias("document_id"), F.col("source").alias("source_name"),
        F.col("lang").alias("project_name"), "text",
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def embedded_questions(spark: SparkSession, folder: str, dim: int = 64) -> DataFrame:
    return questions(spark, folder).withColumn("query_vector", hash_embedding("query_text", dim))


def searchable(spark: SparkSession, folder: str, dim: int = 64) -> DataFrame:
    """Whole documents as chunks with tokens and a hash embedding."""
    return documents(spark, folder).select(
        F.col("document_id").alias("chunk_id"), "document_id", "source_name", "project_name",
        F.col("text").alias("content"), tokens("text").alias("tokens"), hash_embedding("text", dim).alias("embedding"),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return fan_out(table(spark, folder, "embeddings"), "vec_id").select(
        F.col("vec_id").alias("chunk_id"), F.col("label").alias("document_id"), "embedding"
    )


def label_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """One question vector per label: the mean of the label's vectors."""
    exploded = vectors(spark, folder).select("document_id", F.posexplode("embedding").alias("i", "v"))
    means = exploded.groupBy("document_id", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    packed = means.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("p"))
    return packed.select(
        F.col("document_id").cast("bigint").alias("query_id"), F.transform("p", lambda x: x["v"]).alias("query_vector")
    )


def traces(spark: SparkSession, folder: str) -> DataFrame:
    """Events read as traces: value as latency, type as action, user as client."""
    return fan_out(table(spark, folder, "events"), "event_id").select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("user_id").alias("client"),
        F.col("value").alias("total_latency_ms"),
        F.get_json_object("props", "$.k").cast("bigint").alias("total_tokens"),
        F.when(F.col("event_type") == "error", "block").when(F.col("event_type") == "signup", "mask").otherwise("allow").alias("guardrail_action"),
        F.when(F.col("value") > 50, "high").otherwise("low").alias("hallucination_risk"),
        F.concat_ws(" ", F.lit("event"), "event_type", F.col("user_id").cast("string")).alias("query_text"),
        F.when(F.col("event_type") != "error", F.concat_ws(" ", F.lit("answer"), F.col("value").cast("string"))).alias("answer_text"),
    )


def feedback(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases and errors read as feedback on their own trace."""
    return table(spark, folder, "events").where(F.col("event_type").isin("purchase", "error", "view")).select(
        F.col("event_id").alias("trace_id"),
        F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0).alias("thumbs"),
        (F.get_json_object("props", "$.k").cast("int") % 5 + 1).alias("rating"),
        F.when(F.col("value") > 80, F.lit("corrected")).alias("corrected_answer"),
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.when(F.col("event_type") == "view", "get").otherwise("post").alias("method"),
        F.concat(F.lit("/"), "event_type").alias("endpoint"),
        F.when(F.col("value") > 60, 500).otherwise(200).alias("status"), (F.col("value") / 1000).alias("seconds"),
    )


def exchanges(spark: SparkSession, folder: str) -> DataFrame:
    """Assistant turns with the turn before as question and up to three earlier turns as contexts.

    The neighbours are brought together by the exact (conversation, turn) they belong to, so a
    conversation holding a third of all turns is still spread over all tasks.
    """
    turns = table(spark, folder, "conversations")
    offers = turns.select(
        "conv_id", "text",
        F.explode(F.array(*[F.struct(F.lit(d).alias("back"), (F.col("turn") + d).alias("turn")) for d in (1, 2, 3)])).alias("o"),
    ).select("conv_id", F.col("o.turn").alias("turn"), F.col("o.back").alias("back"), "text", F.lit(None).cast("string").alias("role"))
    own = turns.select("conv_id", "turn", F.lit(0).alias("back"), "text", "role")
    grouped = offers.unionByName(own).groupBy("conv_id", "turn").agg(
        F.max(F.when(F.col("back") == 0, F.col("text"))).alias("answer"),
        F.max("role").alias("role"),
        F.max(F.when(F.col("back") == 1, F.col("text"))).alias("query"),
        F.array_sort(F.collect_list(F.when(F.col("back") > 0, F.struct("back", "text")))).alias("c"),
    )
    return grouped.where((F.col("role") == "assistant") & F.col("query").isNotNull()).select(
        "conv_id", "turn", "query", "answer", F.transform("c", lambda x: x["text"]).alias("contexts")
    )
