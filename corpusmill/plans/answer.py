"""A batch of questions to answers: guard, route, search, rerank, gate, generate, check, trace."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..config import Settings
from ..functions import text, vectors
from ..operators import filters, gate, guardrails, retrieve, telemetry
from ..session import cut_lineage
from .subqueries import plan_subqueries

# Fixed answers.
BLOCKED_ANSWER = "보안 가드레일이 질의를 차단했습니다."
SEARCHES = {
    "dense": lambda c, q, k: retrieve.dense_search(c, q, k).withColumn("score", F.col("similarity")),
    "weighted": retrieve.hybrid_weighted,
    "terms": lambda c, q, k: retrieve.hybrid_terms(c, q, k).withColumn("score", F.col("combined_score")),
    "exhaustive": lambda c, q, k: retrieve.hybrid_exhaustive(c, q, k).withColumn("score", F.col("combined_score")),
    "scaled": lambda c, q, k: retrieve.hybrid_scaled(c, q, k).withColumn("score", F.col("combined_score")),
}


@dataclass
class Answered:
    answers: DataFrame
    sources: DataFrame


def _parts(complete: Callable[[str], str | None] | None) -> Callable:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def plan(questions: pd.Series) -> pd.Series:
        return questions.map(lambda q: list(plan_subqueries(q, complete).queries), na_action="ignore")

    return plan


def answer_questions(questions: DataFrame, chunks: DataFrame, documents: DataFrame, settings: Settings | None = None,
                     mode: str = "dense", scope: filters.SearchScope | None = None, embed=None,
                     complete: Callable[[Column, Column], Column] | None = None,
                     planner: Callable[[str], str | None] | None = None, model_score: Column | None = None) -> Answered:
    """questions(query_id, query_text) against chunks and their live documents.

    ``embed`` maps text to a vector column, ``complete`` maps (question, context) to an answer
    column, ``planner`` and ``model_score`` stand for the optional models. Without ``complete``
    answers are null and sources are returned alone.
    """
    settings = settings or Settings()
    scope = scope or filters.SearchScope()
    k = settings.retrieval_top_k
    embed = embed or (lambda column: vectors.hash_embedding(column, settings.embedding_dim))
    guarded = guardrails.input_guardrail(questions, "query_text", settings.input_max_length, settings.mask_pii).select(
        "query_id", F.col("action").alias("input_action"), "passed", F.col("sanitized_text").alias("query_text"),
        F.length("query_text").alias("question_length"),
    ).withColumn("route", F.when(F.col("passed"), text.query_route("query_text")).otherwise("blocked"))
    searched = guarded.where("route = 'retrieval'").select("query_id", "query_text")
    parts = searched.select(F.col("query_id").alias("question"), F.posexplode(_parts(planner)("query_text")).alias("part", "query_text"))
    asked = parts.select(
        F.concat_ws(":", F.col("question").cast("string"), F.col("part").cast("string")).alias("query_id"), "question", "part",
        "query_text", embed(F.col("query_text")).alias("query_vector"),
    )
    visible = filters.in_scope(chunks, scope)
    wide = max(15, 3 * k)
    # A few rows per question, read by three branches below.
    hits = cut_lineage(SEARCHES[mode](visible, asked, wide))
    by_part = hits.join(asked.select("query_id", "question", "part"), "query_id")
    fused = retrieve.fuse_subqueries(by_part.select(F.col("question").alias("query_id"), "part", "chunk_id", "rank"), wide)
    details = visible.select("chunk_id", "document_id", "chunk_index", "content", "quality_score", "parent_index", "parent_text")
    # Single searches keep their own score, fused ones the fusion score.
    own = by_part.groupBy(F.col("question").alias("query_id"), "chunk_id").agg(
        F.max("score").alias("own_score"), F.max("part").alias("last_part"))
    many = F.max("last_part").over(Window.partitionBy("query_id")) > 0
    scored = fused.join(own, ["query_id", "chunk_id"]).withColumn(
        "score", F.when(many, F.col("combined_score")).otherwise(F.col("own_score"))).drop("own_score", "last_part", "combined_score")
    bound = retrieve.bind_live_documents(scored.join(details, "chunk_id"), documents, scope.project)
    ranked = retrieve.rerank(bound.join(searched, "query_id"), k, model_score=model_score).withColumn("score", F.col("rerank_score"))
    sources = retrieve.expand_parents(ranked)
    candidates = by_part.join(details.select("chunk_id", "content"), "chunk_id")
    decisions = gate.lexical_gate(asked, candidates).join(asked.select("query_id", "question", "part"), "query_id").drop("query_id")
    gated = gate.combined_gate(decisions, "question").select(
        F.col("question").alias("query_id"), F.col("action").alias("gate_action"), F.col("reason").alias("gate_reason"))
    context = retrieve.build_context(sources)
    evidence = sources.groupBy("query_id").agg(
        F.collect_list("score").alias("scores"), F.collect_list("content").alias("texts"), F.count(F.lit(1)).alias("hit_count"))
    ready = guarded.join(gated, "query_id", "left").join(context, "query_id", "left").join(evidence, "query_id", "left")
    accepted = (F.col("route") == "retrieval") & (F.col("gate_action") == "accept")
    if complete:
        # A Python function in ``complete`` is computed for every row that reaches it, whatever
        # condition surrounds it, so no text of the others does.
        visible_text, visible_context = (F.when(accepted, F.col(c)) for c in ("query_text", "context"))
        generated = F.when(accepted, complete(visible_text, visible_context))
    else:
        generated = F.lit(None).cast("string")
    drafted = ready.withColumn("answer", F.when(
        F.col("route") == "conversation", text.conversational_reply("query_text")).when(F.col("route") == "blocked", BLOCKED_ANSWER)
        .when(accepted, generated)).withColumn("joined", F.array_join("texts", " "))
    checked = guardrails.output_guardrail(drafted, "answer", "joined", settings.mask_pii).withColumn(
        "answer", F.when(F.col("withheld"), F.lit(None)).when(F.col("answer").isNotNull(), F.col("sanitized_text")))
    judged = guardrails.attribution(checked.drop("passed"))
    answers = judged.select(
        "query_id", "route", "input_action", F.col("action").alias("output_action"), "gate_action", "gate_reason", "answer", "withheld",
        "confidence_score", "hallucination_risk", "grounding_ratio", F.coalesce("hit_count", F.lit(0)).alias("hit_count"),
        F.concat(F.lit("omitted;chars:"), F.col("question_length").cast("string")).alias("audit_query"),
    )
    return Answered(answers, sources)


def events(answered: Answered) -> DataFrame:
    """(query_id, seq, type, payload) in protocol order: input check, sources, gate, final check, attribution, done."""
    listed = answered.sources.groupBy("query_id").agg(F.to_json(F.collect_list(F.struct(
        "rank", "source_name", "chunk_index", "score"))).alias("sources"))
    rows = answered.answers.join(listed, "query_id", "left")
    event = lambda seq, kind, payload: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("type"), payload.alias("payload"))
    parts = F.array(
        event(0, "guardrail", F.to_json(F.struct(F.col("input_action").alias("action")))),
        event(1, "sources", F.coalesce("sources", F.lit("[]"))),
        event(2, "retrieval_gate", F.to_json(F.struct(F.col("gate_action").alias("action"), F.col("gate_reason").alias("reason")))),
        event(3, "guardrail", F.to_json(F.struct(F.lit("final").alias("phase"), F.col("output_action").alias("action")))),
        event(4, "attribution", F.to_json(F.struct("confidence_score", "hallucination_risk"))),
        event(5, "done", F.lit("[DONE]")),
    )
    return rows.select("query_id", F.inline(parts))


def traces(answered: Answered, created_at: Column | None = None) -> DataFrame:
    """Trace rows of answered questions; the question text itself is not kept."""
    return answered.answers.select(
        F.col("query_id").alias("id"), (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
        F.col("audit_query").alias("query_text"), F.col("answer").alias("answer_text"),
        F.col("output_action").alias("guardrail_action"), "hallucination_risk", "confidence_score",
        text.token_estimate(F.coalesce("answer", F.lit(""))).alias("total_tokens"), F.lit(0.0).alias("estimated_cost_usd"),
        telemetry.spans(["retrieval", "generation"], [F.lit(0.0), F.lit(0.0)]).alias("spans"),
    )
