"""Lexical relevance gate over the first hits of each question, and its combination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_col, normalize_phrase, rounded, strip, tokens

CANDIDATES = 5


def lexical_gate(queries: DataFrame, hits: DataFrame, limit: int = CANDIDATES, query: str = "query_id") -> DataFrame:
    """(query_id, action, reason, evidence...) from word evidence only; scores are not read.

    queries(query_id, query_text), hits(query_id, rank, content).
    """
    asked = queries.select(
        query, (strip("query_text") == "").alias("blank"),
        F.array_distinct(tokens("query_text")).alias("terms"), normalize_phrase("query_text").alias("phrase"),
    )
    examined = hits.where(F.col("rank") <= limit).select(query, "rank", "content").withColumn("__phrase", normalize_phrase("content"))
    judged = (
        examined.join(asked, query)
        .withColumn("usable", F.coalesce(strip("content") != "", F.lit(False)))
        .withColumn("matched", F.size(F.array_intersect("terms", tokens("content"))))
        .withColumn("exact", (F.col("phrase") != "") & F.contains(F.col("__phrase"), F.col("phrase")))
    )
    signal = F.struct(F.col("exact").cast("int").alias("exact"), "matched", (-F.col("rank")).alias("back"))
    found = judged.groupBy(query).agg(
        F.count(F.lit(1)).alias("examined"),
        F.count_if("usable").alias("usable"),
        F.count_if(F.col("usable") & F.col("exact")).alias("exact_count"),
        F.max(F.when(F.col("usable"), signal)).alias("best"),
    )
    out = asked.join(found, query, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    count = F.size("terms")
    matched = zero("best.matched")
    enough = (zero("exact_count") > 0) | ((count >= 2) & (matched >= F.greatest(F.lit(2), F.ceil(count / 2))))
    reason = (
        F.when(F.col("blank"), "empty_query").when(count == 0, "no_informative_query_terms")
        .when(zero("examined") == 0, "no_candidates").when(zero("usable") == 0, "no_usable_candidate_text")
        .when(enough, "sufficient_lexical_support").when(matched == 0, "no_lexical_support")
        .otherwise("partial_lexical_support")
    )
    stop = F.col("reason").isin("empty_query", "no_informative_query_terms", "no_usable_candidate_text")
    best_rank = F.when(matched + zero("best.exact") > 0, -F.col("best.back"))
    return out.withColumn("reason", reason).select(
        query,
        F.when(F.col("reason") == "sufficient_lexical_support", "accept").when(stop, "abstain").otherwise("retry_retrieval").alias("action"),
        "reason", count.alias("query_term_count"), zero("usable").alias("usable_candidate_count"),
        best_rank.alias("best_candidate_rank"), matched.alias("best_matched_term_count"),
        F.when(count > 0, rounded(matched / count, 4)).otherwise(0.0).alias("best_term_coverage"),
        (zero("best.exact") == 1).alias("exact_phrase_match"), zero("exact_count").alias("exact_phrase_candidate_count"),
    )


def combined_gate(decisions: DataFrame, query: str = "query_id", part: str = "part", mode: str = "off",
                  probability: Column | str | None = None, minimum: float = 0.5) -> DataFrame:
    """Accept a question when every sub-question accepts; in ``enforce`` mode a support
    probability (one per question, repeated on its rows) may rescue it, in ``shadow`` it is
    only reported.
    """
    if mode not in ("off", "shadow", "enforce"):
        raise ValueError("mode is off, shadow or enforce")
    support = F.lit(None).cast("double") if probability is None else as_col(probability)
    rejected = F.min(F.when(F.col("action") != "accept", F.struct(part, "action", "reason")))
    folded = decisions.groupBy(query).agg(
        F.bool_and(F.col("action") == "accept").alias("lexical"), rejected.alias("first"), F.max(support).alias("p")
    )
    would = F.coalesce(F.col("p") >= minimum, F.lit(False))
    rescued = F.lit(mode == "enforce") & ~F.col("lexical") & would
    accepted = F.col("lexical") | rescued
    return folded.select(
        query, F.when(accepted, "accept").otherwise("abstain").alias("action"),
        F.when(F.col("lexical"), "all_subqueries_supported").when(rescued, "semantic_support")
        .otherwise(F.col("first.reason")).alias("reason"),
        F.when(~accepted, F.col("first.action")).alias("suggested_action"),
        F.when(F.col("lexical"), "accept").otherwise("abstain").alias("lexical_action"), rescued.alias("rescued"),
        (F.lit(mode != "off") & would).alias("would_accept"),
    )
