"""Answer scoring, batch reports, golden-set reports and the release gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import as_col, keyword_set, let, rounded, sentences_for_scoring
from .ranking import beside


def _prefixes(context: Column) -> Column:
    """First two characters of every longer word, for the shared-stem test."""
    words = F.filter(F.split(context, r"(?U)\s+"), lambda w: F.length(w) >= 2)
    return F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, 2)))


def _supported(word: Column, context: Column, prefixes: Column) -> Column:
    """A word, its form less one or two final characters, or a word of the same first two.

    A longer form occurs only where its shorter form does, so the shortest is tested.
    """
    length = F.length(word)
    stem = F.when(length >= 4, F.substr(word, F.lit(1), length - 2)).when(
        length == 3, F.substr(word, F.lit(1), F.lit(2))
    ).otherwise(word)
    return F.contains(context, stem) | F.array_contains(prefixes, F.substring(word, 1, 2))


def faithfulness(answer: Column | str, contexts: Column | str) -> Column:
    """Share of sentences with at least 35 % of their keywords supported."""
    answer, contexts = as_col(answer), as_col(contexts)
    joined = F.lower(F.array_join(contexts, " "))

    def with_context(context: Column) -> Column:
        def with_prefixes(prefixes: Column) -> Column:
            def grounded(sentence: Column) -> Column:
                def judge(words: Column) -> Column:
                    known = F.size(F.filter(words, lambda w: _supported(w, context, prefixes)))
                    return (F.size(words) == 0) | (known / F.size(words) >= 0.35)

                return let(keyword_set(sentence), judge)

            def share(sentences: Column) -> Column:
                return F.when(F.size(sentences) == 0, 1.0).otherwise(
                    rounded(F.size(F.filter(sentences, grounded)) / F.size(sentences), 3)
                )

            return let(sentences_for_scoring(answer), share)

        return let(_prefixes(context), with_prefixes)

    missing = (F.coalesce(answer, F.lit("")) == "") | contexts.isNull() | (F.size(contexts) == 0)
    return F.when(missing, 0.0).otherwise(let(joined, with_context))


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.75, "low").when(score >= 0.45, "medium").otherwise("high")


def answer_relevance(query: Column | str, answer: Column | str) -> Column:
    query, answer = as_col(query), as_col(answer)

    def by_words(q: Column) -> Column:
        def score(a: Column) -> Column:
            shared = F.size(F.array_intersect(q, a))
            value = shared / F.size(q) * 0.7 + shared / F.size(F.array_union(q, a)) * 2.0 * 0.3
            return (
                F.when(F.size(q) == 0, 0.5).when(F.size(a) == 0, 0.0)
                .otherwise(F.least(F.lit(1.0), rounded(value, 3)))
            )

        return let(keyword_set(answer), score)

    missing = (F.coalesce(query, F.lit("")) == "") | (F.coalesce(answer, F.lit("")) == "")
    return F.when(missing, 0.0).otherwise(let(keyword_set(query), by_words))


def context_precision(query: Column | str, contexts: Column | str) -> Column:
    query, contexts = as_col(query), as_col(contexts)

    def score(words: Column) -> Column:
        def relevant(context: Column) -> Column:
            known = let(F.lower(context), lambda c: F.size(F.filter(words, lambda w: F.contains(c, w))))
            return known / F.size(words) >= 0.2

        return F.when(F.size(words) == 0, 0.5).otherwise(
            rounded(F.size(F.filter(contexts, relevant)) / F.size(contexts), 3)
        )

    missing = (F.coalesce(query, F.lit("")) == "") | contexts.isNull() | (F.size(contexts) == 0)
    return F.when(missing, 0.0).otherwise(let(keyword_set(query), score))


def context_recall(truth: Column | str, contexts: Column | str) -> Column:
    truth, contexts = as_col(truth), as_col(contexts)

    def by_context(context: Column) -> Column:
        def score(words: Column) -> Column:
            known = F.size(F.filter(words, lambda w: F.contains(context, w)))
            return F.when(F.size(words) == 0, 1.0).otherwise(rounded(known / F.size(words), 3))

        return let(keyword_set(truth), score)

    missing = (F.coalesce(truth, F.lit("")) == "") | contexts.isNull() | (F.size(contexts) == 0)
    return F.when(~missing, let(F.lower(F.array_join(contexts, " ")), by_context))


def score_answers(df: DataFrame, query: str = "query", answer: str = "answer", contexts: str = "contexts",
                  truth: str | None = None) -> DataFrame:
    """Adds the four scores, the risk and the overall score of every answer."""
    scored = (
        df.withColumn("faithfulness", faithfulness(answer, contexts))
        .withColumn("answer_relevance", answer_relevance(query, answer))
        .withColumn("context_precision", context_precision(query, contexts))
        .withColumn("context_recall", context_recall(truth, contexts) if truth else F.lit(None).cast("double"))
        .withColumn("hallucination_risk", risk_level(F.col("faithfulness")))
    )
    raw = F.col("faithfulness") * 40.0 + F.col("answer_relevance") * 35.0 + F.col("context_precision") * 25.0
    penalized = F.when(F.col("hallucination_risk") == "high", F.greatest(F.lit(0.0), raw - 20.0)).otherwise(raw)
    return scored.withColumn("overall_score", rounded(penalized, 1))


def order_statistics(df: DataFrame, value: str, ranks: dict[str, Column]) -> DataFrame:
    """One row with the exact values at 0-based ``ranks`` (columns over the row count ``n``).

    Equal values are counted first. Sketched quantiles cut the distinct values into many
    ranges; only the ranges that hold a wanted rank are ordered.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    cuts = counted.agg(
        F.sum("c").alias("n"), F.percentile_approx("v", [i / 512 for i in range(1, 512)], 4096).alias("cuts")
    )
    ranged = beside(counted, cuts).withColumn(
        "range", F.size(F.filter("cuts", lambda cut: cut <= F.col("v")))
    ).select("v", "c", "n", "range")
    # At most 512 rows.
    totals = ranged.groupBy("range").agg(F.sum("c").alias("size"), F.first("n").alias("n"))
    placed = totals.withColumn("before", F.sum("size").over(Window.orderBy("range")) - F.col("size"))
    wanted = placed.select(
        "range", "before",
        F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("at")) for name, rank in ranks.items()]).alias("w"),
        "size",
    ).select(
        "range", "before",
        F.filter("w", lambda w: (w["at"] >= F.col("before")) & (w["at"] < F.col("before") + F.col("size"))).alias("w"),
    ).where(F.size("w") > 0)
    inside = ranged.select("v", "c", "range").join(F.broadcast(wanted), "range")
    running = Window.partitionBy("range").orderBy("v")
    located = inside.withColumn("upto", F.col("before") + F.sum("c").over(running)).select(
        "v", F.explode(F.filter("w", lambda w: (w["at"] < F.col("upto")) & (w["at"] >= F.col("upto") - F.col("c")))).alias("w")
    )
    return located.agg(*[F.max(F.when(F.col("w.name") == name, F.col("v"))).alias(name) for name in ranks])


def batch_report(scored: DataFrame, latency: str = "latency_ms") -> DataFrame:
    """Means, high-risk rate and the latency at positions int(n/2) and int(0.95 n)."""
    n = F.col("n")
    ranks = {
        "p50_latency_ms": F.floor(n * 0.5),
        "p95_latency_ms": F.least(n - 1, F.floor(n * 0.95)),
    }
    means = scored.agg(
        F.count(F.lit(1)).alias("sample_count"),
        *[rounded(F.avg(c), 3).alias(f"mean_{c}") for c in ("faithfulness", "answer_relevance", "context_precision")],
        rounded(F.avg("overall_score"), 1).alias("mean_overall_score"),
        rounded(F.count_if(F.col("hallucination_risk") == "high") / F.count(F.lit(1)), 3).alias("high_hallucination_rate"),
    )
    latencies = order_statistics(scored, latency, ranks).select(
        *[rounded(name, 1).alias(name) for name in ranks]
    )
    return beside(means, latencies)


def source_checks(df: DataFrame, expected: str = "expected_sources", retrieved: str = "retrieved_sources") -> DataFrame:
    """Adds source_hit, source_recall and source_precision; names compared without case."""
    fold = lambda c: F.array_distinct(F.transform(F.filter(c, lambda s: s != ""), F.lower))
    work = df.withColumn("__e", fold(expected)).withColumn("__r", fold(retrieved))
    matched = F.size(F.array_intersect("__e", "__r"))
    asked = F.size("__e") > 0
    return work.select(
        *df.columns,
        F.when(asked, matched > 0).otherwise(F.size("__r") == 0).alias("source_hit"),
        F.when(asked, matched / F.size("__e")).alias("source_recall"),
        F.when(asked, matched / F.greatest(F.lit(1), F.size("__r"))).alias("source_precision"),
    )


def golden_report(rows: DataFrame, latency: str = "latency_ms") -> DataFrame:
    """Hit rate, recall, precision, guardrail pass rate, median and 95th latency."""
    n = F.col("n")
    ranks = {"low": F.floor((n - 1) / 2), "high": F.floor(n / 2), "p95": F.least(n - 1, F.ceil(n * 0.95) - 1)}
    checks = rows.agg(
        F.count(F.lit(1)).alias("sample_count"),
        rounded(F.avg(F.col("source_hit").cast("double")), 3).alias("source_hit_rate"),
        rounded(F.avg("source_recall"), 3).alias("mean_source_recall"),
        rounded(F.avg("source_precision"), 3).alias("mean_source_precision"),
        rounded(F.avg((F.col("expected_action") == F.col("action")).cast("double")), 3).alias("guardrail_pass_rate"),
    )
    latencies = order_statistics(rows, latency, ranks).select(
        rounded((F.col("low") + F.col("high")) / 2, 1).alias("p50_latency_ms"), rounded("p95", 1).alias("p95_latency_ms")
    )
    return beside(checks, latencies)


# Thresholds of a release.
RELEASE_THRESHOLDS = {"min_source_hit_rate": 0.8, "min_guardrail_pass_rate": 1.0}


def release_gate(report: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Adds failures (names of missed thresholds; an unknown measure misses) and released."""
    thresholds = RELEASE_THRESHOLDS if thresholds is None else thresholds
    missed = []
    for name, bound in thresholds.items():
        side, measure = name.split("_", 1)
        ok = F.col(measure) >= bound if side == "min" else F.col(measure) <= bound
        missed.append(F.when(~F.coalesce(ok, F.lit(False)), name))
    return report.withColumn("failures", F.array_compact(F.array(*missed))).withColumn("released", F.size("failures") == 0)


def enforce_release(report: DataFrame) -> None:
    row = report.first()
    if not row["released"]:
        raise AssertionError("release thresholds missed: " + ", ".join(row["failures"]))
