"""Steps that move and look at no more than they need."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import context, terms
from corpusmill.operators import retrieve


def test_chunks_meet_few_pairs_without_a_shuffle(spark):
    """Pairs are sent to the chunks, whose tokens are not dealt out anew, however large both tables seem."""
    chunks = spark.range(100).select(F.col("id").alias("chunk_id"), F.array(F.lit("a"), F.col("id").cast("string")).alias("tokens"))
    pairs = spark.createDataFrame([(1, 2), (2, 2), (1, 4)], "query_id long, chunk_id long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = retrieve.with_tokens(pairs, chunks)
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["query_id"], r["chunk_id"], r["tokens"]) for r in found.collect()) == [(1, 2, ["a", "2"]), (1, 4, ["a", "4"]), (2, 2, ["a", "2"])]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_patterns_run_only_where_their_variant_is(spark):
    df = spark.createDataFrame([("핸드폰, 휴대폰. 핸드폰번호 공문",), ("plain",), ("é 시행일자",), (None,)], "t string")
    made = df.select(terms.replace_terms("t").alias("r"), terms.term_counts("t").alias("n")).collect()
    assert [r["r"] for r in made] == ["휴대전화, 휴대전화. 핸드폰번호 공문서", "plain", "é 시행일자", None]
    assert made[0]["n"] == {"핸드폰 -> 휴대전화": 1, "휴대폰 -> 휴대전화": 1, "공문 -> 공문서": 1} and made[2]["n"] == {}
    assert "CONTAINS" in df.select(terms.replace_terms("t"))._jdf.queryExecution().toString().upper()


def test_headings_of_all_shapes_pass_the_first_look(spark):
    shapes = ["# One", "2.1 Two words", "제 3 장 넷", "제4조(목적)", "가. 항목 이름", "٣. arabic digit", "plain", "- item"]
    df = spark.createDataFrame([(s,) for s in shapes], "line string").withColumn("level", context.heading_level(F.col("line")))
    rows = df.withColumn("first", F.col("line").rlike(context.HEADING_START)).collect()
    assert all(r["first"] for r in rows if r["level"] is not None) and [r["first"] for r in rows[-2:]] == [False, False]
