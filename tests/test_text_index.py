"""The text index against a walk over all texts."""

from __future__ import annotations

import itertools
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.functions.text import TOKEN_PATTERN
from corpusmill.operators import text_index
from corpusmill.session import scratch_folder

LONG = "x" * 40 + "needle" + "y" * 40


def _texts():
    some = random.Random(3)
    words = ["red", "green", "blue", "a", "amber-tree", "bluebird", "세금", "세금신고", "it_is", "42", "."]
    texts = [(i, " ".join(some.choice(words) for _ in range(some.randrange(30)))) for i in range(120)]
    texts += [(200 + i, "red green blue") for i in range(40)]  # ties
    return texts + [(300, ""), (301, None), (302, "Red GREEN. blue"), (303, LONG), (None, "red green"), (304, "red " * 3000 + "green")]


def _index(spark, texts, lane_bytes=400, key="id long"):
    table = spark.createDataFrame(texts, f"{key}, text string").repartition(5)
    return text_index.build(table, "id", "text", f"{scratch_folder(spark)}/text", lane_bytes)


def _asked(spark, questions):
    return spark.createDataFrame(questions, "q long, t array<string>")


def _found(df):
    out = {}
    for r in df.orderBy("q", "rank").collect():
        out.setdefault(r.q, []).append((r.id, r.score))
    return out


def _plain_rank(text, words):
    """Every stretch with all words that holds no shorter one, tried one after the other."""
    listed = re.findall(TOKEN_PATTERN, text.lower())
    whole = lambda i, j: set(words) <= set(listed[i:j])
    near = sorted(i for i, w in enumerate(listed) if w in words)
    covers = [(i, j + 1) for i, j in itertools.combinations_with_replacement(near, 2) if whole(i, j + 1) and not whole(i + 1, j + 1) and not whole(i, j)]
    return round(sum(0.1 / (1 + sum(w not in words for w in listed[i:j])) for i, j in covers), 9) if covers else None


QUESTIONS = [(1, ["red", "green"]), (2, ["red", "green", "blue"]), (3, ["세금"]), (4, ["red", "missing"]), (5, []), (6, ["bluebird", "amber-tree", "42", "it_is"])]


@pytest.fixture(scope="module")
def index(spark):
    return _index(spark, _texts())


def test_cover_density_ranks_as_a_walk_over_all_stretches(spark, index):
    assert index.lanes > 10
    found = _found(text_index.cover_search(index, _asked(spark, QUESTIONS), "q", "t", 25, max_queries=2))
    short = [(i, t) for i, t in _texts() if i is not None and t and len(t) < 5000]
    for q, words in QUESTIONS:
        ranks = [(i, r) for i, t in short if words and (r := _plain_rank(t, words)) is not None]
        if words == ["red", "green"]:
            ranks.append((304, 0.1))
        assert found.get(q, []) == sorted(ranks, key=lambda x: (-x[1], x[0]))[:25]


def test_covers_count_the_words_in_between():
    assert _plain_rank("red x green y z red", ["red", "green"]) == round(0.1 / 2 + 0.1 / 3, 9)


def test_parts_of_words_are_found(spark, index):
    asked = [(1, ["blue", "red"]), (2, ["needle"]), (3, ["세금", "tree"]), (4, ["is"]), (5, ["nowhere"]), (6, []), (7, ["r-t", "42"])]
    found = _found(text_index.part_search(index, _asked(spark, asked), "q", "t", 20, max_queries=3))
    for q, words in asked:
        counts = [(i, float(n)) for i, t in _texts() if i is not None and (n := sum(w in (t or "").lower() for w in words))]
        assert found.get(q, []) == sorted(counts, key=lambda x: (-x[1], x[0]))[:20]


def test_rare_words_read_few_postings(spark, index):
    stored = index.table(spark, "words").count()
    assert index.postings(spark, ["red"]).count() == index.table(spark, "words").where("term = 'red'").count() > 10
    assert index.postings(spark, ["missing"]).count() == 0 < stored
    assert [r.word for r in index.runs_holding(spark, ["needle"]).collect()] == ["needle"]
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    assert files(index.postings(spark, ["red"])) < files(index.table(spark, "words"))


def test_candidates_hold_both_lists(spark, index):
    asked = _asked(spark, [(1, ["red", "green"])])
    found = {r.id: r.n for r in text_index.keyword_candidates(index, asked, "q", "t", 5).collect()}
    wanted = {r.id for search in (text_index.part_search, text_index.cover_search) for r in search(index, asked, "q", "t", 5).collect()}
    assert set(found) == wanted and set(found.values()) == {2.0}


def test_empty_tables_and_names_as_keys(spark):
    empty = _index(spark, [])
    asked = _asked(spark, [(1, ["red"])])
    for search in (text_index.cover_search, text_index.part_search):
        assert search(empty, asked, "q", "t").count() == 0
        assert search(empty, asked.limit(0), "q", "t").count() == 0
    named = _index(spark, [("b", "red"), ("a", "red")], key="id string")
    assert [r.id for r in text_index.cover_search(named, asked, "q", "t").orderBy("rank").collect()] == ["a", "b"]


def test_letter_grams_move_in_lists(spark):
    """No row for a gram and run, neither where they are written nor where a search intersects them."""
    index = _index(spark, [*_texts(), *((400 + i, f"bluebird{i}") for i in range(50))], 1 << 20)
    grams, runs = index.table(spark, "grams"), index.table(spark, "runs")
    pairs = sorted((g, r.id) for r in runs.collect() for g in {r.run[i : i + n] for n in (2, 3) for i in range(len(r.run) - n + 1)})
    assert sorted((r.gram, i) for r in grams.collect() for i in r.ids) == pairs
    assert grams.count() == grams.select("gram", "lane").distinct().count() < len(pairs)
    plan = index.runs_holding(spark, ["blue"])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "HashAggregate" not in plan


def test_keys_that_share_an_id_are_told_apart():
    table = pa.table({"lane": [5, 5, 5], "id": [9, 9, 2], "run": ["abc", "xabc", "bc"]})
    made = text_index._lane_grams(table, lambda g: 0)
    assert {r["term"]: r["ids"] for r in made.to_pylist()} == {"ab": [9], "abc": [9], "bc": [2, 9], "xa": [9], "xab": [9]}


def test_postings_are_made_once(spark, monkeypatch):
    """Dealing packs to tasks takes no sample, for which every lane would be made a second time."""
    made = spark.sparkContext.accumulator(0)
    lane_postings = text_index._lane_postings

    def counted(table, bucket_of):
        made.add(1)
        return lane_postings(table, bucket_of)

    monkeypatch.setattr(text_index, "_lane_postings", counted)
    rows = spark.createDataFrame([(i, f"red {i}") for i in range(40)], "id long, text string")
    index = text_index.build(rows, "id", "text", f"{scratch_folder(spark)}/text", 50, parts=False)
    assert index.lanes > 4 and made.value == index.table(spark, "words").select("lane").distinct().count()
