"""The vector index against a scan of all vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from corpusmill.operators import vector_index
from corpusmill.session import scratch_folder


def _table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], "id long, v array<float>").repartition(5)


def _exact(rows, asked, k):
    def cosine(a, b):
        if a is None or b is None or len(a) != len(b):
            return 0.0
        a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
        norm = np.linalg.norm(a) * np.linalg.norm(b)
        return round(float(a @ b / norm), 9) if norm else 0.0

    return {q: sorted(((-cosine(x, v), i) for i, v in rows))[:k] for q, x in asked}


def _search(spark, rows, asked, k, lists=None, **options):
    table = _table(spark, rows)
    index = vector_index.build(table, "id", "v", f"{scratch_folder(spark)}/index", lists=lists)
    assert index.table(spark).count() == len(rows) == index.rows
    questions = _table(spark, asked).select(F.col("id").alias("q"), F.col("v").alias("x"))
    found = vector_index.search(index, table, "v", questions, "q", "x", k, **options)
    out = {}
    for r in found.orderBy("q", "rank").collect():
        out.setdefault(r.q, []).append((r.similarity, r.id))
    return index, out


def _clustered(n, seed=1):
    some = np.random.default_rng(seed)
    middles = some.normal(size=(12, 16)) * 2
    return [(i, (middles[i % 12] + some.normal(size=16)).tolist()) for i in range(n)]


def test_all_lists_give_the_exact_answer(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "ROW_LANE", 7)
    monkeypatch.setattr(vector_index, "QUESTION_LANE", 2)
    rows = _clustered(300)
    rows += [(1000 + i, rows[5][1]) for i in range(100)]
    asked = rows[::60]
    index, found = _search(spark, rows, asked, 5, probes=99, again=30)
    assert index.lists == 20
    assert {q: [i for _, i in f] for q, f in found.items()} == {q: [i for _, i in best] for q, best in _exact(rows, asked, 5).items()}


def test_few_lists_find_nine_in_ten(spark):
    rows = _clustered(2000)
    asked = rows[::100]
    index, found = _search(spark, rows, asked, 10, probes=8)
    exact = _exact(rows, asked, 10)
    hits = sum(len({i for _, i in found[q]} & {i for _, i in exact[q]}) for q in exact)
    assert index.lists == 45 and hits >= 0.9 * 10 * len(asked)


def test_number_of_lists_follows_the_wanted_recall(spark):
    rows = _clustered(600, 4)
    table = _table(spark, rows)
    index = vector_index.build(table, "id", "v", f"{scratch_folder(spark)}/index")
    asked = _table(spark, rows[::40]).select(F.col("id").alias("q"), F.col("v").alias("x"))
    probes = [vector_index.probes_for(index, table, "v", asked, "q", "x", 10, share) for share in (0.3, 0.9, 1.0)]
    assert 1 <= probes[0] <= probes[1] <= probes[2] <= index.lists and probes[0] < index.lists
    found = vector_index.search(index, table, "v", asked, "q", "x", 10, probes=probes[2], again=10)
    exact = _exact(rows, rows[::40], 10)
    assert {(r.q, r.id) for r in found.collect()} == {(q, i) for q, best in exact.items() for _, i in best}
    assert vector_index.probes_for(index, table, "v", asked.limit(0), "q", "x", 10) == 1


def test_recall_is_a_share_of_the_exact_answers(spark):
    exact = spark.createDataFrame([(1, 1), (1, 2), (2, 5), (2, 6)], "q long, id long")
    found = spark.createDataFrame([(1, 2), (1, 9), (2, 5), (2, 6)], "q long, id long")
    assert tuple(vector_index.recall(found, exact, "q", "id").first()) == (2, 0.75)


def test_vectors_that_point_nowhere(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [0.5, 0.1])]
    _, found = _search(spark, rows, [(10, [1.0, 0.0])], 2, probes=9, again=9)
    assert [i for _, i in found[10]] == [1, 6]


def test_no_rows_and_no_questions(spark):
    assert _search(spark, [], [(1, [1.0, 0.0])], 3)[1] == {}
    assert _search(spark, [(1, [1.0, 0.0])], [], 3)[1] == {}
