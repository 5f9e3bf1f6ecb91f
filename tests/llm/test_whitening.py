"""Whitening against NumPy on all vectors, and exact sums against Python's whole numbers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from corpusmill.llm import whitening
from corpusmill.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, key string, n string, z string"


def _plain(vectors, weights=None, components=32):
    x = np.floor(64 * np.array(vectors, np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    fitted = x if weights is None else x[weights]
    n, s = len(fitted), fitted.sum(axis=0)
    centred = (fitted * n - s) / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    deviation = [sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, s, strict=True)) for row in x]
    return n, deviation, (x - s / n) @ basis / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def _compare(vectors, ids, made, weights=None):
    n, deviation, z, shares = _plain(vectors, weights)
    found = {}
    for r in made:
        found.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(found) == sorted(ids) and all(sorted(f) == list(range(1, z.shape[1] + 1)) for f in found.values())
    for c in range(z.shape[1]):
        mine = np.array([found[i][c + 1].whitened for i in ids])
        assert min(np.abs(mine - z[:, c]).max(), np.abs(mine + z[:, c]).max()) < 1e-7
        assert all(math.isclose(found[i][c + 1].explained, shares[c], rel_tol=1e-9) for i in ids)
    assert all(found[i][1].deviation == d and found[i][1].n == n for i, d in zip(ids, deviation, strict=True))
    assert len({r.identity_error for r in made}) == 1 and made[0].identity_error < 1e-8


def test_query_on_given_embeddings(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    _compare([r.embedding for r in rows], [r.vec_id for r in rows], QUERIES["op13_whitened_embeddings"](spark, sf).collect())


def test_repeated_vectors_count_as_often_as_they_occur(spark, tmp_path):
    random = np.random.default_rng(4)
    some = random.normal(size=(90, 5)).astype(np.float32) * [1, 3, 0.5, 2, 9]
    vectors = [some[0].tolist()] * 60 + some.tolist()
    rows = [(i, v, 0, "k", "n", "z") for i, v in enumerate(vectors)]
    bad = [None, [None] * 5, [1.0, 2.0, None, 4.0, 5.0], [1.0, math.nan, 0.0, 0.0, 0.0], [math.inf, 0.0, 0.0, 0.0, 0.0]]
    rows += [(1000 + i, v, 0, "k", "n", "z") for i, v in enumerate(bad)]
    spark.createDataFrame(rows, SCHEMA).repartition(7).write.parquet(f"{tmp_path}/embeddings.parquet")
    _compare(vectors, list(range(len(vectors))), QUERIES["op13_whitened_embeddings"](spark, str(tmp_path)).collect())
    once, model, error = whitening.whiten(spark.createDataFrame(rows, SCHEMA), weighted=False)
    assert model.n == 90 and error < 1e-9 and once.count() == len(vectors)
    assert whitening.groups(spark.createDataFrame(rows, SCHEMA))[1].count() == 90


def test_repeated_and_null_ids_stay(spark):
    rows = [(None, [1.0, 0.0]), (None, [0.0, 1.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [2.5, -1.0])]
    made, model, _ = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted(str(r.vec_id) for r in made.collect()) == ["3", "3", "4", "None", "None"] and len(model.values) == 2


def test_directions_without_variance_are_left_out(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(20)]
    made, model, error = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert len(model.values) == 1 and error < 1e-9 and {len(r.z) for r in made.collect()} == {1}
    made, model, error = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<float>"))
    assert len(model.values) == 0 and error == 0.0 and {len(r.z) for r in made.collect()} == {0} and made.count() == 5


def test_shorter_vectors_go_on_with_zeros(spark):
    vectors = [[1.0, 2.0, 3.0], [2.0, 1.0], [], [0.5, 0.25, -4.0], [7.0, 1.0, 1.0]]
    made, model, _ = whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>"))
    padded = [v + [0.0] * (3 - len(v)) for v in vectors]
    assert {r.vec_id: r.deviation for r in made.collect()} == dict(enumerate(_plain(padded, components=3)[1]))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [math.nan])]])
def test_nothing_to_fit(spark, tmp_path, rows):
    spark.createDataFrame([(*r, 0, "k", "n", "z") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert QUERIES["op13_whitened_embeddings"](spark, str(tmp_path)).count() == 0


def test_deviation_of_large_numbers_is_exact_or_null():
    model = whitening.Fit(3, [10, 10], np.ones(0), np.zeros((2, 0)), 0.0)
    big = np.array([[1 << 29, 5], [1 << 40, 5]], np.int64)
    assert model.deviation(big) == [(3 * (1 << 29) - 10) ** 2 + 25, None]
