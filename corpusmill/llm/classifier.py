"""Quality scores from document statistics: random Fourier features, ridge regression, isotonic calibration.

Cosines of random projections approximate a Gaussian kernel, so a linear fit over them is a kernel fit whose size does
not depend on the number of rows. Each partition sums its part of the normal equations; only the sums, a few tens of
thousands of numbers for any input, reach the driver. Calibration counts labels in a fixed number of bins of the raw
score and makes their rates monotone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import cut_lineage

from .arrow import map_texts
from .common import fold, keep_rows

#: Number of cosines, ridge penalty for each training row, bins of the raw score, and the seed of the projections.
COSINES, PENALTY, BINS, SEED = 256, 1e-3, 512, 20
#: Folds of crc32(id) mod 4: held out, and used for calibration; the others fit the ridge.
FOLDS, HELD_OUT, CALIBRATING = 4, 2, 3

_SYMBOLS = b"#*$%&|<>@^~=_+\\/[]{}"


def _statistics(text: bytes | None) -> list[float]:
    """Numbers that describe a text: sizes on log scales, shares of kinds of characters and words, and repetition."""
    text = text or b""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    each = np.fromiter(map(hash, words), np.int64, len(words))
    lower = text.lower()
    lines = [line for line in text.split(b"\n") if line]
    # In UTF-8 an upper-case Latin letter differs from its lower case in ASCII; others are few enough not to matter.
    upper = sum(a != b for a, b in zip(text, lower)) if len(text) < 256 else int(np.count_nonzero(np.frombuffer(text, np.uint8) != np.frombuffer(lower, np.uint8)))
    _, counts = np.unique(each, return_counts=True) if len(each) else (None, np.zeros(1))
    pairs = each[:-1] * np.int64(1_000_003) + each[1:] if len(each) > 1 else np.zeros(0, np.int64)
    spans = each[:-3] + 31 * each[1:-2] + 961 * each[2:-1] + 29791 * each[3:] if len(each) > 3 else np.zeros(0, np.int64)
    share = lambda chars: (len(text) - len(text.translate(None, chars))) / size
    repeat = lambda values: 1 - len(np.unique(values)) / len(values) if len(values) else 0.0
    return [
        np.log1p(len(words)), np.log1p(len(text) / n), float(np.log1p(lengths.std())), float((lengths <= 3).mean()), float(np.log1p(lengths.max())),
        len(counts) / n, float(counts.max()) / n, float((each[1:] == each[:-1]).mean()) if len(each) > 1 else 0.0,
        repeat(pairs), repeat(spans), upper / size, np.sqrt(share(_SYMBOLS)), np.sqrt(share(b"!?")), np.sqrt(share(b"|")),
        np.sqrt(share(b"0123456789")), np.sqrt(share(b".,;:")), np.log1p(len(lines)), np.log1p(len(text) / max(1, len(lines))),
        1 - len(set(lines)) / max(1, len(lines)),
    ]


FEATURES = len(_statistics(b""))


def statistics(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key (hash of the text) and x, the statistics of the text, for every row."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("key"), F.col(text).cast("binary").alias("_text"))
    return map_texts(rows, "_text", "x array<double>", lambda texts: {"x": pa.array(map(_statistics, texts), pa.list_(pa.float64()))})


@dataclass(frozen=True)
class Model:
    """Standardization, projections, ridge weights, and the calibration curve as points of rising raw score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    knots: np.ndarray
    values: np.ndarray

    def cosines(self, x: np.ndarray) -> np.ndarray:
        random = np.random.default_rng(SEED)
        directions = random.normal(size=(FEATURES, COSINES)) / np.sqrt(FEATURES)
        phases = random.uniform(0, 2 * np.pi, COSINES)
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / COSINES) * np.cos(z @ directions + phases), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.zeros(len(x)) if self.weights is None else self.cosines(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)


def _normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sums of z z' and z y over `rows` (x, y): one matrix from each partition, added cell by cell in a shuffle."""
    width = COSINES + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width + 1))
        for batch in batches:
            if batch.num_rows:
                z = model.cosines(_matrix(batch))
                total += z.T @ np.column_stack([z, batch.column("y").to_numpy()])
        if total.any():
            i, j = np.triu_indices(width, 0, width + 1)
            yield pa.RecordBatch.from_arrays([pa.array((i * (width + 1) + j).astype(np.int32)), pa.array(total[i, j])], names=["cell", "v"])

    cells = rows.select("x", "y").mapInArrow(partial, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).toPandas()
    full = np.zeros(width * (width + 1))
    full[cells["cell"].to_numpy(np.int64)] = cells["v"].to_numpy(np.float64)
    full = full.reshape(width, width + 1)
    upper = np.triu(full[:, :width])
    return upper + np.triu(upper, 1).T, full[:, width]


def isotonic(places: np.ndarray, weights: np.ndarray, rates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest rising sequence by weighted squares, as pools: neighbours that fall are pooled. Mean place and rate of each pool."""
    pools: list[tuple[float, float, float]] = []
    for place, weight, rate in zip(places, weights, rates, strict=True):
        pools.append((weight, weight * place, weight * rate))
        while len(pools) > 1 and pools[-2][2] / pools[-2][0] >= pools[-1][2] / pools[-1][0]:
            pools[-2:] = [tuple(a + b for a, b in zip(*pools[-2:], strict=True))]
    return np.array([p / w for w, p, _ in pools]), np.array([r / w for w, _, r in pools])


def _calibrated(rows: DataFrame, model: Model) -> Model:
    """The model with its curve, from label counts of `rows` (x, y) in equal bins of the raw score from -0.5 to 1.5.

    The curve runs straight between the pools, so that raw scores between two pools keep their order.
    """

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, good = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            if batch.num_rows:
                at = np.clip(((model.raw(_matrix(batch)) + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)
                n += np.bincount(at, minlength=BINS)
                good += np.bincount(at, weights=batch.column("y").to_numpy(), minlength=BINS)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(good[some])], names=["bin", "n", "good"])

    bins = rows.select("x", "y").mapInArrow(binned, "bin int, n double, good double").groupBy("bin").agg(
        F.sum("n").alias("n"), F.sum("good").alias("good")
    ).toPandas().sort_values("bin")
    if not len(bins):
        return model
    n, good = bins["n"].to_numpy(np.float64), bins["good"].to_numpy(np.float64)
    knots = (bins["bin"].to_numpy(np.float64) + 0.5) / BINS * 2 - 0.5
    return Model(model.mean, model.scale, model.weights, *isotonic(knots, n, good / n))


def fit(labelled: DataFrame) -> Model:
    """The model for `labelled` (doc_id, x, y), of which held-out ids are not read.

    Two thirds of the rest fit the ridge and one third the calibration. Without rows for either, it says 0.5 or the
    uncalibrated value.
    """
    rows = cut_lineage(labelled.withColumn("part", fold("doc_id", FOLDS)).where(F.col("part") != HELD_OUT))
    ridge, rest = rows.where(F.col("part") != CALIBRATING), rows.where(F.col("part") == CALIBRATING)
    columns = [F.element_at("x", i + 1) for i in range(FEATURES)]
    n, *moments = ridge.agg(F.count("*"), *map(F.avg, columns), *map(F.stddev_pop, columns)).first()
    line = np.array([0.0, 1.0])
    if not n:
        return Model(np.zeros(FEATURES), np.ones(FEATURES), None, line, np.array([0.5, 0.5]))
    mean, scale = np.array(moments[:FEATURES], float), np.array(moments[FEATURES:], float)
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), None, line, line)
    left, right = _normal_equations(ridge, model)
    penalty = np.full(COSINES + 1, PENALTY * n + 1e-3)
    penalty[-1] = 1e-9
    weights = np.linalg.solve(left + np.diag(penalty), right)
    return _calibrated(rest, Model(model.mean, model.scale, weights, line, line))


def scored(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality",
) -> DataFrame:
    """doc_id, key, held_out, score for every row of `docs`; `labels` has the id column and the label, 0 or 1.

    Labels are learned from rows whose crc32(id as text) mod 4 is not 2; nothing but the text makes a score. Several
    labels of an id count with their mean, null labels and ids not at all. Null and empty texts are scored like any
    other. Null and repeated ids stay. Other columns are ignored. Empty documents: no rows; no labels: score 0.5.
    """
    rows = cut_lineage(statistics(docs, id_column, text))
    known = labels.groupBy(F.col(id_column).alias("_id")).agg(F.avg(F.col(label).cast("double")).alias("y")).where("y is not null and _id is not null")
    model = fit(rows.join(known, F.col("doc_id") == F.col("_id")).select("doc_id", "x", "y"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array(model.score(_matrix(batch)) if batch.num_rows else [], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), made], names=["doc_id", "key", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, key long, score double").withColumn("held_out", fold("doc_id", FOLDS) == HELD_OUT)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.7, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that score `least` or more, with all their columns."""
    good = scored(docs, labels, id_column, text).where(F.col("score") >= least).select(
        F.struct(F.col("doc_id").alias("id"), F.col("key").alias("hash")).alias("_row")
    )
    return keep_rows(docs, good.distinct(), id_column, text)
