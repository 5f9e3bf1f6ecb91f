"""A partitioned index of vectors for approximate search by cosine, with exact scores for what it finds.

Unit vectors are assigned to the nearest of some centroids, and each row keeps its list and the rest, vector minus centroid, as
one byte a dimension. The table is written by list, so that a search reads the lists that a question looks into and no others. Rows of a
list are dealt into lanes of bounded size, and so are the questions that look into it; a task scores one lane of rows for one
lane of questions by their codes and gives out its best few. These are scored again with their whole vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from .ranking import top_k
from .retrieve import dense_search
from .scan import SIMILARITY_DIGITS

#: Rows that centroids are fitted on at most; every row is indexed.
SAMPLE = 65_536
#: Lists at most, and rounds of the fit.
MAX_LISTS, ROUNDS, SEED = 4096, 12, 7
#: Questions that the number of lists to look into is measured on.
TUNING = 256
#: Rows of a list, and questions that look into it, in one task.
ROW_LANE, QUESTION_LANE = 32_768, 4096


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors; a null vector, one of another length or with an undefined entry is zero."""
    lengths = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out, ends = np.zeros((len(lengths), dim)), np.cumsum(lengths)
    fit = np.flatnonzero(lengths == dim)
    if len(fit):
        out[fit] = flat[(ends[fit] - dim)[:, None] + np.arange(dim)]
    out[~np.isfinite(out).all(axis=1)] = 0.0
    return _unit(out)


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means over unit vectors; a centroid without rows keeps its place."""
    random = np.random.default_rng(SEED)
    centroids = sample[random.permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        nearest = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        full = np.linalg.norm(sums, axis=1) > 0
        centroids[full] = _unit(sums[full])
    return centroids


@dataclass(frozen=True)
class VectorIndex:
    """Where the coded rows lie, their centroids, the rows of each list and the name of the key."""

    path: str
    centroids: np.ndarray
    sizes: DataFrame
    item: str
    rows: int
    schema: T.StructType

    def table(self, spark: SparkSession) -> DataFrame:
        """The coded rows: key, scale, code, list."""
        return spark.read.schema(self.schema).parquet(self.path)

    @property
    def lists(self) -> int:
        return len(self.centroids)


def build(rows: DataFrame, item: str, vector: str, path: str, lists: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """Index every row of `rows` in a new table at `path`; a list for each square root of rows if `lists` is not given.

    Centroids are fitted on at most `sample` rows, those of the smallest key hash. Rows whose vector is null, zero, undefined or of another
    length than the first of the sample are indexed with similarity 0 to everything. Keys should be unique.
    """
    spark = rows.sparkSession
    known = rows.select(F.col(item), F.col(vector).alias("v"))
    n = known.count()
    some = known.where(F.col("v").isNotNull()).orderBy(F.xxhash64(item), item).limit(sample).select("v").toArrow().column("v").combine_chunks()
    dim = len(some[0]) if len(some) else 1
    usable = _rows(some, dim) if len(some) else np.zeros((0, dim))
    usable = usable[np.linalg.norm(usable, axis=1) > 0]
    wanted = max(1, min(MAX_LISTS, lists or round(n**0.5), len(usable)))
    centroids = fit_centroids(usable, wanted) if len(usable) else np.zeros((1, dim))
    shared = spark.sparkContext.broadcast(centroids)
    schema = T.StructType([known.schema[item], T.StructField("list", T.IntegerType()), T.StructField("scale", T.DoubleType()), T.StructField("code", T.BinaryType())])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = shared.value
        for batch in batches:
            unit = _rows(batch.column("v"), dim)
            nearest = (unit @ middle.T).argmax(axis=1)
            rest = unit - middle[nearest]
            scale = np.abs(rest).max(axis=1, initial=0.0) / 127
            codes = np.round(np.divide(rest, scale[:, None], out=np.zeros_like(rest), where=scale[:, None] > 0)).astype(np.int8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(item), pa.array(nearest.astype(np.int32)), pa.array(scale), pa.array([c.tobytes() for c in codes], pa.binary())],
                names=schema.fieldNames(),
            )

    coded = known.mapInArrow(code, schema)
    # A list of many rows is spread over tasks and files.
    spread = F.pmod(F.xxhash64(item), F.lit(64)).cast("int")
    coded.repartition("list", spread).write.partitionBy("list").parquet(path)
    sizes = spark.read.schema(schema).parquet(path).groupBy("list").agg(F.count("*").alias("n"))
    return VectorIndex(path, centroids, sizes, item, n, schema)


def _probes(index: VectorIndex, questions: DataFrame, question: str, vector: str, probes: int) -> DataFrame:
    """question, v, list, place: the nearest `probes` lists of every question, nearest first (place 1)."""
    asked = questions.select(F.col(question), F.col(vector).alias("v"))
    shared = questions.sparkSession.sparkContext.broadcast(index.centroids)
    kind = T.StructType([asked.schema[question], T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("list", T.IntegerType()), T.StructField("place", T.IntegerType())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = shared.value
        for batch in batches:
            unit = _rows(batch.column("v"), middle.shape[1])
            near = np.argsort(-(unit @ middle.T), axis=1, kind="stable")[:, :probes]
            who = np.repeat(np.arange(len(unit)), near.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(question).take(pa.array(who)), pa.array(list(unit[who]), pa.list_(pa.float64())), pa.array(near.ravel().astype(np.int32)),
                 pa.array(np.tile(np.arange(1, near.shape[1] + 1, dtype=np.int32), len(unit)))],
                names=kind.fieldNames(),
            )

    return asked.mapInArrow(look, kind)


def search(index: VectorIndex, rows: DataFrame, vector: str, questions: DataFrame, question: str, query_vector: str, k: int,
           probes: int = 8, again: int = 4) -> DataFrame:
    """question, item, similarity, rank: the k nearest rows of every question among those in the `probes` lists nearest to it.

    The best `again` x k rows of a question by their codes are scored with their vectors in `rows`. Similarities are cosines at nine
    decimals, ties by the key. With as many probes as lists and `again` x k rows or more, the answer is the exact one. No rows or
    no questions: no answer.
    """
    spark, short = rows.sparkSession, again * k
    asked = _probes(index, questions, question, query_vector, min(probes, index.lists))
    per_list = asked.groupBy("list").agg(F.count("*").alias("asked")).join(index.sizes, "list").select(
        "list", F.ceil(F.col("n") / ROW_LANE).cast("int").alias("row_lanes"), F.ceil(F.col("asked") / QUESTION_LANE).cast("int").alias("question_lanes")
    )
    # One row a list, of which there are MAX_LISTS at most.
    per_list = F.broadcast(per_list)
    coded = index.table(spark).join(per_list, "list").withColumn(
        "row_lane", F.pmod(F.xxhash64(index.item), F.col("row_lanes")).cast("int")
    ).withColumn("question_lane", F.explode(F.sequence(F.lit(0), F.col("question_lanes") - 1)))
    dealt = asked.join(per_list, "list").withColumn(
        "question_lane", F.pmod(F.xxhash64(question), F.col("question_lanes")).cast("int")
    ).withColumn("row_lane", F.explode(F.sequence(F.lit(0), F.col("row_lanes") - 1)))
    place = ["list", "row_lane", "question_lane"]
    shared, item = spark.sparkContext.broadcast(index.centroids), index.item
    schema = T.StructType([asked.schema[question], coded.schema[item], T.StructField("estimate", T.DoubleType())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema_arrow.empty_table()
        middle = shared.value[left.column("list")[0].as_py()]
        codes = np.frombuffer(b"".join(left.column("code").to_pylist()), np.int8).reshape(left.num_rows, -1).astype(np.float64)
        near = codes * left.column("scale").to_numpy()[:, None]
        views = right.column("v").combine_chunks().flatten().to_numpy().reshape(right.num_rows, -1)
        kept = min(short, left.num_rows)
        who, what, how = [], [], []
        for start in range(0, right.num_rows, 256):
            part = views[start : start + 256]
            estimate = (part @ middle)[:, None] + part @ near.T
            best = np.argpartition(-estimate, kept - 1, axis=1)[:, :kept]
            who.append(np.repeat(np.arange(start, start + len(part)), kept))
            what.append(best.ravel())
            how.append(np.take_along_axis(estimate, best, axis=1).ravel())
        return pa.Table.from_arrays([
            right.column(question).take(pa.array(np.concatenate(who))), left.column(item).take(pa.array(np.concatenate(what))), pa.array(np.concatenate(how)),
        ], schema=schema_arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema_arrow = to_arrow_schema(schema)
    left = coded.select(item, "scale", "code", *place).groupBy(*place)
    found = left.cogroup(dealt.select(question, "v", *place).groupBy(*place)).applyInArrow(score, schema)
    shortlist = top_k(found, [question], [F.desc("estimate"), F.asc(item)], short).select(question, item)
    whole = shortlist.join(rows.select(item, F.col(vector).alias("_v")), item).join(questions.select(question, F.col(query_vector).alias("_q")), question)
    scored = whole.select(question, item, F.round(F.nanvl(V.cosine("_v", "_q"), F.lit(0.0)), SIMILARITY_DIGITS).alias("similarity"))
    return top_k(scored, [question], [F.desc("similarity"), F.asc(item)], k)


def probes_for(index: VectorIndex, rows: DataFrame, vector: str, questions: DataFrame, question: str, query_vector: str, k: int,
               share: float = 0.95, sample: int = TUNING) -> int:
    """How many lists to look into so that `share` of the exact answers of some questions lie in them.

    The questions are the `sample` of smallest key hash. Their exact answers come from one scan; each lies in a list that is
    the first, second or later one for its question, and the places are counted. No questions or rows: 1.
    """
    some = questions.select(F.col(question).alias("_q"), F.col(query_vector).alias("query_vector")).orderBy(F.xxhash64("_q"), "_q").limit(sample)
    exact = dense_search(rows.select(F.col(index.item).alias("chunk_id"), F.col(vector).alias("embedding")), some.select(F.col("_q").alias("query_id"), "query_vector"), k)
    lists = index.table(rows.sparkSession).select(F.col(index.item).alias("chunk_id"), "list")
    seen = _probes(index, some, "_q", "query_vector", index.lists).select(F.col("_q").alias("query_id"), "list", "place")
    places = exact.join(lists, "chunk_id").join(seen, ["query_id", "list"]).groupBy("place").count().orderBy("place").collect()
    wanted, held = share * sum(r["count"] for r in places), 0
    for r in places:
        held += r["count"]
        if held >= wanted:
            return r["place"]
    return 1


def recall(found: DataFrame, exact: DataFrame, question: str, item: str) -> DataFrame:
    """questions, recall: the share of the exact answers that were found, over all questions."""
    hit = exact.select(question, item).join(found.select(question, item, F.lit(1).alias("_hit")), [question, item], "left")
    return hit.agg(F.count_distinct(question).alias("questions"), (F.count("_hit") / F.count("*")).alias("recall"))
