"""A text index: words with their places, and runs of letters that can be searched for any part of them.

Chunks are dealt into lanes of bounded size. A posting is one word in one lane, with the chunks and places that hold it, so a frequent
word is many rows of bounded length. Building moves each text once, to its lane, where all its postings are made; no row is shuffled for a
word and place, and postings travel to their buckets in packs. Letter grams are postings too, of the different runs instead of chunks. Postings are written by buckets of words: a search reads the buckets of its words, brings
the postings of a lane together and gives out the best few chunks of each question and lane. What travels is the postings of the asked words, once for
a block of questions, and lanes x questions x k results; no row holds a question and a chunk beside these.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import TOKEN_PATTERN
from . import scan
from .ranking import top_k

#: Bytes of text in one lane, and the fewest and most buckets that words are written by.
LANE_BYTES, FEW_BUCKETS, MANY_BUCKETS = 16 << 20, 4, 1024
#: Fixed value: what a cover without words in between adds to the rank.
COVER_WEIGHT = 0.1
#: Occurrences, and sixteen for each term, in one pack.
PACK = 1 << 16
#: Lanes whose packs of a bucket go to one task.
LANES_TOGETHER = 64
#: Runs up to this length are their own key, longer ones their digest.
KEY_LENGTH = 32


@dataclass(frozen=True)
class TextIndex:
    """Where the tables lie, the name and type of the chunk key, and the numbers of lanes and buckets.

    ``words``: term, lane, items, how many places each has, places one item after the other; ``held``: run key, lane, items, the run where it is
    not its own key; ``grams``: gram, lane of runs, ids of the runs. These by bucket of their first column. ``runs``: lane of runs, id, key, run;
    an id is a hash of the key, and keys that share one are in one lane.
    """

    path: str
    item: T.StructField
    lanes: int
    buckets: int

    def bucket(self, word: Column) -> Column:
        return F.pmod(F.crc32(word.cast("binary")), F.lit(self.buckets)).cast("int")

    def _buckets_of(self, words: list[str]) -> list[int]:
        """As ``bucket``, for words on the driver."""
        return sorted({zlib.crc32(w.encode()) % self.buckets for w in words})

    def _write_placed(self, df: DataFrame, order: list[str], name: str) -> None:
        df.sortWithinPartitions(*order).write.partitionBy("bucket").parquet(f"{self.path}/{name}")

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        item = self.item.dataType.simpleString()
        columns = {
            "words": f"term string, lane bigint, items array<{item}>, counts array<int>, places array<int>",
            "held": f"key string, lane bigint, items array<{item}>, run string",
            "runs": "lane bigint, id bigint, key string, run string", "grams": "gram string, lane bigint, ids array<bigint>",
        }
        return spark.read.schema(columns[name] + (", bucket int" if name != "runs" else "")).parquet(f"{self.path}/{name}")

    def postings(self, spark: SparkSession, words: list[str]) -> DataFrame:
        """Postings of some words: only their buckets are read."""
        return self.table(spark, "words").where(F.col("bucket").isin(self._buckets_of(words)) & F.col("term").isin(words))

    def runs_holding(self, spark: SparkSession, words: list[str]) -> DataFrame:
        """(word, key): every run that holds a word of two letters or more.

        A run must have all grams of the word, of three letters where the word is long enough; those that do are compared letter by letter.
        The lists of a lane's grams are intersected in one task, which gives out no row for a gram and run.
        """
        grams = {w: sorted({w[i : i + 3] for i in range(max(1, len(w) - 2))}) for w in words}
        listed = sorted({g for needed in grams.values() for g in needed})
        known = self.table(spark, "grams").where(F.col("bucket").isin(self._buckets_of(listed)) & F.col("gram").isin(listed))
        shared = spark.sparkContext.broadcast(grams)
        likely = known.select("lane", "gram", "ids").groupBy("lane").applyInArrow(lambda t: _holding_all(t, shared.value), "word string, lane bigint, id bigint")
        return likely.join(self.table(spark, "runs"), ["lane", "id"]).where(F.contains("run", "word")).select("word", "key")


def _key(term: str) -> str:
    return term if len(term) <= KEY_LENGTH else hashlib.sha256(term.encode()).hexdigest()


def _lane_postings(table: pa.Table, bucket_of: Callable[[str], int]) -> pa.Table:
    """One row a term of the (lane, item, terms) rows of a lane, by bucket and term: its items in order, how often each holds it, and where."""
    table = table.sort_by(table.column_names[1])
    lane, items, terms = (c.combine_chunks() for c in table.columns)
    listed, keys, lengths = terms.flatten().dictionary_encode(), items.dictionary_encode(), np.asarray(terms.value_lengths())
    known = pa.table({"bucket": pa.array([bucket_of(t) for t in listed.dictionary.to_pylist()], pa.int32()), "term": listed.dictionary})
    by_bucket = np.asarray(pc.sort_indices(known, [("bucket", "ascending"), ("term", "ascending")]))
    term = np.argsort(by_bucket)[np.asarray(listed.indices)]
    item = np.repeat(np.asarray(keys.indices), lengths)
    place = (np.arange(len(item)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
    unique = len(keys.dictionary) == len(items)  # then items and places ascend as they stand
    order = np.argsort(term, kind="stable") if unique else np.lexsort((place, item, term))
    term, item = term[order], item[order]
    first = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(item, prepend=-1) != 0))
    edges = lambda sorted_terms: pa.array(np.searchsorted(sorted_terms, np.arange(known.num_rows + 1)).astype(np.int32))
    within, counts = edges(term[first]), np.diff(first, append=len(item)).astype(np.int32)
    lists = (within, keys.dictionary.take(pa.array(item[first]))), (within, pa.array(counts)), (edges(term), pa.array(place[order]))
    known = known.take(pa.array(by_bucket)).append_column("lane", pa.array(np.full(known.num_rows, lane[0].as_py(), np.int64)))
    for name, parts in zip(("items", "counts", "places"), lists):
        known = known.append_column(name, pa.ListArray.from_arrays(*parts))
    return known


def _lane_grams(table: pa.Table, bucket_of: Callable[[str], int]) -> pa.Table:
    """One row a gram of two or three letters of the (lane, id, run) rows of a lane, by bucket and gram: the ids of the runs that hold it."""
    lane, runs = table.column(0)[0].as_py(), table.column(2).to_pylist()
    ids, place = np.unique(np.asarray(table.column(1)), return_inverse=True)
    codes = np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32).astype(np.int64)
    run = np.repeat(np.arange(len(runs), dtype=np.int32), [len(r) for r in runs])
    grams, at = [], []
    for n in (2, 3):  # 21 bits a letter; no run has the letter 0, so pairs and triples differ
        parts = [codes[i : len(codes) - n + 1 + i] << 21 * (n - 1 - i) for i in range(n)]
        within = run[: len(parts[0])] == run[n - 1 :]
        grams.append(np.bitwise_or.reduce(parts)[within])
        at.append(place[run[: len(parts[0])][within]])
    known, gram = np.unique(np.concatenate(grams), return_inverse=True)
    names = ["".join(chr(g >> 21 * i & 0x1FFFFF) for i in (2, 1, 0) if g >> 21 * i) for g in known.tolist()]
    terms = pa.table({"bucket": pa.array([bucket_of(g) for g in names], pa.int32()), "term": pa.array(names, pa.string())})
    by_bucket = np.asarray(pc.sort_indices(terms, [("bucket", "ascending"), ("term", "ascending")]))
    pairs = np.unique(np.argsort(by_bucket)[gram] * len(ids) + np.concatenate(at))
    gram, held = np.divmod(pairs, max(1, len(ids)))
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(gram, np.arange(len(names) + 1)).astype(np.int32)), pa.array(ids[held]))
    terms = terms.take(pa.array(by_bucket)).append_column("lane", pa.array(np.full(len(names), lane, np.int64)))
    return terms.append_column("ids", lists)


def _packed(postings: pa.Table) -> pa.Table:
    """(bucket, term, lane, pack): postings of one bucket that stand together, under the first of their terms. The last column has the longest lists."""
    bucket = np.asarray(postings.column("bucket"))
    weight = np.cumsum(np.asarray(pc.list_value_length(postings.column(-1)), dtype=np.int64) + 16) // PACK
    starts = np.flatnonzero((np.diff(bucket, prepend=-1) != 0) | (np.diff(weight, prepend=-1) != 0))
    packs = []
    for a, b in zip(starts, [*starts[1:], len(bucket)]):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, postings.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(postings.slice(a, b - a))
        packs.append(sink.getvalue().to_pybytes())
    return postings.select(["bucket", "term", "lane"]).take(pa.array(starts)).append_column("pack", pa.array(packs, pa.binary()))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pack in batch.column("pack"):
            yield from pa.ipc.open_stream(pack.as_buffer())


def _by_bucket(rows: DataFrame, task: Callable[[pa.Table], pa.Table], columns: str) -> DataFrame:
    """(bucket, term, lane, further columns) that ``task`` makes of the rows of a lane, a bucket's postings of some lanes in one partition.

    Packs go by the hash of bucket and lanes: no sample is taken, for which all postings would be made twice, and a frequent word's are spread.
    """
    packs = rows.groupBy("lane").applyInArrow(lambda table: _packed(task(table)), "bucket int, term string, lane bigint, pack binary")
    packs = packs.repartition("bucket", F.floor(F.col("lane") / LANES_TOGETHER))
    return packs.mapInArrow(_unpacked, f"bucket int, term string, lane bigint, {columns}")


def _postings(rows: DataFrame, index: TextIndex, pattern: str, key: Callable[[str], str]) -> DataFrame:
    """(bucket, term, lane, items, counts, places) of what ``pattern`` finds.

    Texts move to their lanes before words are cut, packs of postings to their buckets.
    """
    found, buckets, item = F.regexp_extract_all("content", F.lit(pattern), F.lit(0)).alias("terms"), index.buckets, index.item
    words = rows.repartition("lane").select("lane", item.name, found)
    task = lambda table: _lane_postings(table, lambda t: zlib.crc32(key(t).encode()) % buckets)
    return _by_bucket(words, task, f"items array<{item.dataType.simpleString()}>, counts array<int>, places array<int>")


def build(chunks: DataFrame, item: str, content: str, path: str, lane_bytes: int = LANE_BYTES, parts: bool = True) -> TextIndex:
    """Index the words of every text in new tables at ``path``; without ``parts`` for ``cover_search`` alone.

    Chunks without a key or a text are not indexed. Keys should be unique: chunks of one key count as one text. Words are those of
    ``functions.text.tokens`` and count places among all words, stop words and single letters included. A task holds the words of
    one lane: ``lane_bytes`` of text, or its longest text.
    """
    rows = chunks.where(F.col(item).isNotNull() & F.col(content).isNotNull()).select(F.col(item), F.lower(content).alias("content"))
    size = rows.agg(F.sum(F.octet_length("content").cast("bigint"))).first()[0] or 0
    lanes = max(1, math.ceil(size / lane_bytes))
    index = TextIndex(path, rows.schema[item], lanes, min(MANY_BUCKETS, FEW_BUCKETS * lanes))
    rows = rows.withColumn("lane", F.pmod(F.xxhash64(item), F.lit(index.lanes)))
    index._write_placed(_postings(rows, index, TOKEN_PATTERN, str), ["bucket", "term", "lane"], "words")
    if not parts:
        return index

    short = F.length("term") <= KEY_LENGTH
    keys = F.when(short, F.col("term")).otherwise(F.sha2("term", 256)).alias("key")
    held = _postings(rows, index, scan.KeywordScorer.RUN, _key).select("bucket", keys, "lane", "items", F.when(~short, F.col("term")).alias("run"))
    index._write_placed(held, ["bucket", "key", "lane"], "held")
    written = index.table(rows.sparkSession, "held").groupBy("key").agg(F.min("run").alias("run"))
    number = F.xxhash64("key")
    runs = written.select(F.pmod(number, F.lit(FEW_BUCKETS * lanes)).alias("lane"), number.alias("id"), "key", F.coalesce("run", "key").alias("run"))
    runs.write.parquet(f"{path}/runs")
    buckets = index.buckets
    task = lambda table: _lane_grams(table, lambda g: zlib.crc32(g.encode()) % buckets)
    grams = _by_bucket(index.table(rows.sparkSession, "runs").select("lane", "id", "run"), task, "ids array<bigint>")
    index._write_placed(grams.withColumnRenamed("term", "gram"), ["bucket", "gram", "lane"], "grams")
    return index


def covers(items: np.ndarray, places: np.ndarray, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Chunks that hold all ``n`` words and their rank by cover density.

    A cover is a stretch with every word in it that holds no shorter such stretch; it adds ``COVER_WEIGHT`` divided by one more than
    its number of other words. For every occurrence the latest place of each word so far is kept; the
    earliest of these begins the shortest stretch that ends there, a cover where it begins later than the one before.
    """
    order = np.lexsort((words, places, items))
    items, places, words = items[order], places[order].astype(np.int64), words[order]
    known, chunk = np.unique(items, return_inverse=True)
    span = int(places.max(initial=0)) + 1
    at = chunk * span + places
    latest = [np.maximum.accumulate(np.where(words == w, at, -1)) for w in range(n)]
    begin = np.minimum.reduce(latest)
    cover = (begin >= chunk * span) & (np.diff(begin, prepend=-1) != 0)
    end = np.flatnonzero(cover)
    others = at[end] - begin[end] - (end - np.searchsorted(at, begin[end]))
    ranks = np.bincount(chunk[end], weights=COVER_WEIGHT / (1 + others), minlength=len(known))
    whole = np.bincount(chunk[end], minlength=len(known)) > 0
    return known[whole], np.round(ranks[whole], scan.SIMILARITY_DIGITS)


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column as arrays, without copies."""
    out = []
    for part in column.chunks:
        flat, ends = part.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.asarray(part.value_lengths().fill_null(0)))
        out += np.split(flat, ends[:-1]) if len(ends) else []
    return out


def _best(items: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    keep = np.lexsort((items, -scores))[:k]
    return items[keep], scores[keep]


def _holding_all(table: pa.Table, grams: dict[str, list[str]]) -> pa.Table:
    """(word, lane, id) of the runs of the lane that have all grams of a word, from its (lane, gram, ids) rows."""
    ids, row = _lists(table.column("ids")), {g: i for i, g in enumerate(table.column("gram").to_pylist())}
    found: dict[str, np.ndarray] = {}
    for word, needed in grams.items():
        if all(g in row for g in needed):
            found[word] = reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), sorted((ids[row[g]] for g in needed), key=len))
    word = np.repeat(np.arange(len(found)), [len(x) for x in found.values()])
    ids = np.concatenate([np.empty(0, np.int64), *found.values()])
    words = pa.array(list(found), pa.string()).take(pa.array(word.astype(np.int64)))
    return pa.table({"word": words, "lane": np.full(len(ids), table.column("lane")[0].as_py(), np.int64), "id": ids})


def _by_cover(table: pa.Table, terms: list[list[str]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each question whose words are all in the lane: the chunks holding all of them and their rank."""
    items, times, places = (_lists(table.column(c)) for c in ("items", "counts", "places"))
    row = {t: i for i, t in enumerate(table.column("term").to_pylist())}
    for q, asked in enumerate(terms):
        if not asked or any(t not in row for t in asked):
            continue
        rows = [row[t] for t in asked]
        common = reduce(lambda kept, r: np.intersect1d(kept, items[r]), sorted(rows, key=lambda r: len(items[r])), items[rows[0]])
        if len(common):
            inside = [np.isin(items[r], common) for r in rows]
            kept = [(items[r][i].repeat(times[r][i]), places[r][i.repeat(times[r])]) for r, i in zip(rows, inside)]
            yield q, *covers(*(np.concatenate(x) for x in zip(*kept)), np.repeat(np.arange(len(rows)), [len(p) for _, p in kept]), len(rows))


def _by_count(table: pa.Table, terms: list[list[str]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each question the chunks of the lane with a word of it inside a run, and how many words they hold."""
    holding: dict[str, list[np.ndarray]] = {}
    for words, items in zip(table.column("words").to_pylist(), _lists(table.column("items"))):
        for word in words:
            holding.setdefault(word, []).append(items)
    chunks = {word: np.unique(np.concatenate(lists)) for word, lists in holding.items()}
    for q, asked in enumerate(terms):
        if found := [chunks[t] for t in asked if t in chunks]:
            items, n = np.unique(np.concatenate(found), return_counts=True)
            yield q, items, n.astype(float)


def _per_lane(index: TextIndex, postings: DataFrame, queries: DataFrame, query_id: str, block: scan.QueryBlock, k: int, scored: Callable) -> DataFrame:
    """(query, item, score): the best k of each question in each lane."""
    item = index.item.name
    types = scan._arrow_type(queries.schema[query_id].dataType), scan._arrow_type(index.item.dataType), pa.float64()
    shared = postings.sparkSession.sparkContext.broadcast((block.ids, block.terms))

    def task(table: pa.Table) -> pa.Table:
        ids, terms = shared.value
        parts = [(ids[q], *_best(items, scores, k)) for q, items, scores in scored(table, terms)]
        columns = [i for i, items, _ in parts for _ in items], [x for _, items, _ in parts for x in items.tolist()], [s for _, _, scores in parts for s in scores.tolist()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=[query_id, item, "score"])

    schema = T.StructType([queries.schema[query_id], T.StructField(item, index.item.dataType), T.StructField("score", T.DoubleType())])
    return postings.groupBy("lane").applyInArrow(task, schema)


def _search(index: TextIndex, queries: DataFrame, query_id: str, terms: str, k: int, max_queries: int, read: Callable, scored: Callable) -> DataFrame:
    spark, item = queries.sparkSession, index.item.name
    found = []
    for block in scan.query_blocks(queries.where(F.size(terms) > 0), query_id, terms=terms, max_queries=max_queries):
        words = sorted({t for asked in block.terms for t in asked})
        found.append(_per_lane(index, read(spark, words), queries, query_id, block, k, scored))
    none = spark.createDataFrame([], T.StructType([queries.schema[query_id], T.StructField(item, index.item.dataType), T.StructField("score", T.DoubleType())]))
    return top_k(reduce(DataFrame.unionByName, found, none), [query_id], [F.desc("score"), F.asc(item)], k)


def cover_search(index: TextIndex, queries: DataFrame, query_id: str, terms: str, k: int = 30, max_queries: int = 1024) -> DataFrame:
    """(query, item, score, rank): the best k chunks that hold every word of the array ``terms``, by cover density, ties by key.

    Words must be different and as ``functions.text.tokens`` gives them; a question without words finds nothing.
    """
    return _search(index, queries, query_id, terms, k, max_queries, index.postings, _by_cover)


def part_search(index: TextIndex, queries: DataFrame, query_id: str, terms: str, k: int = 30, max_queries: int = 1024) -> DataFrame:
    """(query, item, score, rank): the best k chunks by how many words of ``terms`` occur in them, also inside longer words, ties by key.

    Words must be different, lower-case, of two or more letters, digits, ``_`` or ``-``.
    """

    def read(spark: SparkSession, words: list[str]) -> DataFrame:
        runs = index.runs_holding(spark, words).groupBy("key").agg(F.collect_list("word").alias("words"))  # a run's chunks move once for all its words
        return index.table(spark, "held").drop("run").join(runs, "key").select("lane", "words", "items")

    return _search(index, queries, query_id, terms, k, max_queries, read, _by_count)


def keyword_candidates(index: TextIndex, queries: DataFrame, query_id: str, terms: str, k: int = 30, max_queries: int = 1024) -> DataFrame:
    """(query, item, n): the best k by ``part_search`` and the best k by ``cover_search`` together, with the number of words they hold."""
    parts = part_search(index, queries, query_id, terms, k, max_queries).select(query_id, index.item.name, F.col("score").alias("n"))
    whole = cover_search(index, queries, query_id, terms, k, max_queries).select(query_id, index.item.name)
    needed = queries.select(query_id, F.size(terms).cast("double").alias("n"))
    return parts.unionByName(whole.join(needed, query_id)).groupBy(query_id, index.item.name).agg(F.max("n").alias("n"))
