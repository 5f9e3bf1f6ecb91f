"""Language-model scores by context-tree weighting over binary-decomposed bytes.

The eight bits of a byte are predicted one after another, each in the tree of its own bit prefix. In a tree, the node of
a context holds how often its bit was 0 and 1 in the training texts; its Krichevsky-Trofimov (KT) estimate is mixed
half and half with the product over the contexts one byte longer, down to the full depth. The weights of that mixture
given the training texts make the prediction for new text, so every depth counts as much as the data support.

The model is a table with one row for each context and byte that occurs anywhere. It is summed up, weighted and looked
up by shuffles and may be of any size: texts are dealt into blocks, each block asks once for each of its contexts and
words, and its texts meet only the answers. The driver sees the two topmost levels of the tree, at most 65,536 counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import scratch_folder

from .arrow import map_texts
from .common import fold

#: Bytes of context, 2 to 6; text bytes in a block; and bytes laid out at once.
DEPTH, BLOCK_BYTES, LAID_OUT = 5, 32 << 20, 2 << 20
#: Folds of crc32(id) mod 7: this one is held out.
FOLDS, HELD_OUT = 7, 2
END = 10  # No word holds a line feed; it stands for the end of a text, and before its start.


def _grams(texts: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for each byte of the texts (words joined by spaces, then END) with the bytes before it, and where each text starts.

    The nearest byte of the context is the highest digit and the byte itself the lowest, so that contexts with a
    common ending are neighbours.
    """
    pad = bytes([END]) * depth
    joined = [b" ".join(words) + b"\n" for words in texts]
    data = np.frombuffer(pad + pad.join(joined), np.uint8).astype(np.int64)
    keys = np.zeros(len(data) - depth, np.int64)
    for back in range(1, depth + 1):
        keys = keys << 8 | data[depth - back : len(data) - back]
    keys = keys << 8 | data[depth:]
    lengths = np.fromiter(map(len, joined), np.int64, len(joined))
    starts = np.cumsum(lengths + depth) - lengths - depth
    real = np.ones(len(keys), bool)
    for back in range(depth):
        real[starts[1:] - 1 - back] = False
    return keys[real], np.cumsum(lengths) - lengths


def _packed(texts: list[bytes | None]) -> dict[str, pa.Array]:
    pack = zstandard.ZstdCompressor(level=3).compress
    return {"packed": pa.array([pack(t or b"") for t in texts], pa.binary())}


def _parts(table: pa.Table) -> Iterator[tuple[slice, list[list[bytes]]]]:
    """Runs of rows with about LAID_OUT bytes of text, and the words of each text; a longer text is a run of its own."""
    unpack = zstandard.ZstdDecompressor().decompress
    packed = table.column("packed")
    start, size, held = 0, 0, []
    for i, value in enumerate(packed):
        text = unpack(value.as_py()).lower()
        if held and size + len(text) > LAID_OUT:
            yield slice(start, i), held
            start, size, held = i, 0, []
        held.append(text.split())
        size += len(text)
    if held:
        yield slice(start, start + len(held)), held


def _tokens(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word and each end, and where each text starts among them."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    each = chain.from_iterable(chain(t, (b"\n",)) for t in texts)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, each), np.uint64, int(lengths.sum())).view(np.int64)
    return hashes, np.cumsum(lengths) - lengths


class _Tally:
    """Counts by key, brought together now and then."""

    def __init__(self):
        self.keys, self.counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(self, keys: np.ndarray, starts: np.ndarray, train: np.ndarray) -> None:
        learned = np.repeat(train, np.diff([*starts, len(keys)]))
        found, at = np.unique(keys, return_inverse=True)
        self.keys.append(found)
        self.counts.append(np.bincount(at, weights=learned, minlength=len(found)).astype(np.int64))
        if len(self.keys) > 6:
            found, counts = self.sums()
            self.keys, self.counts = [found], [counts]

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        found, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        return found, np.bincount(at, weights=np.concatenate(self.counts), minlength=len(found)).astype(np.int64)


_ITEM = "block long, word boolean, key long, n long"


def _items(depth: int):
    """The contexts and words of one block, each once, with their counts in its training texts."""

    def count(table: pa.Table) -> pa.Table:
        train = np.array(table.column("train").to_pylist(), bool)
        tallies = {False: _Tally(), True: _Tally()}
        for part, texts in _parts(table):
            tallies[False].add(*_grams(texts, depth), train[part])
            tallies[True].add(*_tokens(texts), train[part])
        block = table.column("block")[0].as_py()
        out = []
        for word, tally in tallies.items():
            keys, n = tally.sums()
            out.append(pa.table({
                "block": pa.array(np.full(len(keys), block, np.int64)), "word": pa.array(np.full(len(keys), word)),
                "key": pa.array(keys), "n": pa.array(n),
            }))
        return pa.concat_tables(out)

    return count


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5: eight steps up, then Stirling's series."""
    shift = np.zeros_like(x)
    for step in range(8):
        shift += np.log(x + step)
    y = x + 8
    inverse = 1 / y
    square = inverse * inverse
    series = inverse * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square / 1680)))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the KT probability of a sequence with these counts."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - np.log(np.pi) - _log_gamma(zeros + ones + 1.0)


class Level:
    """All nodes at one depth: context (nearest byte highest) << 8 | bit prefix with a leading 1, with counts and weights."""

    def __init__(self, contexts: np.ndarray, symbols: np.ndarray, counts: np.ndarray):
        node, bit, context, count = [], [], [], []
        for j in range(8):
            node.append(1 << j | symbols >> (8 - j))
            bit.append(symbols >> (7 - j) & 1)
            context.append(contexts)
            count.append(counts)
        full = np.concatenate(context) << 8 | np.concatenate(node)
        self.keys, at = np.unique(full, return_inverse=True)
        ones, count = np.concatenate(bit), np.concatenate(count).astype(float)
        self.ones = np.bincount(at, weights=count * ones, minlength=len(self.keys))
        self.zeros = np.bincount(at, weights=count * (1 - ones), minlength=len(self.keys))
        self.own = _log_kt(self.zeros, self.ones)
        self.weight = np.ones(len(self.keys))
        self.total = self.own

    def mix(self, below_keys: np.ndarray, below_total: np.ndarray) -> None:
        """Mixes in the nodes one byte longer, given with their keys cut to this depth."""
        below = np.bincount(np.searchsorted(self.keys, below_keys), weights=below_total, minlength=len(self.keys))
        both = np.logaddexp(self.own, below)
        self.weight = np.exp(self.own - both)
        self.total = both - np.log(2)

    def cut(self) -> np.ndarray:
        """Keys of these nodes one level up."""
        return self.keys >> 16 << 8 | self.keys & 255

    def step(self, contexts: np.ndarray, symbols: np.ndarray, deeper: np.ndarray | None) -> np.ndarray:
        """Probability of each of the eight bits of `symbols` in these contexts, mixed with what the deeper level says."""
        out = np.empty((8, len(symbols)))
        for j in range(8):
            at = np.searchsorted(self.keys, contexts << 8 | 1 << j | symbols >> (8 - j))
            hit = np.where(symbols >> (7 - j) & 1, self.ones[at], self.zeros[at])
            own = (hit + 0.5) / (self.zeros[at] + self.ones[at] + 1)
            out[j] = own if deeper is None else self.weight[at] * own + (1 - self.weight[at]) * deeper[j]
        return out


def _levels(keys: np.ndarray, counts: np.ndarray, depth: int, top: int) -> list[Level]:
    """Levels `top` to `depth`, mixed from below, for grams sorted by key."""
    levels: list[Level] = []
    for d in range(depth, top - 1, -1):
        cut = keys >> 8 * (depth - d + 1) << 8 | keys & 255
        pairs, at = np.unique(cut, return_inverse=True)
        level = Level(pairs >> 8, pairs & 255, np.bincount(at, weights=counts, minlength=len(pairs)))
        if levels:
            level.mix(levels[0].cut(), levels[0].total)
        levels.insert(0, level)
    return levels


_TOP = 2


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    table = [b for b in batches if b.num_rows]
    if not table:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = pa.Table.from_batches(table)
    return whole.column("gram").to_numpy(), whole.column("n").to_numpy()


def model(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """gram, log10 for `grams` (gram, n; no repeats): the log10 probability of each byte in its context.

    Contexts that end in the same two bytes are worked on together; the levels above hold at most 65,536 counts and are
    worked out by the driver.
    """
    parts = int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = grams.repartition(parts, F.shiftright("gram", 8 * (depth - 1)))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = _gathered(batches)
        level = _levels(keys, counts, depth, _TOP)[0]
        up, at = np.unique(level.cut(), return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(up), pa.array(np.bincount(at, weights=level.total, minlength=len(up)))], names=["key", "total"])

    below = dealt.mapInArrow(sums, "key long, total double").groupBy("key").agg(F.sum("total").alias("total")).toPandas()
    last = F.shiftright("gram", 8 * depth) * 256 + F.col("gram").bitwiseAND(255)
    pairs = grams.groupBy(last.alias("pair")).agg(F.sum("n").alias("n")).toPandas()
    pair, n = pairs["pair"].to_numpy(np.int64), pairs["n"].to_numpy(np.int64)
    one = Level(pair >> 8, pair & 255, n)
    one.mix(below["key"].to_numpy(np.int64), below["total"].to_numpy(float))
    symbols, at = np.unique(pair & 255, return_inverse=True)
    zero = Level(np.zeros(len(symbols), np.int64), symbols, np.bincount(at, weights=n, minlength=len(symbols)))
    zero.mix(one.keys & 255, one.total)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = _gathered(batches)
        said, symbols = None, keys & 255
        levels = [zero, one, *_levels(keys, counts, depth, _TOP)]
        for d in range(depth, -1, -1):
            said = levels[d].step(keys >> 8 * (depth - d + 1) if d else np.zeros_like(keys), symbols, said)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.log10(said).sum(axis=0))], names=["gram", "log10"])

    return dealt.mapInArrow(predict, "gram long, log10 double")


def scored(docs: DataFrame, id_column: str = "doc_id", text: str = "text", depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte for every row.

    A-Z are lower-cased and a text is its words (runs of other than ASCII white space) and one end. `score` is the
    log10 probability of the words joined by spaces and the end; the model and the word counts come from rows whose
    crc32(id as text) mod 7 is not 2. `base_score` sums log10((c + 1) / (N + V + 1)) over the words and the end. Words are
    counted by a 64-bit hash.

    Null and empty texts: the end alone. Long texts are scored whole. Null ids are in fold 0, repeated rows count and are
    scored as often as they occur. Other columns are ignored. Empty table: no rows; nothing to learn from: all counts 0.
    """
    spark = docs.sparkSession
    body = F.col(text).cast("binary")
    total = docs.agg(F.sum(F.octet_length(body))).first()[0] or 0
    blocks = total // block_bytes + 1
    rows = docs.select(F.col(id_column).alias("doc_id"), body.alias("text")).withColumn(
        "block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))
    ).withColumn("train", fold("doc_id", FOLDS) != HELD_OUT)
    # Both passes over the blocks shuffle texts, so they travel packed.
    rows = map_texts(rows, "text", "packed binary", _packed)
    folder = scratch_folder(spark)
    rows.drop("doc_id").groupBy("block").applyInArrow(_items(depth), _ITEM).write.option("compression", "zstd").parquet(f"{folder}/items")
    items = spark.read.schema(_ITEM).parquet(f"{folder}/items")
    words, contexts = items.where("word").drop("word"), items.where("not word").drop("word")
    contexts.groupBy(F.col("key").alias("gram")).agg(F.sum("n").alias("n")).write.option("compression", "zstd").parquet(f"{folder}/grams")
    grams = spark.read.schema("gram long, n long").parquet(f"{folder}/grams")
    counts = words.groupBy("key").agg(F.sum("n").alias("c"))
    tokens, kinds = counts.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1))).first()
    tokens, kinds = tokens or 0, kinds or 0
    said = contexts.select("block", "key").join(model(grams, depth).withColumnRenamed("gram", "key"), "key").select(
        "block", F.lit(False).alias("word"), "key", F.col("log10").alias("value")
    )
    answers = said.unionByName(words.select("block", "key").join(counts, "key").select(
        "block", F.lit(True).alias("word"), "key", F.col("c").cast("double").alias("value")
    ))

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        of = {}
        for word in (False, True):
            some = answers.filter(pc.equal(answers.column("word"), word))
            keys, values = some.column("key").to_numpy(), some.column("value").to_numpy()
            order = np.argsort(keys)
            of[word] = keys[order], values[order]

        def answered(word: bool, keys: np.ndarray) -> np.ndarray:
            once, at = np.unique(keys, return_inverse=True)
            return of[word][1][np.searchsorted(of[word][0], once)][at]

        found = {name: [np.zeros(0)] for name in ("n_tokens", "n_known", "base_score", "score", "n_bytes")}
        for _, texts in _parts(table):
            hashes, starts = _tokens(texts)
            seen, n = answered(True, hashes), np.diff([*starts, len(hashes)])
            found["n_tokens"].append(n)
            found["n_known"].append(np.add.reduceat(seen > 0, starts, dtype=np.int64))
            found["base_score"].append(np.add.reduceat(np.log10(seen + 1), starts) - n * np.log10(tokens + kinds + 1))
            grams, starts = _grams(texts, depth)
            found["score"].append(np.add.reduceat(answered(False, grams), starts))
            found["n_bytes"].append(np.diff([*starts, len(grams)]))
        whole = {name: np.concatenate(parts) for name, parts in found.items()}
        return pa.table({
            "doc_id": table.column("doc_id"), "held_out": pc.invert(table.column("train")),
            "n_tokens": pa.array(whole["n_tokens"].astype(np.int64)), "n_known": pa.array(whole["n_known"].astype(np.int64)),
            "train_tokens": pa.array(np.full(table.num_rows, tokens, np.int64)),
            "base_score": pa.array(whole["base_score"]), "score": pa.array(whole["score"]), "n_bytes": pa.array(whole["n_bytes"].astype(np.int64)),
            "bits_per_byte": pa.array(-whole["score"] * np.log2(10) / whole["n_bytes"]),
        })

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    )
