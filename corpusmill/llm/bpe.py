"""Byte-level BPE encoding and decoding with an index of pair occurrences.

The different words of a batch lie one after another in one array of symbols. An index maps each adjacent pair that has
a merge rule to all positions where it occurs. The lowest rank in the index is taken first, all its occurrences are
merged from left to right, and only the lists of the pairs beside them change. Words do not touch, so each gets the
merges it would get alone, in the same order.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_texts
from .common import unused

# Fixed value: the pattern that splits a text into words before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a Python worker remembers before the older half goes, and tokens of a long text that are laid out at once.
REMEMBERED = 400_000
LAID_OUT = 1 << 20
_END = -1


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class Vocabulary:
    """Merge rules, token bytes and special tokens of a tokenizer file, and the words already encoded."""

    def __init__(self, source: str):
        spec = json.loads(source)
        letters = byte_letters()
        byte_of = {letter: b for b, letter in letters.items()}
        ids = dict(spec["model"]["vocab"])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of: dict[int, bytes] = {
            i: bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
            for token, i in {**ids, **self.special}.items()
        }
        self.first = [ids[letters[b]] for b in range(256)]
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rules.setdefault((ids[left], ids[right]), (rank, ids[left + right]))
        self.words = regex.compile(PATTERN)
        names = sorted(map(regex.escape, self.special), key=len, reverse=True)
        self.split = regex.compile(f"({'|'.join(names)})") if names else None
        size = max(self.bytes_of, default=0) + 1
        self.lengths = np.array([len(self.bytes_of.get(i, b"")) for i in range(size)], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(size)), np.uint8)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word."""
        first, rules = self.first, self.rules
        symbols: list[int] = []
        heads = []
        for word in words:
            heads.append(len(symbols))
            symbols += [first[b] for b in word.encode()]
            symbols.append(_END)
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        places: dict[int, list[int]] = {}
        pair_of: dict[int, tuple[int, int, int]] = {}
        rank_of = {pair: rules.get(pair) for pair in set(zip(symbols, symbols[1:]))}
        for at, pair in enumerate(zip(symbols, symbols[1:])):
            rule = rank_of[pair]
            if rule is not None:
                places.setdefault(rule[0], []).append(at)
                pair_of[rule[0]] = (*pair, rule[1])
        active = list(places)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            left, right, new = pair_of[rank]
            for at in sorted(places.pop(rank)):
                if symbols[at] != left:
                    continue
                gone = after[at]
                if symbols[gone] != right:
                    continue
                beyond = after[gone]
                symbols[at], symbols[gone] = new, _END
                after[at] = beyond
                before[beyond] = at
                for start, pair in ((before[at], (symbols[before[at]], new)), (at, (new, symbols[beyond]))):
                    rule = rules.get(pair)
                    if rule is not None:
                        if rule[0] not in places:
                            places[rule[0]] = []
                            pair_of[rule[0]] = (*pair, rule[1])
                            heapq.heappush(active, rule[0])
                        places[rule[0]].append(start)
        out = []
        for at in heads:
            ids = []
            while symbols[at] != _END:
                ids.append(symbols[at])
                at = after[at]
            out.append(ids)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text; special tokens written in a text are recognised."""
        split = []
        for text in texts:
            parts = self.split.split(text) if self.split else [text]
            split.append([(self.special[p] if i % 2 else self.words.findall(p)) for i, p in enumerate(parts)])
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        needed = set(chain.from_iterable(p for parts in split for p in parts if not isinstance(p, int))) - self.known.keys()
        self.known.update((w, self.older[w]) for w in needed & self.older.keys())
        fresh = list(needed - self.known.keys())
        self.known.update((w, np.array(ids, "<u4").tobytes()) for w, ids in zip(fresh, self.merged(fresh), strict=True))
        of = self.known.__getitem__
        return [
            np.frombuffer(b"".join(int(p).to_bytes(4, "little") if isinstance(p, int) else b"".join(map(of, p)) for p in parts), "<u4")
            for parts in split
        ]

    def decode(self, ids: np.ndarray) -> str:
        """The text of token ids; bytes that are not UTF-8 become U+FFFD."""
        pieces = []
        for start in range(0, len(ids), LAID_OUT):
            some = ids[start : start + LAID_OUT].astype(np.int64)
            lengths = self.lengths[some]
            ends = np.cumsum(lengths)
            places = np.repeat(self.starts[some] - ends + lengths, lengths) + np.arange(ends[-1])
            pieces.append(self.letters[places].tobytes())
        return b"".join(pieces).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _vocabulary(source: str) -> Vocabulary:
    return Vocabulary(source)


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids (array of int) for every row.

    `path` is a tokenizer file on the driver; its contents, a few megabytes, go out as a broadcast. The digests are of
    the ids as little-endian unsigned 32-bit integers and of the text decoded from the ids, in UTF-8.

    Null and empty texts have no ids. Long texts are encoded whole. Null and repeated ids stay as they are, other
    columns are ignored. Empty table: no rows.
    """
    with open(path, encoding="utf-8") as file:
        source = docs.sparkSession.sparkContext.broadcast(file.read())

    def work(values: list[bytes | None]) -> dict[str, pa.Array]:
        vocabulary = _vocabulary(source.value)
        encoded = vocabulary.encode([(v or b"").decode("utf-8", "replace") for v in values])
        decoded = [hashlib.sha256(vocabulary.decode(e).encode()).hexdigest() for e in encoded]
        out = {
            "n_tokens": pa.array([len(e) for e in encoded], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(e.tobytes()).hexdigest() for e in encoded], pa.string()),
            "decoded_sha256": pa.array(decoded, pa.string()),
        }
        if ids:
            out["ids"] = pa.array(encoded, pa.list_(pa.int32()))
        return out

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).cast("binary").alias("_text"))
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    return map_texts(rows, "_text", schema, work)


def decode(encoded: DataFrame, path: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """`encoded` with `into`: the text of the token ids, null where the ids are null. Unknown ids are an error."""
    with open(path, encoding="utf-8") as file:
        source = encoded.sparkSession.sparkContext.broadcast(file.read())
    kept = [c for c in encoded.columns if c != into]
    numbers, made = unused("ids", kept), unused("text", kept)

    def work(values: list[list[int] | None]) -> dict[str, pa.Array]:
        vocabulary = _vocabulary(source.value)
        return {made: pa.array([None if v is None else vocabulary.decode(np.array(v, np.int64)) for v in values], pa.string())}

    rows = encoded.select(*[F.col(f"`{c}`") for c in kept], F.col(ids).alias(numbers))
    return map_texts(rows, numbers, f"{made} string", work).withColumnRenamed(made, into)
