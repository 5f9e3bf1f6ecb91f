"""Periodic runs of words: catchers over completed power-of-two blocks find squares, which are extended and merged into runs.

A run is a stretch with smallest period q that is at least LEAST_POWER times as long and cannot be extended. For each power of
two B the text is cut into blocks of B words. When a block is complete a catcher is set up for it: as words are appended, the
suffix of B words is compared with the block while it ends B to 2 B words after it, by a hash of the suffix that is made of
those of its two halves. An equal suffix q words later is a square of the period q. The first complete block inside a run
of period q with B <= q < 2 B is always caught: it starts less than B after the run, so it comes back at q and at 2 q. Catchers of
one level advance together over all words of a batch of texts, which is what an array comparison does; words between two
texts are equal to nothing, so that no square spans them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_texts

#: A run is at least LEAST_POWER periods and LEAST_LENGTH words long.
LEAST_POWER, LEAST_LENGTH = 4, 6

_LEFT, _RIGHT, _FIRST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _LEFT
    return values ^ (values >> np.uint64(29))


def _reach(same: np.ndarray) -> int:
    """How many leading values are true."""
    return len(same) if same.all() else int(same.argmin())


def _extended(ids: np.ndarray, at: int, q: int) -> tuple[int, int]:
    """Start and end of the longest stretch of period q around the words at and at + q, which are equal. Looks in steps that double."""
    start, step = at, 64
    while start > 0:
        low = max(0, start - step)
        got = _reach((ids[low:start] == ids[low + q : start + q])[::-1])
        start -= got
        if start > low:
            break
        step *= 2
    end, step = at + q, 64
    while end < len(ids):
        high = min(len(ids), end + step)
        got = _reach(ids[end:high] == ids[end - q : high - q])
        end += got
        if end < high:
            break
        step *= 2
    return start, end


def _caught(hashes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of squares whose first words are a block, found by the suffixes up to two blocks later."""
    n = len(hashes)
    own = np.repeat(hashes[::block], block)[: n - block]
    ends = np.flatnonzero(own == hashes[block:]) + block
    starts = (ends // block - 1) * block
    return starts, ends - starts


def _lasting(hashes: np.ndarray, block: int, starts: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which squares go on for 4 q - block + 1 words from the block, as they do at the first block of a run."""
    last = starts + (LEAST_POWER - 1) * q - 2 * block + 1
    good = (last + q < len(hashes)) & (last >= starts)
    step = 0
    while good.any():
        at = np.minimum(starts + step, last)
        kept = np.flatnonzero(good)
        good[kept] = hashes[at[kept]] == hashes[at[kept] + q[kept]]
        step += block
        if (starts + step - block >= last)[good].all():
            break
    return good


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """start, length, period of all runs in the whole numbers `ids`, by start, then period. Memory: a few times that of `ids`."""
    n = len(ids)
    runs: list[tuple[int, int, int]] = []
    covered = np.zeros(n + 1, np.int64)
    hashes, block = _mixed(ids.astype(np.uint64) * _RIGHT + _FIRST), 1
    while n >= max(LEAST_LENGTH, LEAST_POWER * block):
        starts, q = _caught(hashes, block)
        if len(starts):
            # A stretch inside a run of a smaller period, found at an earlier level, has that period too.
            new = covered[starts] < starts + q + block
            starts, q = starts[new], q[new]
            lasting = _lasting(hashes, block, starts, q)
            starts, q = starts[lasting], q[lasting]
            found, known = [], {}
            for at, period in zip(starts.tolist(), q.tolist(), strict=True):
                if at < known.get(period, 0):
                    continue
                start, end = _extended(ids, at, period)
                known[period] = end - period
                if end - start >= max(LEAST_LENGTH, LEAST_POWER * period):
                    found.append((start, end - start, period))
            for start, length, _ in found:
                np.maximum(covered[start : start + length], start + length, out=covered[start : start + length])
            runs += found
        if n < 2 * LEAST_POWER * block:
            break
        hashes = _mixed(hashes[:-block] * _LEFT + hashes[block:] * _RIGHT)
        block *= 2
    return sorted(runs, key=lambda r: (r[0], r[2]))


def surplus(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Which of n words lie in a run behind its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges)[:n] > 0


def _grouped(lists: list[list[bytes]]) -> Iterator[tuple[list[tuple[int, int, int]], list[bytes]]]:
    """Runs and words of each list, searched all at once; a gap between two lists is a word of its own."""
    seen: dict[bytes, int] = {}
    fresh, gaps = count(), count(-1, -1)
    ids: list[int] = []
    starts = []
    for words in lists:
        starts.append(len(ids))
        ids += map(seen.setdefault, words, fresh)
        ids.append(next(gaps))
    runs = find_runs(np.array(ids, np.int64))
    at = 0
    for start, words in zip(starts, lists, strict=True):
        mine = []
        while at < len(runs) and runs[at][0] < start + len(words):
            mine.append((runs[at][0] - start, *runs[at][1:]))
            at += 1
        yield mine, words


def _work(texts: list[bytes | None]) -> dict[str, pa.Array]:
    parts: tuple[list, list, list] = ([], [], [])
    kept = []
    for found, words in _grouped([(t or b"").split() for t in texts]):
        for part, values in zip(parts, zip(*found, strict=True) if found else ((), (), ()), strict=True):
            part.append(values)
        if found:
            drop = surplus(found, len(words))
            words = [w for w, gone in zip(words, drop.tolist(), strict=True) if not gone]
        kept.append(b" ".join(words))
    numbers = pa.list_(pa.int64())
    return dict(zip(("starts", "lengths", "periods", "collapsed"), [*[pa.array(p, numbers) for p in parts], pa.array(kept, pa.binary())], strict=True))


def collapsed(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, runs, collapsed (binary, UTF-8) for every row of `docs`.

    Words are what ASCII white space leaves. `runs` are in order of start, then period; `collapsed` has the words that no run
    contains behind its first period, joined by one space. Null, empty and wordless texts: no runs, nothing left. Null and
    repeated ids stay, each row by itself. Other columns are ignored, whatever their names. Empty table: no rows. Nothing is
    shuffled; a task holds the words of about 4 MB of text, or of one longer text.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).cast("binary").alias("_text"))
    made = map_texts(rows, "_text", "starts array<long>, lengths array<long>, periods array<long>, collapsed binary", _work)
    runs = F.transform("starts", lambda s, i: F.struct(s.alias("start"), F.get("lengths", i).alias("length"), F.get("periods", i).alias("period")))
    return made.select("doc_id", runs.alias("runs"), "collapsed")
