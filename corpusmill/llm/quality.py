"""Quality rules on documents, and verdicts on hosts from how often their documents fail."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import cut_lineage

from .arrow import map_texts
from .common import keep_rows, keyed_join

# The counted symbols, and the width of a repeated passage in words.
SYMBOLS = b"#*$%&|<>"
SPAN = 8

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Symbols for each word and the share of words on repeated lines above which a document fails.
MAX_SYMBOLS = 0.1
MAX_DUP_LINES = 0.3
#: A host is rejected when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.8
#: Bounds on the weight of the prior, in documents.
PRIOR_WEIGHT = (2.0, 1000.0)

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _repeated(words: list[bytes], span: int = SPAN) -> int:
    """Words inside windows of `span` words that occur twice or more."""
    windows = len(words) - span + 1
    if windows < 2:
        return 0
    each = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(windows, np.uint64)
    for i in range(span):
        rolled = rolled * _ODD + each[i : i + windows]
    order = np.argsort(rolled, kind="stable")
    ranked = rolled[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    # Equal windows have equal hashes; only these few are compared word by word.
    likely = np.zeros(windows, bool)
    likely[order[1:][same]] = likely[order[:-1][same]] = True
    places: dict[tuple, list[int]] = {}
    for at in np.flatnonzero(likely).tolist():
        places.setdefault(tuple(words[at : at + span]), []).append(at)
    edges = np.zeros(len(words) + 1, np.int64)
    for found in places.values():
        if len(found) > 1:
            np.add.at(edges, found, 1)
            np.add.at(edges, np.add(found, span), -1)
    return int(np.count_nonzero(np.cumsum(edges)))


def _measure(texts: list[bytes | None]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {name: [] for name in COUNTS}
    for text in texts:
        text = text or b""
        words = text.split()
        lines = [line for line in text.split(b"\n") if line and not line.isspace()]
        joined = b"".join(words)
        out["n_words"].append(len(words))
        # Code points: all bytes but UTF-8 continuation bytes.
        out["word_chars"].append(len(joined) - int(np.count_nonzero(np.frombuffer(joined, np.uint8) & 0xC0 == 0x80)))
        out["n_symbols"].append(len(joined) - len(joined.translate(None, SYMBOLS)))
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        out["n_repeat_words"].append(_repeated(words))
    return out


def measured(docs: DataFrame, id_column: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host, key (hash of the text) and the five counts of each row. Null text: all counts 0."""
    rows = docs.select(
        F.col(id_column).alias("doc_id"), F.col(host).alias("host"), F.xxhash64(text).alias("key"), F.col(text).cast("binary").alias("_text")
    )
    return map_texts(rows, "_text", ", ".join(f"{c} long" for c in COUNTS), _measure)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rules(max_symbols: float, max_dup_lines: float) -> dict[str, Column]:
    """The rules that a document can fail, by name."""
    return {
        "base": base_failed(),
        "symbols": F.col("n_symbols") > max_symbols * F.col("n_words"),
        "lines": F.col("n_dup_lines") * SPAN > max_dup_lines * F.col("n_words"),
    }


def host_verdicts(failures: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """host, n_docs, failed, rate, host_rejected for `failures` (host, fails: boolean).

    The prior Beta(a, b) has the mean and the spread of the hosts' own rates: with mean m and variance v its weight is
    m(1 - m)/v - 1, within PRIOR_WEIGHT. A host's rate is (failed + a) / (n_docs + a + b), so a host of few documents
    stays near the mean. Two numbers reach the driver.
    """
    hosts = cut_lineage(failures.groupBy("host").agg(F.count("*").alias("n_docs"), F.count(F.when(F.col("fails"), 1)).alias("failed")))
    raw = F.col("failed") / F.col("n_docs")
    mean, square = hosts.agg(F.avg(raw), F.avg(raw * raw)).first()
    mean, square = mean or 0.0, square or 0.0
    spread = max(square - mean * mean, 1e-9)
    weight = min(max(mean * (1 - mean) / spread - 1, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1])
    rate = (F.col("failed") + F.lit(mean * weight)) / (F.col("n_docs") + F.lit(weight))
    return hosts.withColumn("rate", rate).withColumn("host_rejected", F.col("rate") > max_rate)


def judged(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", host: str = "source",
    max_symbols: float = MAX_SYMBOLS, max_dup_lines: float = MAX_DUP_LINES, max_host_rate: float = MAX_HOST_RATE,
) -> DataFrame:
    """doc_id, host, key, the five counts, base_failed, fails, rate, host_rejected, kept for every row.

    A document is kept if it fails no rule and its host is not rejected. A line counts as SPAN words in the line rule.

    Null or empty text: no words, fails the base rule. Null host: a host of its own. Null and repeated ids stay, each
    row with its own verdict. Other columns are ignored, whatever their names. Empty table: no rows.
    """
    rows = cut_lineage(measured(docs, id_column, text, host))
    failed = rules(max_symbols, max_dup_lines)
    fails = failed["base"] | failed["symbols"] | failed["lines"]
    rows = rows.withColumn("base_failed", failed["base"]).withColumn("fails", fails)
    hosts = host_verdicts(rows.select("host", "fails"), max_host_rate)
    return keyed_join(rows, hosts, "host", "n_docs", rows.count()).drop("n_docs", "failed").withColumn(
        "kept", ~F.col("fails") & ~F.col("host_rejected")
    )


def keep_good(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs` that `judged` keeps, with all their columns."""
    good = judged(docs, id_column, text, **options).where("kept").select(F.struct(F.col("doc_id").alias("id"), F.col("key").alias("hash")).alias("_row"))
    return keep_rows(docs, good.distinct(), id_column, text)
