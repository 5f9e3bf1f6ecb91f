"""Document fingerprints by winnowing: polynomial hashes of word k-grams, the least of every window kept with its place.

All of it is DataFrame expressions over arrays. The hash of a gram is the one that a rolling polynomial hash has there;
it is composed from the hashes of its two halves, so a text takes a few passes over an array instead of one over its
words for each k. Window minima are found by doubling in the same way. A minimum is packed as hash and reversed
position in one number, which makes the rightmost of equal hashes the least, as winnowing asks.

Two texts that share a run of k + window - 1 words share a fingerprint (the match guarantee).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, text_of

GRAM, WINDOW = 5, 8
#: Hashes are below this prime, so that products stay below 2^62.
PRIME = (1 << 31) - 1
BASE = 1_000_003
_PLACES = (1 << 32) - 1


def _pairs(left: Column, right: Column, shift: Column | int, n: Column, join) -> Column:
    """join(left[i], right[i + shift]) for the first `n` places, none if `n` is negative."""
    n = F.greatest(n, F.lit(0))
    return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(1) + shift, n), join)


def _append(width: int):
    """Hash of a gram followed by a gram of `width` words."""
    return lambda a, b: (a * F.lit(pow(BASE, width, PRIME)) + b) % PRIME


def with_fingerprint(df: DataFrame, text: str, into: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Adds `into`: array of hash << 32 | (2^32 - 1 - position), in order of position; see `hashes` and `places`.

    A text of fewer words than a gram has one gram, all its words; with fewer grams than a window all are one window.
    Null, empty and wordless texts have an empty array. Equal texts have equal arrays. Columns starting with `_w_`
    are used inside and not kept.
    """
    hashed = F.transform(F.regexp_extract_all(text_of(text), F.lit(WORD), F.lit(0)), lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME)))
    df = df.withColumn("_w_1", hashed).withColumn("_w_n", F.size("_w_1"))
    have, column, n = 1, "_w_1", F.col("_w_n")
    for i, bit in enumerate(bin(gram)[3:]):
        df = df.withColumn(f"_w_d{i}", _pairs(F.col(column), F.col(column), have, n - (2 * have - 1), _append(have)))
        have, column = 2 * have, f"_w_d{i}"
        if bit == "1":
            df = df.withColumn(f"_w_e{i}", _pairs(F.col(column), F.col("_w_1"), have, n - have, _append(1)))
            have, column = have + 1, f"_w_e{i}"
    whole = F.array(F.aggregate("_w_1", F.lit(0).cast("long"), _append(1)))
    grams = F.when(n >= gram, F.col(column)).when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))
    packed = F.transform(grams, lambda h, i: F.shiftleft(h, 32) + (F.lit(_PLACES) - i.cast("long")))
    df = df.withColumn("_w_p", packed).withColumn("_w_m", F.size("_w_p"))
    have, column, n = 1, "_w_p", F.col("_w_m")
    while have < window:
        step = min(have, window - have)
        df = df.withColumn(f"_w_m{have}", _pairs(F.col(column), F.col(column), step, n - (have + step - 1), lambda a, b: F.least(a, b)))
        have, column = have + step, f"_w_m{have}"
    least = F.when(n >= window, F.array_distinct(column)).when(n > 0, F.array(F.array_min("_w_p"))).otherwise(F.col("_w_p"))
    return df.withColumn(into, least).drop(*[c for c in df.columns if c.startswith("_w_")])


def hashes(fingerprint: str | Column) -> Column:
    return F.transform(fingerprint, lambda p: F.shiftright(p, 32))


def places(fingerprint: str | Column) -> Column:
    """Where in the text the chosen grams start, in words from 0."""
    return F.transform(fingerprint, lambda p: F.lit(_PLACES) - p.bitwiseAND(F.lit(_PLACES)))


def written(fingerprint: str | Column) -> Column:
    """The fingerprint as text: hash:place for each chosen gram, hashes in hexadecimal, places in decimal."""
    return F.array_join(F.transform(fingerprint, lambda p: F.concat(
        F.lower(F.hex(F.shiftright(p, 32))), F.lit(":"), (F.lit(_PLACES) - p.bitwiseAND(F.lit(_PLACES))).cast("string")
    )), " ")


def likeness(left: str | Column, right: str | Column) -> Column:
    """Shared share of two arrays of hashes without repeats (Jaccard), 1 if both are empty."""
    both = F.size(F.array_intersect(left, right))
    either = F.size(left) + F.size(right) - both
    return F.when(either == 0, 1.0).otherwise(both / either)
