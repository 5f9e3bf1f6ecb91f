"""Vector expressions: hash embedding, cosine, mixing."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import text_udf
from .text import as_col

_WORD = re.compile(r"\w+")
_SLOT_CACHE_LIMIT = 500_000


def hash_bucket(token: Column, dim: int) -> Column:
    """First 64 bits of SHA-256 modulo the dimension, reduced in two exact 32-bit halves."""
    digest = F.sha2(token.cast("binary"), 256)
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("bigint")
    return (((high % dim) * ((1 << 32) % dim) + low % dim) % dim).cast("int")


class _Slots(dict):
    """Positions of words, found once."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, word: str) -> int:
        found = self[word] = int.from_bytes(hashlib.sha256(word.encode("utf-8")).digest()[:8], "big") % self.dim
        return found

    def __reduce__(self):
        return _Slots, (self.dim,)


def hash_embedding(value: Column | str, dim: int) -> Column:
    """Deterministic unit vector of token counts over hashed positions.

    An Arrow UDF: counting tokens per slot with expressions alone needs either a shuffle per
    text or a scan of all slots per token.
    """
    slots = _Slots(dim)

    def embed(texts: list) -> pa.Array:
        vectors = []
        for text in texts:
            if text is None:
                vectors.append(None)
                continue
            words = _WORD.findall(text.lower()) or [text]
            if len(slots) >= _SLOT_CACHE_LIMIT:
                slots.clear()
            counts = np.bincount(list(map(slots.__getitem__, words)), minlength=dim).astype(float)
            vectors.append(counts / np.sqrt((counts * counts).sum()))
        return pa.array(vectors, pa.list_(pa.float64()))

    return text_udf(embed, T.ArrayType(T.DoubleType()))(as_col(value))


def model_embedding(value: Column | str, load: Callable[[], Callable[[list[str]], list]], dim: int, batch: int = 8) -> Column:
    """Unit vectors of an outside model.

    ``load`` runs once per Python worker and returns a function from texts to vectors; a
    vector of another length fails the task.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            rows: list = []
            for at in range(0, len(texts), batch):
                part = np.asarray(encode(texts.iloc[at : at + batch].tolist()), dtype=float)
                if part.ndim != 2 or part.shape[1] != dim:
                    raise ValueError(f"the model returned vectors of another length than {dim}")
                norms = np.linalg.norm(part, axis=1, keepdims=True)
                rows.extend(np.divide(part, norms, out=part.copy(), where=norms > 0))
            yield pd.Series(rows)

    return embed(as_col(value))


def embed_distinct(df: DataFrame, text: str, embed: Callable[[Column], Column], name: str = "embedding") -> DataFrame:
    """Embed every different text once and give each row its vector."""
    distinct = df.select(text).where(F.col(text).isNotNull()).distinct()
    return df.join(distinct.withColumn(name, embed(F.col(text))), text, "left")


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def cosine(left: Column | str, right: Column | str) -> Column:
    """0 where a norm is zero, a vector is empty or the lengths differ."""
    left, right = as_col(left), as_col(right)
    norm = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    fits = (F.size(left) == F.size(right)) & (F.size(left) > 0)
    return F.when(fits & (norm > 0), dot(left, right) / norm).otherwise(F.lit(0.0))


def l2_normalize(vector: Column) -> Column:
    norm = F.sqrt(dot(vector, vector))
    return F.when(norm > 0, F.transform(vector, lambda v: v / norm)).otherwise(vector)


def mix_hyde(query: Column | str, hypothetical: Column | str) -> Column:
    """0.65 query + 0.35 hypothetical, unit length; the query alone where the mix vanishes."""
    query, hypothetical = as_col(query), as_col(hypothetical)
    mixed = F.zip_with(query, hypothetical, lambda q, h: q * 0.65 + h * 0.35)
    norm = F.sqrt(dot(mixed, mixed))
    return F.when(hypothetical.isNull() | (norm == 0), query).otherwise(
        F.transform(mixed, lambda v: v / norm)
    )
