"""Row-wise Python work on texts in parts of bounded size, whatever the length of an Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that are Python objects at once, about; a longer text is a part of its own.
PART_BYTES = 1 << 20


def parts(texts: pa.Array, limit: int | None = None) -> Iterator[pa.Array]:
    """Consecutive slices of a string array of about ``limit`` bytes each."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    limit = PART_BYTES if limit is None else limit
    start = 0
    while start < len(texts):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield texts.slice(start, stop - start)
        start = stop


def text_udf(work: Callable[[list], pa.Array], result: T.DataType) -> Callable[[Column], Column]:
    """An Arrow UDF of one text column; ``work`` makes an array as long as the list of texts (null: None) it is given."""

    @F.arrow_udf(result)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield from (work(part.to_pylist()) for part in parts(batch))

    return run
