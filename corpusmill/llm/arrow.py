"""Row-wise work in Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Texts handed to Python at once are cut to about this many bytes, whatever the length of a batch.
BATCH_BYTES = 4 << 20


def _bytes(value: pa.Scalar) -> int:
    return value.as_buffer().size if hasattr(value, "as_buffer") else value.values.nbytes


def slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose values in `column` take about `limit` bytes; a longer value is a part of its own."""
    rows = batch.num_rows
    if rows == 0 or batch.column(column).nbytes <= limit:
        if rows:
            yield batch
        return
    start = size = 0
    for i, value in enumerate(batch.column(column)):
        length = _bytes(value) if value.is_valid else 0
        if i > start and size + length > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += length
    yield batch.slice(start)


def map_texts(df: DataFrame, column: str, schema: str, work: Callable[[list], dict[str, list]]) -> DataFrame:
    """Adds what `work` makes of each list of values of `column` (null: None) in place of that column.

    `work` returns lists as long as its input, by name; `schema` declares them in order. The other columns stay.
    """
    kept = [i for i, c in enumerate(df.columns) if c != column]
    at = df.columns.index(column)
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, f"_{at}"):
                made = work(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in kept] + [pa.array(made[n]) if not isinstance(made[n], pa.Array) else made[n] for n in names],
                    names=[*[f"_{i}" for i in kept], *names],
                )

    # Inside, columns go by their number, so that any names pass.
    types = [f"_{i} {df.schema[i].dataType.simpleString()}" for i in kept]
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]).mapInArrow(run, ", ".join([*types, schema])).toDF(*[df.columns[i] for i in kept], *names)
