"""The store as a data source: batches whole and once, whatever fails."""

from __future__ import annotations

import datetime
import weakref

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusmill.session import scratch_folder
from corpusmill.sources import store


@pytest.fixture
def path(spark):
    spark.dataSource.register(store.CorpusStore)
    return f"{scratch_folder(spark)}/store"


def _rows(spark, start=0, n=40):
    return spark.range(start, start + n, numPartitions=4).select(
        "id", F.when(F.col("id") % 7 != 0, F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"), F.array(F.col("id").cast("double")).alias("v"))


def _write(df, path, batch=None):
    writer = df.write.format("corpus_store").option("path", path).mode("append")
    (writer.option("batch", batch) if batch else writer).save()


def _read(spark, path):
    return spark.read.format("corpus_store").option("path", path).load()


def _files(path):
    return store.Folder(path).names("data")


def test_a_batch_written_twice_is_there_once(spark, path):
    for _ in range(2):
        _write(_rows(spark), path, "one/ä")
    _write(_rows(spark, 40), path, "two")
    assert sorted(tuple(r) for r in _read(spark, path).collect()) == sorted(tuple(r) for r in _rows(spark, 0, 80).collect())
    assert len(_files(path)) == 8
    assert _read(spark, path).schema.simpleString() == _rows(spark).schema.simpleString()


def test_a_failed_task_leaves_no_rows_and_no_files(spark, path):
    broken = _rows(spark).withColumn("text", F.when(F.col("id") == 35, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    _write(_rows(spark), path, "one")
    with pytest.raises(Exception, match="lost"):
        _write(broken, path, "two")
    assert len(_files(path)) == 4 and _read(spark, path).count() == 40
    _write(_rows(spark, 40), path, "two")
    assert _read(spark, path).count() == 80


def test_rows_of_unnamed_batches_are_all_kept(spark, path):
    for _ in range(2):
        _write(_rows(spark, n=3), path)
    assert _read(spark, path).count() == 6


def test_empty_batches_and_other_schemas(spark, path):
    with pytest.raises(Exception, match="no batch"):
        _read(spark, path)
    assert spark.read.format("corpus_store").option("path", path).schema("id long").load().count() == 0
    _write(_rows(spark, n=0), path, "none")
    assert _read(spark, path).count() == 0
    with pytest.raises(Exception, match="the store holds"):
        _write(spark.range(3), path, "other")
    with pytest.raises(Exception, match="only appended"):
        _rows(spark).write.format("corpus_store").option("path", path).mode("overwrite").save()
    with pytest.raises(Exception, match="path"):
        _rows(spark).write.format("corpus_store").mode("append").save()


def test_a_given_schema_reads_only_its_columns(spark, path):
    _write(_rows(spark), path, "one")
    found = spark.read.format("corpus_store").option("path", path).schema("text string, id long").load()
    assert found.columns == ["text", "id"] and found.agg(F.sum("id")).first()[0] == sum(range(40))


def test_many_files_are_dealt_to_tasks_by_size(spark, path, monkeypatch):
    _write(_rows(spark), path, "one")
    reader = store.Reader(store.Folder(path), _rows(spark).schema)
    assert [len(p.files) for p in reader.partitions()] == [4]
    monkeypatch.setattr(store, "TASK_BYTES", 1)
    assert [len(p.files) for p in reader.partitions()] == [1, 1, 1, 1]


def test_long_tasks_write_several_files(path, spark, monkeypatch):
    monkeypatch.setattr(store, "FILE_BYTES", 100)
    writer = store.Writer(store.Folder(path), _rows(spark).schema, "one")
    batches = _rows(spark).toArrow().to_batches(max_chunksize=10)
    staged = writer.write(iter(batches))
    assert len(staged.files) > 1 and sum(rows for _, rows, _ in staged.files) == 40
    writer.commit([staged, None])
    assert _read(spark, path).count() == 40


def test_a_stream_that_starts_again_adds_nothing(spark, path):
    source = f"{scratch_folder(spark)}/source"
    _rows(spark).write.parquet(source)

    def stream(place):
        rows = spark.readStream.schema(_rows(spark).schema).option("maxFilesPerTrigger", 2).parquet(source)
        rows.writeStream.format("corpus_store").option("path", path).option("batch", "inbox").option(
            "checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()

    first = f"{scratch_folder(spark)}/first"
    stream(first)
    stream(first)  # nothing new
    assert len(store.Folder(path).manifests()) == 2
    stream(f"{scratch_folder(spark)}/lost")  # its progress was lost: all batches come again
    assert _read(spark, path).count() == 40 and _read(spark, path).distinct().count() == 40


def test_sweep_deletes_what_no_manifest_names(spark, path):
    _write(_rows(spark), path, "one")
    left = store.Writer(store.Folder(path), _rows(spark).schema, "lost").write(iter(_rows(spark).toArrow().to_batches()))
    assert store.sweep(path) == 0
    assert store.sweep(path, datetime.timedelta(0)) == len(left.files) == 1
    assert _read(spark, path).count() == 40


def test_row_groups_are_bounded_and_batches_are_let_go(spark, path, monkeypatch):
    monkeypatch.setattr(store, "GROUP_BYTES", 2000)

    def incoming():
        for i in range(3):
            batch = pa.record_batch({"id": range(i * 100, i * 100 + 100), "text": ["x" * 92] * 100})
            last = weakref.ref(batch)
            yield batch
            del batch
            assert last() is None

    writer = store.Writer(store.Folder(path), spark.range(0).selectExpr("id", "'' as text").schema, "one")
    writer.commit([writer.write(incoming())])
    (file,) = _files(path)
    found = pq.ParquetFile(file.path)
    assert [found.metadata.row_group(i).num_rows <= 20 for i in range(found.num_row_groups)] == [True] * 18
    assert [r.id for r in _read(spark, path).orderBy("id").collect()] == list(range(300))


def test_small_batches_share_a_row_group(spark, path):
    writer = store.Writer(store.Folder(path), _rows(spark).schema, "one")
    writer.write(iter(_rows(spark).toArrow().to_batches(max_chunksize=5)))
    (file,) = _files(path)
    assert pq.ParquetFile(file.path).num_row_groups == 1


def test_a_task_that_outlives_its_batch_leaves_no_files(spark, path):
    writer = store.Writer(store.Folder(path), _rows(spark).schema, "one")
    batches = _rows(spark).toArrow().to_batches(max_chunksize=10)

    def late():
        yield batches[0]
        writer.abort([])
        yield from batches[1:]

    writer.write(late())
    with pytest.raises(OSError):
        writer.write(iter(batches))
    assert not _files(path)
