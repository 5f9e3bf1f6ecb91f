"""Watched folder to stored documents and chunks, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings
from ..plans import ingest
from ..sources.files import parse_documents

# File types taken from the inbox.
SUPPORTED = "*.{pdf,hwpx,docx,json,html,txt}"
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def inbox(spark: SparkSession, folder: str, processed: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """Stream of (name, payload); with ``processed`` finished files are moved there."""
    reader = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
        .option("pathGlobFilter", SUPPORTED).option("maxFilesPerTrigger", files_per_batch)
    )
    if processed:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", processed)
    return reader.load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").alias("payload"))


def stored(spark: SparkSession, store: str, table: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{store}/{table}")
    except Exception as problem:
        if "PATH_NOT_FOUND" in str(problem) or "UNABLE_TO_INFER_SCHEMA" in str(problem):
            return None
        raise


def write_batch(files: DataFrame, batch_id: int, store: str, settings: Settings, dim: int, project: str) -> None:
    """Append one batch under its own batch folder, so that a repeated batch replaces itself.

    Files that cannot be read or hold no text go to the table ``failed`` with the reason and
    their bytes, since a finished source file may be moved away.
    """
    spark = files.sparkSession
    everything = parse_documents(files)
    readable = F.col("parsed.error").isNull() & (F.col("parsed.text") != "")
    everything.where(~readable).select(
        F.col("name").alias("source_name"), F.coalesce("parsed.error", F.lit("no text")).alias("error"), "payload",
        F.current_timestamp().alias("created_at"),
    ).write.mode("overwrite").parquet(f"{store}/failed/batch_id={batch_id}")
    parsed = everything.where(readable)
    documents = parsed.select(
        F.sha2(F.concat_ws("\x01", "name", F.sha2("payload", 256)), 256).alias("document_id"), F.col("name").alias("source_name"),
        F.lit(project).alias("project_name"), F.col("parsed.text").alias("text"),
    )
    known = stored(spark, store, "documents")
    earlier = known.where(F.col("batch_id") != batch_id) if known is not None else None
    fresh, _chunks = ingest.ingest(documents, settings, dim, earlier)
    target = f"{store}/documents/batch_id={batch_id}"
    fresh.write.mode("overwrite").parquet(target)
    chunks = ingest.to_chunks(spark.read.parquet(target), settings, dim)
    chunks.write.mode("overwrite").parquet(f"{store}/chunks/batch_id={batch_id}")


def watch(spark: SparkSession, folder: str, store: str, checkpoint: str, processed: str | None = None,
          settings: Settings | None = None, dim: int | None = None, project: str = "default", once: bool = False) -> StreamingQuery:
    """Start the intake; polls every two seconds, or takes what is there and stops."""
    settings = settings or Settings()
    size = dim or settings.embedding_dim
    writer = inbox(spark, folder, processed).writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, batch_id: write_batch(df, batch_id, store, settings, size, project)
    )
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()
