"""Document and chunk tables: idempotent insert, replacement, deletion, listing, counts.

Every function returns the new table state; writing it is the caller's step, so a lost
executor only repeats reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import beside

IDENTITY = ["source_name", "content_hash", "project_name"]


def _null_safe(columns: list[str], left: DataFrame, right: DataFrame) -> Column:
    test = F.lit(True)
    for c in columns:
        test = test & left[c].eqNullSafe(right[c])
    return test


def distinct_documents(df: DataFrame, identity: list[str] | None = None, key: str = "document_id") -> DataFrame:
    """The document with the smallest key of each identity.

    Only identities and keys are aggregated, so a group of copies holding a third of all rows
    is one row after the map side; texts are then kept by their unique key.
    """
    identity = identity or IDENTITY
    first = df.groupBy(*identity).agg(F.min(key).alias(key)).select(key)
    return df.join(first, key, "left_semi")


def new_documents(incoming: DataFrame, stored: DataFrame, identity: list[str] | None = None, key: str = "document_id") -> DataFrame:
    """Incoming documents not stored yet, one per identity."""
    identity = identity or IDENTITY
    first = incoming.groupBy(*identity).agg(F.min(key).alias(key))
    known = stored.select(*identity).distinct()
    fresh = first.join(known, _null_safe(identity, first, known), "left_anti").select(key)
    return incoming.join(fresh, key, "left_semi")


def replace_sources(stored: DataFrame, incoming: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Stored rows whose source the incoming rows replace are dropped, then both are united."""
    scope = scope or ["source_name", "project_name"]
    named = incoming.select(*scope).distinct()
    return stored.join(named, _null_safe(scope, stored, named), "left_anti").unionByName(incoming)


def delete_documents(documents: DataFrame, chunks: DataFrame, ids: DataFrame, project: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables without the documents; with a project only ids inside it count."""
    gone = ids.select("document_id").distinct()
    if project is not None:
        gone = gone.join(documents.where(F.col("project_name") == project).select("document_id"), "document_id", "left_semi")
    return documents.join(gone, "document_id", "left_anti"), chunks.join(gone, "document_id", "left_anti")


def chunk_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with their number of chunks, 0 included; chunks are counted before the join."""
    counted = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    return documents.join(counted, "document_id", "left").fillna(0, ["chunk_count"])


def statistics(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    return beside(
        documents.agg(F.count(F.lit(1)).alias("total_documents")), chunks.agg(F.count(F.lit(1)).alias("total_chunks"))
    )


def drop_orphans(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    return chunks.join(documents.select("document_id"), "document_id", "left_semi")


def cache_scope(filter_key: Column, generation: Column) -> Column:
    """Key of a cache scope; raising the generation on every ingestion or deletion empties it."""
    return F.concat_ws(":", generation.cast("string"), F.sha2(filter_key, 256))
