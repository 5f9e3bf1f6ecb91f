"""Documents to stored documents and chunks, one declarative pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import chunking, context, pii, terms, text, vectors
from ..operators import catalog, quality
from ..session import scratch_folder


def prepare(documents: DataFrame, settings: Settings) -> DataFrame:
    """Masked, optionally term-replaced, normalized text with its hash; empty text is dropped.

    documents(document_id, source_name, project_name, text). The quality score is that of the
    original text.
    """
    # Masking and normalizing leave nothing only where there was nothing but white space; the
    # test on the raw column reaches the scan and repeats none of that work.
    documents = documents.where(F.col("text").rlike(rf"[^{text.SPACE_CLASS}\x00]"))
    scored = quality.enterprise_quality(
        documents, mask=settings.mask_pii, replace=settings.apply_term_replacements
    ).select(
        *documents.columns, "cleaned_text", F.col("score").alias("quality_score"), F.col("status").alias("quality_status"),
        "pii_detected_count", "standardized_terms",
    )
    return (
        scored.withColumn("content", text.normalize_text("cleaned_text"))
        .drop("text", "cleaned_text")
        .withColumn("content_hash", text.content_hash("content"))
    )


def to_chunks(prepared: DataFrame, settings: Settings, dim: int, embed=None) -> DataFrame:
    """Chunks with metadata, tokens and an embedding of their (optionally prefixed) text.

    ``embed`` maps a text column to a vector column; the default is the hash embedding. The
    chunk inherits its document's scope fields.
    """
    embed = embed or (lambda column: vectors.hash_embedding(column, dim))
    if settings.parent_child_chunking:
        pieces = chunking.parent_child_array(
            "content", settings.child_chunk_size, settings.child_chunk_overlap, settings.parent_chunk_size, settings.parent_chunk_overlap)
    else:
        pieces = chunking.chunk_array("content", settings.chunk_size, settings.chunk_overlap)
    scope = [c for c in ("department", "security_level") if c in prepared.columns]
    keep = ["document_id", "source_name", "project_name", "quality_score", *scope]
    rows = prepared.select(*keep, F.inline(pieces))
    if settings.contextual_retrieval:
        rows = context.with_section_paths(rows, "char_start", prepared, "document_id", "content")
        embedded = context.embedding_input("text", F.col("source_name"), F.col("section_path"), F.lit(None).cast("string"))
    else:
        rows = rows.withColumn("section_path", F.lit(None).cast("string"))
        embedded = F.col("text")
    return rows.withColumn("embedding", embed(embedded)).select(
        F.concat_ws(":", F.col("document_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"),
        *keep, "chunk_index", F.col("text").alias("content"), "char_start", "char_end", "parent_index", "parent_text", "section_path",
        text.tokens("text").alias("tokens"), "embedding",
    )


def ingest(documents: DataFrame, settings: Settings | None = None, dim: int | None = None, stored: DataFrame | None = None,
           embed=None) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) to append: new ones only, one per source, content and project."""
    settings = settings or Settings()
    # Written once: identities are aggregated from it, and texts kept by them.
    folder = f"{scratch_folder(documents.sparkSession)}/prepared"
    prepare(documents, settings).write.parquet(folder)
    prepared = documents.sparkSession.read.parquet(folder)
    fresh = catalog.distinct_documents(prepared) if stored is None else catalog.new_documents(prepared, stored)
    return fresh, to_chunks(fresh, settings, dim or settings.embedding_dim, embed)
