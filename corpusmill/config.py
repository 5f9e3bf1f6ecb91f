"""Pipeline defaults in one immutable object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Defaults that retrieval and ingestion results depend on.
    chunk_size: int = 1600
    chunk_overlap: int = 240
    child_chunk_size: int = 280
    child_chunk_overlap: int = 40
    parent_chunk_size: int = 1200
    parent_chunk_overlap: int = 120
    parent_child_chunking: bool = False
    embedding_dim: int = 1024
    retrieval_top_k: int = 5
    rrf_k: int = 60
    cache_ttl_seconds: int = 1800
    cache_max_entries: int = 256
    cache_threshold: float = 0.95
    mask_pii: bool = True
    apply_term_replacements: bool = False
    contextual_retrieval: bool = False
    hyde: bool = False
    input_max_length: int = 16384
