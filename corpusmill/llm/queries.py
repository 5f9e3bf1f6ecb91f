"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from . import (  # noqa: F401
    query_bpe, query_classifier, query_ctw, query_extraction, query_licenses, query_mixing, query_quality, query_runs, query_sharding, query_simhash,
    query_warc, query_whitening, query_winnowing,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
