"""op9: language-model scores of all documents."""

from __future__ import annotations

from .common import read
from .ctw import scored
from .registry import query


@query("op9_ctw_scores")
def ctw_scores(spark, folder):
    return scored(read(spark, folder, "documents")).drop("n_bytes")
