"""Semantic answer cache as keyed state: limited in age and number, newest match first."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Settings

REQUEST_SCHEMA = "filter_key string, request_id bigint, stored_at double, embedding array<double>, response string"
RESULT_SCHEMA = "filter_key string, request_id bigint, response string"
# Fixed value: larger records are not stored.
MAX_RECORD_BYTES = 1_000_000


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    if a.shape != b.shape or not a.size:
        return 0.0
    norm = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / norm) if norm else 0.0


def cached_answers(requests: DataFrame, settings: Settings | None = None, expire_idle: bool = False) -> DataFrame:
    """Answer lookups and stores of one filter key in the order they arrive.

    A row with a response stores it; a row without one looks an answer up and yields it. The
    state of a key holds at most the configured number of entries, the oldest leaving first.
    Expired entries leave at the next request of their key; with ``expire_idle`` the state of a
    silent key is dropped too, which needs a query that keeps running.
    """
    limits = settings or Settings()
    ttl, size, threshold = limits.cache_ttl_seconds, limits.cache_max_entries, limits.cache_threshold

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        entries = json.loads(state.get[0]) if state.exists else []
        for frame in frames:
            found = []
            for row in frame.sort_values(["stored_at", "request_id"]).itertuples(index=False):
                entries = [e for e in entries if row.stored_at - e[0] <= ttl]
                vector = np.asarray(row.embedding, dtype=float)
                if row.response is not None:
                    if len(row.response.encode()) <= MAX_RECORD_BYTES:
                        entries = (entries + [[row.stored_at, vector.tolist(), row.response]])[-size:]
                    continue
                hit = next((e[2] for e in reversed(entries) if _cosine(vector, np.asarray(e[1])) >= threshold), None)
                found.append((key[0], row.request_id, hit))
            yield pd.DataFrame(found, columns=["filter_key", "request_id", "response"])
        state.update((json.dumps(entries),))
        if expire_idle:
            state.setTimeoutDuration(ttl * 1000)

    return requests.groupBy("filter_key").applyInPandasWithState(
        step, RESULT_SCHEMA, "entries string", "append",
        GroupStateTimeout.ProcessingTimeTimeout if expire_idle else GroupStateTimeout.NoTimeout,
    )
