"""Structured Streaming: file intake, guarded token streams, counters, cache and audit."""
