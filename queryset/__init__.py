"""Registered queries over the test tables, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from . import corpus, ops, retrieval, scoring, tabular

_MODULES = (tabular, corpus, retrieval, scoring, ops)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
