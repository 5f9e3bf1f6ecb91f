"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from corpusmill.session import ship_package

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(function):
        def run(spark, folder):
            ship_package(spark)
            return function(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register
