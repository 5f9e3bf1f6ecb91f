"""Licence phrases and notices against a plain walk over the words."""

from __future__ import annotations

import math
import os
import re

import duckdb
import pytest

from corpusmill.llm import licenses
from corpusmill.llm.queries import ORACLES, QUERIES

from .data import awkward, awkward_rows, empty

MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use"
)
ROWS = [
    (1, "x\n# Released under the MIT License.\n"),
    (2, "under the mit license, under-the-MIT-license. UNDER  THE MIT LICENSE"),
    (3, "Licensed under the Apache License, Version 2.0 and CC BY-NC 4.0."),
    (4, "This work is licensed under the GNU General Public License, version 3."),
    (5, "This work is licensed under the GNU General Public License, version 2."),
    (6, "mit license of the school; the license version is general and public"),
    (7, f"/* {MIT} */ " + "word " * 50 + "licensed under cc by 4.0"),
    (8, "license " * 3000 + "mit gnu general public version 3 " * 300),
    (9, "É cc\x00by\tnc É漢字"),
    (10, "Licensed, e.g., under the GNU General Public License, version 3, by us."),
    (11, " ".join(MIT.split()[:12])),
    (12, None), (13, ""), (14, "  ,;"), (None, "released under the MIT license"), (1, "released under the MIT license"),
]


def _words(text):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small)


def _plain(rows):
    texts = [(i, _words(t)) for i, t in rows]
    holds = [set(w) for _, w in texts]
    wanted = {x for _, wording, _ in licenses.TEMPLATES for x in wording.split()}
    df = {x: sum(x in h for h in holds) for x in wanted}
    out = []
    for i, w in texts:
        base = [(at, label) for label, phrase in licenses.PHRASES for at in range(len(w)) if w[at : at + len(phrase.split())] == phrase.split()]
        found = []
        for label, wording, keys in licenses.TEMPLATES:
            seq = wording.split()
            rare = sorted(set(seq) & set(w), key=lambda x: (df[x], x))[: licenses.LOOKED]
            votes = {((at - p) // 8 + d, x) for at, x in enumerate(w) if x in rare for p, y in enumerate(seq) if x == y for d in (0, 1)}
            for cell in {c for c, _ in votes}:
                if sum(c == cell for c, _ in votes) < math.ceil(len(rare) * 3 / 4):
                    continue
                start = (cell - 1) * 8
                near = w[max(start, 0) : start + len(seq) + 24]
                share = len(set(seq) & set(near)) / len(set(seq))
                if share >= 0.75 and all(f" {k} " in f" {' '.join(near)} " for k in keys):
                    found.append((label, share))
        at = [a for a, _ in base]
        out.append((
            i, len(w), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})),
            ",".join(sorted({x for _, x in base} | {x for x, _ in found})), 1.0 if base else max([s for _, s in found], default=0.0),
        ))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _made(spark, folder):
    return sorted(map(tuple, QUERIES["op11_license_notices"](spark, folder).select(*COLUMNS).collect()), key=str)


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("licences"))
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return folder


def test_query_against_plain_walk(spark, written):
    made = _made(spark, written)
    assert made == _plain(ROWS)
    labels = {r[0]: r[6] for r in made if r[0] not in (1, None)}
    assert labels[3] == "apache-2,cc-by-nc" and labels[4] == "gpl-3" and labels[5] == "gpl-2" and labels[6] == "" and labels[7] == "cc-by,mit"
    assert labels[10] == "gpl-3" and labels[11] == ""


def test_query_on_given_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert _made(spark, sf) == _plain(rows)


@pytest.mark.parametrize("folder", ["written", "sf"])
def test_sql_gives_the_same(spark, written, sf, folder):
    folder = written if folder == "written" else sf
    file = f"{folder}/documents.parquet"
    file = f"{file}/*.parquet" if os.path.isdir(file) else file
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{file}'")
    sql = duck.execute(f"select {', '.join(COLUMNS)} from ({ORACLES['op11_license_notices']})").fetchall()
    assert sorted(sql, key=str) == _made(spark, folder)


def test_awkward_and_no_documents(spark):
    from pyspark.sql import functions as F

    docs = awkward(spark)
    for name in ("_words", "_have", "_open", "_placed", "_starts", "places", "matches"):
        docs = docs.withColumn(name, F.lit("x"))
    assert sorted(r.n_words for r in licenses.scan(docs).collect()) == sorted(len(_words(r[1])) for r in awkward_rows())
    assert licenses.scan(empty(spark)).collect() == []


def test_no_templates_or_phrases(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert all(not r.matches for r in licenses.scan(docs, templates=()).collect())
    assert all(not r.places for r in licenses.scan(docs, phrases=()).collect())


def test_no_python_worker(spark, sf):
    plan = QUERIES["op11_license_notices"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
