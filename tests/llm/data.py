"""Awkward documents that every operator has to take."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, hash string, fp string, size string, score string, n string, word string, block string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))


def awkward_rows() -> list[tuple]:
    texts = [
        None, "", " \n\t ", "one", "Éa été où ça", "same text here " * 12, "same text here " * 12, LONG, "x" * 50_000, "<|endoftext|> a\x00b",
        "line one is here\n" * 5, "Ünïcode 漢字 🙂 " * 40,
    ]
    rows = [(i, t, "en", f"s{i % 2}", None) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "no id", None, None, 1), (None, None, None, None, None), (5, "other text of the same id", "en", None, 3)]
    return [(*r, "k", "h", "f", "z", "sc", "n", "wd", "bl") for r in rows]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
