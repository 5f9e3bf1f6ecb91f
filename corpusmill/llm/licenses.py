"""Licence scans over a positional index of rare words.

Every template is a sequence of words with the places where each word stands in it (its postings). How rare a licence word is
follows from all documents: the fewer hold it, the higher its IDF. A text looks up the LOOKED rarest words of a template that
it has; a word at place i of the text and p of the template votes for a template that starts at i - p. Starts on which
enough words agree, within SLACK words, are verified: the mandatory phrases stand in that stretch, word for word, and
enough of the template's words do. All of it is DataFrame expressions within a row, so that texts are not shuffled; only
licence words and their counts are, at most one row a word and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import let

from .common import text_of

# Phrases that name a licence wherever they stand, and their labels.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

# Label, wording of a notice, and the phrases that must stand in it.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial 4 0",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-3", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license as published", "version 3 of the license")),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("lgpl", "licensed under the gnu lesser general public license version", ("gnu lesser general public license",)),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)

#: Rarest words that a text looks up of each template, how far places may be apart, and the share of words that has to agree.
LOOKED, SLACK, SHARE = 8, 8, (3, 4)
_WORD_BITS = 16

#: What is no part of a word, and capitals, which become small.
_GAPS = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: str) -> Column:
    """Runs of digits, letters a to z (A to Z in lower case) and all beyond ASCII; none for null."""
    clean = F.translate(text_of(text), _GAPS + _CAPITALS, " " * len(_GAPS) + _CAPITALS.lower())
    return F.array_remove(F.split(clean, " "), "")


def _vocabulary(templates: tuple, phrases: tuple) -> list[str]:
    return sorted({w for _, wording, keys in templates for t in (wording, *keys) for w in t.split()} | {w for _, p in phrases for w in p.split()})


def document_counts(docs: DataFrame, text: str = "text", templates: tuple = TEMPLATES) -> DataFrame:
    """word, n: how many of the documents have each word of the templates."""
    have = F.array_intersect(_strings(_vocabulary(templates, ())), words(text))
    return docs.select(F.explode(have).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _strings(values: list[str] | tuple) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _index(templates: tuple, counts: dict[str, int]) -> Column:
    """The templates as an array: label, words by falling IDF, postings, length, key phrases and their words."""
    rows = []
    for label, wording, keys in templates or (("", "none", ("none",)),):
        seq = wording.split()
        rare = sorted(set(seq), key=lambda w: (counts.get(w, 0), w))
        postings = [x for w in rare for x in (F.lit(w), F.array(*[F.lit(p) for p, other in enumerate(seq) if other == w]))]
        rows.append(F.struct(
            F.lit(label).alias("label"), _strings(rare).alias("rare"), F.create_map(*postings).alias("postings"), F.lit(len(seq)).alias("length"),
            _strings(keys).alias("keys"), _strings(sorted({w for k in keys for w in k.split()})).alias("needed"),
        ))
    return F.slice(F.array(*rows), 1, len(templates))


def _known(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull())


def _places_of(label: str, phrase: str) -> Column:
    parts = phrase.split()
    whole = lambda w, i: (w == parts[0]) & (F.slice("_words", i + 1, F.lit(len(parts))) == _strings(parts))
    at = F.transform("_words", lambda w, i: F.when(whole(w, i), F.struct(i.alias("start"), F.lit(label).alias("label"))))
    return F.when(F.size(F.array_except(_strings(parts), "_have")) == 0, _known(at))


def _phrase_places(phrases: tuple) -> Column:
    """Array of start and label, for each place where a phrase's words stand one after the other."""
    none = F.array().cast("array<struct<start:int,label:string>>")
    return F.concat(none, *[F.coalesce(_places_of(*p), none) for p in phrases])


def _looked(template: Column) -> Column:
    return F.slice(F.array_intersect(template["rare"], F.col("_have")), 1, LOOKED)


def _cells(template: Column, chosen: Column) -> Column:
    """Where the looked-up words put the start of the template, in cells of SLACK places and the next ones, sorted, once for each word."""
    hits = F.filter("_placed", lambda h: F.array_contains(chosen, h["word"]))
    # A vote is one whole number, the cell of the start and the word's place among the looked-up ones: Spark tells those apart by hash.
    votes = F.flatten(F.transform(hits, lambda h: F.flatten(F.transform(template["postings"][h["word"]], lambda p: F.transform(
        F.array(F.lit(0), F.lit(1)),
        lambda d: F.shiftleft(F.floor((h["at"] - p) / SLACK) + d, _WORD_BITS) + F.array_position(chosen, h["word"]) - 1,
    )))))
    return F.transform(F.array_sort(F.array_distinct(votes)), lambda v: F.shiftright(v, _WORD_BITS).cast("int"))


def _agreed(template: Column) -> Column:
    """Starts of stretches of 2 SLACK places in which enough looked-up words put the start of the template."""

    def starts(chosen: Column, cells: Column) -> Column:
        need = F.ceil(F.size(chosen) * F.lit(SHARE[0]) / F.lit(SHARE[1])).cast("int")
        # Votes are different words within a cell and sorted, so `need` of them agree where the cell `need` - 1 places back is the same.
        ends = F.transform(cells, lambda c, i: F.when((i >= need - 1) & (F.get(cells, i - need + 1) == c), (c - 1) * SLACK))
        return F.array_distinct(_known(ends))

    return let(_looked(template), lambda chosen: let(_cells(template, chosen), lambda cells: starts(chosen, cells)))


def _verified(template: Column, start: Column) -> Column:
    """Share of the template's words in the stretch, null if a key phrase or too many words are missing."""

    def judged(near: Column) -> Column:
        line = F.concat(F.lit(" "), F.array_join(near, " "), F.lit(" "))
        held = F.size(F.array_intersect(template["rare"], near)) / F.size(template["rare"])
        phrases = F.forall(template["keys"], lambda k: F.contains(line, F.concat(F.lit(" "), k, F.lit(" "))))
        return F.when(phrases & (held >= F.lit(SHARE[0]) / F.lit(SHARE[1])), held)

    return let(F.slice("_words", F.greatest(start, F.lit(0)) + 1, template["length"] + 3 * SLACK + F.least(start, F.lit(0))), judged)


def scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text", templates: tuple = TEMPLATES, phrases: tuple = PHRASES) -> DataFrame:
    """doc_id, n_words, places, matches for every row of `docs`.

    `places`: start (words from 0) and label of each phrase. `matches`: label, start (of the stretch, words from 0 of the text)
    and share (of the template's words that stand in it) of each verified notice.

    Null, empty and wordless texts have no words, places or matches. Null and repeated ids stay, each row by itself. Other
    columns are ignored, whatever their names. Words that equally many documents have are looked up in code point order.
    Empty table: no rows. The number of document counts read by the driver is at most the number of words in the templates.
    """
    counts = {r["word"]: r["n"] for r in document_counts(docs, text, templates).collect()}
    rows = docs.select(F.col(id_column).alias("doc_id"), words(text).alias("_words"))
    rows = rows.withColumn("_have", F.array_intersect(_strings(_vocabulary(templates, phrases)), "_words"))
    # Templates without the words of their key phrases cannot be verified.
    rows = rows.withColumn("_open", F.when(F.size("_have") > 0, F.filter(
        _index(templates, counts), lambda t: F.size(F.array_except(t["needed"], F.col("_have"))) == 0
    )))
    asked = F.array_distinct(F.flatten(F.transform("_open", _looked)))
    some = F.size("_open") > 0
    placed = let(asked, lambda a: _known(F.transform("_words", lambda w, i: F.when(F.array_contains(a, w), F.struct(w.alias("word"), i.alias("at"))))))
    rows = rows.withColumn("_placed", F.when(some, placed))
    starts = F.transform("_open", lambda t: F.transform(_agreed(t), lambda s: F.struct(t.alias("template"), s.alias("start"))))
    rows = rows.withColumn("_starts", F.when(some, F.flatten(starts)))
    matches = F.transform("_starts", lambda s: F.struct(
        s["template"]["label"].alias("label"), F.greatest(s["start"], F.lit(0)).alias("start"), _verified(s["template"], s["start"]).alias("share")
    ))
    matches = F.when(some, F.filter(matches, lambda m: m["share"].isNotNull()))
    return rows.select(
        "doc_id", F.size("_words").cast("long").alias("n_words"), _phrase_places(phrases).alias("places"),
        F.coalesce(matches, F.array().cast("array<struct<label:string,start:int,share:double>>")).alias("matches"),
    )


def labels_of(*found: Column) -> Column:
    """The different labels of arrays of places or matches, sorted and joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(f, lambda m: m["label"]) for f in found]))), ",")
