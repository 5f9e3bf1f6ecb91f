"""Operators that look at one text at a time, against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from corpusmill.llm import bpe, classifier, ctw, extraction, quality, winnowing
from corpusmill.llm.query_winnowing import with_next

from .data import awkward, awkward_rows, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def sample(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# Winnowing


def _plain_hash(spark, words):
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(winnowing.PRIME)).alias("h")).collect()
    return {r.w: r.h for r in rows}


def _plain_winnow(words, hashed, k=winnowing.GRAM, window=winnowing.WINDOW):
    def rolled(some):
        out = 0
        for w in some:
            out = (out * winnowing.BASE + hashed[w]) % winnowing.PRIME
        return out

    if not words:
        return []
    grams = [rolled(words[i : i + k]) for i in range(len(words) - k + 1)] or [rolled(words)]
    chosen = set()
    for i in range(max(1, len(grams) - window + 1)):
        some = grams[i : i + window]
        least = min(some)
        chosen.add(max(i + j for j, g in enumerate(some) if g == least))
    return [(grams[i], i) for i in sorted(chosen)]


@pytest.mark.parametrize("k,window", [(5, 8), (3, 6), (1, 1), (4, 5)])
def test_winnowing_matches_plain_walk(spark, sf, k, window):
    docs = sample(spark, sf).where("n_chars < 3000").select("doc_id", "text").unionByName(awkward(spark).where("length(text) < 5000 or text is null").select("doc_id", "text"))
    rows = winnowing.with_fingerprint(docs, "text", "f", k, window).select("text", winnowing.hashes("f").alias("h"), winnowing.places("f").alias("p")).collect()
    hashed = _plain_hash(spark, {w for r in rows for w in WORD.findall(r.text or "")})
    for r in rows:
        assert list(zip(r.h, r.p, strict=True)) == _plain_winnow(WORD.findall(r.text or ""), hashed, k, window)


def test_winnowing_guarantee(spark):
    shared = " ".join(f"shared{i}" for i in range(winnowing.GRAM + winnowing.WINDOW - 1))
    texts = [(i, " ".join(f"t{i}n{j}" for j in range(40)) + f" {shared} " + " ".join(f"u{i}n{j}" for j in range(25 * i))) for i in range(4)]
    rows = winnowing.with_fingerprint(spark.createDataFrame(texts, "doc_id long, text string"), "text", "f").select(winnowing.hashes("f").alias("h")).collect()
    assert all(set(a.h) & set(b.h) for a in rows for b in rows)


def test_next_row_in_descending_order(spark, monkeypatch):
    from corpusmill.llm import query_winnowing

    monkeypatch.setattr(query_winnowing, "GROUP_ROWS", 16)
    ids = random.Random(4).sample(range(-10**12, 10**12), 500)
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    paid = lambda df: df.withColumn("p", F.length("text"))
    got = {r.doc_id: (r._next.text, r._next.payload) for r in with_next(docs, "doc_id", "text", "p", paid).collect()}
    down = sorted(ids, reverse=True)
    assert got == {a: (f"text {b}", len(f"text {b}")) for a, b in zip(down, down[1:] + down[:1], strict=True)}
    assert with_next(awkward(spark).select("doc_id", "text"), "doc_id", "text", "p", paid).count() == len(awkward_rows())
    assert with_next(empty(spark).select("doc_id", "text"), "doc_id", "text", "p", paid).count() == 0


# Quality rules


def _plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    spans = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + j for i in range(len(words) - 7) if spans[tuple(words[i : i + 8])] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, sf):
    docs = sample(spark, sf).select("doc_id", "text", "source").unionByName(awkward(spark).select("doc_id", "text", "source"))
    texts = docs.join(quality.judged(docs).select(F.col("doc_id").alias("i"), "key", *quality.COUNTS, "base_failed", "kept"), F.col("doc_id").eqNullSafe(F.col("i")) & (F.xxhash64("text") == F.col("key"))).collect()
    assert len(texts) >= docs.count()
    for r in texts:
        n = _plain_counts(r.text)
        assert tuple(r[c] for c in quality.COUNTS) == n
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert not (r.base_failed and r.kept)
    assert quality.judged(empty(spark)).count() == 0


def test_bad_hosts_are_rejected_and_small_hosts_shrink(spark):
    good = " ".join(f"clean{i} words" for i in range(30))
    bad = " ".join(f"junk{i}###" for i in range(30))
    rows = [(i, bad, "bad") for i in range(200)] + [(900, good, "bad")] + [(1000 + i, good, f"host{i % 20}") for i in range(400)] + [(2000, bad, "tiny"), (2001, good, "tiny")]
    out = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[900].host_rejected and not out[900].kept and not out[0].kept
    assert out[2001].kept and not out[2000].kept and all(out[1000 + i].kept for i in range(400))


# BPE


def test_bpe_matches_library(spark, sf):
    library = tokenizers.Tokenizer.from_file(PATH)
    docs = sample(spark, sf).select("doc_id", "text").unionByName(awkward(spark).select("doc_id", "text"))
    rows = docs.join(bpe.encode(docs, PATH).withColumnRenamed("doc_id", "i"), F.col("doc_id").eqNullSafe(F.col("i")) & (F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256) == F.col("decoded_sha256"))).distinct().collect()
    assert len(rows) == docs.distinct().count()
    for r in rows:
        expected = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == expected and r.n_tokens == len(expected)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in expected)).hexdigest()
    assert bpe.encode(empty(spark), PATH).count() == 0


def test_bpe_on_random_strings_and_broken_utf8():
    library, own = tokenizers.Tokenizer.from_file(PATH), bpe.Vocabulary(open(PATH, encoding="utf-8").read())
    some = random.Random(8)
    letters = "aaabc  \n\t'sdrtveml0123²é世界🙂\xa0　!?<|endoftext|>_-\r\x00\x85"
    texts = ["".join(some.choice(letters) for _ in range(some.randint(0, 60))) for _ in range(800)] + ["", "<|endoftext|>" * 3, "a" * 5000]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert own.decode(ids) == text
    for _ in range(200):
        ids = [some.randrange(50257) for _ in range(some.randint(0, 12))]
        assert own.decode(bpe.np.array(ids, "<u4")) == library.decode(ids, skip_special_tokens=False)


def test_bpe_round_trip_of_a_table(spark):
    docs = awkward(spark).select("doc_id", "text")
    back = bpe.decode(bpe.encode(docs, PATH), PATH, into="back").select("back").collect()
    assert sorted(r.back for r in back) == sorted((r[1] or "") for r in awkward_rows())


# Extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script><style>p{}</style></head><body class="has-sidebar">
<header><a href="/">Home</a> <h2>Site</h2></header><nav><ul><li><a>one</a><li><a>two</a></ul></nav><div id="cookie-notice">We use cookies.</div>
<main><article><header><h1>Head &amp; line</h1></header><p>First&nbsp;  para<br>graph <b>bold <i>it</b>.<p>Second &lt;p&gt; &#233;&eacute;.</p>
<aside>Related</aside><ul><li>item <a href=x>link</a> text</li></ul><div class="comments"><p>Reader says</p></div><form><p>Name</p><input></form></article></main>
<div class="ad banner">Buy</div><footer><p>&copy; x</p></footer><!-- <p>comment</p> --></body></html>"""


def test_extraction_of_an_article():
    assert extraction.main_text(PAGE) == "Head & line\n\nFirst para graph bold it.\n\nSecond <p> éé.\n\nitem link text"


def test_extraction_without_landmarks_uses_the_words():
    body = "This is the story of a town that was by the sea and of the people who lived in it for many years. " * 2
    page = f"<body><div><a>one</a> <a>two</a></div><h2>Title</h2><div>{body}</div><div>It was so.</div><div>{body}</div><div>Copyright 2020 Example</div></body>"
    assert extraction.main_text(page).split("\n\n") == ["Title", body.strip(), "It was so.", body.strip()]


def test_extraction_is_not_misled_by_an_article_card():
    body = "the cat and the dog were on the hill when it was so " * 10
    page = f"<body><div>{body}</div><article class=card><h3>Other</h3><p>Short card text here.</p></article></body>"
    assert extraction.main_text(page) == body.strip()
    page = f"<body><article><h1>Head</h1><p>{body}</p></article><div>{body}</div><div>{body}</div><article><p>Card.</p></article></body>"
    assert extraction.main_text(page).count(body.strip()) == 3


def test_extraction_in_languages_that_are_not_listed():
    russian = ["Это первый абзац длинного текста без служебных слов из списка и он должен остаться целиком " * 6, "Второй абзац также остаётся на странице потому что он длинный " * 9]
    menu = "<div><a href=/1>Главная</a> <a href=/2>Новости</a></div>"
    page = f"<body>{menu}<h1>Заголовок</h1><p>{russian[0]}</p><p>Короткая строка.</p><p>{russian[1]}</p><div>© 2020</div></body>"
    assert extraction.main_text(page).split("\n\n") == ["Заголовок", russian[0].strip(), "Короткая строка.", russian[1].strip()]
    chinese = ["这是一个没有空格的中文段落它应该被完整地保留下来" * 7, "第二个段落也很长所以它也应该留在结果里面" * 9]
    page = f"<body>{menu}<div>{chinese[0]}</div><div>{chinese[1]}</div></body>"
    assert extraction.main_text(page).split("\n\n") == chinese


def _plain_labels(page):
    """The two passes written out: rules on each block, then neighbours, on pages in the listed languages."""
    blocks = extraction.blocks_of(page)
    text = [b for b in blocks if not b.outside and b.link_share <= 0.5]
    landmark = any(b.inside and not b.outside for b in blocks) and 2 * sum(b.size for b in text if b.inside) >= sum(b.size for b in text)
    first = []
    for b in blocks:
        density = b.stop_words / max(1, b.words)
        if b.outside or landmark and not b.inside or not landmark and b.link_share > 0.5:
            first.append(-1)
        elif landmark:
            first.append(1 if b.link_share <= 0.5 or b.heading else 0)
        elif b.words < 12 or b.heading or 0.15 <= density < 0.3 and b.words < 30:
            first.append(0)
        else:
            first.append(1 if density >= 0.15 else -1)
    out = []
    for i, (b, label) in enumerate(zip(blocks, first, strict=True)):
        before = next((x for x in reversed(first[:i]) if x), -1)
        after = next((x for x in first[i + 1 :] if x), -1)
        if label:
            out.append(label)
        elif before == after or b.heading:
            out.append(after)
        else:
            out.append(1 if b.stop_words >= 0.3 * max(1, b.words) or b.words >= 12 else -1)
    return out


def test_extraction_rules_against_two_plain_passes():
    some, seen = random.Random(9), Counter()
    good = "the cat and the dog were on the hill when it was so".split()
    bad = "alpha beta gamma delta epsilon zeta eta theta".split()
    for _ in range(300):
        parts = ["<p>" + "the man who was here and there is one of them " * 4 + "</p>"]
        for _ in range(some.randint(1, 12)):
            words = " ".join(some.choice(some.choice([good, bad])) for _ in range(some.randint(1, 40)))
            tag = some.choice(["p", "div", "h2", "nav", "li"])
            parts.append(f"<{tag}>{f'<a href=x>{words}</a>' if some.random() < 0.2 else words}</{tag}>")
        some.shuffle(parts)
        at = some.randint(0, len(parts))
        page = "".join(parts) if some.random() < 0.5 else "".join([*parts[:at], "<article>", *parts[at:], "</article>"])
        blocks = extraction.labelled(page)
        seen.update(b.rule for b in blocks)
        if any(b.label == 1 for b in blocks):
            assert [b.label for b in blocks] == _plain_labels(page)
    assert min(seen[r] for r in ("place", "landmark", "links", "density", "neighbours")) > 20


def test_extraction_with_broken_links():
    assert extraction.main_text("<nav><a href=a>x</a></nav><article><p><a name=top>First one</p><p>Second one</p></article>") == "First one\n\nSecond one"
    assert extraction.main_text("<article><p><a href=x>All is a link</p><p>Next</p></article><footer>f</footer>") == "All is a link\n\nNext"


@pytest.mark.parametrize("name", ["button", "select", "object", "svg", "noscript"])
def test_extraction_behind_an_unclosed_button(name):
    page = f"<nav><{name}>Menu<ul><li>x</ul></nav><article><p>First one</p><p>Second one</p></article>"
    assert extraction.main_text(page) == "First one\n\nSecond one"
    assert extraction.main_text(f"<article><p>One<{name}>not this</p><p>Two</p></article><script>x") == "One\n\nTwo"


def test_extraction_matches_the_documents(spark, sf):
    texts = {" ".join(r.text.split()) for r in sample(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for r in extraction.extract(pages).collect():
        head, *rest = r.text.split("\n\n")
        assert " ".join(rest) in texts and " ".join(rest).startswith(head[:10])


def test_extraction_of_awkward_pages(spark):
    pages = [(1, None), (2, ""), (None, "<p"), (3, "<article>" + "<p>word " * 20_000), (3, "plain text only"), (4, "<article></article>" * 3), (5, "</p></div>&#x110000;&bogus;")]
    df = spark.createDataFrame([(i, h, "old") for i, h in pages], "page_id long, html string, text string")
    out = extraction.extract(df)
    assert out.columns == ["page_id", "text"] and out.count() == len(pages)
    by = {(r.page_id, len(r.text)) for r in out.collect()}
    assert {(1, 0), (2, 0), (4, 0), (3, 20_000 * 4 + 19_999 * 2)} <= by
    assert extraction.extract(df.limit(0)).count() == 0


# Classifier


def test_classifier_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = sample(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    rows = classifier.scored(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and all(0 <= r.score <= 1 for r in rows)
    assert sum((r.score >= 0.7) == (r.quality == 1) for r in rows) >= 0.95 * len(rows)


def test_classifier_learns_from_no_held_out_label(spark, sf):
    docs, labels = sample(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = ({r.doc_id: r.score for r in classifier.scored(docs, x).collect()} for x in (labels, flipped))
    assert one.keys() == two.keys() and all(abs(one[i] - two[i]) < 1e-6 for i in one)


def test_classifier_on_awkward_rows(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert classifier.scored(awkward(spark), labels).where("score between 0 and 1").count() == len(awkward_rows())
    assert {r.score for r in classifier.scored(awkward(spark), labels.limit(0)).collect()} == {0.5}
    odd = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (3, None)], "doc_id long, quality int")
    assert classifier.scored(awkward(spark), odd).count() == len(awkward_rows())
    assert classifier.scored(empty(spark), labels).count() == 0


def test_isotonic_is_the_best_rising_fit():
    import numpy as np

    places, rates = classifier.isotonic(np.arange(5.0), np.array([1.0, 1, 2, 1, 1]), np.array([0.2, 0.1, 0.5, 0.4, 0.9]))
    assert np.allclose(places, [0.5, 7 / 3, 4]) and np.allclose(rates, [0.15, 1.4 / 3, 0.9])


# Context-tree weighting


def _plain_ctw(train, test, depth):
    """Log10 probability of each test text by the mixture written out node by node."""
    from math import exp, lgamma, log, log10, pi

    def steps(text):
        data = b"\n" * depth + b" ".join(text.lower().split()) + b"\n"
        for i in range(depth, len(data)):
            for j in range(8):
                prefix = 1 << j | data[i] >> (8 - j)
                yield data[i - depth : i], prefix, data[i] >> (7 - j) & 1

    counts, children = {}, {}
    for known, texts in ((1, train), (0, test)):
        for text in texts:
            for context, prefix, bit in steps(text):
                for d in range(depth + 1):
                    node = (context[depth - d :], prefix)
                    counts.setdefault(node, [0, 0])[bit] += known
                    if d:
                        children.setdefault((node[0][1:], prefix), set()).add(node)
    total = {}

    def weigh(node):
        if node not in total:
            a, b = counts[node]
            own = lgamma(a + 0.5) + lgamma(b + 0.5) - log(pi) - lgamma(a + b + 1)
            if len(node[0]) == depth:
                total[node] = (own, 1.0)
            else:
                below = sum(weigh(c)[0] for c in children[node])
                top = max(own, below)
                both = top + log(exp(own - top) + exp(below - top))
                total[node] = (both - log(2), exp(own - both))
        return total[node]

    out = []
    for text in [*train, *test]:
        score = 0.0
        for context, prefix, bit in steps(text):
            said = None
            for d in range(depth, -1, -1):
                node = (context[depth - d :], prefix)
                n = counts[node]
                own = (n[bit] + 0.5) / (sum(n) + 1)
                weight = weigh(node)[1]
                said = own if said is None else weight * own + (1 - weight) * said
            score += log10(said)
        out.append(score)
    return out


@pytest.mark.parametrize("depth,block", [(2, 1 << 20), (3, 500), (5, 2000)])
def test_ctw_matches_plain_tree(spark, sf, depth, block):
    texts = [r.text for r in sample(spark, sf).orderBy("n_chars").limit(40).collect()] + [None, "", "Zoë ÉTÉ\n\n x", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("block", F.lit("b")).withColumn("key", F.lit(1))
    got = {r.doc_id: r for r in ctw.scored(df, depth=depth, block_bytes=block).collect()}
    bodies = [(t or "").encode() for t in texts]
    train, test = [i for i in got if not got[i].held_out], [i for i in got if got[i].held_out]
    plain = dict(zip([*train, *test], _plain_ctw([bodies[i] for i in train], [bodies[i] for i in test], depth), strict=True))
    assert len(got) == len(texts) and test
    for i, r in got.items():
        assert abs(r.score - plain[i]) < 1e-6 * max(1, -plain[i])


def test_base_scores(spark, sf):
    from math import log10
    from zlib import crc32

    docs = [(r.doc_id, r.text) for r in sample(spark, sf).collect()]
    split = {i: [w.encode().lower() for w in WORD.findall(t or "")] + [b"\n"] for i, t in docs}
    counts = Counter(w for i, ws in split.items() if crc32(str(i).encode()) % 7 != 2 for w in ws)
    total = sum(counts.values())
    for r in ctw.scored(sample(spark, sf)).collect():
        words = split[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), total)
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 7 == 2)
        assert abs(r.base_score - sum(log10((counts[w] + 1) / (total + len(counts) + 1)) for w in words)) < 1e-6 * len(words)


def test_ctw_on_awkward_rows(spark):
    rows = ctw.scored(awkward(spark)).collect()
    assert len(rows) == len(awkward_rows()) and all(r.score < 0 and r.bits_per_byte > 0 for r in rows)
    assert ctw.scored(empty(spark)).count() == 0
