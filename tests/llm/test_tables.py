"""Operators on whole tables: shards, archives, near-duplicates, mixes and the pipeline, against plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import components, mixing, quality, sharding, simhash, warc
from corpusmill.llm.common import keyed_join
from corpusmill.session import scratch_folder

from .test_near_copies import _least_ids as least_ids
from .data import awkward, awkward_rows, empty


def _docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# Shards


def _smallest(sizes, shards):
    low, high = max(sizes, default=0), sum(sizes)
    while low < high:
        middle, used, now = (low + high) // 2, 1, 0
        for s in sizes:
            used, now = (used + 1, s) if now + s > middle else (used, now + s)
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


def _groups(rows):
    sizes = defaultdict(int)
    for r in rows:
        body = (r[1] or "").encode()
        sizes[hashlib.md5(body).hexdigest()] += len(body) + 1
    return [sizes[h] for h in sorted(sizes)]


def _check_shards(rows, out, shards):
    text = {zlib.crc32((r[1] or "").encode()): (r[1] or "") for r in rows}
    assert Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows) == Counter((r.doc_id, r.size, r.text_crc32) for r in out)
    of, slots = defaultdict(set), defaultdict(list)
    for r in out:
        of[text[r.text_crc32]].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in of.values()) and set(slots) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("shards,seed", [(16, 1), (3, 2), (40, 3)])
def test_shards_are_minimax(spark, shards, seed):
    some = random.Random(seed)
    rows = [(i, f"text {some.randrange(300)} " + "y" * some.randrange(60)) for i in range(900)]
    out = sharding.shard_rows(_docs(spark, rows), shards).collect()
    _check_shards(rows, out, shards)
    loads = Counter()
    for r in out:
        loads[r.shard] += r.size
    assert max(loads.values()) == _smallest(_groups(rows), shards)


def test_giants_get_shards_of_their_own(spark):
    rows = [(i, "copy " * 40) for i in range(300)] + [(1000 + i, f"other {i}") for i in range(700)]
    out = sharding.shard_rows(_docs(spark, rows), 8).collect()
    _check_shards(rows, out, 8)
    loads, giant = Counter(), {r.shard for r in out if r.doc_id < 300}
    for r in out:
        loads[r.shard] += r.size
    rest = [loads[s] for s in range(8) if s not in giant]
    assert len(giant) == 1 and max(rest) <= min(rest) + 100


def test_shards_of_a_hot_group_are_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 16)
    rows = [(i, "hot" if i % 2 else f"t{i}") for i in range(400)] + [(None, "hot")] * 3
    _check_shards(rows, sharding.shard_rows(_docs(spark, rows), 4).collect(), 4)


def test_shards_of_awkward_rows(spark):
    _check_shards(awkward_rows(), sharding.shard_rows(awkward(spark)).collect(), 16)
    assert sharding.shard_rows(empty(spark)).count() == 0
    assert sharding.shard_rows(_docs(spark, [(1, "a")]), 16).collect()[0].slot == 0


# Archives

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Page-ID: 999\r\nContent-Length: 30\r\n\r\n" + "x" * 30 + "\r\n\r\n"


def _pages(seed):
    some, rows = random.Random(seed), []
    for i in range(150):
        html = some.choice([
            "", "small", "a" * 150, "b" * some.randint(100, 4000), f"pre{FAKE * some.randint(1, 100)}post{i}", "WARC/1.1\r\nhalf" + "z" * 90 + "WARC/1.1\r\n",
            "é" * some.randint(10, 400) + "\r\n\r\nWARC/1.1\r\n\r\n", "w" * 100, "w" * 99,
        ])
        rows.append((i, f"http://x/{i}" + ("\r\nWARC-Type: revisit" if i % 50 == 0 else ""), html))
    return [*rows, (7, "u", None), (None, "n", "nullid" * 50), (None, "n", "a" * 150), (5, None, rows[5][2]), (5, None, rows[5][2])]


def _expected(rows):
    first, out = {}, []
    for page, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 100 and page is not None:
            first[body] = min(first.get(body, page), page)
    for page, _, html in rows:
        body = (html or "").encode()
        again = body in first and first[body] != page
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[body] if again else None))
    return Counter(out)


@pytest.mark.parametrize("split,broadcast", [("2000", 200_000), ("64m", 0)])
def test_archives_come_back_whole(spark, monkeypatch, split, broadcast):
    monkeypatch.setattr(warc, "MAX_BROADCAST", broadcast)
    rows, path = _pages(3), f"{scratch_folder(spark)}/warc"
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        warc.write_archives(_docs(spark, [(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, size string"), path)
        out = warc.read_archives(spark, path)
        assert Counter(tuple(r) for r in out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == _expected(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_archives_of_no_pages(spark):
    path = f"{scratch_folder(spark)}/warc"
    warc.write_archives(_docs(spark, [], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


# Near-duplicates


def _plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def _plain_components(edges, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_covering_masks_miss_no_pair():
    for positions in (list(range(64)), list(range(3, 33))):
        masks = simhash.covering_masks(positions)
        some = random.Random(5)
        for _ in range(3000):
            differing = sum(1 << p for p in some.sample(positions, some.randint(0, 3)))
            assert any(not m & differing for m in masks)


def test_fingerprint_is_that_of_the_jvm_hash(spark):
    row = spark.sql("select xxhash64('éa b c') h").first()
    assert _plain_fingerprint("éa b c") == row.h == simhash._fingerprint("éA B\n c".encode().replace("A".encode(), b"A")) == row.h


def _near(spark, values):
    out = components.components(simhash.links(_docs(spark, [(v,) for v in values], "fp long"))).collect()
    return {r.node: r.root for r in out}


@pytest.mark.parametrize("again", [2048, 4])
def test_links_join_what_all_pairs_join(spark, monkeypatch, again):
    monkeypatch.setattr(simhash, "DEAL_AGAIN", again)
    some, values = random.Random(6), set()
    for _ in range(40):
        base = some.getrandbits(64)
        for _ in range(some.randint(1, 12)):
            values.add(base)
            for _ in range(some.randint(1, 4)):
                base ^= 1 << some.randrange(64)
    values = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = [(a, b) for i, a in enumerate(values) for b in values[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    plain = _plain_components(edges, values)
    found = _near(spark, values)
    assert {v: found.get(v, v) for v in values} == plain


def test_near_groups(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(awkward(spark).select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [_plain_fingerprint(t) for _, t in rows]
    nodes = sorted(set(prints))
    edges = [(a, b) for i, a in enumerate(nodes) for b in nodes[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    root, least = _plain_components(edges, nodes), {}
    for (doc, _), p in zip(rows, prints, strict=True):
        if doc is not None:
            least[root[p]] = min(doc, least.get(root[p], doc))
    out = simhash.near_groups(docs).collect()
    assert Counter((d, p, least.get(root[p])) for (d, _), p in zip(rows, prints, strict=True)) == Counter((r.doc_id, r.fp, r.component_id) for r in out)
    kept = simhash.keep_one(docs).collect()
    assert Counter(root[_plain_fingerprint(r.text)] for r in kept) == Counter(set(root.values()))
    assert all(r.doc_id == least.get(root[_plain_fingerprint(r.text)]) for r in kept)
    assert simhash.near_groups(awkward(spark)).count() == len(awkward_rows()) and simhash.near_groups(empty(spark)).count() == 0


def test_components_of_chains_stars_and_none(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (7, 6), (6, 7)]
    got = {r.node: r.root for r in components.components(_docs(spark, edges, "u long, v long")).collect()}
    assert got == _plain_components(edges, {n for e in edges for n in e})
    assert components.components(_docs(spark, [], "u long, v long")).count() == 0


# Mixes


def _plain_targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full = set()
    while True:
        free = [s for s in order if s not in full]
        level = (sum(sizes.values()) - cap * sum(sizes[s] for s in full)) / sum(weight[s] for s in free) if free else 0
        more = {s for s in free if weight[s] * level >= cap * sizes[s]}
        if not more:
            return {s: cap * sizes[s] if s in full else weight[s] * level for s in order}
        full |= more


def test_mix_meets_its_targets(spark):
    some = random.Random(9)
    rows = [(i, "w " * some.randint(1, 9), f"s{min(some.randrange(9), some.randrange(9))}") for i in range(6000)] + [(9000 + i, "a b", None) for i in range(9)] + [(9100, " ", "none")]
    docs = _docs(spark, rows, "doc_id long, text string, source string")
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    targets, taken = _plain_targets(sizes), Counter()
    source = {i: s for i, _, s in rows}
    out = mixing.copy_counts(docs).collect()
    for r in out:
        assert r.source_size == sizes[source[r.doc_id]] and abs(r.target - targets[source[r.doc_id]]) < 1e-6 * max(1, r.target)
        assert 0 <= r.copies <= 3 and abs(r.copies - r.rate) < 1
        taken[source[r.doc_id]] += r.size * r.copies
    assert abs(sum(targets.values()) - sum(sizes.values())) < 1e-3
    assert all(abs(taken[s] - t) < 0.1 * t + 20 for s, t in targets.items())
    mixed = Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert mixed == Counter({r.doc_id: r.copies for r in out if r.copies})


def test_mix_of_awkward_rows(spark):
    counts = mixing.copy_counts(awkward(spark))
    assert counts.count() == len(awkward_rows())
    mixed = mixing.mix(awkward(spark))
    assert mixed.columns == awkward(spark).columns
    assert mixing.copy_counts(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0


def test_keyed_join_treats_hot_and_cold_keys_alike(spark):
    rows = _docs(spark, [(k, i) for k, n in ((None, 50), (1, 3000), (2, 1), (3, 2)) for i in range(n)], "k long, i long")
    keys = rows.groupBy("k").agg(F.count("*").alias("n"))
    assert keyed_join(rows, keys, "k", "n", rows.count()).count() == rows.count()
    assert keyed_join(rows, keys, "k", "n", 10**9).count() == rows.count()


# Pipeline


@pytest.fixture(scope="module")
def staged(spark):
    folder, out = "/root/testdata/sf0.01", []
    docs = spark.read.parquet(f"{folder}/documents.parquet").cache()
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, folder).cache()
        out.append((name, docs, made))
        docs = made
    return folder, out


def test_stages_keep_columns_and_only_drop_rows(staged):
    _, out = staged
    for name, before, after in out[:-1]:
        assert after.columns == before.columns
        ids = Counter(r.doc_id for r in before.select("doc_id").collect())
        kept = Counter(r.doc_id for r in after.select("doc_id").collect())
        assert set(kept) <= set(ids) and (name == "source_mix" or not kept - ids)


def test_rules_stage(staged):
    _, before, after = staged[1][0]
    kept = {r.doc_id for r in quality.judged(before).where("kept").collect()}
    assert {r.doc_id for r in after.collect()} == kept


def test_classifier_stage_keeps_clean_documents(spark, staged):
    folder, out = staged
    _, before, after = out[1]
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1")
    clean, kept = before.join(labels, "doc_id").count(), after.join(labels, "doc_id").count()
    assert kept >= 0.97 * clean


def test_near_duplicate_stage(staged):
    _, before, after = staged[1][2]
    assert sorted(r.doc_id for r in after.collect()) == least_ids([(r.doc_id, r.text) for r in before.collect()])


def test_mix_and_token_stages(staged):
    _, before, mixed = staged[1][3]
    counts = Counter({r.doc_id: r.copies for r in mixing.copy_counts(before).collect() if r.copies})
    assert Counter(r.doc_id for r in mixed.collect()) == counts
    _, _, tokens = staged[1][4]
    rows = tokens.join(mixed.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(rows) == sum(counts.values()) and all(r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in rows)


def test_run_gives_what_the_stages_give(spark, staged):
    folder, out = staged
    assert corpus_pipeline.run(spark, folder).select("doc_id", "ids_sha256").exceptAll(out[-1][2].select("doc_id", "ids_sha256")).count() == 0


@pytest.mark.parametrize("make", [awkward, empty])
def test_stages_take_awkward_and_no_documents(spark, sf, make):
    docs = make(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        rows = out.count()
        assert rows == 0 if make is empty else rows <= 3 * len(awkward_rows())
        assert name == "tokens" or out.columns == docs.columns
