"""WARC archives: written as text files whose line separator ends a record, read back in splits by boundary chains.

A reader that starts in the middle of a file cannot trust the magic that opens a record, for a payload may hold it too.
Here every magic is only a candidate: tasks parse the header behind it and say where its successor would start. A record
is real if the chain of successors from the start of its file reaches it. Inside a split a task follows chains on its
own and hands on where each leaves the split; pointer jumping over these exits then finds the entry of every split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from corpusmill.session import cut_lineage

from .common import keyed_join, text_of

# The format's magic, ends and profile.
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
#: Smaller payloads are always stored.
LEAST_SHARED = 100
#: Keys of revisits up to this number are broadcast (some 100 bytes each); more are joined by a shuffle.
MAX_BROADCAST = 200_000


def _line(name: str, value: Column) -> Column:
    """A header line, nothing where the value is null; line breaks in a value would end it and become spaces."""
    clean = F.regexp_replace(value.cast("string"), r"[\r\n]+", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def _head(kind: str, length: Column, *more: Column) -> Column:
    named = F.when(F.col("page_id").isNotNull(), F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">")))
    return F.concat(
        F.lit(f"{MAGIC}WARC-Type: {kind}\r\n"), _line("WARC-Record-ID", F.coalesce(named, F.concat(F.lit("<urn:sha256:"), F.col("digest"), F.lit(">")))),
        F.lit(f"WARC-Date: {DATE}\r\n"), _line("WARC-Target-URI", F.col("url")), _line("WARC-Page-ID", F.col("page_id")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\n")), *more,
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit(END),
    )


def write_archives(pages: DataFrame, path: str, id_column: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes one record for each row of `pages` below `path`, uncompressed: full payloads in path/full, revisits in path/again.

    Of rows with equal payloads of at least LEAST_SHARED bytes those with the smallest page_id are responses and the others revisit
    it; smaller payloads are all responses. Payloads are not shuffled: equal ones are found by digest, and the scan that
    writes full records leaves revisits out. Null html: an empty payload. Null ids: written without one; beside a known
    id of the same payload a revisit of it, else a response. Other columns are ignored. Empty table: no records.
    """
    body = text_of(html)
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url).alias("url"), body.alias("html"), F.sha2(body.cast("binary"), 256).alias("digest"))
    rows = rows.withColumn("size", F.octet_length("html").cast("long"))
    narrow = cut_lineage(rows.drop("html"))
    large = narrow.where(F.col("size") >= LEAST_SHARED)
    firsts = cut_lineage(large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    again = cut_lineage(keyed_join(large, firsts, "digest", "n", narrow.count()).where(~F.col("page_id").eqNullSafe(F.col("first"))).drop("n"))
    keys = again.select(F.struct("page_id", "digest").alias("_again")).distinct()
    few = again.count() <= MAX_BROADCAST
    full = rows.join(F.broadcast(keys) if few else keys, F.struct("page_id", "digest") == F.col("_again"), "left_anti")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    full.select(F.concat(_head("response", F.length(http) + F.col("size")), http, "html").alias("value")).write.option(
        "lineSep", END
    ).text(f"{path}/full")
    refers = F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))
    again.select(_head(
        "revisit", F.lit(0), _line("WARC-Profile", F.lit(IDENTICAL)), _line("WARC-Refers-To", refers), _line("WARC-Refers-To-Page-ID", F.col("first")),
        _line("WARC-Payload-Length", F.col("size")),
    ).alias("value")).write.option("lineSep", END).text(f"{path}/again")


def _fields(head: bytes) -> dict[bytes, bytes]:
    found = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            found.setdefault(name.strip().lower(), value.strip())
    return found


def _payload(block: bytes, fields: dict[bytes, bytes]) -> bytes:
    """The payload of a record's block: what follows the HTTP header where there is one."""
    if fields.get(b"content-type", b"").startswith(b"application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


_SEGMENT = (
    "file string, block long, seq long, at long, size long, head long, next long, exit long, "
    "kind string, page_id long, refers_to long, payload_bytes long, payload_digest string"
)


def _number(value: bytes | None) -> int | None:
    try:
        return None if value is None else int(value)
    except ValueError:
        return None


def _segment(value: bytes) -> tuple:
    """What a candidate says of itself: header length, declared record length, kind, ids, and its payload if all of it is here."""
    head, ended, _ = value.partition(b"\r\n\r\n")
    fields = _fields(head) if ended else {}
    length = _number(fields.get(b"content-length"))
    if length is None or length < 0 or b"warc-type" not in fields:
        return None, None, None, None, None, None, None
    start = len(head) + 4
    kind, page, refers = fields[b"warc-type"].decode("utf-8", "replace"), _number(fields.get(b"warc-page-id")), _number(fields.get(b"warc-refers-to-page-id"))
    size = digest = None
    if kind == "revisit":
        size, digest = _number(fields.get(b"warc-payload-length")), fields.get(b"warc-payload-digest", b"").rpartition(b":")[2].decode("utf-8", "replace")
    elif len(value) == start + length + len(END):
        payload = _payload(value[start : start + length], fields)
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    return start, start + length + len(END), kind, page, refers, size, digest


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """The text between magics, with the split that each piece starts in; pieces of a split come in order."""
    lines = spark.read.option("lineSep", MAGIC).option("recursiveFileLookup", "true").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value")
    )


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[bytes]]]:
    """Pieces with the split they belong to, one at a time."""
    for batch in batches:
        yield from zip(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()), batch.column("value"))


def segments(spark: SparkSession, path: str) -> DataFrame:
    """One row for each piece: its place in its split, and what the candidate in it declares; places count from the split's first byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, place = None, [], 0

        def flush():
            # From the last piece back: a successor inside the split is known already when it is asked for.
            exits: dict[int, int] = {}
            for row in reversed(rows):
                if row[6] is not None:
                    row[7] = exits.get(row[6], row[6])
                    exits[row[3]] = row[7]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=[f.split()[0] for f in _SEGMENT.split(", ")]
            )

        for split, value in _splits(batches):
            if split != key:
                if rows:
                    yield flush()
                key, rows, place = split, [], 0
            data = value.as_py() or b""
            head, span, *told = _segment(data)
            rows.append([*key, len(rows), place, len(data), head, None if span is None else place + span + len(MAGIC), None, *told])
            place += len(data) + len(MAGIC)
        if rows:
            yield flush()

    return _raw(spark, path).mapInArrow(run, _SEGMENT)


_TYPES = [pa.string()] + [pa.int64()] * 7 + [pa.string()] + [pa.int64()] * 3 + [pa.string()]


def _placed(found: DataFrame) -> DataFrame:
    """Places turned into offsets in the file. A piece before the first magic of a file gets a negative one."""
    blocks = found.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("_span"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select("file", "block", (F.coalesce(F.sum("_span").over(earlier), F.lit(0)) - len(MAGIC)).alias("_base"))
    joined = found.join(bases, ["file", "block"])
    return joined.withColumns({c: F.col(c) + F.col("_base") for c in ("at", "next", "exit")}).drop("_base")


def _entries(candidates: DataFrame) -> DataFrame:
    """file, at: candidates at which a chain from the start of a file enters a split, by pointer jumping over exits."""
    jump = cut_lineage(candidates.where("exit is not null").select("file", "at", F.col("exit").alias("to")))
    reached = cut_lineage(jump.where("at = 0").select("file", "at"))
    count = reached.count()
    while True:
        landed = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        # Where a jump leads to no candidate the file has ended.
        known = landed.join(jump.select("file", "at"), ["file", "at"], "left_semi")
        reached = cut_lineage(reached.unionByName(known).distinct())
        before, count = count, reached.count()
        if count == before:
            return reached
        onward = jump.select("file", F.col("at").alias("to"), F.col("to").alias("_to"))
        jump = cut_lineage(jump.join(onward, ["file", "to"], "left").select("file", "at", F.coalesce("_to", "to").alias("to")))


def _walked(candidates: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds `owner`: the start of the real record that a piece belongs to, null if that starts in an earlier split."""
    marked = candidates.join(entries.withColumn("_entry", F.lit(True)), ["file", "at"], "left")
    narrow = marked.select("file", "block", "seq", "at", "next", "_entry")

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        at, onward = table.column("at").to_pylist(), dict(zip(table.column("at").to_pylist(), table.column("next").to_pylist()))
        entry = [a for a, e in zip(at, table.column("_entry").to_pylist()) if e]
        real, now = set(), entry[0] if entry else None
        while now in onward and now is not None and now not in real:
            real.add(now)
            now = onward[now]
        owners, last = [], None
        for a in at:
            last = a if a in real else last
            owners.append(last)
        return pa.table({"file": table.column("file"), "block": table.column("block"), "seq": table.column("seq"), "owner": pa.array(owners, pa.int64())})

    owners = narrow.groupBy("file", "block").applyInArrow(walk, "file string, block long, seq long, owner long")
    return candidates.join(owners, ["file", "block", "seq"])


def _owned(walked: DataFrame) -> DataFrame:
    """Fills owners that start in an earlier split of the file."""
    last = walked.groupBy("file", "block").agg(F.max("owner").alias("_last"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = last.select("file", "block", F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    return walked.join(before, ["file", "block"]).withColumn("owner", F.coalesce("owner", "_before")).drop("_before")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, block, seq, value of every piece, numbered as in `segments`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seq = None, 0
        for batch in batches:
            numbers = []
            for split in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()):
                key, seq = (key, seq + 1) if split == key else (split, 0)
                numbers.append(seq)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=[*batch.schema.names, "seq"])

    return _raw(spark, path).mapInArrow(run, "file string, block long, value binary, seq long")


def _assembled(spark: SparkSession, path: str, open_: DataFrame, owned: DataFrame) -> DataFrame:
    """file, at, payload_bytes, payload_digest of records whose payload holds the magic: their pieces are read again and put together."""
    parts = owned.join(open_.select("file", F.col("at").alias("owner"), "head", F.col("next").alias("_end")), ["file", "owner"], "left_semi")
    wanted = parts.select("file", "block", "seq", "owner", "at")
    values = _pieces(spark, path).join(wanted, ["file", "block", "seq"])
    whole = values.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("at", F.col("value").cast("string").alias("v")))).alias("_p"))
    text = F.array_join(F.transform("_p", lambda p: p["v"]), MAGIC).cast("binary")
    joined = whole.select("file", F.col("owner").alias("at"), text.alias("data")).join(open_.select("file", "at", "head", "next"), ["file", "at"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, digest = [], []
            for data, head, at, end in zip(*(batch.column(c) for c in ("data", "head", "at", "next"))):
                data, head = data.as_py(), head.as_py()
                block = data[head : end.as_py() - at.as_py() - len(MAGIC) - len(END)]
                payload = _payload(block, _fields(data[:head]))
                size.append(len(payload))
                digest.append(hashlib.sha256(payload).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("at"), pa.array(size, pa.int64()), pa.array(digest, pa.string())],
                names=["file", "at", "_bytes", "_digest"],
            )

    return joined.select("file", "at", "data", "head", "next").mapInArrow(finish, "file string, at long, _bytes long, _digest string")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest (SHA-256 of the payload that was read; of a revisit, what its header says),
    record_type, refers_to for every real record of the archives below `path`, uncompressed and of any size.
    """
    found = cut_lineage(_placed(cut_lineage(segments(spark, path))))
    owned = cut_lineage(_owned(_walked(found, _entries(found))))
    real = owned.where(F.col("owner") == F.col("at"))
    open_ = real.where(F.col("payload_digest").isNull())
    if not open_.isEmpty():
        more = _assembled(spark, path, open_, owned)
        real = real.join(more, ["file", "at"], "left").withColumn("payload_bytes", F.coalesce("payload_bytes", "_bytes")).withColumn(
            "payload_digest", F.coalesce("payload_digest", "_digest")
        )
    return real.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")
