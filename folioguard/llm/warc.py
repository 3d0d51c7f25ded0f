"""WARC archives: writing with payload deduplication, and reading back.

Spark cuts archives into splits, and each split at the places that look like the
start of a record.  Tasks emit, for every such place, the place of the record that
would follow.  Pointer jumping from the file's start over those links, across
splits, keeps what is reachable; record headers inside payloads are reached by no
chain and are rejected.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch_dir, settle, small_batches

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Candidates of one range of a split, whose links a task follows itself.
RANGE_CANDIDATES = 4096

BASE32_HEX = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_sha1(hex_digest: Column) -> Column:
    """Bare upper-case base32 of a 40-digit hex string: 20 bits at a time."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), BASE32_HEX, BASE32)


def plan_records(pages: DataFrame, *, page_id: str = "page_id", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """(``digest``, ``bytes``, ``winner``) of payloads that several pages share.

    ``winner`` is the largest page id.  A null payload is an empty one.  Only
    payloads of at least ``min_bytes`` are here.
    """
    body = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit(""))
    return (
        pages.select(F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).cast("long").alias("bytes"), F.col(f"`{page_id}`").alias("id"))
        .where(F.col("bytes") >= min_bytes)
        .groupBy("digest", "bytes")
        .agg(F.max("id").alias("winner"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )


def write_archives(
    pages: DataFrame,
    path: str,
    *,
    page_id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    min_bytes: int = 0,
    records_per_file: int = 0,
) -> None:
    """Write one WARC record per row of ``pages`` into files below ``path``.

    Of rows with equal payloads of at least ``min_bytes`` bytes, the one with
    the largest page id is written as response (all of them, if it repeats), the
    others as revisit records without payload.  Null payloads are empty, null
    urls are empty; a null page id is left out of the record, and loses to any
    other.  Line breaks in a url become ``%0D`` and ``%0A``.  Other columns are
    not written.  ``records_per_file`` of 0 sets no limit.  Spark's text writer ends each record, so its commit protocol
    guards the files against lost executors.
    """
    body = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit(""))
    rows = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("id"),
        F.replace(F.replace(F.coalesce(F.col(f"`{url}`"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("url"),
        body.alias("body"),
        F.sha1(body.cast("binary")).alias("digest"),
        F.octet_length(body).cast("long").alias("bytes"),
    )
    shared = settle(plan_records(pages, page_id=page_id, payload=payload, min_bytes=min_bytes), "warc-shared")
    rows = rows.join(shared.withColumn("shared", F.lit(True)), ["digest", "bytes"], "left")
    revisit = F.coalesce(F.col("shared"), F.lit(False)) & ~F.col("id").eqNullSafe(F.col("winner"))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))

    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF)
    )
    block = F.when(revisit, F.lit("")).otherwise(F.concat(http, F.col("body")))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", kind),
        F.lit("WARC-Record-ID: <urn:uuid:"), F.uuid(F.lit(7)), F.lit(f">{CRLF}WARC-Date: {DATE}{CRLF}"),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_sha1(F.col("digest")))),
        line("X-Payload-Length", F.col("bytes")),
        line("X-Page-ID", F.col("id")),
        line("X-Refers-To-Page-ID", F.when(revisit, F.col("winner"))),
        F.when(revisit, F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}")).otherwise(F.lit("")),
        F.when(revisit, F.lit("")).otherwise(F.lit(f"Content-Type: application/http; msgtype=response{CRLF}")),
        line("Content-Length", F.octet_length("block")),
        F.lit(CRLF),
        F.col("block"),
    )
    (
        rows.withColumn("block", block)
        .select(record.alias("value"))
        .write.option("lineSep", CRLF + CRLF)
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


#: Ends a record, and starts one.
MAGIC = b"WARC/1."
END = b"\r\n\r\n"
#: Where Spark's reader cuts files: at the last byte of ``END`` and the magic.  It does
#: not look back over its buffer, so a separator whose start repeats, as that of all of
#: ``END`` does, is missed there behind further line breaks.
BREAK = END[-1:] + MAGIC
FIELD = re.compile(rb"([^\r\n:]+): ?([^\r\n]*)(?:\r\n|$)")
VERSION = re.compile(rb"[01]\r\n")

RECORD = "page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, intact boolean"
SCANNED = (
    "path string, block long, range long, file_size long, at long, size long, next long, exit long, enter long, leave long, "
    f"inside boolean, open boolean, {RECORD}"
)
JOINED = f"path string, offset long, {RECORD}"
RECORD_COLUMNS = [c.split()[0] for c in RECORD.split(", ")]


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def parse_head(text: bytes) -> tuple[dict[bytes, bytes], int, int] | None:
    """(fields, where the block starts, its length) of the candidate whose bytes
    behind the magic are ``text``; None if that is no record header.  The last line
    break of the header may lead the next piece."""
    if not VERSION.match(text):
        return None
    end = text.find(END)
    if end < 0:
        if not text.endswith(END[:-1]):
            return None
        end = len(text) - len(END[:-1])
    fields = {k.lower(): v for k, v in FIELD.findall(text, 3, end)}
    length = fields.get(b"content-length", b"")
    return (fields, end + len(END), int(length)) if length.isdigit() else None


def describe(fields: dict[bytes, bytes], block: bytes) -> tuple:
    """The columns of ``RECORD``."""
    kind = fields.get(b"warc-type", b"").decode("utf-8", "replace")
    stated = fields.get(b"warc-payload-digest", b"").rpartition(b":")[2].decode("ascii", "replace")
    number = lambda k: int(v) if (v := fields.get(k)) and v.lstrip(b"-").isdigit() else None
    size, digest, intact = number(b"x-payload-length"), stated, True
    if kind != "revisit":
        body = 0
        if fields.get(b"content-type", b"").startswith(b"application/http"):
            body = block.find(END)
            body = len(block) if body < 0 else body + len(END)
        size = len(block) - body
        digest = base64.b32encode(hashlib.sha1(memoryview(block)[body:]).digest()).decode()
        intact = not stated or stated == digest
    return number(b"x-page-id"), kind, number(b"x-refers-to-page-id"), fields.get(b"warc-target-uri", b"").decode("utf-8", "replace"), size, digest, intact


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, bytes, bool]]:
    """(path, block, file size, at, text, led by a magic) of the pieces of splits,
    in order.  ``at`` is the place behind the magic, counted from where the pieces
    of this split begin."""
    here, at, ended = None, 0, False
    for batch in batches:
        for path, block, size, value in zip(*batch.columns, strict=True):
            path, block, text = path.as_py(), block.as_py(), value.as_py()
            if (path, block) != here:
                here, at, ended = (path, block), 0, block > 0  # what ends before a later split is not seen here
            start, span, led, ended = at, len(text) + len(BREAK), ended, text.endswith(END[:-1])
            if not led and text.startswith(MAGIC):
                start, text, led = len(MAGIC), text[len(MAGIC) :], True
            yield path, block, size.as_py(), start, text, led
            at += span


def candidate(at: int, text: bytes, led: bool) -> tuple:
    """(size, next, inside, open, ...) of a piece.

    ``next`` is the place of the successor.  ``inside``: the record ends in this
    piece, and its columns follow; ``open``: that takes the line break which leads
    the next piece.  Both are null where no record can be.
    """
    nothing = (len(text), None, None, None, *[None] * len(RECORD_COLUMNS))
    if not led or (head := parse_head(text)) is None:
        return nothing
    fields, start, length = head
    stop = start + length
    after = at + stop + len(END)
    if stop > len(text):
        return len(text), after, False, None, *[None] * len(RECORD_COLUMNS)
    rest = text[stop : stop + len(END)]
    if rest not in (END, END[:-1]):
        return nothing
    return len(text), after, True, rest != END, *describe(fields, text[start:stop])


def numbered(ats: list[int], after: list[int | None]) -> list[tuple[int | None, int, int]]:
    """(exit, enter, leave) of the candidates of one range, in order.

    ``exit``: the first place outside the range on the candidate's chain of
    successors.  ``enter`` and ``leave`` number the candidates as a forest in which
    a record's parent is its successor: a record lies on the chain of another
    exactly if its interval holds the other's ``enter``.
    """
    index = {at: i for i, at in enumerate(ats)}
    parent = [index.get(a) for a in after]
    count = [1] * len(ats)
    for i, p in enumerate(parent):  # successors lie behind
        if p is not None:
            count[p] += count[i]
    out: list = [None] * len(ats)
    free, place = 0, [0] * len(ats)
    for i in reversed(range(len(ats))):
        p = parent[i]
        if p is None:
            enter, free, leaves = free, free + count[i], after[i]
        else:
            enter, leaves = place[p], out[p][0]
            place[p] += count[i]
        place[i] = enter + 1
        out[i] = (leaves, enter, enter + count[i])
    return out


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidates of splits, range by range: rows of ``SCANNED``."""
    schema = arrow_schema(SCANNED)

    def flush(key: tuple, rows: list[tuple]) -> pa.RecordBatch:
        # Places of magics, before the text of a piece.
        chains = numbered([r[0] - len(MAGIC) for r in rows], [r[2] for r in rows])
        made = [(*key, r[0], r[1], r[2], *c, *r[3:]) for r, c in zip(rows, chains, strict=True)]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)

    key, rows = None, []
    for path, block, size, at, text, led in pieces(batches):
        if rows and (key[:2] != (path, block) or len(rows) == RANGE_CANDIDATES):
            yield flush(key, rows)
            rows = []
        if not rows:
            key = (path, block, at, size)
        rows.append((at, *candidate(at, text, led)))
    if rows:
        yield flush(key, rows)


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces with their text, a few MB at a time."""
    schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("text", pa.binary())])
    rows, held = [], 0
    for path, block, _, at, text, _ in pieces(batches):
        rows.append((path, block, at, text))
        held += len(text)
        if held >= 4 << 20 or len(rows) == RANGE_CANDIDATES:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows, held = [], 0
    if rows:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from their pieces, which follow each other: one at a time."""
    schema = arrow_schema(JOINED)

    def made(key: tuple, content: bytearray) -> Iterator[pa.RecordBatch]:
        fields, start, length = parse_head(bytes(content))
        if content[start + length : start + length + len(END)] == END:
            row = (*key, *describe(fields, bytes(content[start : start + length])))
            yield pa.record_batch([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    key, content = None, bytearray()
    for batch in batches:
        for path, offset, text in zip(*batch.columns, strict=True):
            if (path.as_py(), offset.as_py()) != key:
                if key:
                    yield from made(key, content + END[-1:])
                key, content = (path.as_py(), offset.as_py()), bytearray()
            else:
                content += BREAK
            content += text.as_py()
    if key:
        yield from made(key, content + END[-1:])


def _scan_splits(spark: SparkSession, path: str) -> DataFrame:
    """The pieces between record starts, in the splits that Spark makes of files."""
    lines = spark.read.option("lineSep", BREAK.decode()).option("recursiveFileLookup", True).text(path)
    return lines.select("_metadata.file_path", F.col("_metadata.file_block_start").alias("block"), "_metadata.file_size", F.col("value").cast("binary").alias("value"))


def read_archives(spark: SparkSession, path: str, *, range_bytes: int | None = None) -> DataFrame:
    """The records of all archives below ``path``: ``path``, ``offset``,
    ``page_id``, ``record_type``, ``refers_to``, ``url``, ``payload_bytes``,
    ``payload_digest`` and ``intact`` (the stated digest holds).

    Archives are not compressed; any size is read by many tasks, in splits of
    ``range_bytes`` (``spark.sql.files.maxPartitionBytes`` if that is None).  A
    task holds one piece between candidates, and where a record has several, its
    whole.  A record that is cut off ends the chain of its file: records behind it
    are not returned.  A record is returned if line breaks end it, whatever
    follows.  No archives give no rows.
    """
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    small_batches(spark)
    if range_bytes:
        spark.conf.set(name, str(range_bytes))
    try:
        return _read(spark, path)
    finally:
        spark.conf.set(name, before)


def _read(spark: SparkSession, path: str) -> DataFrame:
    local = settle(_scan_splits(spark, path).mapInArrow(scan, SCANNED), "warc-scan")
    # Pieces of a split begin where those of the splits before it end.
    spans = local.groupBy("path", "block").agg(F.sum(F.col("size") + len(BREAK)).alias("span"), F.min(F.when(F.col("block") == 0, F.col("at"))).alias("led"))
    spans = spans.withColumn("span", F.col("span") + F.coalesce("led", F.lit(0)))
    blocks = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = spans.select("path", "block", F.coalesce(F.sum("span").over(blocks), F.lit(0)).alias("start"))
    found = local.join(starts, ["path", "block"]).withColumn("offset", F.col("start") + F.col("at") - len(MAGIC))
    found = found.withColumn("next", F.col("start") + F.col("next")).withColumn("exit", F.col("start") + F.col("exit"))
    ends = F.col("offset") + len(MAGIC) + F.col("size")
    found = found.withColumn("whole", (F.col("next") <= F.col("file_size")) & (~F.coalesce("open", F.lit(False)) | (ends < F.col("file_size"))))
    found = settle(found, "warc-found")

    first = found.where("offset = 0").select("path", F.col("offset").alias("at"))
    entries = first.unionByName(found.where("exit is not null").select("path", F.col("exit").alias("at"))).distinct()
    jump = found.where("exit is not null").join(entries.withColumnRenamed("at", "offset"), ["path", "offset"], "left_semi")
    jump = settle(jump.select("path", F.col("offset").alias("at"), F.col("exit").alias("to")), "warc-jump")
    ranges = found.select("path", "block", "range").distinct()
    most = ranges.groupBy("path").count().agg(F.max("count")).first()[0] or 0
    reached, step = first, 1
    while step < most:
        ahead = reached.join(jump, ["path", "at"]).select("path", F.col("to").alias("at"))
        reached = settle(reached.unionByName(ahead).distinct(), "warc-reached")
        nxt = jump.select("path", F.col("at").alias("to"), F.col("to").alias("then"))
        jump = settle(jump.join(nxt, ["path", "to"]).select("path", "at", F.col("then").alias("to")), "warc-jump")
        step *= 2
    # A chain enters a range at one place.
    chains = found.join(reached.withColumnRenamed("at", "offset"), ["path", "offset"]).select("path", "block", "range", F.col("enter").alias("from"))
    on_chain = F.coalesce((F.col("enter") <= F.col("from")) & (F.col("from") < F.col("leave")), F.lit(False))
    marked = found.join(chains, ["path", "block", "range"], "left").withColumn("chained", on_chain)
    records = marked.where("chained and inside and whole").select("path", "offset", *RECORD_COLUMNS)

    # Records of several pieces: each piece goes to the last record before it.
    rest = settle(marked.select("path", "block", "range", "at", "offset", "next", F.when(F.col("chained"), F.struct("offset", "next", (~F.col("inside") & F.col("whole")).alias("long"))).alias("owner")), "warc-owners")
    owned = W.partitionBy("path", "block", "range").orderBy("offset")
    carried = rest.groupBy("path", "block", "range").agg(F.max("owner").alias("owner"))
    carried = carried.select("path", "block", "range", F.max("owner").over(W.partitionBy("path").orderBy("block", "range").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    rest = rest.withColumn("owner", F.last("owner", ignorenulls=True).over(owned)).join(carried, ["path", "block", "range"]).withColumn("owner", F.coalesce("owner", "carried"))
    need = settle(rest.where("owner.long and offset < owner.next").select("path", "block", "at", F.col("owner.offset").alias("owner"), "offset"), "warc-need")
    if need.isEmpty():
        return records
    texts = _scan_splits(spark, path).mapInArrow(texts_of, "path string, block long, at long, text binary").join(need, ["path", "block", "at"])
    ordered = texts.repartition("path", "owner").sortWithinPartitions("path", "owner", "offset").select("path", F.col("owner").alias("offset"), "text")
    return records.unionByName(settle(ordered.mapInArrow(joined, JOINED), "warc-long"))


def archive_round_trip(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as WARC archives to the shared scratch folder and read
    them back, as :func:`write_archives` and :func:`read_archives` do."""
    path = scratch_dir(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes=min_bytes)
    return read_archives(pages.sparkSession, path)
