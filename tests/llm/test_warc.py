"""WARC archives: round trips, planted headers, deduplication, broken files."""

import base64
import hashlib
import os
import random
import tempfile

from pyspark.sql import functions as F

from folioguard.llm.warc import archive_round_trip, candidate, parse_head, read_archives, write_archives

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nX-Page-ID: 666\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def want(pages):
    out = []
    for i, _, html in pages:
        ids = [j for j, _, h in pages if (h or "") == (html or "")]
        best = max([j for j in ids if j is not None], default=None)
        out.append((i, len((html or "").encode()), digest(html), *(("response", None) if i == best else ("revisit", best))))
    return sorted(out, key=repr)


def seen(df):
    rows = df.collect()
    assert all(r["intact"] for r in rows)
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=repr)


def frame(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    return df.withColumn("digest", F.lit("theirs")).withColumn("winner", F.lit(1)).withColumn("bytes", F.lit(1))


PAGES = [
    (1, "http://a", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (3, None, None), (4, "http://x\r\ny", ""), (5, "u", FAKE * 3), (6, "u", "WARC/1.1\r\n"),
    (7, "u", "\r\n\r\n" + FAKE), (None, "u", "no id"), (8, "u", "x" * 3_000_000), (9, "u", "tail"), (9, "u", "tail"), (10, "u", "tail"), (11, "u", "🙂\n\nlines"),
]


def test_round_trip(spark):
    assert seen(archive_round_trip(frame(spark, PAGES).coalesce(1))) == want(PAGES)
    assert archive_round_trip(frame(spark, PAGES).limit(0)).collect() == []


def test_small_ranges_and_many_files(spark):
    pages = [(i, "u", FAKE * (i % 3) + "y" * (i * 37 % 500)) for i in range(300)]
    path = "file://" + tempfile.mkdtemp(prefix="spark-") + "/w"
    write_archives(frame(spark, pages).coalesce(1), path, records_per_file=120)
    for size in (4_000, 1 << 20):  # a range is a task of its own
        assert seen(read_archives(spark, path, range_bytes=size)) == want(pages)


def test_payloads_that_end_with_line_breaks(spark):
    """An archive of many 64 KB buffers of the reader, some of which end within the line
    breaks before a record."""
    draw = random.Random(1)
    pages = [(i, "u", f"{i}" + "y" * draw.randint(0, 300) + "\r\n" * draw.randint(0, 4)) for i in range(6000)]
    assert seen(archive_round_trip(frame(spark, pages).coalesce(1))) == want(pages)


def test_record_starts_in_payloads_at_any_split(spark):
    starts = ["\nWARC/1.", "\r\nWARC/1.1\r\n", "\r\n\r\nWARC/1.", "WARC/1.1\r\n\r\n", "\r\n\r", "\n", FAKE]
    pages = [(i, "u", a + "z" * (i % 7) + b) for i, (a, b) in enumerate((a, b) for a in starts for b in starts)]
    path = "file://" + tempfile.mkdtemp(prefix="spark-") + "/w"
    write_archives(frame(spark, pages).coalesce(1), path)
    for size in (2_011, 1 << 20):
        assert seen(read_archives(spark, path, range_bytes=size)) == want(pages)


def test_minimum_size_of_revisits(spark):
    pages = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    got = {r["page_id"]: r["record_type"] for r in archive_round_trip(frame(spark, pages), min_bytes=5).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_planted_chain_and_cut_file(spark):
    record = lambda i, body: f"WARC/1.1\r\nWARC-Type: response\r\nX-Page-ID: {i}\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"
    path = tempfile.mkdtemp(prefix="spark-")
    with open(os.path.join(path, "a.warc"), "w", newline="") as f:
        f.write(record(1, record(100, "in") + record(101, "in")) + record(2, "two") + record(3, "three")[:-5])
    got = {r["page_id"] for r in read_archives(spark, f"file://{path}", range_bytes=64).collect()}
    assert got == {1, 2}
    assert parse_head(b"no records at all") is None
    assert candidate(0, b"no records at all", True)[:3] == (17, None, None)
