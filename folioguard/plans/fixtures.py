"""The given tables in the shape of scanned documents.

``documents`` become OCR words, page by page; one line by ``doc_id % 16`` is added
to each text, so that every rule has something to find.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_dir

#: The line added to documents, by ``doc_id % 16``.
LINES = [
    "", "IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "Steuer ID 12345678901", "Sozialversicherung 12039012A123", "Dokument Nr L01X00T471",
    "IDD<<L01X00T471<<<<<<<<<<<<<<<", "Unterschrift Mieter", "Rechnungsnummer 12345678901", "Kundennummer 12039012A123", "Dokumentennummer\nL01X00T47",
    "GB82WEST12345698765432 und DE89370400440532013001", "Gehaltsabrechnung Januar Brutto Netto Lohnsteuer Sozialversicherung",
    "SCHUFA BonitätsAuskunft Basisscore Bonitätsinformationen", "BUNDESREPUBLIK DEUTSCHLAND PERS0NALAUSWEIS GEBURTSDATUM", "Arbeitsvertrag Arbeitgeber Probezeit", "",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with the added line."""
    added = F.element_at(F.array(*[F.lit(x) for x in LINES]), F.pmod("doc_id", F.lit(16)).cast("int") + 1)
    return table(spark, sf_dir, "documents").withColumn("text", F.concat("text", F.lit("\n"), added))


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines with a word: (``doc_id``, ``line_num``, ``page_num``, ``line_key``,
    ``line``); 40 of them, blank ones too, are a page."""
    lines = texts(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_num", "line"))
    page = F.floor(F.col("line_num") / 40).cast("int")
    key = F.concat_ws("-", page.cast("string"), F.lit("0"), F.lit("0"), F.col("line_num").cast("string"))
    return lines.where(F.upper("line").rlike("[A-Z0-9]")).select("doc_id", "line_num", page.alias("page_num"), key.alias("line_key"), "line")


def words_of(lines: DataFrame) -> DataFrame:
    """The words of text lines, with the lines' other columns: a line is one of 24
    units."""
    kept = [c for c in lines.columns if c != "line"]
    words = lines.select(*kept, F.posexplode(F.split("line", " ")).alias("word_num", "text"))
    return (
        words.withColumn("normalized", F.regexp_replace(F.upper("text"), "[^A-Z0-9]", ""))
        .where(F.upper("text").rlike("[A-Z0-9]"))  # else nothing is left of it
        .select(
            *[c for c in kept if c != "line_num"], (F.col("line_num").cast("long") * 100000 + F.col("word_num")).alias("word_seq"), "text", "normalized",
            (F.col("word_num") * 60.0).alias("left"), (F.col("line_num") * 24.0).alias("top"), (F.length("text") * 9.0).alias("width"), F.lit(16.0).alias("height"),
            (60 + (F.col("doc_id") * 7 + F.col("word_num") * 3) % 40).cast("double").alias("confidence"),
        )
    )


def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR words: a text line is a line of 24 units, 40 of them a page."""
    return words_of(text_lines(spark, sf_dir))


def line_words(line: Column, n: Column) -> Column:
    """The words of text line ``n`` as ``words_of`` has them, as an array."""

    def word(text: Column, i: Column) -> Column:
        return F.struct(
            (i * 60.0).alias("left"), (n.cast("long") * 100000 + i).alias("word_seq"), text.alias("text"), F.regexp_replace(F.upper(text), "[^A-Z0-9]", "").alias("normalized"), (n * 24.0).alias("top"),
            (F.length(text) * 9.0).alias("width"), F.lit(16.0).alias("height"), (60 + (F.col("doc_id") * 7 + i * 3) % 40).cast("double").alias("confidence"),
        )

    return F.filter(F.transform(F.split(line, " "), word), lambda w: w["normalized"] != "")


def nested_words(lines: DataFrame) -> DataFrame:
    """``words_of`` with the words of each line in one row, as array ``words``."""
    return lines.select(*[c for c in lines.columns if c not in ("line", "line_num")], line_words(F.col("line"), F.col("line_num")).alias("words"))


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ocr_words`` by line.  A document's text is one row, so no shuffle is needed to
    put the words of a line together."""
    return nested_words(text_lines(spark, sf_dir))


def slot_of(number) -> F.Column:
    from ..rules import SLOTS

    return F.element_at(F.array(*[F.lit(s) for s in SLOTS], F.lit(None).cast("string")), number.cast("int") + 1)


def folder_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders are sources; labelled documents have a slot that a user chose."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    types = F.array(F.lit("application/pdf"), F.lit("image/jpeg"), F.lit(None).cast("string"))
    return docs.join(labels, "doc_id", "left").select(
        F.col("source").alias("folder_id"), F.col("doc_id").alias("id"), F.format_string("doc-%d.pdf", F.col("doc_id") % 40).alias("name"), F.col("n_chars").alias("size"),
        F.element_at(types, (F.col("doc_id") % 3).cast("int") + 1).alias("type"),
        F.when(F.col("quality").isNotNull(), slot_of((F.col("quality") * 2 + F.col("toxic") + F.col("doc_id")) % 6)).alias("slot"),
    )


def scan_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh document has no state yet."""
    status = F.element_at(F.array(*[F.lit(s) for s in ("done", "done", "done", "loading", "idle", "error")]), (F.col("doc_id") % 7).cast("int") + 1)
    docs = table(spark, sf_dir, "documents").where("doc_id % 7 < 6")
    return docs.select(F.col("source").alias("folder_id"), "doc_id", status.alias("status"), (F.col("doc_id") % 10 / 10.0).alias("progress"))


def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each document; folders with an even number have a cover."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("source").alias("folder_id"), F.col("doc_id").alias("id"), F.format_string("doc-%d.pdf", F.col("doc_id") % 40).alias("name"), F.col("doc_id").alias("ord"),
        (1 + F.col("n_chars") / 3000.0).alias("page_count"), (F.length("source") % 2 == 0).alias("include_cover"),
    )


def draft_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as draft versions; ``error`` events delete a draft."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("title"), F.get_json_object("props", "$.k").alias("address"),
        F.col("ts").alias("updated_at"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("deleted"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as measured camera frames of a session per user."""
    e = table(spark, sf_dir, "events")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    d = (F.col("event_id") % 10) / 200.0
    corners = F.struct(
        point(0.1 + d, 0.1 + d).alias("top_left"), point(0.9 - d, 0.1 + d).alias("top_right"), point(0.9 - d, 0.9 - d).alias("bottom_right"), point(0.1 + d, 0.9 - d).alias("bottom_left")
    )
    return e.select(
        F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("frame_no"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("document_detected"),
        F.col("value").alias("movement"), corners.alias("corners"),
    )


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 by 8 grey images: each of the 64 numbers, from -0.5 to 0.5,
    becomes a pixel from 0 to 255."""
    e = table(spark, sf_dir, "embeddings")
    grey = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 0.5) * 255).cast("int"))))
    return e.select(F.col("vec_id").alias("image_id"), F.col("label").alias("burst"), F.lit(8).alias("width"), F.lit(8).alias("height"), grey.alias("grey"))


#: Pixels of a side of a page image; each grey number is a square of an eighth of it.
SIDE = 64


def png(rgb: np.ndarray) -> bytes:
    """A PNG file of (height, width, 3)."""
    height, width, _ = rgb.shape
    rows = np.concatenate([np.zeros((height, 1), np.uint8), rgb.reshape(height, -1)], axis=1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 1)) + chunk(b"IEND", b"")


def _page_files(grey: Column, left: Column, right: Column, top: Column, bottom: Column) -> Column:
    """PNG files of dark noise with a bright, slightly yellow page on it."""

    @F.arrow_udf("binary")
    def run(grey: pa.Array, left: pa.Array, right: pa.Array, top: pa.Array, bottom: pa.Array) -> pa.Array:
        out = []
        for g, a, b, c, d in zip(*[x.to_pylist() for x in (grey, left, right, top, bottom)], strict=True):
            dark = np.kron(np.array(g, np.int64).reshape(8, 8) // 4, np.ones((SIDE // 8, SIDE // 8), np.int64))
            dark[c:d, a:b] += 160
            out.append(png(np.stack([dark, dark, np.maximum(0, dark - 30)], axis=2).astype(np.uint8)))
        return pa.array(out, pa.binary())

    return run(grey, left, right, top, bottom)


def page_images(spark: SparkSession, sf_dir: str) -> str:
    """A folder of PNG files, one of each embedding: ``image=<id>/part-...``.  The
    page in it is of a place and size by the id, at times too small for a paper."""
    n = F.col("image_id")
    edges = {"left": n % 5 * 3, "right": 64 - n % 7 * 5, "top": n % 3 * 4, "bottom": 64 - n % 4 * 12}
    files = rasters(spark, sf_dir).select(n.alias("image"), _page_files(F.col("grey"), *[e.cast("int") for e in edges.values()]).cast("string").alias("value"))
    path = scratch_dir(spark, "images")
    # Text files of these very bytes, with a line break that decoders do not read.
    files.sortWithinPartitions("image").write.partitionBy("image").text(path)
    return path


def scanned_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page images, read back and decoded by Spark."""
    from ..sources.images import read_images

    images = read_images(spark, page_images(spark, sf_dir))
    return images.select(F.regexp_extract("path", "image=([0-9]+)", 1).cast("long").alias("image_id"), "width", "height", "channels", "pixels")
