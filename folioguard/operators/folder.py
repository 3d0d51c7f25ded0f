"""Folders: slots, admission, order, completeness, page plans, progress, export.

A folder may hold a third of all documents, so nothing collects one: counts are
aggregated before they meet.  The order-dependent assignment is in ``assign``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import half_up, page_label
from ..rules import MULTI, OTHER, SLOTS, SURE, TYPE_TO_SLOT
from ..sources.scratch import settle
from .assign import assign_slots

#: Folders are cut at multiples of two to this power of their order.
RANGE_BITS = 16


def slot_order(slot: Column, slots=SLOTS) -> Column:
    """The slot's place, unassigned last."""
    out = F.lit(len(slots))
    for i, s in enumerate(slots):
        out = F.when(slot == s, i).otherwise(out)
    return out


def slot_of_type(kind: Column, table=TYPE_TO_SLOT) -> Column:
    """The slot of a document type; null without one."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), kind)


def is_multi(slot: Column, multi=MULTI) -> Column:
    return F.coalesce(slot.isin(*multi), F.lit(False))


def review_assignment(expected: Column, kind: Column, confidence: Column, least: int = SURE) -> Column:
    """struct(status, detected_slot, message) of a chosen slot against a
    classification."""
    slot = slot_of_type(kind)

    def made(status: str, detected: Column, message: Column) -> Column:
        return F.struct(F.lit(status).alias("status"), detected.cast("string").alias("detected_slot"), message.alias("message"))

    unsure = expected.isNull() | (expected == "") | kind.isNull() | confidence.isNull() | (confidence < least)
    return (
        F.when(unsure, made("uncertain", F.lit(None), F.lit("Die Zuordnung konnte noch nicht sicher verglichen werden.")))
        .when(slot.isNull(), made("uncertain", F.lit(None), F.concat(kind, F.lit(" ist keiner Pflichtkategorie eindeutig zugeordnet."))))
        .when(slot != expected, made("mismatch", slot, F.concat(F.lit("Unter „"), expected, F.lit("“ abgelegt, aber als „"), kind, F.lit("“ erkannt. Bitte prüfen."))))
        .otherwise(made("match", slot, F.concat(kind, F.lit(" passt zur Kategorie „"), expected, F.lit("“."))))
    )


def completeness(documents: DataFrame, slots=SLOTS) -> DataFrame:
    """``completed``, ``total``, ``percent`` and ``missing`` (in order) by folder."""
    present = documents.groupBy("folder_id").agg(F.array_sort(F.collect_set("slot")).alias("present"))
    return present.select("folder_id", *completeness_of(F.col("present"), slots))


def completeness_of(present: Column, slots=SLOTS) -> list[Column]:
    """The same from an array of the slots of a folder's documents."""
    filled = F.array_distinct(F.filter(present, lambda s: s.isNotNull()))
    done, missing = F.size(filled), F.array_except(F.array(*[F.lit(s) for s in slots]), filled)
    return [done.alias("completed"), F.lit(len(slots)).alias("total"), half_up(done * 100.0 / len(slots)).cast("int").alias("percent"), missing.alias("missing")]


def slot_coverage(documents: DataFrame, slots=SLOTS) -> DataFrame:
    """For each folder and required slot: documents assigned, the first by order
    and name, and whether the slot is missing."""
    order = F.struct(F.collate("name", "de").alias("sorted"), "id")
    counts = documents.groupBy("folder_id", "slot").agg(F.count(F.lit(1)).alias("n"), F.min_by("name", order).alias("first_name"))
    grid = documents.select("folder_id").distinct().select("folder_id", F.posexplode(F.array(*[F.lit(s) for s in slots])).alias("slot_ord", "slot"))
    return grid.join(counts, ["folder_id", "slot"], "left").select(
        "folder_id", "slot", "slot_ord", F.coalesce("n", F.lit(0)).alias("n"), "first_name", F.col("n").isNull().alias("missing")
    )


def sort_order() -> list[Column]:
    """Slot, then name in German order, then id."""
    return [slot_order(F.col("slot")), F.collate(F.col("name"), "de"), F.col("id")]


def positions(documents: DataFrame) -> DataFrame:
    """``documents`` with ``position`` from 1 in their sorted folder.

    Documents are sorted in ranges of (folder, slot, name, id), split where a sample
    says, so a slot of any size is in many tasks: each is ranked within its folder
    and range, and the numbers in earlier ranges are added.
    """
    sort = documents.withColumn("__slot", slot_order(F.col("slot"))).withColumn("__name", F.collate("name", "de"))
    ranged = settle(sort.repartitionByRange("folder_id", "__slot", "__name", "id").drop("__name").withColumn("__part", F.spark_partition_id()), "folder-order")
    place = F.row_number().over(W.partitionBy("folder_id", "__part").orderBy("__slot", F.collate("name", "de"), "id"))
    counts = ranged.groupBy(F.col("folder_id").alias("__f"), F.col("__part").alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    below = F.sum("__n").over(W.partitionBy("__f").orderBy("__p").rowsBetween(W.unboundedPreceding, -1))
    before = counts.select("__f", "__p", F.coalesce(below, F.lit(0)).alias("__before"))
    placed = ranged.withColumn("__place", place).join(before, F.col("folder_id").eqNullSafe(F.col("__f")) & (F.col("__part") == F.col("__p")))
    return placed.withColumn("position", F.col("__before") + F.col("__place")).select(*documents.columns, "position")


def confirmed(slot: Column, status: Column, kind: Column, confidence: Column, least: int = SURE) -> Column:
    """Scanned, surely typed, and in the slot of its type."""
    return F.coalesce((status == "done") & (confidence >= least) & (slot_of_type(kind) == slot), F.lit(False))


def _sums_before(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``rows`` (``folder_id``, ``ord``, ``id``) with ``name``: the sum of
    ``value`` over earlier rows of the folder.

    Folders are cut at ranges of ``ord``: only the sums of ranges are added up
    over a folder.  Null ``ord`` come first.
    """
    ranges = F.coalesce(F.shiftright(F.col("ord").cast("long"), RANGE_BITS), F.lit(-(1 << 63)))
    cut = rows.withColumn("__range", ranges).withColumn("__value", value.cast("long"))
    inside = F.sum("__value").over(W.partitionBy("folder_id", "__range").orderBy("ord", "id").rowsBetween(W.unboundedPreceding, -1))
    sums = cut.groupBy(F.col("folder_id").alias("__f"), F.col("__range").alias("__r")).agg(F.sum("__value").alias("__sum"))
    below = F.sum("__sum").over(W.partitionBy("__f").orderBy("__r").rowsBetween(W.unboundedPreceding, -1))
    starts = sums.select("__f", "__r", F.coalesce(below, F.lit(0)).alias("__below"))
    placed = cut.withColumn("__inside", F.coalesce(inside, F.lit(0)))
    joined = placed.join(starts, F.col("folder_id").eqNullSafe(F.col("__f")) & (F.col("__range") == F.col("__r")))
    return joined.withColumn(name, F.col("__below") + F.col("__inside")).drop("__range", "__value", "__f", "__r", "__below", "__inside")


def page_plan(items: DataFrame) -> DataFrame:
    """``items`` (``folder_id``, ``id``, ``ord``, ``page_count``,
    ``include_cover``) with whole page counts of at least 1, ``start_page``,
    ``end_page`` and ``page_label``; a cover is page 1."""
    count = F.greatest(F.lit(1), F.coalesce(F.floor(F.col("page_count")), F.lit(1))).cast("long")
    counted = _sums_before(items.withColumn("page_count", count), F.col("page_count"), "__before")
    start = F.col("__before") + F.when(F.col("include_cover"), 2).otherwise(1)
    planned = counted.withColumn("start_page", start).withColumn("end_page", F.col("start_page") + F.col("page_count") - 1).drop("__before")
    return planned.withColumn("page_label", page_label(F.col("start_page"), F.col("end_page")))


def contents_rows(plan: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows of the table of contents: number, slot, name and pages."""
    docs = documents.select("folder_id", "id", "slot")
    listed = _sums_before(plan.join(docs, ["folder_id", "id"], "left"), F.lit(1), "number").withColumn("number", F.col("number") + 1)
    return listed.select("folder_id", "id", "number", "slot", "name", "page_label")


def page_tops(pages: DataFrame) -> DataFrame:
    """``pages`` (``doc_id``, ``page_no``, ``width``, ``height``) with ``top`` in
    the stacked composite."""
    before = F.sum("height").over(W.partitionBy("doc_id").orderBy("page_no").rowsBetween(W.unboundedPreceding, -1))
    return pages.withColumn("top", F.coalesce(before, F.lit(0.0)))


def composite_sizes(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.max("width").alias("width"), F.sum("height").alias("height"), F.count(F.lit(1)).alias("n_pages"))


def pending_documents(documents: DataFrame, states: DataFrame) -> DataFrame:
    """Documents that are not ``done``, or have no state."""
    return documents.join(states.where("status = 'done'").select("folder_id", F.col("doc_id").alias("id")), ["folder_id", "id"], "left_anti")


def _with_states(documents: DataFrame, states: DataFrame) -> DataFrame:
    return documents.select("folder_id", "id").join(states.select("folder_id", F.col("doc_id").alias("id"), "status", "progress"), ["folder_id", "id"], "left")


def batch_progress(documents: DataFrame, states: DataFrame) -> DataFrame:
    """``completed``, ``total`` and ``percent`` by folder."""
    done = F.coalesce(F.col("status") == "done", F.lit(False))
    part = F.when(done, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("progress", F.lit(0.0)))))
    return _with_states(documents, states).groupBy("folder_id").agg(
        F.count_if(done).alias("completed"), F.count(F.lit(1)).alias("total"), half_up(F.sum(part) / F.count(F.lit(1)) * 100).cast("int").alias("percent")
    )


def export_readiness(folders: DataFrame, documents: DataFrame, states: DataFrame) -> DataFrame:
    """(``folder_id``, ``ready``): at least one document, and all done."""
    done = _with_states(documents, states).groupBy("folder_id").agg(F.bool_and(F.coalesce(F.col("status") == "done", F.lit(False))).alias("ready"))
    return folders.select("folder_id").join(done, "folder_id", "left").select("folder_id", F.coalesce("ready", F.lit(False)).alias("ready"))


def export_gate(folders: DataFrame, documents: DataFrame) -> DataFrame:
    """``allowed`` and ``reason`` by folder (``include_cover``,
    ``applicant_name``); documents have ``status`` and ``rendered``."""
    good = F.coalesce((F.col("status") == "done") & F.col("rendered"), F.lit(False))
    counts = documents.groupBy("folder_id").agg(F.count_if(good).alias("good"), F.count(F.lit(1)).alias("n"))
    none, some = F.coalesce("good", F.lit(0)) == 0, F.col("good") != F.col("n")
    nameless = F.col("include_cover") & (F.trim(F.coalesce("applicant_name", F.lit(""))) == "")
    reason = F.when(none, "nothing to export").when(some, "unchecked documents").when(nameless, "name missing")
    return folders.join(counts, "folder_id", "left").select("folder_id", reason.isNull().alias("allowed"), reason.alias("reason"))


def scan_report(documents: DataFrame, states: DataFrame, types: DataFrame, pages: DataFrame, hits: DataFrame) -> DataFrame:
    """The status text of each document, from its type, pages and hits."""
    joined = _with_states(documents, states).join(types, "id", "left").join(pages, "id", "left").join(hits, "id", "left")
    done = F.concat(
        F.coalesce("type", F.lit(OTHER)), F.lit(" · "), F.coalesce("n_pages", F.lit(1)).cast("string"), F.lit(" Seite(n) · "), F.coalesce("n_hits", F.lit(0)).cast("string"), F.lit(" Treffer")
    )
    loading = F.concat(F.lit("Smart Scan "), F.greatest(F.lit(1), half_up(F.coalesce("progress", F.lit(0.0)) * 100)).cast("string"), F.lit("%"))
    text = F.when(F.col("status") == "done", done).when(F.col("status") == "loading", loading).when(F.col("status") == "error", "Prüfung fehlgeschlagen").otherwise("Noch nicht geprüft")
    return joined.select("folder_id", "id", text.alias("report"))


def bundles(slot: Column, n_files: Column) -> Column:
    """Whether a selection becomes one document of several pages."""
    return slot.isNotNull() & (slot != "") & ~is_multi(slot) & (n_files > 1)


def admit_files(selection: DataFrame, documents: DataFrame) -> DataFrame:
    """``selection`` (``folder_id``, ``slot``, ``idx``, ``name``, ``size``,
    ``type``) with ``outcome``: ``slot occupied``, ``bundled``, ``duplicate``,
    ``repeated`` or ``accepted``.

    An occupied single slot refuses all; several files for a single slot are
    bundled, so that none is ever refused for being the second of its slot; else a
    file is compared with the folder and with the files before it by (name, size,
    type).
    """
    files = selection.withColumn("type", F.coalesce("type", F.lit("")))
    taken = documents.where(F.col("slot").isNotNull() & ~is_multi(F.col("slot"))).select("folder_id", "slot").distinct().withColumn("taken", F.lit(True))
    have = documents.select("folder_id", "name", "size", F.coalesce("type", F.lit("")).alias("type")).distinct().withColumn("have", F.lit(True))
    counts = files.groupBy("folder_id", F.col("slot").alias("chosen")).agg(F.count(F.lit(1)).alias("n_files"))
    first = F.row_number().over(W.partitionBy("folder_id", "slot", "name", "size", "type").orderBy("idx"))
    work = files.withColumn("nth", first).join(taken, ["folder_id", "slot"], "left").join(have, ["folder_id", "name", "size", "type"], "left")
    work = work.join(counts, (work["folder_id"] == counts["folder_id"]) & work["slot"].eqNullSafe(counts["chosen"])).drop(counts["folder_id"], counts["chosen"])
    outcome = (
        F.when(F.coalesce("taken", F.lit(False)), "slot occupied")
        .when(F.coalesce(bundles(F.col("slot"), F.col("n_files")), F.lit(False)), "bundled")
        .when(F.coalesce("have", F.lit(False)), "duplicate")
        .when(F.col("nth") > 1, "repeated")
        .otherwise("accepted")
    )
    return work.withColumn("outcome", outcome).drop("taken", "have", "nth", "n_files")


def append_documents(documents: DataFrame, accepted: DataFrame) -> DataFrame:
    """The folder with accepted files."""
    return documents.unionByName(accepted, allowMissingColumns=True)


def append_pages(pages: DataFrame, extra: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages with ``extra`` ones behind their document's, in order, and the scan
    states without those of changed documents."""
    most = pages.groupBy("doc_id").agg(F.max("page_no").alias("most"))
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("page_no"))
    moved = extra.withColumn("place", place).join(most, "doc_id").withColumn("page_no", (F.col("most") + F.col("place")).cast("int")).drop("most", "place")
    return pages.unionByName(moved), states.join(extra.select("doc_id").distinct(), "doc_id", "left_anti")
