"""Queries over folders and drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import classify, detect, drafts, folder
from ..rules import MULTI, SLOTS, TYPE_TO_SLOT
from ..sources import store
from ..sources.scratch import scratch_dir
from . import fixtures as fx
from .words import FOUND, quoted
from .words import SQL as WORD_SQL

# --- Spark ---------------------------------------------------------------------


def typed(spark: SparkSession, sf: str) -> DataFrame:
    return fx.texts(spark, sf).select(F.col("doc_id").alias("id"), classify.classify(F.col("text")).alias("c")).select("id", "c.type", "c.confidence")


def assignment_review(spark: SparkSession, sf: str) -> DataFrame:
    both = fx.folder_documents(spark, sf).select("folder_id", "id", "slot").join(typed(spark, sf), "id")
    return both.select("folder_id", "id", folder.review_assignment(F.col("slot"), F.col("type"), F.col("confidence")).alias("r")).select("folder_id", "id", "r.*")


def folder_completeness(spark: SparkSession, sf: str) -> DataFrame:
    """The slot of an identity card is emptied in folders of even length, so that
    slots are missing."""
    slot = F.when((F.col("slot") != "Ausweiskopie") | (F.length("folder_id") % 2 == 1), F.col("slot"))
    return folder.completeness(fx.folder_documents(spark, sf).withColumn("slot", slot)).withColumn("missing", F.array_join("missing", ","))


def slot_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return folder.slot_coverage(fx.folder_documents(spark, sf))


def folder_order(spark: SparkSession, sf: str) -> DataFrame:
    states = fx.scan_states(spark, sf).select(F.col("doc_id").alias("id"), "status")
    docs = folder.positions(fx.folder_documents(spark, sf).drop("type")).join(states, "id", "left").join(typed(spark, sf), "id")
    return docs.select("folder_id", "id", "slot", "position", folder.confirmed(F.col("slot"), F.col("status"), F.col("type"), F.col("confidence")).alias("confirmed"))


def page_plan(spark: SparkSession, sf: str) -> DataFrame:
    return folder.page_plan(fx.page_counts(spark, sf)).select("folder_id", "id", "page_count", "start_page", "end_page", "page_label")


def contents_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = folder.contents_rows(folder.page_plan(fx.page_counts(spark, sf)), fx.folder_documents(spark, sf))
    return rows.select("folder_id", "id", t.row_number_label(F.col("number")).alias("number"), t.footer(F.col("slot"), F.col("name"), F.col("page_label")).alias("entry"))


def page_rows(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx.table(spark, sf, "documents").select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.floor(F.col("n_chars") / 3000.0).cast("int"))).alias("page_no"))
    return docs.select("doc_id", "page_no", (500 + (F.col("n_chars") + F.col("page_no")) % 300).cast("double").alias("width"), (700 + F.col("page_no") * 10 % 50).cast("double").alias("height"))


def page_tops(spark: SparkSession, sf: str) -> DataFrame:
    return folder.page_tops(page_rows(spark, sf))


def composite_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return folder.composite_sizes(page_rows(spark, sf))


def appended_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth document gets its first two pages again behind its last."""
    pages = page_rows(spark, sf)
    states = fx.scan_states(spark, sf)
    more, left = folder.append_pages(pages, pages.where("doc_id % 5 = 0 and page_no < 2"), states)
    counts = more.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.max("page_no").alias("last_page"), F.max_by("width", "page_no").alias("last_width"))
    return counts.join(left.select("doc_id", "status"), "doc_id", "left")


def pending_documents(spark: SparkSession, sf: str) -> DataFrame:
    return folder.pending_documents(fx.folder_documents(spark, sf), fx.scan_states(spark, sf)).select("folder_id", "id")


def batch_progress(spark: SparkSession, sf: str) -> DataFrame:
    return folder.batch_progress(fx.folder_documents(spark, sf), fx.scan_states(spark, sf))


def folders(spark: SparkSession, sf: str) -> DataFrame:
    names = fx.table(spark, sf, "documents").select(F.col("source").alias("folder_id")).distinct()
    return names.select("folder_id", (F.length("folder_id") % 2 == 0).alias("include_cover"), F.when(F.col("folder_id") != "src3", F.col("folder_id")).alias("applicant_name"))


def finished(spark: SparkSession, sf: str) -> DataFrame:
    """The scan states, where folders whose name has an odd length are done."""
    docs = fx.table(spark, sf, "documents").select(F.col("source").alias("folder_id"), "doc_id")
    states = docs.join(fx.scan_states(spark, sf), ["folder_id", "doc_id"], "left")
    return states.withColumn("status", F.when(F.length("folder_id") % 2 == 1, "done").otherwise(F.col("status"))).where("status is not null")


def export_readiness(spark: SparkSession, sf: str) -> DataFrame:
    """All documents of folders of odd length have been scanned by now."""
    return folder.export_readiness(folders(spark, sf), fx.folder_documents(spark, sf), finished(spark, sf))


def export_gate(spark: SparkSession, sf: str) -> DataFrame:
    """In folders of odd length all is scanned and rendered."""
    states = finished(spark, sf).select(F.col("doc_id").alias("id"), "status")
    docs = fx.folder_documents(spark, sf).join(states, "id", "left").withColumn("rendered", (F.length("folder_id") % 2 == 1) | (F.col("id") % 2 == 1))
    return folder.export_gate(folders(spark, sf), docs)


def scan_report(spark: SparkSession, sf: str) -> DataFrame:
    pages = page_rows(spark, sf).groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n_pages"))
    hits = detect.detect(fx.ocr_words(spark, sf)).groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n_hits"))
    return folder.scan_report(fx.folder_documents(spark, sf).drop("type"), fx.scan_states(spark, sf), typed(spark, sf).select("id", "type"), pages, hits)


def admitted_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth document is offered to its folder, in the slot of its number."""
    docs = fx.folder_documents(spark, sf)
    offered = docs.where("id % 5 = 0").select("folder_id", fx.slot_of(F.col("id") % 6).alias("slot"), F.col("id").alias("idx"), "name", F.col("size") % 50 + 1, "type").toDF("folder_id", "slot", "idx", "name", "size", "type")
    there = docs.where("id % 5 > 0").withColumn("size", F.col("size") % 50 + 1).withColumn("slot", F.when(F.col("slot") != "Ausweiskopie", F.col("slot")))
    # The documents of one folder have gone to an archive, so it is empty.
    moved = there.withColumn("folder_id", F.when(F.col("folder_id") == "src7", "archive").otherwise(F.col("folder_id")))
    return folder.admit_files(offered, moved).select("folder_id", "idx", "outcome")


def auto_assigned(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx.folder_documents(spark, sf)
    wanted = F.when(F.col("confidence") >= 65, folder.slot_of_type(F.col("type")))
    turns = docs.select("folder_id", "id").join(typed(spark, sf), "id").select("folder_id", "id", F.col("id").alias("turn"), wanted.alias("wanted"))
    return folder.assign_slots(docs.withColumn("slot", F.when(F.col("id") % 3 == 0, F.col("slot"))), turns)


def corrected_slots(spark: SparkSession, sf: str) -> DataFrame:
    """Reviewers move documents of low quality, twice each."""
    docs = fx.folder_documents(spark, sf)
    low = fx.table(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("id")).distinct().join(docs.select("folder_id", "id"), "id")
    turns = low.select("folder_id", "id", F.explode(F.array(F.struct(F.col("id").alias("turn"), fx.slot_of(F.col("id") % 5).alias("wanted")), F.struct((F.col("id") + 100_000_000).alias("turn"), fx.slot_of((F.col("id") + 2) % 5).alias("wanted")))).alias("s"))
    docs = docs.withColumn("slot", F.when(F.expr("id % 6 = 0 or id % 4 = 1"), F.col("slot")))
    return folder.assign_slots(docs, turns.select("folder_id", "id", "s.turn", "s.wanted"))


def appended_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth document is a file that was accepted, and has no slot yet."""
    docs = fx.folder_documents(spark, sf).select("folder_id", "id", "slot")
    files = docs.where("id % 5 = 0").select("id", "folder_id", F.lit("accepted").alias("outcome"))
    return folder.append_documents(docs.where("id % 5 > 0").withColumn("outcome", F.lit(None).cast("string")), files)


def latest_drafts(spark: SparkSession, sf: str) -> DataFrame:
    return drafts.latest_drafts(fx.draft_versions(spark, sf))


def stored_drafts(spark: SparkSession, sf: str) -> DataFrame:
    """All versions are put into a store; then the drafts of every tenth user are
    deleted, by their ids, and the store is compacted."""
    versions, path = fx.draft_versions(spark, sf), scratch_dir(spark, "drafts")
    store.put_drafts(versions, path)
    store.delete_drafts(versions.where("cast(id as long) % 10 = 0").select("id"), path)
    store.compact_drafts(spark, path)
    return drafts.latest_drafts(store.read_versions(spark, path))


def newest_drafts(spark: SparkSession, sf: str) -> DataFrame:
    return drafts.newest_drafts(fx.draft_versions(spark, sf), 20).select("id", "title", "updated_at")


def draft_summaries(spark: SparkSession, sf: str) -> DataFrame:
    last = drafts.latest_drafts(fx.draft_versions(spark, sf))
    number = F.col("seq")
    files = F.transform(F.sequence(F.lit(0), (number % 7).cast("int")), lambda i: F.struct(i.alias("id"), fx.slot_of((number + i * i) % 6).alias("slot")))
    return drafts.summaries(last.withColumn("documents", files)).withColumn("missing", F.array_join("missing", ","))


QUERIES = {
    "assignment_review": assignment_review, "folder_completeness": folder_completeness, "slot_coverage": slot_coverage, "folder_order": folder_order, "page_plan": page_plan,
    "contents_rows": contents_rows, "page_tops": page_tops, "composite_sizes": composite_sizes, "appended_pages": appended_pages, "pending_documents": pending_documents,
    "batch_progress": batch_progress, "export_readiness": export_readiness, "export_gate": export_gate, "scan_report": scan_report, "admitted_files": admitted_files,
    "auto_assigned": auto_assigned, "corrected_slots": corrected_slots, "appended_documents": appended_documents, "latest_drafts": latest_drafts, "stored_drafts": stored_drafts, "newest_drafts": newest_drafts, "draft_summaries": draft_summaries,
}

# --- SQL -----------------------------------------------------------------------

SLOT_LIST = "[" + ", ".join(map(quoted, SLOTS)) + "]"
SLOT_AT = f"{SLOT_LIST}[(({{0}}) % 6 + 1)::BIGINT]"
TYPE_SLOT = "CASE {0} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(s)}" for k, s in TYPE_TO_SLOT.items()) + " END"
SLOT_ORD = "coalesce(list_position(" + SLOT_LIST + ", slot), 6)"
DOCS = f"""lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
docs AS (
  SELECT source AS folder_id, doc_id AS id, 'doc-' || doc_id % 40 || '.pdf' AS name, n_chars AS size, ['application/pdf', 'image/jpeg', NULL][(doc_id % 3 + 1)::BIGINT] AS type,
         CASE WHEN quality IS NOT NULL THEN {SLOT_AT.format('quality * 2 + toxic + doc_id')} END AS slot
  FROM documents LEFT JOIN lab USING (doc_id)),
states AS (
  SELECT source AS folder_id, doc_id AS id, ['done', 'done', 'done', 'loading', 'idle', 'error'][(doc_id % 7 + 1)::BIGINT] AS status, doc_id % 10 / 10.0::DOUBLE AS progress
  FROM documents WHERE doc_id % 7 < 6),
pages AS (
  SELECT doc_id, page_no, (500 + (n_chars + page_no) % 300)::DOUBLE AS width, (700 + page_no * 10 % 50)::DOUBLE AS height
  FROM (SELECT doc_id, n_chars, unnest(range(0, n_chars // 3000 + 1))::INT AS page_no FROM documents))"""
TYPED = "typed AS (SELECT doc_id AS id, type, confidence FROM (" + WORD_SQL["document_types"] + "))"
PLAN = """counted AS (SELECT source AS folder_id, doc_id AS id, 'doc-' || doc_id % 40 || '.pdf' AS name, doc_id AS ord, floor(1 + n_chars / 3000.0)::BIGINT AS page_count, length(source) % 2 = 0 AS cover FROM documents),
started AS (SELECT *, coalesce(sum(page_count) OVER (PARTITION BY folder_id ORDER BY ord, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + CASE WHEN cover THEN 2 ELSE 1 END AS start_page FROM counted),
plan AS (SELECT *, start_page + page_count - 1 AS end_page, CASE WHEN page_count = 1 THEN start_page::VARCHAR ELSE start_page || '–' || (start_page + page_count - 1) END AS page_label FROM started)"""
FOLDERS = "folders AS (SELECT DISTINCT source AS folder_id, length(source) % 2 = 0 AS include_cover, CASE WHEN source <> 'src3' THEN source END AS applicant_name FROM documents)"
VERSIONS = """versions AS (SELECT user_id::VARCHAR AS id, event_type AS title, props->>'$.k' AS address, ts AS updated_at, event_id AS seq, event_type = 'error' AS deleted FROM events),
latest AS (SELECT * EXCLUDE (deleted) FROM (SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, seq DESC) = 1) WHERE NOT deleted)"""

#: Slots after the turns of ``t`` (``folder_id``, ``n`` from 1, ``id``, ``slot``,
#: ``wanted``) over the documents of ``e``: a step for each turn of a folder.
ASSIGNED = f"""s AS (
  SELECT folder_id, 0::BIGINT AS n, list_transform({SLOT_LIST}, lambda x: len(list_filter(slots, lambda y: y = x))) AS held, []::STRUCT(id BIGINT, slot VARCHAR)[] AS moved
  FROM (SELECT folder_id, list(slot) AS slots FROM e GROUP BY folder_id)
  UNION ALL
  SELECT folder_id, n, CASE WHEN go THEN list_transform(held, lambda c, i: c + CASE WHEN {SLOT_LIST}[i] = wanted THEN 1 WHEN {SLOT_LIST}[i] = now THEN -1 ELSE 0 END) ELSE held END,
         CASE WHEN go THEN list_append(moved, {{'id': id, 'slot': wanted}}) ELSE moved END
  FROM (SELECT *, wanted IS DISTINCT FROM now AND (wanted = {quoted(MULTI[0])} OR held[list_position({SLOT_LIST}, wanted)] = 0) AS go
        FROM (SELECT t.*, s.held, s.moved, coalesce(list_filter(s.moved, lambda m: m.id = t.id)[-1].slot, t.slot) AS now FROM s JOIN t ON t.folder_id = s.folder_id AND t.n = s.n + 1))),
l AS (SELECT folder_id, unnest(moved) AS m, generate_subscripts(moved, 1) AS k FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY folder_id ORDER BY n DESC) = 1)),
a AS (SELECT folder_id, m.id AS id, arg_max(m.slot, k) AS moved FROM l GROUP BY ALL)
SELECT folder_id, id, coalesce(moved, slot) AS slot FROM e LEFT JOIN a USING (folder_id, id)"""

SQL = {
    "auto_assigned": f"""WITH RECURSIVE {DOCS}, {TYPED}, e AS (SELECT folder_id, id, CASE WHEN id % 3 = 0 THEN slot END AS slot FROM docs),
w AS (SELECT folder_id, id, slot, CASE WHEN confidence >= 65 THEN {TYPE_SLOT.format('typed.type')} END AS wanted FROM e JOIN typed USING (id)),
t AS MATERIALIZED (SELECT folder_id, row_number() OVER (PARTITION BY folder_id ORDER BY id) AS n, id, slot, wanted FROM w WHERE wanted IS NOT NULL),
{ASSIGNED}""",
    "corrected_slots": f"""WITH RECURSIVE {DOCS}, e AS (SELECT folder_id, id, CASE WHEN id % 6 = 0 OR id % 4 = 1 THEN slot END AS slot FROM docs),
w AS (SELECT folder_id, id, slot, unnest([0, 1]) AS again FROM e WHERE id IN (SELECT doc_id FROM labels WHERE quality = 0)),
t AS MATERIALIZED (SELECT folder_id, row_number() OVER (PARTITION BY folder_id ORDER BY id + again * 100000000, id) AS n, id, slot, {SLOT_AT.format('(id + 2 * again) % 5')} AS wanted FROM w),
{ASSIGNED}""",
    "appended_documents": f"""WITH {DOCS} SELECT folder_id, id, CASE WHEN id % 5 > 0 THEN slot END AS slot, CASE WHEN id % 5 = 0 THEN 'accepted' END AS outcome FROM docs""",
    "assignment_review": f"""WITH {DOCS}, {TYPED}, j AS (SELECT folder_id, id, slot, typed.type, confidence, {TYPE_SLOT.format('typed.type')} AS detected FROM docs JOIN typed USING (id))
SELECT folder_id, id, CASE WHEN slot IS NULL OR confidence < 65 OR detected IS NULL THEN 'uncertain' WHEN detected <> slot THEN 'mismatch' ELSE 'match' END AS status,
       CASE WHEN slot IS NOT NULL AND confidence >= 65 THEN detected END AS detected_slot,
       CASE WHEN slot IS NULL OR confidence < 65 THEN 'Die Zuordnung konnte noch nicht sicher verglichen werden.' WHEN detected IS NULL THEN type || ' ist keiner Pflichtkategorie eindeutig zugeordnet.'
            WHEN detected <> slot THEN 'Unter „' || slot || '“ abgelegt, aber als „' || type || '“ erkannt. Bitte prüfen.' ELSE type || ' passt zur Kategorie „' || slot || '“.' END AS message FROM j""",
    "folder_completeness": f"""WITH {DOCS}, e AS (SELECT folder_id, CASE WHEN slot <> 'Ausweiskopie' OR length(folder_id) % 2 = 1 THEN slot END AS slot FROM docs),
g AS (SELECT folder_id, list(DISTINCT slot) FILTER (slot IS NOT NULL) AS present FROM e GROUP BY ALL)
SELECT folder_id, coalesce(len(present), 0)::INT AS completed, 5 AS total, floor(coalesce(len(present), 0) * 100.0 / 5 + 0.5)::INT AS percent,
       array_to_string(list_filter({SLOT_LIST}, lambda s: NOT list_contains(coalesce(present, []), s)), ',') AS missing FROM g""",
    "slot_coverage": f"""WITH {DOCS}, grid AS (SELECT folder_id, unnest({SLOT_LIST}) AS slot, unnest(range(0, 5))::INT AS slot_ord FROM (SELECT DISTINCT folder_id FROM docs)),
c AS (SELECT folder_id, slot, count(*) AS n FROM docs WHERE slot IS NOT NULL GROUP BY ALL),
f AS (SELECT folder_id, slot, name FROM docs WHERE slot IS NOT NULL QUALIFY row_number() OVER (PARTITION BY folder_id, slot ORDER BY name COLLATE de, id) = 1)
SELECT folder_id, slot, slot_ord, coalesce(n, 0) AS n, name AS first_name, n IS NULL AS missing FROM grid LEFT JOIN c USING (folder_id, slot) LEFT JOIN f USING (folder_id, slot)""",
    "folder_order": f"""WITH {DOCS}, {TYPED}
SELECT docs.folder_id, id, slot, row_number() OVER (PARTITION BY docs.folder_id ORDER BY {SLOT_ORD}, name COLLATE de, id) AS position,
       coalesce(status = 'done' AND confidence >= 65 AND {TYPE_SLOT.format('typed.type')} = slot, false) AS confirmed
FROM docs LEFT JOIN states USING (id) JOIN typed USING (id)""",
    "page_plan": f"WITH {PLAN} SELECT folder_id, id, page_count, start_page, end_page, page_label FROM plan",
    "contents_rows": f"""WITH {DOCS}, {PLAN}, r AS (SELECT p.*, d.slot, row_number() OVER (PARTITION BY p.folder_id ORDER BY ord, p.id) AS n FROM plan p LEFT JOIN docs d USING (folder_id, id))
SELECT folder_id, id, CASE WHEN n < 10 THEN '0' || n ELSE n::VARCHAR END AS number, coalesce(slot, name) || ' · Seite ' || page_label AS entry FROM r""",
    "page_tops": f"WITH {DOCS} SELECT *, coalesce(sum(height) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM pages",
    "composite_sizes": f"WITH {DOCS} SELECT doc_id, max(width) AS width, sum(height) AS height, count(*) AS n_pages FROM pages GROUP BY ALL",
    "appended_pages": f"""WITH {DOCS}, m AS (SELECT doc_id, max(page_no) AS most FROM pages GROUP BY ALL),
e AS (SELECT doc_id, most + row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS page_no, width FROM pages JOIN m USING (doc_id) WHERE doc_id % 5 = 0 AND page_no < 2),
a AS (SELECT doc_id, page_no, width FROM pages UNION ALL SELECT * FROM e)
SELECT doc_id, count(*) AS n_pages, max(page_no)::INT AS last_page, arg_max(width, page_no) AS last_width, any_value(status) AS status
FROM a LEFT JOIN (SELECT id AS doc_id, status FROM states WHERE id % 5 <> 0) USING (doc_id) GROUP BY doc_id""",
    "pending_documents": f"WITH {DOCS} SELECT folder_id, id FROM docs LEFT JOIN states USING (folder_id, id) WHERE status IS DISTINCT FROM 'done'",
    "batch_progress": f"""WITH {DOCS} SELECT folder_id, count(*) FILTER (status = 'done') AS completed, count(*) AS total,
       floor(sum(CASE WHEN status = 'done' THEN 1 ELSE greatest(0, least(1, coalesce(progress, 0))) END) / count(*) * 100 + 0.5)::INT AS percent
FROM docs LEFT JOIN states USING (folder_id, id) GROUP BY ALL""",
    "export_readiness": f"""WITH {DOCS}, {FOLDERS}, g AS (SELECT folder_id, bool_and(length(folder_id) % 2 = 1 OR coalesce(status = 'done', false)) AS ready FROM docs LEFT JOIN states USING (folder_id, id) GROUP BY ALL)
SELECT folder_id, coalesce(ready, false) AS ready FROM folders LEFT JOIN g USING (folder_id)""",
    "export_gate": f"""WITH {DOCS}, {FOLDERS},
g AS (SELECT folder_id, count(*) FILTER (length(folder_id) % 2 = 1 OR status = 'done' AND id % 2 = 1) AS good, count(*) AS n FROM docs LEFT JOIN states USING (folder_id, id) GROUP BY ALL),
r AS (SELECT folder_id, CASE WHEN coalesce(good, 0) = 0 THEN 'nothing to export' WHEN good <> n THEN 'unchecked documents' WHEN include_cover AND trim(coalesce(applicant_name, '')) = '' THEN 'name missing' END AS reason
      FROM folders LEFT JOIN g USING (folder_id))
SELECT folder_id, reason IS NULL AS allowed, reason FROM r""",
    "scan_report": f"""WITH {FOUND}, {DOCS}, {TYPED}, p AS (SELECT doc_id AS id, count(*) AS n_pages FROM pages GROUP BY ALL), h AS (SELECT doc_id AS id, count(*) AS n_hits FROM found GROUP BY ALL)
SELECT docs.folder_id, id, CASE status WHEN 'done' THEN coalesce(typed.type, 'Sonstiges') || ' · ' || coalesce(n_pages, 1) || ' Seite(n) · ' || coalesce(n_hits, 0) || ' Treffer'
       WHEN 'loading' THEN 'Smart Scan ' || greatest(1, floor(progress * 100 + 0.5)::BIGINT) || '%' WHEN 'error' THEN 'Prüfung fehlgeschlagen' ELSE 'Noch nicht geprüft' END AS report
FROM docs LEFT JOIN states USING (id) LEFT JOIN typed USING (id) LEFT JOIN p USING (id) LEFT JOIN h USING (id)""",
    "admitted_files": f"""WITH {DOCS},
offered AS (SELECT folder_id, {SLOT_AT.format('id % 6')} AS slot, id AS idx, name, size % 50 + 1 AS size, coalesce(type, '') AS type FROM docs WHERE id % 5 = 0),
there AS (SELECT folder_id, name, size % 50 + 1 AS size, coalesce(type, '') AS type, CASE WHEN slot <> 'Ausweiskopie' THEN slot END AS slot FROM docs WHERE id % 5 > 0 AND folder_id <> 'src7'),
o AS (SELECT *, count(*) OVER (PARTITION BY folder_id, slot) AS n, row_number() OVER (PARTITION BY folder_id, slot, name, size, type ORDER BY idx) AS nth FROM offered)
SELECT folder_id, idx, CASE WHEN slot <> {quoted(MULTI[0])} AND (folder_id, slot) IN (SELECT (folder_id, slot) FROM there) THEN 'slot occupied' WHEN slot <> {quoted(MULTI[0])} AND n > 1 THEN 'bundled'
       WHEN (folder_id, name, size, type) IN (SELECT (folder_id, name, size, type) FROM there) THEN 'duplicate' WHEN nth > 1 THEN 'repeated' ELSE 'accepted' END AS outcome FROM o""",
    "latest_drafts": f"WITH {VERSIONS} SELECT * FROM latest",
    "stored_drafts": f"WITH {VERSIONS} SELECT * FROM latest WHERE id::BIGINT % 10 <> 0",
    "newest_drafts": f"WITH {VERSIONS} SELECT id, title, updated_at FROM latest ORDER BY updated_at DESC, seq DESC LIMIT 20",
    "draft_summaries": f"""WITH {VERSIONS}, f AS (SELECT *, list_transform(range(0, seq % 7 + 1), lambda i: {SLOT_AT.format('seq + i * i')}) AS slots FROM latest),
d AS (SELECT *, list_distinct(list_filter(slots, lambda s: s IS NOT NULL)) AS present FROM f)
SELECT id, title, address, updated_at, len(slots)::INT AS document_count, len(present)::INT AS completed, 5 AS total, floor(len(present) * 20.0 + 0.5)::INT AS percent,
       array_to_string(list_filter({SLOT_LIST}, lambda s: NOT list_contains(present, s)), ',') AS missing FROM d""",
}
