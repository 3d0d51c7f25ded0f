"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprints, licenses, pii, prefixtrie, toxicity, variants
from .ann import nearest_neighbours
from .common import WORD_PATTERN, settle, table
from .mixing import mix_sources
from .sharding import number_slots, shard_records
from .simhash import near_groups
from .topk import exact_top_k
from .warc import archive_round_trip


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"), width=3, max_bits=2)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", pii.spans_column(F.col("text"), pii.fit()).alias("s"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind):
        return F.size(F.filter("s", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("s", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in pii.BASE_KINDS], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("s")).alias("spans"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), k=10, every=100, factor=1024.0)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return encoded.select("doc_id", bpe.digest_column(F.col("ids"), path).alias("d")).select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    model = toxicity.fit(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.score_column(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size")
    )
    docs = settle(docs.withColumn("members", F.array("source")), "sizes")
    mixed = mix_sources(docs, members="members", size="size", key="doc_id", weights=(3.0, 1.0, 2.0), share=1.5, most=2)
    per_source = mixed.groupBy("source").agg(F.sum("size").alias("source_size"))
    joined = mixed.join(per_source, mixed["source"].eqNullSafe(per_source["source"]))
    return joined.select("doc_id", "size", "source_size", "target", "taken")


def op7_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shard_records(table(spark, sf_dir, "documents"), "doc_id", [1.0] * 16, grown=[1.0] * 17)
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "grown_shard",
    )
    return number_slots(narrow, "doc_id").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archive_round_trip(table(spark, sf_dir, "pages"), min_bytes=0)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", licenses.scan(F.col("text")).alias("s"))
    labels = F.array_sort(F.array_distinct(F.concat("s.base_labels", F.transform("s.matches", lambda m: m["label"]))))
    return found.select(
        "doc_id",
        "s.n_words",
        "s.n_base",
        "s.first_word",
        "s.last_word",
        F.array_join("s.base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        "s.score",
    )


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(variants.damaged_words(table(spark, sf_dir, "documents")))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))
    own, edited, after = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return made.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprints.as_text(own).alias("fingerprint"), fingerprints.as_text(edited).alias("edited_fingerprint"),
        fingerprints.resemblance(own, edited).alias("near_edited"), fingerprints.resemblance(own, after).alias("near_next"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(prefixtrie.rebuilt(prefixtrie.sequences(table(spark, sf_dir, "conversations"))))


OP13_SQL = """
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
-- crc32 of the decimal id, byte by byte and bit by bit
crc AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda r, c: list_reduce([xor(r, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM own)),
turns AS (
  SELECT c.conv_id, o.i, o.role, o.text FROM crc c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 100 AND o.i <= c.h
  UNION ALL SELECT conv_id, i, role, text FROM own JOIN crc USING (conv_id) WHERE i > h),
placed AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS depth, length(role) || ':' || length(text) || ':' || role || text AS said FROM turns),
paths AS (
  SELECT conv_id, depth, length(text) AS n, md5(string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS k FROM placed
  UNION ALL SELECT conv_id, 0, 0, '' FROM crc),
above AS (SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY depth) AS up, depth = max(depth) OVER (PARTITION BY conv_id) AS done FROM paths),
nodes AS (
  SELECT k, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(up) AS up, any_value(n) AS n, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (done), '')) AS ends FROM above GROUP BY k),
kids AS (SELECT up AS k, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up),
-- every node under each node of its own path
under AS (SELECT a.k, sum((b.n_convs - 1) * b.n) AS saved, count(*) FILTER (b.k NOT IN (SELECT k FROM kids)) AS leaves
          FROM nodes b JOIN above a ON a.conv_id = b.conv_id AND a.depth <= b.depth GROUP BY a.k)
SELECT nodes.conv_id, nodes.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, nodes.n_convs, coalesce(n_children, 0) AS n_children, leaves AS n_leaves,
       saved::BIGINT AS saved_tokens, nodes.ends AS ends_sha256
FROM nodes JOIN under USING (k) LEFT JOIN kids USING (k) LEFT JOIN nodes p ON p.k = nodes.up
"""


OP8_SQL = """
WITH rows AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
         sha1(coalesce(html, '')) AS hex
  FROM pages),
ids AS (SELECT hex, payload_bytes, max(page_id) AS winner FROM rows GROUP BY ALL)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + ((('0x' || substr(hex, (1 + 5 * (i // 4))::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31), 1)), '')
         AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM winner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM winner THEN winner END AS refers_to
FROM rows JOIN ids USING (hex, payload_bytes)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_near_dedup": op1_simhash_near_dedup,
        "op2_pii_spans": op2_pii_spans,
        "op3_exact_top_k": op3_exact_top_k,
        "op4_bpe_round_trip": op4_bpe_round_trip,
        "op5_toxicity": op5_toxicity,
        "op6_mix_sources": op6_mix_sources,
        "op7_rendezvous_shards": op7_rendezvous_shards,
        "op8_warc_round_trip": op8_warc_round_trip,
        "op9_license_scan": op9_license_scan,
        "op10_nearest_neighbours": op10_nearest_neighbours,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_fingerprints": op12_fingerprints,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_top_k": OP3_SQL, "op8_warc_round_trip": OP8_SQL, "op13_prefix_trie": OP13_SQL}
