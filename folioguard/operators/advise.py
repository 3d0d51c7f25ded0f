"""Recommendations, privacy scores and review groups over detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import half_up, masked
from ..rules import COST, DISCLAIMER, MRZ, OTHER, RECOMMENDATIONS

RULES = "label string, action string, level string, title string, reason string"


def rule_table(spark, rules=RECOMMENDATIONS) -> DataFrame:
    return spark.createDataFrame(rules, RULES)


def recommend(detections: DataFrame, rules=RECOMMENDATIONS) -> DataFrame:
    """``detections`` with ``action``, ``level``, ``title``, ``reason`` and
    ``disclaimer``; ``type`` (the document's, null: other) is worded into the
    reason for labels without a rule."""
    known = detections.join(F.broadcast(rule_table(detections.sparkSession, rules)), "label", "left")
    unknown = F.concat(F.lit("Für „"), F.col("label"), F.lit("“ gibt es bei "), F.coalesce("type", F.lit(OTHER)), F.lit(" noch keine eindeutige Regel."))
    return known.withColumns(
        {
            "action": F.coalesce("action", F.lit("review")),
            "level": F.coalesce("level", F.lit("medium")),
            "title": F.coalesce("title", F.lit("Bitte selbst prüfen")),
            "reason": F.coalesce("reason", unknown),
            "disclaimer": F.lit(DISCLAIMER),
        }
    )


def privacy_scores(documents: DataFrame, detections: DataFrame, rules=RECOMMENDATIONS) -> DataFrame:
    """(``doc_id``, ``score``) for each document: 100 less the cost of each label
    to redact that is not selected everywhere, 0 at least."""
    by_label = detections.groupBy("doc_id", "label").agg(F.bool_and("selected").alias("safe"))
    costs = F.broadcast(rule_table(detections.sparkSession, rules).where("action = 'redact'").select("label", F.when(F.col("level") == "high", COST["high"]).otherwise(COST["medium"]).alias("cost")))
    risk = by_label.where(~F.col("safe")).join(costs, "label").groupBy("doc_id").agg(F.sum("cost").alias("risk"))
    return documents.select("doc_id").join(risk, "doc_id", "left").select("doc_id", F.greatest(F.lit(0), 100 - F.coalesce("risk", F.lit(0))).cast("int").alias("score"))


def findings(detections: DataFrame) -> DataFrame:
    """Selected detections by label."""
    return detections.where("selected").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def review_groups(detections: DataFrame) -> DataFrame:
    """Groups as a reviewer sees them: all machine-readable lines of a document
    are one, every other detection stands alone.  ``detail`` masks the value."""
    key = F.when(F.col("label") == MRZ, "mrz").otherwise(F.col("detection_id"))
    grouped = detections.groupBy("doc_id", key.alias("group_key")).agg(
        F.count(F.lit(1)).alias("n"), F.bool_and("selected").alias("all_selected"), F.bool_or("selected").alias("some_selected"),
        half_up(F.avg("confidence")).cast("int").alias("confidence"), F.first("value").alias("value"),
    )
    several = F.format_string("%d erkannte Zeilen - OCR durchschnittlich %d%%", F.col("n"), F.col("confidence"))
    one = F.concat(masked(F.col("value")), F.format_string(" - OCR %d%%", F.col("confidence")))
    return grouped.withColumn("detail", F.when(F.col("n") > 1, several).otherwise(one)).drop("value")


def selection_counts(documents: DataFrame, detections: DataFrame) -> DataFrame:
    """(``doc_id``, ``n_selected``) for each document."""
    counts = detections.where("selected").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_selected"))
    return documents.select("doc_id").join(counts, "doc_id", "left").select("doc_id", F.coalesce("n_selected", F.lit(0)).alias("n_selected"))
