"""Words that come by line, against the same words one by one."""

import pytest
from pyspark.sql import functions as F

from folioguard.operators import detect, redact
from folioguard.plans import fixtures as fx
from folioguard.plans import registry, words

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(repr, df.collect()))


def test_lines_have_the_words_and_detections(spark):
    lines, each = fx.ocr_lines(spark, SF), fx.ocr_words(spark, SF)
    nested = lines.select("doc_id", "page_num", "line_key", F.inline("words"))
    assert rows(nested.select(each.columns)) == rows(each)
    assert rows(detect.detect_lines(lines)) == rows(detect.detect(each))


@pytest.mark.parametrize("name", ["repeated_reads", "review_toggles", "redacted_words"])
def test_no_words_are_shuffled(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for line in plan.split("\n"):
        assert "Exchange" not in line or "line_key" not in line


def test_rectangles_meet_lines_as_they_meet_words(spark):
    each = fx.ocr_words(spark, SF).withColumn("page_no", F.col("page_num")).withColumn("page_top", F.col("page_num") * 960.0)
    pages = each.select("doc_id", "page_no", F.col("page_top").alias("top"), F.lit(5000.0).alias("width"), F.lit(960.0).alias("height")).distinct()
    rects = redact.rectangles(redact.boxes_to_pages(detect.detect(each).where("selected"), pages))
    want = redact.redact_words(each, rects)
    assert rows(words.redacted(spark, SF).select(want.columns)) == rows(want)
