"""Redaction boxes by page, and redacted words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import redaction_rectangle
from ..functions.pixels import burn_column

BLOCK = "█"


def boxes_to_pages(detections: DataFrame, pages: DataFrame) -> DataFrame:
    """Each detection on the page (``doc_id``, ``page_no``, ``top``, ``width``,
    ``height``) whose band holds its vertical centre.  Detections on no page stay
    with a null page, so that none is lost in silence.

    An as-of join: pages and detections of a document are sorted together by height,
    and each detection looks at the last page that begins at or above it, the one
    with the highest number where several begin together.  Bands of pages do not
    overlap, so no other could hold it.  Columns of pages do not clash with those of
    detections.
    """
    names = detections.columns
    at = F.col("bbox.top") + F.col("bbox.height") / 2
    page = "struct<page_no: {}, top: double, width: double, height: double>".format(pages.schema["page_no"].dataType.simpleString())
    boxes = detections.select(F.col("doc_id").alias("__doc"), at.alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(page).alias("__page"), F.struct(*names).alias("__box"))
    bands = pages.where(F.col("top").isNotNull() & F.col("height").isNotNull()).select(
        F.col("doc_id").alias("__doc"), F.col("top").cast("double").alias("__at"), F.lit(0).alias("__kind"),
        F.struct("page_no", F.col("top").cast("double").alias("top"), F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height")).alias("__page"),
        F.lit(None).cast(boxes.schema["__box"].dataType).alias("__box"),
    )
    order = W.partitionBy("__doc").orderBy("__at", "__kind", F.col("__page.page_no")).rowsBetween(W.unboundedPreceding, W.currentRow)
    met = boxes.unionByName(bands).withColumn("__last", F.last("__page", ignorenulls=True).over(order)).where("__kind = 1")
    held = met.withColumn("__last", F.when(F.col("__at") < F.col("__last.top") + F.col("__last.height"), F.col("__last")))
    return held.select("__box.*", F.col("__last.page_no").alias("page_no"), F.col("__last.top").alias("page_top"), F.col("__last.width").alias("page_width"), F.col("__last.height").alias("page_height"))


def rectangles(placed: DataFrame, mode: str = "folder") -> DataFrame:
    """The rectangle of each placed detection on its page."""
    r = redaction_rectangle(F.col("bbox"), F.col("page_top"), F.col("page_width"), F.col("page_height"), mode)
    return placed.where("page_no is not null").select("doc_id", "page_no", r.alias("rect"))


def redact_words(words: DataFrame, rects: DataFrame) -> DataFrame:
    """``words`` (``doc_id``, ``page_no``, ``page_top``, ``left``, ``top``,
    ``width``, ``height``, ``text``) with ``redacted`` and ``shown``: blocks for
    words that a rectangle of their page touches.

    A page's few rectangles become one array, so words are not multiplied; pages
    without any pass through.
    """
    return marked(with_rectangles(words, rects))


def with_rectangles(rows: DataFrame, rects: DataFrame) -> DataFrame:
    """``rows`` (``doc_id``, ``page_no``, more), be it words or the lines that they are
    made of later, with ``rects``: the rectangles of their page, null if it has none."""
    by_page = rects.groupBy("doc_id", "page_no").agg(F.collect_list("rect").alias("rects"))
    return rows.join(by_page, ["doc_id", "page_no"], "left")


def marked(words: DataFrame) -> DataFrame:
    """``words`` with ``rects`` as ``redact_words`` gives them."""
    y = F.col("top") - F.col("page_top")
    touches = lambda r: (r["left"] < F.col("left") + F.col("width")) & (r["left"] + r["width"] > F.col("left")) & (r["top"] < y + F.col("height")) & (r["top"] + r["height"] > y)
    redacted = words.withColumn("redacted", F.coalesce(F.exists("rects", touches), F.lit(False))).drop("rects")
    return redacted.withColumn("shown", F.when(F.col("redacted"), F.repeat(F.lit(BLOCK), F.length("text"))).otherwise(F.col("text")))


def burn_images(images: DataFrame, rects: DataFrame, channels: int = 3) -> DataFrame:
    """``images`` (``image_id``, ``width``, ``height``, ``pixels``) with the
    rectangles (``image_id``, ``rect``) of each made black.

    Only the rectangles are grouped; images without any pass through.  Spark sends
    the rectangles to the images where they are small by its own measure.  Null
    rectangles and rectangles of no image do nothing.
    """
    by_image = rects.where(F.col("rect").isNotNull()).groupBy(F.col("image_id").alias("__image")).agg(F.collect_list("rect").alias("__rects"))
    joined = images.join(by_image, F.col("image_id") == F.col("__image"), "left")
    return joined.withColumn("pixels", burn_column(F.col("pixels"), F.col("width"), F.col("height"), F.col("__rects"), channels)).drop("__image", "__rects")
