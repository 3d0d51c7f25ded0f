"""Page images, decoded by Spark's image source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Content types by the end of a file name.
TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp", "tif": "image/tiff", "tiff": "image/tiff", "pdf": "application/pdf"}


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def mime_of(name: Column) -> Column:
    """The content type by the end of a name; null for others."""
    table = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return F.element_at(table, F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Images below ``path`` as (``path``, ``width``, ``height``, ``channels``,
    ``pixels``: rows of blue, green, red, and alpha where there are four, or of one
    grey).  Files that cannot be decoded are left out."""
    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path)
    return images.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("pixels"))
