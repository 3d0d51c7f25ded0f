"""Applicant profiles as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

FIELDS = ("name", "email", "phone", "currentAddress")


def parse(text: Column) -> Column:
    """struct of trimmed fields.  Broken or missing JSON gives empty fields, and so
    does a field that is no string."""
    broken = F.try_parse_json(text).isNull()

    def field(name: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), f"$.{name}", "variant"))
        value = F.when(kind == "STRING", F.try_variant_get(F.try_parse_json(text), f"$.{name}", "string"))
        return F.when(broken, F.lit("")).otherwise(F.coalesce(strip(value), F.lit(""))).alias(name)

    return F.struct(*[field(n) for n in FIELDS])


def to_text(profile: Column) -> Column:
    """The normalised profile as JSON."""
    return F.to_json(F.struct(*[strip(F.coalesce(profile[n], F.lit(""))).alias(n) for n in FIELDS]))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """One profile for each file below ``path``."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return files.select("path", parse(F.col("value")).alias("p")).select("path", "p.*")


def write_profiles(profiles: DataFrame, path: str) -> None:
    """One line of JSON for each profile."""
    profiles.select(to_text(F.struct(*FIELDS)).alias("value")).write.mode("overwrite").text(path)
