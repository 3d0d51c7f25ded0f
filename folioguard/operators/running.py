"""Running values over keys that may hold any share of the rows.

Keys with many rows are cut at spans of time.  Running sums, minima and maxima are
taken within each span; what a span amounts to is one row, and only these meet over
a key, to say what every span starts from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a key from which it is cut, and the span it is cut at, in microseconds.
HOT, SPAN_US = 1 << 16, 600_000_000

_OVER = {"sum": F.sum, "min": F.min, "max": F.max}


def _joined(kind: str, before: Column, here: Column) -> Column:
    if kind == "sum":
        return F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0))
    return (F.least if kind == "min" else F.greatest)(before, here)


def split_hot(df: DataFrame, key: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """``df`` without and with the keys of over ``rows`` rows.  Null keys are never
    hot."""
    hot = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > rows) & F.col(key).isNotNull()).select(key)
    return df.join(hot, key, "left_anti"), df.join(hot, key, "left_semi")


def span_of(ts: Column, span_us: int = SPAN_US) -> Column:
    return F.coalesce(F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(span_us)), F.lit(-(1 << 62)))


class Running:
    """``df`` with running values, in the order of (time, number) within ``key``,
    over spans of it."""

    def __init__(self, df: DataFrame, key: str, order: tuple[str, str], span_us: int = SPAN_US) -> None:
        self.key, self.order = key, order
        self.df = df.withColumn("__span", span_of(F.col(order[0]), span_us))

    def add(self, **values: tuple[str, Column]) -> Running:
        """Columns ``name`` = (``sum``, ``min`` or ``max``, of what), each running up
        to and with its row.  Nulls do not count; sums start at 0."""
        here = W.partitionBy(self.key, "__span").orderBy(*self.order).rowsBetween(W.unboundedPreceding, W.currentRow)
        df = self.df.withColumns({name: _OVER[kind](value).over(here) for name, (kind, value) in values.items()})
        ends = self.df.groupBy(F.col(self.key).alias("__k"), F.col("__span").alias("__s")).agg(*[_OVER[kind](value).alias(name) for name, (kind, value) in values.items()])
        over = W.partitionBy("__k").orderBy("__s").rowsBetween(W.unboundedPreceding, -1)
        starts = ends.select("__k", "__s", *[_OVER[kind](name).over(over).alias(f"__{name}") for name, (kind, _) in values.items()])
        joined = df.join(starts, (F.col(self.key) == F.col("__k")) & (F.col("__span") == F.col("__s")))
        self.df = joined.withColumns({name: _joined(kind, F.col(f"__{name}"), F.col(name)) for name, (kind, _) in values.items()}).drop("__k", "__s", *[f"__{n}" for n in values])
        return self
