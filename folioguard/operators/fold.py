"""Ordered folds over keyed logs, without collecting a key's rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gathered(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """``df`` with all rows of ``keys`` in one partition, sorted by ``keys`` and ``order``.

    Dealt by a hash of the keys.  Spark leaves a repartition by the keys themselves
    out where its input is dealt by them already, and may then still coalesce the sides
    of a union apart or split a skewed join, as ``mapInArrow`` does not say that it
    needs keys whole; a key would be in several tasks.
    """
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)


def fold(df: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable[[object, dict], object], finish: Callable[[object, object], dict], schema: str) -> DataFrame:
    """One row for each key: ``finish(key, state)`` after all its rows went through
    ``state = step(state, row)`` in ``order``.

    Rows are shuffled by key, sorted and streamed; a task holds one state.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, out, begun = None, None, [], False
        for batch in batches:
            for row in batch.to_pylist():
                if not begun or row[key] != at:
                    if begun:
                        out.append(finish(at, state))
                    at, state, begun = row[key], start(), True
                state = step(state, row)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if begun:
            out.append(finish(at, state))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return gathered(df, [key], *order).mapInArrow(run, schema)
