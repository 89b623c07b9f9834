"""Recurrences over sorted rows, one small state per key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def replayed(rows: DataFrame, key: list[str], fields: list[str], step: Callable, kind: str, order: tuple[str, ...] = ("t_s", "seq")) -> DataFrame:
    """(*key, what step gives): step run over each key's rows in order.

    step(state, row of fields) gives the new state and a row of the type ``kind``, or None; the state is None before
    the first row of a key. Rows are dealt by key and sorted, which can spill; beyond that a task holds one
    batch and one state, however many rows a key has.
    """
    n, schema = len(key), StructType([*(rows.schema[k] for k in key), *StructType.fromDDL(kind).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = state = None
        for batch in batches:
            columns, out = [c.to_pylist() for c in batch.columns], []
            for row in zip(*columns, strict=True):
                if row[:n] != now:
                    now, state = row[:n], None
                state, got = step(state, row[n:])
                if got is not None:
                    out.append(now + got)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    taken = rows.select(*key, *fields, *(rows[c].alias(f"__{c}") for c in order))
    dealt = taken.repartition(*key).sortWithinPartitions(*key, *(f"__{c}" for c in order))
    return dealt.select(*key, *fields).mapInArrow(run, schema)
