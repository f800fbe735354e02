"""Folds over ordered rows: for rules in which a row depends on what the rows before it became."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructType


def in_order(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """rows dealt by keys, so that each key's rows follow each other in order. A long key spills in its sort."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def ordered_fold(rows: DataFrame, keys: list[str], order: list[Column | str], start: Callable[[], object], step: Callable[[object, dict], Iterable[tuple]], schema: StructType | str) -> DataFrame:
    """Rows of `schema` that step(state, row) gives for each row of a key in order; start() is a key's state before its first row.

    One pass over the sorted rows: a key is never gathered, and only one state is held, so that the work is linear in
    the rows. Null keys are a key of their own.
    """
    wanted = rows.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(wanted)

    def run(batches):
        key, state = None, None
        for batch in batches:
            names, out = batch.schema.names, []
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = dict(zip(names, values, strict=True))
                now = tuple(row[k] for k in keys)
                if now != key:
                    key, state = now, start()
                out += step(state, row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return in_order(rows, keys, order).mapInArrow(run, wanted)


def numbered_groups(rows: DataFrame, keys: list[str], order: list[Column | str], value: str, reach: Column, name: str) -> DataFrame:
    """rows with `name`, 0 and up within a key: a new group begins at a row whose value is over `reach` above that of the group's first row.

    The first row of a group decides, so that groups depend on the order and not on the gaps alone.
    """
    taken = {c.lower() for c in rows.columns}
    far = "reach"
    while far in taken:
        far += "_"
    kept = rows.columns
    wanted = StructType([*rows.schema.fields]).add(name, LongType())
    arrow = to_arrow_schema(wanted)

    def run(batches):
        key, first, group = None, None, -1
        for batch in batches:
            # Only what decides is read; the other columns pass as they are.
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            deciding = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*keys, value, far)]
            numbers = []
            for *now, at, most in zip(*deciding, strict=True):
                if now != key:
                    key, first, group = now, None, -1
                if first is None or at - first > most:
                    first, group = at, group + 1
                numbers.append(group)
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(columns, arrow)), pa.array(numbers, pa.int64())], schema=arrow)

    return in_order(rows.withColumn(far, reach), keys, order).mapInArrow(run, wanted)
