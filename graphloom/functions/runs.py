"""Sorted streams cut into groups: what a grouped function does, with one Python call for a task instead of one for each group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """Of each run of equal values of the first column, a whole number, the columns as lists. Memory holds one run and one batch."""
    held: list[list] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        columns = [c.to_pylist() for c in batch.columns]
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            part = [c[start:end] for c in columns]
            if held is not None and held[0][0] == part[0][0]:
                for all_of, more in zip(held, part, strict=True):
                    all_of += more
                continue
            if held is not None:
                yield held
            held = part
    if held is not None:
        yield held


def by_run(rows: DataFrame, of_run: Callable[[list[list]], Iterator[list]], kind: pa.DataType, name: str, schema: str, at_once: int = 10_000) -> DataFrame:
    """``of_run`` for the rows of each value of the first column of ``rows``; each list that it gives is a row of the one column ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        for columns in runs(batches):
            for found in of_run(columns):
                held.append(found)
                if len(held) == at_once:
                    yield pa.RecordBatch.from_arrays([pa.array(held, kind)], [name])
                    held = []
        yield pa.RecordBatch.from_arrays([pa.array(held, kind)], [name])

    key = rows.columns[0]
    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)
