"""How often every term occurs and in how many records (problem 2).

The pairs of term and record are sorted by an external range-partitioned sort;
a scan over the sorted runs counts occurrences and distinct records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.tables import shuffle_partitions

RARE_RECORDS = 2
COMMON_SHARE = (4, 10)


def _pairs_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One row per term and record of a batch, with the term's number there: the part of the counting that needs no shuffle."""
    lists = batch.column(1)
    terms = pc.list_flatten(lists)
    rows = pc.list_parent_indices(lists)
    table = pa.table({"row": rows, "term": terms}).filter(pc.is_valid(terms))
    counted = table.group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")])
    per_row = pa.table({"term": counted.column("term"), "record": batch.column(0).take(counted.column("row").combine_chunks()), "n": counted.column("count_all").cast(pa.int64())})
    # deliveries of one record that meet in a batch become one
    most = per_row.group_by(["term", "record"], use_threads=False).aggregate([("n", "max")])
    return pa.RecordBatch.from_arrays([most.column(c).combine_chunks() for c in ("term", "record", "n_max")], ["term", "record", "n"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _pairs_of(batch)


def _starts(column: pa.Array) -> np.ndarray:
    """Where a run of equal values starts; the first row always does."""
    out = np.ones(len(column), dtype=bool)
    if len(column) > 1:
        out[1:] = pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length scan of one sorted partition: a row per term and batch part.

    A run of one term and record counts as one record, with the largest of its
    counts: further deliveries of a record add nothing. The last run of a batch
    is carried into the next one, so memory holds one batch.
    """
    carry: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if carry is not None:
            batch = pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
        term, record, n = batch.columns
        new = np.flatnonzero(_starts(term) | _starts(record))
        most = np.maximum.reduceat(n.to_numpy(), new)
        carry = pa.RecordBatch.from_arrays([term[new[-1] : new[-1] + 1], record[new[-1] : new[-1] + 1], pa.array(most[-1:])], batch.schema.names)
        if len(new) > 1:
            yield _per_term(term.take(pa.array(new[:-1])), most[:-1])
    if carry is not None:
        yield _per_term(carry.column(0), carry.column(2).to_numpy())


def _per_term(term: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    first = np.flatnonzero(_starts(term))
    records = np.diff(np.append(first, len(term)))
    return pa.RecordBatch.from_arrays([term.take(pa.array(first)), pa.array(np.add.reduceat(n, first)), pa.array(records.astype(np.int64))], ["term", "occurrences", "records"])


def term_frequency(df: DataFrame, record_id: str, terms: str, partitions: int | None = None) -> DataFrame:
    """``(term, occurrences, records)`` of every distinct non-null value of the array column ``terms``.

    Several rows with one ``record_id`` are deliveries of one record: a term
    counts in it as often as in the delivery that has it most. Rows whose id is
    null belong to no record and are left out; null or empty arrays add nothing.
    An empty table gives no rows. The sort key is term and record, so a term in
    most records spreads over many partitions; the sums of its parts are added
    in a second, small aggregation.
    """
    kind = df.schema[terms].dataType.elementType
    ids = df.schema[record_id].dataType
    schema = T.StructType([T.StructField("term", kind), T.StructField("record", ids), T.StructField("n", T.LongType())])
    parts = partitions or shuffle_partitions(df.sparkSession)
    source = df.select(F.col(record_id), F.col(terms)).where(F.col(record_id).isNotNull() & F.col(terms).isNotNull())
    pairs = source.mapInArrow(_pairs, schema)
    ordered = pairs.repartitionByRange(parts, "term", "record").sortWithinPartitions("term", "record")
    scanned = ordered.mapInArrow(_scan, T.StructType([T.StructField("term", kind), T.StructField("occurrences", T.LongType()), T.StructField("records", T.LongType())]))
    return scanned.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked(frequencies: DataFrame, records: int, rare: int = RARE_RECORDS, common: tuple[int, int] = COMMON_SHARE) -> DataFrame:
    """``frequencies`` with ``mark``: rare in at most ``rare`` records, common in more than the share ``common`` of all ``records``.

    Whole numbers only, so no rounding decides. A term that is both is rare.
    """
    over, of = common
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") * of > F.lit(records * over), "common")
    return frequencies.withColumn("mark", mark)


def label_frequency(graphs: DataFrame) -> DataFrame:
    """``(label, occurrences, records, mark)`` of every label over the distinct graphs."""
    n = graphs.agg(F.count_distinct("graph_id")).first()[0]
    return marked(term_frequency(graphs, "graph_id", "labels").withColumnRenamed("term", "label"), n)


def found_labels(graphs: DataFrame) -> DataFrame:
    """``(label, mark)`` of the labels in too few or too many graphs."""
    return label_frequency(graphs).where(F.col("mark").isNotNull()).select("label", "mark")
