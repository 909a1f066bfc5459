"""Writers of graph files and results.

Text formats are DataFrames of lines in file order (``line_no``, ``value``),
written by ``write_lines`` as a folder of parts, or as one file. Parquet is the
native sink. Binary files are written by the driver from an ordered stream.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import adjacency, arcs, degree_histogram, degrees
from graphloom.plans.pattern import Pattern, as_text


def _text(*parts: Column | str) -> Column:
    return F.concat_ws(" ", *(p.cast("string") if isinstance(p, Column) else F.col(p).cast("string") for p in parts))


def created(path: str) -> pa.NativeFile:
    """A new file of a shared store by its URI, or of the machine by its path."""
    store, name = FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))
    store.create_dir(os.path.dirname(name), recursive=True)
    return store.open_output_stream(name)


def write_lines(lines: DataFrame, path: str, *order: str, single: bool = False) -> None:
    """The column ``value`` in the given order, as a folder of text parts; ``single`` writes one file by a single ordered stream through the driver."""
    if not single:
        (lines.orderBy(*order) if order else lines).select("value").write.mode("overwrite").text(path)
        return
    with created(path) as f:
        for row in (lines.orderBy(*order) if order else lines).select("value").toLocalIterator():
            f.write((row.value + "\n").encode())


def peregrine_edges(edges: DataFrame) -> DataFrame:
    """Lines ``src dst``, src < dst."""
    return edges.select("src", "dst", _text("src", "dst").alias("value"))


def peregrine_labels(vertices: DataFrame) -> DataFrame:
    """Lines ``v label``."""
    return vertices.select("v", _text("v", "label").alias("value"))


def pangolin_edges(edges: DataFrame) -> DataFrame:
    """Lines ``src dst``, numbered from 1."""
    return edges.select("src", "dst", _text(F.col("src") + 1, F.col("dst") + 1).alias("value"))


def with_labels(vertices: DataFrame, labels: int = 4, seed: int = 0) -> DataFrame:
    """``vertices(v)`` with a ``label`` from 0 to ``labels`` - 1 that vertex and seed fix."""
    return vertices.withColumn("label", F.pmod(F.xxhash64(F.lit(seed), "v"), F.lit(labels)).cast("int"))


def labelled_lines(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """``t``, ``v`` and ``e`` lines of the labelled format; ``vertices(v, label)``. Order by (kind, a, b)."""
    spark = edges.sparkSession
    n, m = vertices.count(), edges.count()
    head = spark.createDataFrame([(0, 0, 0, f"t {n} {m}")], "kind int, a bigint, b bigint, value string")
    deg = vertices.join(degrees(edges), "v", "left").select("v", "label", F.coalesce("deg", F.lit(0)).alias("deg"))
    vs = deg.select(F.lit(1).alias("kind"), F.col("v").alias("a"), F.lit(0).cast("bigint").alias("b"), _text(F.lit("v"), "v", "label", "deg").alias("value"))
    es = edges.select(F.lit(2).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), _text(F.lit("e"), "src", "dst").alias("value"))
    return head.union(vs).union(es)


def gsi_lines(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Lines of the ``.g`` format, all labels 1. Order by (kind, a, b)."""
    spark = edges.sparkSession
    n, m = vertices.count(), edges.count()
    fixed = spark.createDataFrame([(0, 0, 0, "t # 0"), (0, 1, 0, f"{n} {m} 1 1"), (3, 0, 0, "t # -1")], "kind int, a bigint, b bigint, value string")
    vs = vertices.select(F.lit(1).alias("kind"), F.col("v").alias("a"), F.lit(0).cast("bigint").alias("b"), _text(F.lit("v"), "v", F.lit(1)).alias("value"))
    es = edges.select(F.lit(2).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), _text(F.lit("e"), "src", "dst", F.lit(1)).alias("value"))
    return fixed.union(vs).union(es)


def adjacency_lines(edges: DataFrame, vertices: int | None = None) -> DataFrame:
    """Line v has the neighbours of v, blank for none, for v from 0 to ``vertices`` - 1 (to the largest id if not given)."""
    adj = adjacency(edges).select("v", "nbrs")
    n = vertices if vertices is not None else (adj.agg(F.max("v")).first()[0] or -1) + 1
    every = edges.sparkSession.range(n).select(F.col("id").alias("v"))
    return every.join(adj, "v", "left").select("v", F.coalesce(F.array_join(F.transform("nbrs", lambda x: x.cast("string")), " "), F.lit("")).alias("value"))


def adjacency_lines_with_ids(edges: DataFrame) -> DataFrame:
    """Lines ``v length<TAB>n1 n2 ...``."""
    adj = adjacency(edges)
    return adj.select("v", F.concat(_text("v", "deg"), F.lit("\t"), F.array_join(F.transform("nbrs", lambda x: x.cast("string")), " ")).alias("value"))


def set_lines(sets: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Lines ``k v1 ... vk``; with ``ids(v, id)`` the members are given as the v of their id."""
    if ids is not None:
        keyed = sets.withColumn("_set", F.xxhash64("members")).select("_set", F.posexplode("members").alias("_at", "id")).join(ids.select("v", "id"), "id")
        sets = keyed.groupBy("_set").agg(F.array_sort(F.collect_list("v")).alias("members"))
    return sets.select("members", F.concat_ws(" ", F.size("members").cast("string"), F.array_join(F.transform("members", lambda x: x.cast("string")), " ")).alias("value"))


def part_lines(parts: DataFrame, column: str = "part") -> DataFrame:
    """Line v has the part of vertex v."""
    return parts.select("v", F.col(column).cast("string").alias("value"))


def write_bins(bins: DataFrame, path: str) -> None:
    """A bin map: the number of bins, then the bin of each vertex, a line each."""
    n = bins.select("bin").distinct().count()
    with created(path) as f:
        f.write(f"{n}\n".encode())
        for row in bins.orderBy("v").select("bin").toLocalIterator():
            f.write(f"{row.bin}\n".encode())


def bin_statistics(bins: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines ``view bin id: i, sources: n, total size: s``. Order by bin."""
    per = bins.join(degrees(edges), "v").groupBy("bin").agg(F.count("*").alias("n"), F.sum("deg").alias("s"))
    return per.select("bin", F.format_string("view bin id: %d, sources: %d, total size: %d", "bin", "n", "s").alias("value"))


def degree_json(edges: DataFrame, least_max: int = 10) -> str | None:
    """``{"degree": vertices}`` as JSON; None unless some degree is above ``least_max``."""
    rows = {r.deg: r.vertices for r in degree_histogram(edges).collect()}
    return json.dumps({str(d): rows[d] for d in sorted(rows)}) if rows and max(rows) > least_max else None


def _chunks(values: Iterator[int], kind: str, at_once: int = 1_000_000) -> Iterator[np.ndarray]:
    while len(part := np.fromiter(islice(values, at_once), np.int64)):
        yield part.astype(kind)


def _degree_stream(edges: DataFrame, vertices: int) -> Iterator[int]:
    """The degree of each vertex from 0 to ``vertices`` - 1, in order."""
    every = edges.sparkSession.range(vertices).select(F.col("id").alias("v"))
    for row in every.join(degrees(edges), "v", "left").orderBy("v").select(F.coalesce("deg", F.lit(0)).alias("deg")).toLocalIterator(prefetchPartitions=True):
        yield row.deg


def _write_offsets(f: pa.NativeFile, edges: DataFrame, vertices: int) -> None:
    for part in _chunks(accumulate(_degree_stream(edges, vertices), initial=0), "<u8"):
        f.write(part.tobytes())


def _write_neighbours(f: pa.NativeFile, edges: DataFrame) -> None:
    stream = (row.dst for row in arcs(edges).orderBy("src", "dst").toLocalIterator(prefetchPartitions=True))
    for part in _chunks(stream, "<u4"):
        f.write(part.tobytes())


def _numbers(kind: str, *values: int) -> bytes:
    return np.array(values, dtype=kind).tobytes()


def write_csr(edges: DataFrame, path: str, vertices: int, variant: str = "offsets") -> None:
    """The binary file of densely numbered normalised edges, in one of the layouts of ``read_csr``. Streams through the driver, which holds no more than a part."""
    arc_count = 2 * edges.count()
    with created(path) as f:
        if variant == "offsets":
            f.write(_numbers("<u8", 4, 8, vertices, arc_count))
            _write_offsets(f, edges, vertices)
        else:
            f.write(_numbers("<u4", 4, vertices, arc_count))
            for part in _chunks(_degree_stream(edges, vertices), "<u4"):
                f.write(part.tobytes())
        _write_neighbours(f, edges)


def write_gamma(edges: DataFrame, base: str, vertices: int) -> None:
    """``base``.col (u32 vertices, u64 offsets), .dst (u64 arcs, u32 neighbours) and .vlabel (u32 vertices, bytes of 1)."""
    with created(f"{base}.col") as f:
        f.write(_numbers("<u4", vertices))
        _write_offsets(f, edges, vertices)
    with created(f"{base}.dst") as f:
        f.write(_numbers("<u8", 2 * edges.count()))
        _write_neighbours(f, edges)
    with created(f"{base}.vlabel") as f:
        f.write(_numbers("<u4", vertices))
        for at in range(0, vertices, 1_000_000):
            f.write(b"\x01" * min(1_000_000, vertices - at))


def write_degrees(edges: DataFrame, path: str, vertices: int) -> None:
    """The degree cache: u64 vertices, u64 degrees."""
    with created(path) as f:
        f.write(_numbers("<u8", vertices))
        for part in _chunks(_degree_stream(edges, vertices), "<u8"):
            f.write(part.tobytes())


def write_pattern(p: Pattern, path: str) -> None:
    with created(path) as f:
        f.write(as_text(p).encode())


def write_table(df: DataFrame, path: str, *partition_by: str) -> None:
    """The native sink."""
    df.write.mode("overwrite").parquet(path, partitionBy=list(partition_by) or None)
