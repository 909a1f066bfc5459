"""Readers of graph files. Text is read in splits; binary files in slices of their arrays."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.graph import edges_norm


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, value)``, from 0, in the order of the file (of several files by their names).

    The lines of a split are contiguous in a task, so a number is the lines in the
    splits before plus the place in the split; only one row per split is ordered.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    splits = lines.groupBy("_f", "_b").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(splits.select("_f", "_b", "_first", before.alias("_before")), ["_f", "_b"]).select((F.col("_before") + F.col("_i") - F.col("_first")).alias("line_no"), "value")


def read_edge_list(spark: SparkSession, path: str, shift: bool = True) -> DataFrame:
    """``(src, dst)`` as given, of lines that start with a digit; ids less the smallest one if ``shift``."""
    parts = F.split("value", r"\s+")
    pairs = spark.read.text(path).where(F.col("value").rlike(r"^[0-9]+\s+[0-9]+")).select(parts[0].cast("bigint").alias("src"), parts[1].cast("bigint").alias("dst"))
    if not shift:
        return pairs
    least = pairs.agg(F.min(F.least("src", "dst"))).first()[0] or 0
    return pairs.select((F.col("src") - least).alias("src"), (F.col("dst") - least).alias("dst"))


def opened(path: str) -> pa.NativeFile:
    """A file of a shared store by its URI, or of the machine by its path."""
    store, name = FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))
    return store.open_input_file(name)


def _numbers(f: pa.NativeFile, kind: str, count: int, at: int) -> np.ndarray:
    """``count`` whole numbers from byte ``at`` on."""
    return np.frombuffer(f.read_at(count * np.dtype(kind).itemsize, at), kind).astype(np.int64)


def _ranges(n: int, piece: int) -> list[tuple[int, int]]:
    return [(a, min(n, a + piece)) for a in range(0, n, piece)] or [(0, 0)]


def _lists(spark: SparkSession, n: int, piece: int, ranges: DataFrame, offsets_of: Callable[[dict], np.ndarray], cols: str, cols_at: int) -> DataFrame:
    """``(src, dst)`` of lists laid end to end as u32 from byte ``cols_at`` of the file ``cols``; a task reads the lists of ``piece`` vertices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["a"] == row["b"]:
                    continue
                off = offsets_of(row)
                src = np.repeat(np.arange(row["a"], row["b"]), np.diff(off))
                with opened(cols) as f:
                    for at in range(0, len(src), READ_AT_ONCE):
                        dst = _numbers(f, "<u4", min(READ_AT_ONCE, len(src) - at), cols_at + 4 * (int(off[0]) + at))
                        yield pa.RecordBatch.from_arrays([pa.array(src[at : at + READ_AT_ONCE]), pa.array(dst)], ["src", "dst"])

    return ranges.repartition(max(1, min(4 * spark.sparkContext.defaultParallelism, n // piece + 1))).mapInArrow(run, "src bigint, dst bigint")


#: Numbers that a task reads at once.
READ_AT_ONCE = 100_000


def read_csr(spark: SparkSession, path: str, variant: str = "offsets", piece: int = 1 << 20) -> DataFrame:
    """``(src, dst)``: the arcs of a binary file, in a shared store or on this machine.

    ``offsets``: four u64 (4, 8, vertices, arcs), u64 offsets[vertices + 1], u32
    neighbours[arcs]. ``degrees``: three u32 (any, vertices, arcs), u32 degrees[vertices], u32
    neighbours[arcs]. A task reads the lists of ``piece`` vertices. Sizes that
    don't fit are an error.
    """
    by_offset = variant == "offsets"
    head_kind, head = ("<u8", 4) if by_offset else ("<u4", 3)
    start = np.dtype(head_kind).itemsize * head
    with opened(path) as f:
        numbers = _numbers(f, head_kind, head, 0) if f.size() >= start else np.zeros(head, np.int64)
        n, m = (int(x) for x in numbers[-2:])
        cols_at = start + ((n + 1) * 8 if by_offset else n * 4)
        if f.size() != cols_at + m * 4 or (by_offset and numbers[:2].tolist() != [4, 8]):
            raise ValueError(f"{path} is no such file")
        ranges, base = [], 0
        for a, b in _ranges(n, piece):
            ranges.append((a, b, base))
            base += 0 if by_offset else int(_numbers(f, "<u4", b - a, start + 4 * a).sum())

    def offsets_of(row: dict) -> np.ndarray:
        a, b = row["a"], row["b"]
        with opened(path) as f:
            if by_offset:
                return _numbers(f, "<u8", b - a + 1, start + 8 * a)
            return row["base"] + np.concatenate([[0], np.cumsum(_numbers(f, "<u4", b - a, start + 4 * a))])

    return _lists(spark, n, piece, spark.createDataFrame(ranges, "a bigint, b bigint, base bigint"), offsets_of, path, cols_at)


def read_gamma(spark: SparkSession, base: str, piece: int = 1 << 20) -> DataFrame:
    """``(src, dst)``: the arcs of ``base``.col (u32 vertices, u64 offsets) and ``base``.dst (u64 arcs, u32 neighbours)."""
    with opened(f"{base}.col") as f:
        n = int(_numbers(f, "<u4", 1, 0)[0])

    def offsets_of(row: dict) -> np.ndarray:
        with opened(f"{base}.col") as f:
            return _numbers(f, "<u8", row["b"] - row["a"] + 1, 4 + 8 * row["a"])

    return _lists(spark, n, piece, spark.createDataFrame(_ranges(n, piece), "a bigint, b bigint"), offsets_of, f"{base}.dst", 8)


def read_labelled(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``vertices(v, label, deg)`` and ``edges(src, dst)`` of lines ``v id label degree`` and ``e a b``."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("t"))
    vertices = lines.where(F.col("t")[0] == "v").select(F.col("t")[1].cast("bigint").alias("v"), F.col("t")[2].cast("int").alias("label"), F.col("t")[3].cast("bigint").alias("deg"))
    edges = lines.where(F.col("t")[0] == "e").select(F.col("t")[1].cast("bigint").alias("src"), F.col("t")[2].cast("bigint").alias("dst"))
    return vertices, edges


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(src, dst)`` of a token list: in lines that start with a digit every run of digits is a token, two in a row are an edge; ids 0, 1, ... by first appearance. Tokens that differ in leading zeros differ."""
    lines = numbered_lines(spark, path).where(F.col("value").rlike("^[0-9]"))
    tokens = lines.select("line_no", F.posexplode(F.regexp_extract_all("value", F.lit("[0-9]+"), F.lit(0))).alias("at", "token"))
    counts = tokens.groupBy("line_no").agg(F.count("*").alias("_n"))
    # a line's number of tokens before it decides which of its tokens are first ends
    blocks = counts.withColumn("_block", F.shiftright("line_no", 12))
    sums = blocks.groupBy("_block").agg(F.sum("_n").alias("_m"))
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_block", F.coalesce(F.sum("_m").over(ahead(Window.orderBy("_block"))), F.lit(0)).alias("_a"))
    before = blocks.join(base, "_block").select("line_no", (F.col("_a") + F.coalesce(F.sum("_n").over(ahead(Window.partitionBy("_block").orderBy("line_no"))), F.lit(0))).alias("_before"))
    placed = tokens.join(before, "line_no").select((F.col("_before") + F.col("at")).alias("pos"), "token")
    from graphloom.operators.graph import numbered

    ids = numbered(placed.groupBy("token").agg(F.min("pos").alias("first")), "first", "id").select("token", "id")
    ends = placed.join(ids, "token").select(F.floor(F.col("pos") / 2).alias("edge"), (F.col("pos") % 2).alias("side"), "id")
    return ends.groupBy("edge").agg(F.max(F.when(F.col("side") == 0, F.col("id"))).alias("src"), F.max(F.when(F.col("side") == 1, F.col("id"))).alias("dst")).where(F.col("dst").isNotNull()).select("src", "dst")


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """``(v, nbrs)``: line i has the neighbours of vertex i, a blank line none; lists sorted, loops dropped, nothing else changed."""
    found = F.transform(F.regexp_extract_all("value", F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("bigint"))
    return numbered_lines(spark, path).select(F.col("line_no").alias("v"), F.array_sort(F.filter(found, lambda x: x != F.col("line_no"))).alias("nbrs"))


def read_adjacency_with_ids(spark: SparkSession, path: str) -> DataFrame:
    """``(v, nbrs)`` of lines ``id length<TAB>n1 n2 ...``."""
    number = lambda x: x.cast("bigint")
    found = F.regexp_extract_all(F.substring_index("value", "\t", -1), F.lit("[0-9]+"), F.lit(0))
    return spark.read.text(path).where(F.col("value").contains("\t")).select(F.split("value", r"\s+")[0].cast("bigint").alias("v"), F.transform(found, number).alias("nbrs"))


def read_sets(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """``(set_id, members)`` of lines ``k v1 ... vk``; set_id is the line's number; with ``first`` only the first so many lines (a kernel file)."""
    lines = numbered_lines(spark, path)
    if first is not None:
        lines = lines.where(F.col("line_no") < first)
    found = F.transform(F.regexp_extract_all("value", F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("bigint"))
    rows = lines.select("line_no", found.alias("t")).where(F.size("t") > 0)
    return rows.select(F.col("line_no").alias("set_id"), F.slice("t", 2, F.greatest(F.element_at("t", 1).cast("int"), F.lit(0))).alias("members"))


def read_parts(spark: SparkSession, path: str, with_count: bool = False) -> DataFrame:
    """``(v, part)``: line i has the part of vertex i; with ``with_count`` the first line is the number of parts."""
    skip = int(with_count)
    return numbered_lines(spark, path).where((F.col("line_no") >= skip) & F.col("value").rlike("[0-9]")).select((F.col("line_no") - skip).alias("v"), F.trim("value").cast("int").alias("part"))


def read_degrees(spark: SparkSession, path: str) -> DataFrame:
    """``(v, deg)`` of a degree cache: u64 vertices, u64 degrees[vertices]."""
    with opened(path) as f:
        n = int(_numbers(f, "<u8", 1, 0)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with opened(path) as f:
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), pa.array(_numbers(f, "<u8", b - a, 8 * (a + 1)))], ["v", "deg"])

    return spark.createDataFrame(_ranges(n, READ_AT_ONCE), "a bigint, b bigint").mapInArrow(run, "v bigint, deg bigint")


def arcs_of(adj: DataFrame) -> DataFrame:
    """Neighbour lists ``(v, nbrs)`` as ``(src, dst)``."""
    return adj.select(F.col("v").alias("src"), F.explode("nbrs").alias("dst"))


def read_graph(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Normalised edges ``(src, dst)``, src < dst, of a file of the kind its suffix names: bin, graph, txt, lvid, adj; a name that ends in _q is adjacency text."""
    kind = kind or ("adj" if path.endswith("_q") else path.rsplit(".", 1)[-1])
    if kind == "bin":
        raw = read_csr(spark, path)
    elif kind == "graph":
        raw = read_labelled(spark, path)[1]
    elif kind == "txt":
        raw = read_edge_list(spark, path)
    elif kind == "lvid":
        raw = read_tokens(spark, path)
    elif kind == "adj":
        raw = arcs_of(read_adjacency(spark, path))
    else:
        raise ValueError(f"no reader for {kind!r}")
    return edges_norm(raw)


def from_adjacency(adj: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of a graph in memory ``(v, nbrs)`` its normalised edges, its degree histogram ``(deg, vertices)`` and its vertices ``(v, label)``, all of label 0."""
    histogram = adj.groupBy(F.size("nbrs").cast("bigint").alias("deg")).agg(F.count("*").alias("vertices"))
    return edges_norm(arcs_of(adj)), histogram, adj.select("v", F.lit(0).alias("label"))
