"""Queries of the readers and writers: the edge records go to a file of each format in the shared folder and come back."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph, match, sets
from graphloom.plans.pattern import PRESETS, preset
from graphloom.sources import readers, writers
from graphloom.tables import load, shared_folder, written

Query = Callable[[SparkSession, str], DataFrame]

#: Kernels that are read of the kernel file.
KERNELS = 10
#: The pattern that is written.
PATTERN = 14


def _path(spark: SparkSession, suffix: str) -> str:
    """A new name in the shared folder."""
    return os.path.join(shared_folder(spark), f"file-{uuid.uuid4().hex}{suffix}")


def _numbered_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The edge records as normalised edges, numbered densely, and the number of vertices."""
    edges = written(graph.preprocessed(load(spark, sf_dir, "edges", "src", "dst")))
    return edges, (edges.agg(F.max("dst")).first()[0] or -1) + 1


def _vertices(spark: SparkSession, n: int, **columns: Column) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("v"), *(c.alias(name) for name, c in columns.items()))


def _lines(lines: DataFrame, *order: str) -> str:
    path = _path(lines.sparkSession, ".txt")
    writers.write_lines(lines, path, *order)
    return path


def _edge_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.edges_norm(load(spark, sf_dir, "edges", "src", "dst"))
    return readers.read_graph(spark, _lines(writers.peregrine_edges(edges)))


def _one_based(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_graph(spark, _lines(writers.pangolin_edges(_numbered_edges(spark, sf_dir)[0])))


def _csr(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, n = _numbered_edges(spark, sf_dir)
    path = _path(spark, ".bin")
    writers.write_csr(edges, path, n)
    return readers.read_graph(spark, path)


def _csr_of_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, n = _numbered_edges(spark, sf_dir)
    path = _path(spark, ".bin")
    writers.write_csr(edges, path, n, "degrees")
    return graph.edges_norm(readers.read_csr(spark, path, "degrees"))


def _gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, n = _numbered_edges(spark, sf_dir)
    path = _path(spark, "")
    writers.write_gamma(edges, path, n)
    return graph.edges_norm(readers.read_gamma(spark, path))


def _labelled(spark: SparkSession, sf_dir: str) -> str:
    edges, n = _numbered_edges(spark, sf_dir)
    return _lines(writers.labelled_lines(edges, _vertices(spark, n, label=(F.col("id") % 5).cast("int"))), "kind", "a", "b")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, n = _numbered_edges(spark, sf_dir)
    path = _lines(writers.peregrine_labels(_vertices(spark, n, label=F.col("id") % 5)))
    return readers.read_edge_list(spark, path, shift=False).select(F.col("src").alias("v"), F.col("dst").alias("label"))


def _gsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, n = _numbered_edges(spark, sf_dir)
    path = _lines(writers.gsi_lines(edges, _vertices(spark, n)), "kind", "a", "b")
    return readers.numbered_lines(spark, path).select("line_no", "value")


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _ = _numbered_edges(spark, sf_dir)
    return readers.read_tokens(spark, _lines(writers.peregrine_edges(edges), "src", "dst"))


def _adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, n = _numbered_edges(spark, sf_dir)
    return readers.read_graph(spark, _lines(writers.adjacency_lines(edges, n), "v"), "adj")


def _adjacency_with_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _ = _numbered_edges(spark, sf_dir)
    return graph.edges_norm(readers.arcs_of(readers.read_adjacency_with_ids(spark, _lines(writers.adjacency_lines_with_ids(edges)))))


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = load(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_returnflag").where(F.col("l_returnflag") == "R")
    of_order = sets.dedup_sets(x.groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("members")))
    return sets.member_text(readers.read_sets(spark, _lines(writers.set_lines(of_order))))


def _kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _ = _numbered_edges(spark, sf_dir)
    found = match.triangles(edges).select(F.array("a", "b", "c").alias("members"))
    kernels = readers.read_sets(spark, _lines(writers.set_lines(found), "members"), first=KERNELS)
    return kernels.select("set_id", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, n = _numbered_edges(spark, sf_dir)
    return readers.read_parts(spark, _lines(writers.part_lines(_vertices(spark, n, part=F.col("id") % 7)), "v"))


def _bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, n = _numbered_edges(spark, sf_dir)
    path = _path(spark, ".vbmap")
    writers.write_bins(_vertices(spark, n, bin=F.col("id") % 7), path)
    return readers.read_parts(spark, path, with_count=True)


def _bin_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, n = _numbered_edges(spark, sf_dir)
    path = _lines(writers.bin_statistics(_vertices(spark, n, bin=F.col("id") % 7), edges), "bin")
    return readers.numbered_lines(spark, path).select("line_no", "value")


def _degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, n = _numbered_edges(spark, sf_dir)
    path = _path(spark, ".deg")
    writers.write_degrees(edges, path, n)
    return readers.read_degrees(spark, path)


def _degree_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _ = _numbered_edges(spark, sf_dir)
    return spark.createDataFrame([(writers.degree_json(edges),)], "json string")


def _pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, ".graph")
    writers.write_pattern(preset(PATTERN), path)
    return readers.read_labelled(spark, path)[1]


def _in_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _ = _numbered_edges(spark, sf_dir)
    norm, histogram, vertices = readers.from_adjacency(graph.adjacency(edges))
    return histogram.crossJoin(F.broadcast(norm.agg(F.count("*").alias("edges")))).crossJoin(F.broadcast(graph.label_counts(vertices).select("label", F.col("vertices").alias("labelled"))))


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _ = _numbered_edges(spark, sf_dir)
    path = _path(spark, ".parquet")
    writers.write_table(edges.withColumn("half", F.col("src") % 2), path, "half")
    return spark.read.parquet(path).select("src", "dst")


def queries() -> dict[str, Query]:
    return {
        "io_edge_list": _edge_list,
        "io_one_based": _one_based,
        "io_csr": _csr,
        "io_csr_of_degrees": _csr_of_degrees,
        "io_gamma": _gamma,
        "io_labelled_vertices": lambda s, d: readers.read_labelled(s, _labelled(s, d))[0],
        "io_labelled_edges": lambda s, d: readers.read_graph(s, _labelled(s, d), "graph"),
        "io_labels": _labels,
        "io_gsi": _gsi,
        "io_tokens": _tokens,
        "io_adjacency": _adjacency,
        "io_adjacency_with_ids": _adjacency_with_ids,
        "io_sets": _sets,
        "io_kernels": _kernels,
        "io_parts": _parts,
        "io_bins": _bins,
        "io_bin_statistics": _bin_statistics,
        "io_degrees": _degrees,
        "io_degree_json": _degree_json,
        "io_pattern": _pattern,
        "io_in_memory": _in_memory,
        "io_table": _table,
    }


_E = """WITH g AS MATERIALIZED (SELECT DISTINCT least(src, dst) AS s, greatest(src, dst) AS d FROM edges WHERE src <> dst),
arc AS MATERIALIZED (SELECT s, d FROM g UNION ALL SELECT d, s FROM g),
n AS MATERIALIZED (SELECT s AS old, count(*) AS deg, row_number() OVER (ORDER BY s) - 1 AS id FROM arc GROUP BY s),
e AS MATERIALIZED (SELECT a.id AS src, b.id AS dst FROM g JOIN n a ON a.old = s JOIN n b ON b.old = d)
"""
_SETS = "SELECT DISTINCT array_to_string(list_sort(list_distinct(list(l_partkey))), ',') AS members FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey"


def oracle_sql() -> dict[str, str]:
    same = _E + "SELECT src, dst FROM e"
    values = ", ".join(f"({a}, {b})" for a, b in (pair.split("-") for pair in PRESETS[PATTERN][1].split()))
    return {
        "io_edge_list": _E + "SELECT s - low AS src, d - low AS dst FROM g, (SELECT min(s) AS low FROM g)",
        **dict.fromkeys(("io_one_based", "io_csr", "io_csr_of_degrees", "io_gamma", "io_labelled_edges", "io_adjacency", "io_adjacency_with_ids", "io_table"), same),
        "io_labelled_vertices": _E + "SELECT id AS v, CAST(id % 5 AS INTEGER) AS label, deg FROM n",
        "io_labels": _E + "SELECT id AS v, id % 5 AS label FROM n",
        "io_gsi": _E + """, line AS (SELECT 0 AS kind, 0 AS a, 0 AS b, 't # 0' AS value UNION ALL SELECT 0, 1, 0, (SELECT count(*) FROM n) || ' ' || (SELECT count(*) FROM e) || ' 1 1'
UNION ALL SELECT 1, id, 0, 'v ' || id || ' 1' FROM n UNION ALL SELECT 2, src, dst, 'e ' || src || ' ' || dst || ' 1' FROM e UNION ALL SELECT 3, 0, 0, 't # -1')
SELECT row_number() OVER (ORDER BY kind, a, b) - 1 AS line_no, value FROM line""",
        "io_tokens": _E + """, place AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) AS i FROM e),
first AS (SELECT id, row_number() OVER (ORDER BY min(pos)) - 1 AS new FROM (SELECT src AS id, 2 * i AS pos FROM place UNION ALL SELECT dst, 2 * i + 1 FROM place) GROUP BY id)
SELECT a.new AS src, b.new AS dst FROM e JOIN first a ON a.id = src JOIN first b ON b.id = dst""",
        "io_sets": _SETS,
        "io_kernels": _E + f""", t AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON y.src = x.dst JOIN e z ON z.src = x.src AND z.dst = y.dst)
SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS set_id, concat_ws(',', a, b, c) AS members FROM t ORDER BY a, b, c LIMIT {KERNELS}""",
        **dict.fromkeys(("io_parts", "io_bins"), _E + "SELECT id AS v, CAST(id % 7 AS INTEGER) AS part FROM n"),
        "io_bin_statistics": _E + "SELECT id % 7 AS line_no, 'view bin id: ' || id % 7 || ', sources: ' || count(*) || ', total size: ' || CAST(sum(deg) AS BIGINT) AS value FROM n GROUP BY id % 7",
        "io_degrees": _E + "SELECT id AS v, deg FROM n",
        "io_degree_json": _E + "SELECT '{' || string_agg('\"' || deg || '\": ' || k, ', ' ORDER BY deg) || '}' AS json FROM (SELECT deg, count(*) AS k FROM n GROUP BY deg)",
        "io_pattern": f"SELECT CAST(a AS BIGINT) AS src, CAST(b AS BIGINT) AS dst FROM (VALUES {values}) x(a, b)",
        "io_in_memory": _E + "SELECT deg, count(*) AS vertices, (SELECT count(*) FROM e) AS edges, 0 AS label, (SELECT count(*) FROM n) AS labelled FROM n GROUP BY deg",
    }
