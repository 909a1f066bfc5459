import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import cluster, graph
from graphloom.plans.pattern import preset
from graphloom.sources import readers, writers

EDGES = {(0, 1), (0, 2), (1, 2), (2, 3), (4, 5)}


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(sorted(EDGES), "src long, dst long")


def rows(df):
    return {tuple(r) for r in df.collect()}


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_edge_list(spark, tmp_path):
    path = put(tmp_path, "g.txt", "# c\n\n10 11\n11\t10\n10 10\n12  10\nx 1 2\n")
    assert rows(readers.read_edge_list(spark, path)) == {(0, 1), (1, 0), (0, 0), (2, 0)}
    assert rows(readers.read_graph(spark, path)) == {(0, 1), (0, 2)}
    assert rows(readers.read_edge_list(spark, path, shift=False)) >= {(10, 11)}


def test_numbered_lines_over_splits(spark, tmp_path):
    path = put(tmp_path, "l.txt", "".join(f"line {i}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = readers.numbered_lines(spark, path)
        assert got.rdd.getNumPartitions() > 1
        assert got.where(F.concat(F.lit("line "), F.col("line_no").cast("string")) != F.col("value")).count() == 0
        assert got.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csr_round_trip(spark, tmp_path, edges):
    path = str(tmp_path / "g.bin")
    writers.write_csr(edges, path, 7)
    assert np.fromfile(path, "<u8", 4).tolist() == [4, 8, 7, 10]
    for piece in (2, 1 << 20):
        assert rows(readers.read_csr(spark, path, piece=piece)) == EDGES | {(b, a) for a, b in EDGES}
    assert rows(readers.read_graph(spark, path)) == EDGES
    (tmp_path / "bad.bin").write_bytes((tmp_path / "g.bin").read_bytes() + b"x")
    with pytest.raises(ValueError):
        readers.read_csr(spark, str(tmp_path / "bad.bin"))


def test_csr_with_degrees(spark, tmp_path):
    near = {0: [1, 2], 1: [0], 2: [0], 3: []}
    path = str(tmp_path / "old.bin")
    with open(path, "wb") as f:
        np.array([4, 4, 4, *map(len, near.values()), *(w for n in near.values() for w in n)], dtype="<u4").tofile(f)
    for piece in (1, 3, 100):
        assert rows(readers.read_csr(spark, path, "degrees", piece)) == {(0, 1), (0, 2), (1, 0), (2, 0)}


def test_labelled(spark, tmp_path, edges):
    vertices = writers.with_labels(graph.degrees(edges).select("v"), 4, 1)
    path = str(tmp_path / "g.graph")
    writers.write_lines(writers.labelled_lines(edges, vertices), path, "kind", "a", "b", single=True)
    first = open(path).read().splitlines()
    assert first[0] == "t 6 5" and first[1].startswith("v 0 ") and first[-1] == "e 4 5"
    v, e = readers.read_labelled(spark, path)
    assert rows(v.select("v", "label")) == rows(vertices) and rows(e) == EDGES == rows(readers.read_graph(spark, path))
    assert {r.label for r in v.collect()} <= {0, 1, 2, 3}


def test_tokens(spark, tmp_path):
    path = put(tmp_path, "g.lvid", "c 9 9\n7,8;7\n\n5 8 07 8\n5\n")
    # tokens 7 8 7 5 8 07 8 5 get the ids 0 1 0 2 1 3 1 2
    assert sorted(map(tuple, readers.read_tokens(spark, path).collect())) == [(0, 1), (0, 2), (1, 2), (1, 3)]


def test_adjacency_texts(spark, tmp_path, edges):
    path = str(tmp_path / "g_q")
    writers.write_lines(writers.adjacency_lines(edges, 7), path, "v", single=True)
    assert open(path).read() == "1 2\n0 2\n0 1 3\n2\n5\n4\n\n"
    assert rows(readers.read_graph(spark, path)) == EDGES
    assert {r.v: r.nbrs for r in readers.read_adjacency(spark, path).collect()}[6] == []
    loops = put(tmp_path, "h_q", "0 2 1 1\n\n")
    assert [r.nbrs for r in readers.read_adjacency(spark, loops).orderBy("v").collect()] == [[1, 1, 2], []]
    path = str(tmp_path / "ids.adj")
    writers.write_lines(writers.adjacency_lines_with_ids(edges), path, "v", single=True)
    assert open(path).read().splitlines()[2] == "2 3\t0 1 3"
    assert rows(graph.edges_norm(readers.arcs_of(readers.read_adjacency_with_ids(spark, path)))) == EDGES
    norm, histogram, labels = readers.from_adjacency(graph.adjacency(edges))
    assert rows(norm) == EDGES and rows(histogram) == {(1, 3), (2, 2), (3, 1)} and {r.label for r in labels.collect()} == {0}


def test_sets(spark, tmp_path):
    path = put(tmp_path, "s.txt", "3 5 6 7\n2 8 9 10\n\n0\n")
    assert [(r.set_id, r.members) for r in readers.read_sets(spark, path).orderBy("set_id").collect()] == [(0, [5, 6, 7]), (1, [8, 9]), (3, [])]
    assert readers.read_sets(spark, path, first=1).count() == 1
    assert readers.read_sets(spark, put(tmp_path, "none.txt", "")).count() == 0
    lines = writers.set_lines(readers.read_sets(spark, path).select("members"))
    assert {r.value.strip() for r in lines.collect()} == {"3 5 6 7", "2 8 9", "0"}
    ids = spark.createDataFrame([(50, 5), (40, 6), (70, 7)], "v long, id long")
    assert [r.value for r in writers.set_lines(spark.createDataFrame([([5, 6, 7],)], "members array<long>"), ids).collect()] == ["3 40 50 70"]


def test_parts_and_bins(spark, tmp_path, edges):
    parts = spark.createDataFrame([(v, v % 3) for v in range(6)], "v long, part int")
    path = str(tmp_path / "p.4")
    writers.write_lines(writers.part_lines(parts), path, "v", single=True)
    assert rows(readers.read_parts(spark, path)) == rows(parts)
    bins = parts.withColumnRenamed("part", "bin")
    writers.write_bins(bins, str(tmp_path / "p.vbmap"))
    assert open(tmp_path / "p.vbmap").read().splitlines()[0] == "3"
    assert rows(readers.read_parts(spark, str(tmp_path / "p.vbmap"), with_count=True)) == rows(parts)
    assert writers.bin_statistics(bins, edges).orderBy("bin").first().value == "view bin id: 0, sources: 2, total size: 3"


def test_degrees(spark, tmp_path, edges):
    writers.write_degrees(edges, str(tmp_path / "d.bin"), 7)
    assert rows(readers.read_degrees(spark, str(tmp_path / "d.bin"))) == rows(graph.degrees(edges)) | {(6, 0)}


def test_other_formats(spark, tmp_path, edges):
    vertices = graph.degrees(edges).select("v")
    assert {r.value for r in writers.peregrine_edges(edges).collect()} == {f"{a} {b}" for a, b in EDGES}
    assert {r.value for r in writers.pangolin_edges(edges).collect()} == {f"{a + 1} {b + 1}" for a, b in EDGES}
    assert "3 0" in {r.value for r in writers.peregrine_labels(vertices.withColumn("label", F.lit(0))).collect()}
    lines = [r.value for r in writers.gsi_lines(edges, vertices).orderBy("kind", "a", "b").collect()]
    assert lines[:3] == ["t # 0", "6 5 1 1", "v 0 1"] and lines[-2:] == ["e 4 5 1", "t # -1"]
    writers.write_gamma(edges, str(tmp_path / "g"), 6)
    assert np.fromfile(tmp_path / "g.dst", "<u8", 1)[0] == 10 and np.fromfile(tmp_path / "g.vlabel", "u1")[4:].tolist() == [1] * 6
    assert np.fromfile(tmp_path / "g.col", "<u8", offset=4)[-1] == 10
    assert writers.degree_json(edges) is None
    assert json.loads(writers.degree_json(edges, 2)) == {"1": 3, "2": 2, "3": 1}
    writers.write_pattern(preset(0), str(tmp_path / "q.txt"))
    assert open(tmp_path / "q.txt").read().startswith("t 3 3\nv 0 0 2")
    writers.write_lines(writers.peregrine_edges(edges), str(tmp_path / "folder"), "src", "dst")
    assert spark.read.text(str(tmp_path / "folder")).count() == 5
    writers.write_table(edges, str(tmp_path / "t"))
    assert rows(spark.read.parquet(str(tmp_path / "t"))) == EDGES


def test_unknown_kind(spark):
    with pytest.raises(ValueError):
        readers.read_graph(spark, "x.unknown")


@pytest.fixture(scope="module")
def two_groups(spark):
    pairs = {(a, b) for base in (0, 10) for a in range(base, base + 6) for b in range(a + 1, base + 6)} | {(5, 10)}
    return spark.createDataFrame(sorted(pairs), "src long, dst long")


def test_kmeans(two_groups):
    got = {r.v: r.cluster for r in cluster.kmeans(two_groups, 2, 10).collect()}
    assert len({got[v] for v in range(6)}) == 1 and len({got[v] for v in range(10, 16)}) == 1 and got[0] != got[15]
    assert rows(cluster.kmeans(two_groups, "2x2", 5)) == rows(cluster.kmeans(two_groups, "2^2", 5))
    stats = cluster.cluster_statistics(cluster.kmeans(two_groups, 2, 10, spread=False)).collect()
    assert sum(r.vertices for r in stats) == 12 and all(0 <= r.avg_sim <= 1.0000001 for r in stats)
    assert cluster.levels_of("4x2") == [4, 2] and cluster.levels_of("3^2") == [3, 3]


def test_fennel(two_groups):
    parts = cluster.fennel(two_groups, 2)
    got = {r.v: r.part for r in parts.collect()}
    assert len(got) == 12 and len({got[v] for v in range(6)}) == 1 and got[0] != got[15]
    assert tuple(cluster.cut_edges(two_groups, parts).first()) == (1, 31)
    assert cluster.fennel(two_groups, 2, hops=2).count() == 12
    assert cluster.fennel(two_groups.where("false"), 2).count() == 0


def test_view_bins(two_groups):
    parts = graph.degrees(two_groups).select("v", F.lit(0).alias("part"))
    packed = {r.v: r.bin for r in cluster.view_bins(two_groups, parts, 40).collect()}
    assert len(packed) == 12 and len(set(packed.values())) >= 2
    assert {r.bin for r in cluster.view_bins(two_groups, parts, 10_000).collect()} == {0}
    assert sum(r.vertices for r in cluster.bin_loads(two_groups, cluster.view_bins(two_groups, parts, 40, by_degree=True)).collect()) == 12
    one = graph.degrees(two_groups).select("v", F.lit(0).alias("bin"))
    split = cluster.split_bins(two_groups, one, 2)
    assert split.count() == 12 and split.select("bin").distinct().count() == 2
