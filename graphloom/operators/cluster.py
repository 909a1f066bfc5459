"""Clustering and partitioning of the vertices of a graph."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.runs import runs
from graphloom.operators.graph import arcs, degrees
from graphloom.tables import forget, written

#: Similarities are compared after rounding, so that the order of a sum decides nothing.
DIGITS = 12


def levels_of(text: str) -> list[int]:
    """``4``, ``4x4`` or ``2^3``: the number of parts at each level."""
    if "^" in text:
        base, times = text.split("^")
        return [int(base)] * int(times)
    return [int(x) for x in text.split("x")]


def _vectors(edges: DataFrame) -> DataFrame:
    """``(v, idx, w)``: of each vertex the unit vector with the same weight at each neighbour."""
    deg = degrees(edges)
    return arcs(edges).select(F.col("src").alias("v"), F.col("dst").alias("idx")).join(deg, "v").select("v", "idx", (1 / F.sqrt("deg")).alias("w"))


def _similarity(vectors: DataFrame, placed: DataFrame, centroids: DataFrame) -> DataFrame:
    """``(group, v, k, sim)`` of the vertices of a group and its centroids ``(group, k, idx, c)``, where not zero."""
    norm = centroids.groupBy("group", "k").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    dot = vectors.join(placed.select("group", "v"), "v").join(centroids, ["group", "idx"]).groupBy("group", "v", "k").agg(F.sum(F.col("w") * F.col("c")).alias("dot"))
    return dot.join(norm, ["group", "k"]).select("group", "v", "k", F.round(F.col("dot") / F.col("norm"), DIGITS).alias("sim"))


def _assigned(vectors: DataFrame, placed: DataFrame, centroids: DataFrame) -> DataFrame:
    """``(group, v, k, sim)``: the most similar centroid, of equals the one of lowest number; without any similarity number 0."""
    best = _similarity(vectors, placed, centroids).groupBy("group", "v").agg(F.max(F.struct("sim", (-F.col("k")).alias("minus"))).alias("m"))
    return placed.select("group", "v").join(best, ["group", "v"], "left").select("group", "v", F.coalesce(-F.col("m.minus"), F.lit(0)).cast("int").alias("k"), F.coalesce("m.sim", F.lit(0.0)).alias("sim"))


def _means(vectors: DataFrame, assigned: DataFrame) -> DataFrame:
    size = assigned.groupBy("group", "k").agg(F.count("*").alias("_n"))
    sums = vectors.join(assigned.select("group", "v", "k"), "v").groupBy("group", "k", "idx").agg(F.sum("w").alias("_s"))
    return sums.join(size, ["group", "k"]).select("group", "k", "idx", (F.col("_s") / F.col("_n")).alias("c"))


def _first_centroids(vectors: DataFrame, placed: DataFrame, deg: DataFrame, k: int, seed: int, spread: bool) -> DataFrame:
    """Seeded start: by hash of the vertex; or, ``spread``, one vertex by hash and then always the one least similar to the nearest chosen, of equals the one of larger degree, then the first."""
    by_hash = F.xxhash64(F.lit(seed), "v")
    if not spread:
        dealt = placed.select("group", "v", F.pmod(by_hash, F.lit(k)).cast("int").alias("k"))
        return written(_means(vectors, dealt))
    chosen = placed.groupBy("group").agg(F.min_by("v", F.struct(by_hash, "v")).alias("v")).select("group", "v", F.lit(0).alias("k"))
    chosen = written(chosen)
    centroids = written(chosen.join(vectors, "v").select("group", "k", "idx", F.col("w").alias("c")))
    near = None
    for i in range(1, k):
        new = _similarity(vectors, placed, centroids.where(F.col("k") == i - 1)).select("group", "v", F.col("sim").alias("_new"))
        old = placed.select("group", "v").withColumn("near", F.lit(0.0)) if near is None else near
        near = written(old.join(new, ["group", "v"], "left").select("group", "v", F.greatest("near", F.coalesce("_new", F.lit(0.0))).alias("near")))
        free = near.join(chosen.select("group", "v"), ["group", "v"], "left_anti").join(deg, "v")
        pick = free.groupBy("group").agg(F.min_by("v", F.struct("near", -F.col("deg"), "v")).alias("v")).select("group", "v", F.lit(i).alias("k"))
        chosen = written(chosen.union(pick))
        centroids = written(centroids.union(chosen.where(F.col("k") == i).join(vectors, "v").select("group", "k", "idx", F.col("w").alias("c"))))
    return centroids


def kmeans(edges: DataFrame, parts: str | int = 4, iterations: int = 20, seed: int = 0, spread: bool = True) -> DataFrame:
    """``(v, cluster, sim)``: k-means over neighbour vectors by cosine, at one level or several; empty clusters have no number.

    ``sim`` is the cosine to the own centroid at the last assignment. Each
    iteration is two joins on the vector index; no vector is gathered in one place.
    """
    deg = written(degrees(edges))
    vectors = written(_vectors(edges))
    placed = written(deg.select(F.lit(0).cast("bigint").alias("group"), "v"))
    out = placed.withColumn("sim", F.lit(0.0))
    for k in levels_of(str(parts)):
        centroids = _first_centroids(vectors, placed, deg, k, seed, spread)
        now = written(_assigned(vectors, placed, centroids))
        forget(centroids)
        for _ in range(iterations):
            means = written(_means(vectors, now))
            ahead = written(_assigned(vectors, placed, means))
            same = now.join(ahead, ["group", "v", "k"], "left_anti").isEmpty()
            forget(now, means)
            now = ahead
            if same:
                break
        out = now.select((F.col("group") * k + F.col("k")).alias("group"), "v", "sim")
        placed = written(out.select("group", "v"))
    used = out.select("group").distinct()
    names = used.select("group", (F.row_number().over(Window.orderBy("group")) - 1).cast("int").alias("cluster"))
    return out.join(names, "group").select("v", "cluster", "sim")


def cluster_statistics(clusters: DataFrame) -> DataFrame:
    """``(cluster, vertices, sum_sim, avg_sim)``."""
    return clusters.groupBy("cluster").agg(F.count("*").alias("vertices"), F.sum("sim").alias("sum_sim"), F.avg("sim").alias("avg_sim"))


def _in_order(rows: DataFrame, *by: str) -> DataFrame:
    """All rows in one stream, for algorithms that are defined by the order of the vertices."""
    return rows.repartition(1).sortWithinPartitions(*by)


def fennel(edges: DataFrame, parts: int = 4, hops: int = 1, balance: float = 1.1) -> DataFrame:
    """``(v, part)``: one pass over the vertices by id; each joins the part with most of its neighbours, less a charge that grows with the part.

    The charge is alpha * ((n+1)^1.5 - n^1.5) with alpha = sqrt(parts) * edges /
    vertices^1.5; parts above ``balance`` times their fair share take none; ties go to the lowest part. With two hops neighbours of
    neighbours count too, as often as they are met. The pass depends on its order,
    so it is one task; that holds one number per vertex and streams the arcs.
    """
    both = arcs(edges)
    n, m = degrees(edges).count(), edges.count()
    if not n:
        return both.select(F.col("src").alias("v"), F.lit(0).alias("part"))
    if hops == 2:
        far = both.select("src", F.col("dst").alias("mid")).join(both.select(F.col("src").alias("mid"), F.col("dst").alias("dst")), "mid").select("src", "dst")
        both = both.unionAll(far)
    weighed = both.groupBy("src", "dst").agg(F.count("*").alias("times"))
    alpha, cap = math.sqrt(parts) * m / n**1.5, balance * n / parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_of: dict[int, int] = {}
        size = [0] * parts

        def place(v: int, hits: list[int]) -> int:
            open_parts = [i for i in range(parts) if size[i] <= cap]
            best = max(open_parts, key=lambda i: (hits[i] - alpha * ((size[i] + 1) ** 1.5 - size[i] ** 1.5), -i))
            part_of[v] = best
            size[best] += 1
            return best

        now, hits = None, [0] * parts
        for batch in batches:
            out: list[tuple[int, int]] = []
            for v, w, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if v != now:
                    if now is not None:
                        out.append((now, place(now, hits)))
                    now, hits = v, [0] * parts
                if w in part_of:
                    hits[part_of[w]] += times
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32())], ["v", "part"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([place(now, hits)], pa.int32())], ["v", "part"])

    return _in_order(weighed, "src", "dst").mapInArrow(run, "v bigint, part int")


def cut_edges(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """``(cut, edges)``: edges between different parts of ``parts(v, part)``, and all."""
    a, b = parts.select(F.col("v").alias("src"), F.col("part").alias("_a")), parts.select(F.col("v").alias("dst"), F.col("part").alias("_b"))
    return edges.join(a, "src").join(b, "dst").agg(F.coalesce(F.sum((F.col("_a") != F.col("_b")).cast("bigint")), F.lit(0)).alias("cut"), F.count("*").alias("edges"))


def views(edges: DataFrame, hops: int = 1) -> DataFrame:
    """``(source, v, deg)``: the vertices whose neighbour lists a search of ``hops`` steps from ``source`` reads, and their lengths."""
    from graphloom.operators.graph import k_hop

    sources = degrees(edges)
    reached = k_hop(edges, sources, hops - 1)
    return reached.join(sources, "v").select("source", "v", "deg")


def view_bins(edges: DataFrame, parts: DataFrame, capacity: int, hops: int = 2, open_bins: int = 4, by_degree: bool = False) -> DataFrame:
    """``(v, bin)``: the vertices packed so that the lists that a bin's vertices read together have at most ``capacity`` entries.

    Within each part of ``parts(v, part)`` in id order (or by degree, largest
    first) a vertex joins the open bin that grows least; if none has room a bin is
    opened, and when there are ``open_bins`` the largest is closed. Then the bins
    of all parts, smallest first, are joined one after the other while they fit. A
    vertex whose own view is larger than the capacity has a bin of its own. Parts
    are packed side by side; one part is one ordered pass that holds its open bins
    and one view.
    """
    own = degrees(edges).withColumnsRenamed({"v": "source", "deg": "own"})
    rows = views(edges, hops).join(own, "source").join(parts.select(F.col("v").alias("source"), F.col("part").cast("bigint").alias("part")), "source")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, opened = None, 0, {}  # open bins by number: what they read, how much that is, their vertices
        out: list[tuple] = []

        def close(at: int) -> None:
            _, size, sources = opened.pop(at)
            out.extend((part, at, size, v) for v in sources)

        def taken() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "number", "size", "v"])

        for (source, *_), (new_part, *_), vs, degs in runs(batches):
            if new_part != part:
                for at in list(opened):
                    close(at)
                part, number = new_part, 0
            view = dict(zip(vs, degs, strict=True))
            growth = [(sum(d for v, d in view.items() if v not in held), at) for at, (held, _, _) in opened.items()]
            fits = [(g, at) for g, at in growth if opened[at][1] + g <= capacity]
            if fits:
                grown, at = min(fits)
            else:
                if len(opened) >= open_bins:
                    close(max(opened, key=lambda i: (opened[i][1], -i)))
                grown, at, number = sum(view.values()), number, number + 1
                opened[at] = (set(), 0, [])
            held, size, sources = opened[at]
            held.update(view)
            sources.append(source)
            opened[at] = (held, size + grown, sources)
            if len(out) >= 10_000:
                yield taken()
        for at in list(opened):
            close(at)
        yield taken()

    order: list[str | Column] = ["part", F.desc("own"), "source"] if by_degree else ["part", "source"]
    ordered = rows.repartition("part").sortWithinPartitions(*order).select("source", "part", "v", "deg")
    packed = written(ordered.mapInArrow(pack, "part bigint, number bigint, size bigint, v bigint"))
    sizes = packed.select("part", "number", "size").distinct()

    def join_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, filled = 0, 0
        for batch in batches:
            out = []
            for size in batch.column("size").to_pylist():
                if filled + size > capacity and filled:
                    at, filled = at + 1, 0
                filled += size
                out.append(at)
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("number"), pa.array(out, pa.int32())], ["part", "number", "bin"])

    joined = _in_order(sizes, "size", "part", "number").mapInArrow(join_bins, "part bigint, number bigint, bin int")
    return packed.join(joined, ["part", "number"]).select("v", "bin")


def view_bins_report(edges: DataFrame, bins: DataFrame, capacity: int, hops: int = 2) -> DataFrame:
    """``(v, bins, fits)``: in how many bins a vertex is, and whether what its bin reads together is within the capacity, or it is alone."""
    read = views(edges, hops).join(bins.withColumnRenamed("v", "source"), "source")
    loads = read.select("bin", "v", "deg").distinct().groupBy("bin").agg(F.sum("deg").alias("_load"))
    alone = bins.groupBy("bin").agg(F.count("*").alias("_n"))
    fits = (F.col("_load") <= capacity) | (F.col("_n") == 1)
    return bins.join(loads, "bin").join(alone, "bin").groupBy("v").agg(F.count("*").alias("bins"), F.min(fits).alias("fits"))


def bin_loads(edges: DataFrame, bins: DataFrame) -> DataFrame:
    """``(bin, vertices, load)``: the load of a bin is the degrees of its vertices, largest first."""
    return bins.join(degrees(edges), "v").groupBy("bin").agg(F.count("*").alias("vertices"), F.sum("deg").alias("load")).orderBy(F.desc("load"), "bin")


def split_bins(edges: DataFrame, bins: DataFrame, devices: int, times: int = 1) -> DataFrame:
    """``(v, bin)``: bins split until there are (bins / devices + times) * devices, always the one of largest load; numbers by load, largest first.

    A split deals the vertices, largest degree first, to the two halves in turn.
    """
    deg = written(degrees(edges))
    now = written(bins.select("v", F.col("bin").cast("bigint").alias("bin")))
    have = now.select("bin").distinct().count()
    for i in range((have // devices + times) * devices - have):
        loads = now.join(deg, "v").groupBy("bin").agg(F.sum("deg").alias("load"))
        top = loads.orderBy(F.desc("load"), "bin").limit(1).first()
        if top is None:
            break
        name = now.agg(F.max("bin")).first()[0] + 1
        turn = F.row_number().over(Window.partitionBy("bin").orderBy(F.desc("deg"), "v"))
        part = now.where(F.col("bin") == top.bin).join(deg, "v").select("v", F.when(turn % 2 == 0, F.lit(name)).otherwise(F.col("bin")).alias("bin"))
        ahead = written(now.where(F.col("bin") != top.bin).union(part))
        forget(now)
        now = ahead
    loads = now.join(deg, "v").groupBy("bin").agg(F.sum("deg").alias("load"))
    names = loads.select("bin", (F.row_number().over(Window.orderBy(F.desc("load"), "bin")) - 1).cast("int").alias("_new"))
    return now.join(names, "bin").select("v", F.col("_new").alias("bin"))
