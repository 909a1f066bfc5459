"""Undirected graphs as DataFrames: normalised edges, both directions of them, neighbour lists, degrees, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.tables import written


def edges_norm(edges: DataFrame) -> DataFrame:
    """``(src, dst)`` with src < dst: without loops, repeated edges and null ends."""
    a, b = F.least("src", "dst").cast("bigint"), F.greatest("src", "dst").cast("bigint")
    kept = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    return kept.select(a.alias("src"), b.alias("dst")).distinct()


def arcs(edges: DataFrame) -> DataFrame:
    """Both directions of normalised edges."""
    both = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return edges.select(both.alias("e")).select("e.src", "e.dst")


def degrees(edges: DataFrame) -> DataFrame:
    """``(v, deg)`` of each end of normalised edges."""
    return arcs(edges).groupBy(F.col("src").alias("v")).agg(F.count("*").alias("deg"))


def max_degree(edges: DataFrame) -> DataFrame:
    return degrees(edges).agg(F.max("deg").alias("max_degree"))


def degree_histogram(edges: DataFrame) -> DataFrame:
    """``(deg, vertices)``."""
    return degrees(edges).groupBy("deg").agg(F.count("*").alias("vertices"))


def id_range(edges: DataFrame) -> DataFrame:
    """``(min_id, max_id, vertices, edges)`` of normalised edges."""
    v = arcs(edges)
    return v.agg(F.min("src").alias("min_id"), F.max("src").alias("max_id"), F.count_distinct("src").alias("vertices"), (F.count("*") / 2).cast("bigint").alias("edges"))


def adjacency(edges: DataFrame) -> DataFrame:
    """``(v, nbrs, deg)``: sorted neighbour lists of normalised edges. A list is as long as its vertex has neighbours."""
    return arcs(edges).groupBy(F.col("src").alias("v")).agg(F.sort_array(F.collect_list("dst")).alias("nbrs")).withColumn("deg", F.size("nbrs").cast("bigint"))


def neighbours(edges: DataFrame, of: DataFrame) -> DataFrame:
    """``(v, nbr)`` for the vertices ``v`` of ``of``."""
    return of.select("v").distinct().join(arcs(edges), F.col("v") == F.col("src")).select("v", F.col("dst").alias("nbr"))


def existing_edges(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of ``pairs(a, b)`` that are edges, in whichever direction."""
    keyed = pairs.withColumns({"src": F.least("a", "b"), "dst": F.greatest("a", "b")})
    return keyed.join(edges, ["src", "dst"], "left_semi").drop("src", "dst")


def dense_ids(edges: DataFrame) -> DataFrame:
    """``(v, id)``: ids 0, 1, ... in the order of v.

    Ranks within ranges of v plus the number of vertices before the range: no
    single task sorts all vertices.
    """
    v = arcs(edges).select(F.col("src").alias("v")).distinct()
    return numbered(v, "v", "id")


def numbered(df: DataFrame, by: str, name: str, classes: tuple[str, ...] = (), slice_bits: int = 12) -> DataFrame:
    """``df`` with ``name``, the rank from 0 of its rows by ``classes`` and then by the number ``by``, which together are distinct.

    Slices hold ``2**slice_bits`` values of ``by`` of one class, blocks as many
    slices. Ranks are made within slices and slices summed within blocks; only the
    counts of blocks, about one for ``2**(2 * slice_bits)`` ids and class, are
    ordered in one place.
    """
    sliced = df.withColumn("_slice", F.shiftright(F.col(by).cast("bigint"), slice_bits))
    counts = sliced.groupBy(*classes, "_slice").agg(F.count("*").alias("_n"))
    coarse = counts.withColumn("_block", F.shiftright("_slice", slice_bits))
    blocks = coarse.groupBy(*classes, "_block").agg(F.sum("_n").alias("_m"))
    before = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    block_base = blocks.select(*classes, "_block", before("_m", Window.orderBy(*classes, "_block")).alias("_block_base"))
    in_block = before("_n", Window.partitionBy(*classes, "_block").orderBy("_slice"))
    slice_base = coarse.join(block_base, [*classes, "_block"]).select(*classes, "_slice", (F.col("_block_base") + in_block).alias("_base"))
    rank = F.row_number().over(Window.partitionBy(*classes, "_slice").orderBy(by)) - 1
    return sliced.withColumn("_rank", rank).join(slice_base, [*classes, "_slice"]).withColumn(name, (F.col("_base") + F.col("_rank")).cast("bigint")).drop("_slice", "_rank", "_base")


def recoded(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Normalised edges with the ends replaced by the ``id`` of ``ids(v, id)``; edges with an end that has none are left out."""
    left = ids.select(F.col("v").alias("src"), F.col("id").alias("_a"))
    right = ids.select(F.col("v").alias("dst"), F.col("id").alias("_b"))
    return edges.join(left, "src").join(right, "dst").select(F.least("_a", "_b").alias("src"), F.greatest("_a", "_b").alias("dst"))


def preprocessed(edges: DataFrame) -> DataFrame:
    """Normalised edges of the raw ``edges``, numbered densely in the order of the ids."""
    norm = edges_norm(edges)
    return recoded(norm, dense_ids(norm))


def two_hop(edges: DataFrame) -> DataFrame:
    """``(a, b)``, both directions: the pairs at distance one or two."""
    x, y = arcs(edges), arcs(edges).select(F.col("src").alias("mid"), F.col("dst").alias("b"))
    far = x.select(F.col("src").alias("a"), F.col("dst").alias("mid")).join(y, "mid").where(F.col("a") != F.col("b")).select("a", "b")
    return far.union(x.select("src", "dst")).distinct()


def two_step_walks(edges: DataFrame) -> DataFrame:
    """``(v, walks)``: the walks of two steps from ``v`` to another vertex, from the degrees of its neighbours; no pair is made."""
    deg = degrees(edges)
    ahead = arcs(edges).join(deg.withColumnRenamed("v", "dst"), "dst")
    return ahead.groupBy(F.col("src").alias("v")).agg(F.sum(F.col("deg") - 1).alias("walks"))


def k_hop(edges: DataFrame, sources: DataFrame, hops: int) -> DataFrame:
    """``(source, v)``: what can be reached from each vertex ``v`` of ``sources`` in at most ``hops`` steps, itself included."""
    reached = sources.select(F.col("v").alias("source"), "v").distinct()
    step = arcs(edges)
    for _ in range(hops):
        ahead = reached.join(step, F.col("v") == F.col("src")).select("source", F.col("dst").alias("v"))
        reached = reached.union(ahead).distinct()
    return reached


def label_counts(vertices: DataFrame) -> DataFrame:
    """``(label, vertices)`` of ``vertices(v, label)``."""
    return vertices.groupBy("label").agg(F.count("*").alias("vertices"))


def neighbours_by_label(edges: DataFrame, vertices: DataFrame, label: int) -> DataFrame:
    """``(v, nbr)`` for the neighbours that have ``label``."""
    with_label = vertices.where(F.col("label") == label).select(F.col("v").alias("nbr"))
    return arcs(edges).select(F.col("src").alias("v"), F.col("dst").alias("nbr")).join(with_label, "nbr", "left_semi").select("v", "nbr")


def degree_order(edges: DataFrame, deg: DataFrame | None = None) -> DataFrame:
    """``(src, dst)``: each normalised edge once, from the end of smaller degree to the other, equal degrees by id. No vertex has more than sqrt(2 * edges) out-going arcs."""
    deg = deg if deg is not None else degrees(edges)
    a = deg.select(F.col("v").alias("src"), F.col("deg").alias("_a"))
    b = deg.select(F.col("v").alias("dst"), F.col("deg").alias("_b"))
    both = edges.join(a, "src").join(b, "dst")
    ahead: Column = (F.col("_a") < F.col("_b")) | ((F.col("_a") == F.col("_b")) & (F.col("src") < F.col("dst")))
    return both.select(F.when(ahead, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(ahead, F.col("dst")).otherwise(F.col("src")).alias("dst"))


def degree_recoded(edges: DataFrame) -> DataFrame:
    """Normalised edges numbered densely by degree, then id: counts of patterns don't change, but in the order of the numbers a hub comes last, so few lists start at it."""
    ids = numbered(written(degrees(edges)), "v", "id", ("deg",)).select("v", "id")  # read several times
    return recoded(edges, ids)


def split_by_order(adj: DataFrame) -> DataFrame:
    """``(v, later, earlier)``: the neighbours above and below ``v`` of ``adj(v, nbrs)``."""
    return adj.select("v", F.filter("nbrs", lambda x: x > F.col("v")).alias("later"), F.filter("nbrs", lambda x: x < F.col("v")).alias("earlier"))


def copurchase(lineitem: DataFrame, condition: Column) -> DataFrame:
    """Normalised edges between the parts of one order among the lines that meet ``condition``."""
    x = lineitem.where(condition).select("l_orderkey", "l_partkey").distinct()
    a, b = x.select("l_orderkey", F.col("l_partkey").alias("src")), x.select("l_orderkey", F.col("l_partkey").alias("dst"))
    return a.join(b, "l_orderkey").where(F.col("src") < F.col("dst")).select("src", "dst").distinct()
