"""Core numbers, degeneracy order, and pruning to a core."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.graph import arcs, degrees, numbered, recoded, two_hop
from graphloom.tables import forget, written


#: When at most this part of the vertices changed in a round, the next one looks only at their neighbours.
FEW = 0.1
#: With fewer arcs a whole round costs less than finding the arcs it needs.
WORTH = 2_000_000


def _lowered(step: DataFrame, now: DataFrame) -> DataFrame:
    """``(v, was, core)`` for the ends of ``step``: the largest h such that h neighbours have h or more, no more than before.

    Neighbours are counted per vertex and value before the shuffle, so those of a
    hub never meet as a list, and only these counts are joined with what their
    vertex was: a round shuffles the arcs once.
    """
    theirs = now.select(F.col("v").alias("dst"), F.col("core").alias("_theirs"))
    counts = step.join(theirs, "dst").groupBy(F.col("src").alias("v"), "_theirs").agg(F.count("*").alias("_n"))
    capped = counts.join(now.select("v", F.col("core").alias("was")), "v").withColumn("_value", F.least("_theirs", "was"))
    above = F.sum("_n").over(Window.partitionBy("v").orderBy(F.desc("_value")))  # with all of the same value
    return capped.withColumn("_h", F.least("_value", above)).groupBy("v", "was").agg(F.max("_h").alias("core"))


def core_numbers(edges: DataFrame, most_rounds: int = 10_000, worth: int = WORTH) -> DataFrame:
    """``(v, core)``: the largest k such that v is in a subgraph of minimum degree k.

    Starts from the degrees; each round lowers the vertices to what their
    neighbours allow, until nothing changes. Once few vertices change, a round
    over many arcs reads only those of their neighbours; the result is the same.
    Of the tables of the rounds only that of the last one is kept.
    """
    step = written(arcs(edges))
    now = written(step.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("core")))
    vertices, many, few = now.count(), step.count() >= worth, None
    for _ in range(most_rounds):
        if few is None:
            ahead = written(_lowered(step, now.select("v", "core")))
        else:
            touched = step.join(few, "dst", "left_semi").select("src").distinct()
            ahead = written(_lowered(step.join(touched, "src", "left_semi"), now.select("v", "core")))
        number = ahead.where(F.col("core") < F.col("was")).count()
        whole, looked_at = few is None, few
        few = written(ahead.where(F.col("core") < F.col("was")).select(F.col("v").alias("dst"))) if many and 0 < number <= FEW * vertices else None
        if whole:
            before, now = now, ahead
        elif number:
            new = ahead.select("v", F.col("core").alias("_new"))
            before, now = now, written(now.join(new, "v", "left").select("v", F.coalesce("_new", "core").alias("core")))
            forget(ahead)
        else:
            before = ahead
        forget(before, looked_at)
        if not number:
            forget(step)
            return now.select("v", "core")
    raise ValueError(f"not stable after {most_rounds} rounds")


def kmax(edges: DataFrame) -> DataFrame:
    return core_numbers(edges).agg(F.max("core").alias("kmax"))


def core_histogram(edges: DataFrame) -> DataFrame:
    return core_numbers(edges).groupBy("core").agg(F.count("*").alias("vertices"))


def degeneracy_order(edges: DataFrame) -> DataFrame:
    """``(v, core, deg, id)``: ids 0, 1, ... by core, then degree, then v."""
    ranked = written(core_numbers(edges).join(degrees(edges), "v"))
    return numbered(ranked, "v", "id", ("core", "deg")).select("v", "core", "deg", "id")


def degeneracy_recoded(edges: DataFrame) -> DataFrame:
    """Normalised edges numbered in degeneracy order."""
    return recoded(edges, degeneracy_order(edges))


def largest_later(edges: DataFrame) -> DataFrame:
    """``(largest_later)``: the most neighbours above itself that a vertex has, a bound of degeneracy for the present numbering."""
    return edges.groupBy("src").agg(F.count("*").alias("n")).agg(F.max("n").alias("largest_later"))


def shell_bins(edges: DataFrame, bins: int, dealt: bool = False) -> DataFrame:
    """``(v, id, bin)``: the vertices of each core number in ``bins`` bins by degeneracy order, in equal runs of size/bins + 1, or ``dealt`` one by one."""
    order = degeneracy_order(edges)
    sizes = order.groupBy("core").agg(F.count("*").alias("_n"), F.min("id").alias("_first"))
    at = F.col("id") - F.col("_first")
    run = F.floor(F.col("_n") / bins) + 1
    return order.join(sizes, "core").select("v", "id", (at % bins if dealt else F.floor(at / run)).cast("int").alias("bin"))


def k_core(edges: DataFrame, least: int) -> DataFrame:
    """The edges left when vertices with fewer than ``least`` neighbours are taken away again and again."""
    now = written(edges)
    while True:
        few = written(degrees(now).where(F.col("deg") < least).select("v"))
        if few.isEmpty():
            forget(few)
            return now
        kept = now.join(few.withColumnRenamed("v", "src"), "src", "left_anti").join(few.withColumnRenamed("v", "dst"), "dst", "left_anti")
        ahead = written(kept.select("src", "dst"))
        forget(now, few)
        now = ahead


def dense_core(edges: DataFrame, least_degree: int, least_two_hop: int) -> DataFrame:
    """The edges left when vertices with fewer neighbours, or fewer others within two steps, are taken away until none is."""
    now = k_core(edges, least_degree)
    while True:
        near = two_hop(now).groupBy(F.col("a").alias("v")).agg(F.count("*").alias("n"))
        kept = written(near.where(F.col("n") >= least_two_hop).select("v"))
        if kept.count() == degrees(now).count():
            forget(kept)
            return now
        fewer = now.join(kept.withColumnRenamed("v", "src"), "src", "left_semi").join(kept.withColumnRenamed("v", "dst"), "dst", "left_semi")
        ahead = k_core(fewer.select("src", "dst"), least_degree)
        forget(now, kept)
        now = ahead
