"""Maximal cliques.

Each clique is found at its first member in the order of (degree, id): the later
neighbours of that member are the candidates, the earlier ones the excluded. A
task gets, for one such root, only the edges between a candidate and another
neighbour, so its input is the triangles of the root, not the lists of its
neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.runs import by_run
from graphloom.operators.graph import degree_order
from graphloom.tables import written


def maximal_in(candidates: set[int], excluded: set[int], near: dict[int, set[int]]) -> Iterator[list[int]]:
    """Maximal cliques among ``candidates`` that no member of ``excluded`` extends, by search with a pivot. ``near``: neighbours of each, at least those that are candidates, and of candidates the excluded too."""
    todo = [([], candidates, excluded)]
    none: set[int] = set()
    while todo:
        clique, p, x = todo.pop()
        if not p:
            if not x:
                yield clique
            continue
        pivot = max(p | x, key=lambda u: len(near.get(u, none) & p))
        p, x = set(p), set(x)
        for v in sorted(p - near.get(pivot, none)):
            to = near.get(v, none)
            todo.append(([*clique, v], p & to, x & to))
            p.discard(v)
            x.add(v)


def _root_cliques(columns: list[list]) -> Iterator[list[int]]:
    """One root: rows ``(root, u, w)`` say that u is a candidate if w is null, else that u is and is adjacent to w, excluded or candidate."""
    root, candidates, near, all_ends = columns[0][0], set(), {}, set()
    for u, w in zip(columns[1], columns[2], strict=True):
        candidates.add(u)
        if w is not None:
            near.setdefault(u, set()).add(w)
            near.setdefault(w, set()).add(u)
            all_ends.add(w)
    for clique in maximal_in(candidates, all_ends - candidates, near):
        yield sorted([root, *clique])


def maximal_cliques(edges: DataFrame) -> DataFrame:
    """``(members)``, sorted: every maximal clique of two vertices or more of normalised edges, once."""
    out = written(degree_order(edges))
    ab = out.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    # b before c in the order: both are later neighbours of a, and b -> c is an arc
    triangle = ab.join(out.select(F.col("src").alias("a"), F.col("dst").alias("c")), "a").join(out.select(F.col("src").alias("b"), F.col("dst").alias("c")), ["b", "c"])
    candidate = F.struct(F.col("a").alias("root"), F.col("b").alias("u"), F.col("c").alias("w"))
    excluded = F.struct(F.col("b").alias("root"), F.col("c").alias("u"), F.col("a").alias("w"))
    near = triangle.select(F.explode(F.array(candidate, excluded)).alias("r")).select("r.*")
    rows = out.select(F.col("src").alias("root"), F.col("dst").alias("u"), F.lit(None).cast("bigint").alias("w")).unionByName(near)
    return by_run(rows, _root_cliques, pa.list_(pa.int64()), "members", "members array<bigint>")


def maximal_cliques_by_level(edges: DataFrame, most_levels: int = 1000) -> DataFrame:
    """The same by one DataFrame step per clique size, for graphs whose largest clique is small: every clique is a row, with the neighbours common to all members, and is a result when there are none."""
    from graphloom.operators.graph import adjacency

    adj = written(adjacency(edges).select("v", "nbrs"))
    state = adj.select(F.array("v").alias("members"), F.col("nbrs").alias("common"))
    found = None
    for _ in range(most_levels):
        state = written(state)
        done = state.where(F.size("common") == 0).select("members")
        found = done if found is None else found.union(done)
        state = state.where(F.size("common") > 0)
        if state.isEmpty():
            return found
        ahead = state.select("members", "common", F.explode(F.filter("common", lambda x: x > F.element_at("members", -1))).alias("v"))
        state = ahead.join(adj, "v").select(F.concat("members", F.array("v")).alias("members"), F.array_intersect("common", "nbrs").alias("common"))
    raise ValueError(f"there are cliques of more than {most_levels} vertices")


def clique_statistics(cliques: DataFrame) -> DataFrame:
    """``(cliques, largest)``."""
    return cliques.agg(F.count("*").alias("cliques"), F.max(F.size("members")).alias("largest"))


def clique_histogram(cliques: DataFrame) -> DataFrame:
    """``(size, cliques)``."""
    return cliques.groupBy(F.size("members").alias("size")).agg(F.count("*").alias("cliques"))
