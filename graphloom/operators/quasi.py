"""Quasi-cliques: sets whose every member is adjacent to at least a given share of the others.

With a share of one half or more two members are never further than two steps
apart, so all such sets of which v is the smallest member lie within two steps of v.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.runs import by_run
from graphloom.operators.core import dense_core
from graphloom.operators.graph import arcs, two_hop
from graphloom.operators.sets import maximal_sets
from graphloom.tables import written


#: The ways to leave out branches, see ``mine``.
RULES = frozenset({"bounds", "critical", "cover"})


def needed(share: tuple[int, int], size: int) -> int:
    """Neighbours inside that each of ``size`` members must have: ``size - 1`` times the share, rounded up, in whole numbers."""
    num, den = share
    return -(-num * (size - 1) // den)


def _checked(share: tuple[int, int]) -> tuple[int, int]:
    if not 0 < share[0] <= share[1] or 2 * share[0] < share[1]:
        raise ValueError("the share must be from 1/2 to 1")
    return share


def is_quasi_clique(members: set[int], near: dict[int, set[int]], share: tuple[int, int]) -> bool:
    least = needed(share, len(members))
    return all(len(near[v] & members) >= least for v in members)


def mine(fixed: set[int], candidates: set[int], near: dict[int, set[int]], share: tuple[int, int], least_size: int, rules: frozenset[str] = RULES, states: list[int] | None = None) -> Iterator[frozenset[int]]:
    """Some of the quasi-cliques of at least ``least_size``, the maximal ones among them, that contain ``fixed`` and otherwise only ``candidates``.

    Two members are at most two steps apart, and adjacent if the share is one.
    Branches and candidates go by these ``rules``, which change no maximal result:

    ``bounds``: the degrees among the members, and their sum together with those of
    the candidates best connected to them, bound from above and below how many
    candidates a result can add. ``critical``: a member that needs all its
    neighbours even for the least of these numbers brings them all in. ``cover``:
    candidates that a further candidate, and every member not next to it, are all
    adjacent to make no maximal result by themselves, so none of them starts a
    branch. ``states`` gets the number of branches looked at.
    """
    num, den = share
    close = {v: set(near[v]) if num == den else near[v].union(*(near[u] for u in near[v])) - {v} for v in near}
    need = lambda size: needed(share, size)

    def shrunk(members: set[int], rest: set[int]) -> tuple[set[int], set[int]] | None:
        """The members and candidates of the branch by the rules; None if it holds nothing."""
        while True:
            size, both = len(members), members | rest
            inside = {v: len(near[v] & members) for v in both}
            total = {v: len(near[v] & both) for v in both}
            fewest, most = max(0, least_size - size), min([len(rest)] + [total[v] * den // num + 1 - size for v in members])
            if "bounds" in rules and members:
                ahead = [0, *accumulate(sorted((inside[u] for u in rest), reverse=True))]
                own, weakest = sum(inside[v] for v in members), min(inside[v] for v in members)
                sizes = [t for t in range(fewest, most + 1) if weakest + t >= need(size + t) and own + ahead[t] >= size * need(size + t)]
                if not sizes:
                    return None
                fewest, most = sizes[0], sizes[-1]
            if most < fewest or any(total[v] < need(size + fewest) for v in members):
                return None
            if "critical" in rules and fewest:
                forced = set().union(*(near[v] & rest for v in members if total[v] == need(size + fewest)))
                if forced:
                    members, rest = members | forced, rest - forced
                    for u in forced:
                        rest = rest & close[u]
                        if members - close[u] - {u}:
                            return None
                    continue
            at_least = need(size + max(fewest, 1))
            dropped = {u for u in rest if total[u] < at_least or ("bounds" in rules and inside[u] + most - 1 < need(size + most))}
            if not dropped:
                return members, rest
            rest = rest - dropped

    def covered(members: set[int], rest: set[int]) -> set[int]:
        enough, best = need(len(members) + 1), set()
        weak = {v for v in members if len(near[v] & members) < enough}
        for u in sorted(rest):
            if len(near[u] & members) >= enough and weak <= near[u]:
                own = rest & near[u]
                for v in members - near[u]:
                    own = own & near[v]
                best = max(best, own, key=len)
        return best

    def search(members: set[int], rest: set[int]) -> Iterator[frozenset[int]]:
        if states is not None:
            states[0] += 1
        kept = shrunk(members, rest)
        if kept is None:
            return
        members, rest = kept
        whole = members | rest
        if len(whole) >= least_size and is_quasi_clique(whole, near, share):
            yield frozenset(whole)
            return
        found = False
        left, skipped = set(rest), covered(members, rest) if "cover" in rules else set()
        # the most connected first, so that the last branches are small
        for v in sorted(rest - skipped, key=lambda u: (-len(near[u] & whole), u)):
            left.discard(v)
            for s in search(members | {v}, left & close[v]):
                found = True
                yield s
        if not found and len(members) >= least_size and is_quasi_clique(members, near, share):
            yield frozenset(members)

    for v in fixed:
        candidates = candidates & (close[v] | fixed)
    yield from search(set(fixed), set(candidates) - set(fixed))


def _miner(share: tuple[int, int], least_size: int):  # noqa: ANN202
    """For one run: rows ``(id, u, w, fixed)``; fixed names the members given, u and w are adjacent."""

    def run(columns: list[list]) -> Iterator[list[int]]:
        fixed, near = set(columns[3][0]), {}
        for u, w in zip(columns[1], columns[2], strict=True):
            near.setdefault(u, set()).add(w)
            near.setdefault(w, set()).add(u)
        if fixed <= near.keys():
            for s in mine(fixed, set(near) - fixed, near, share, least_size):
                yield sorted(s)

    return run


def _mined(rows: DataFrame, share: tuple[int, int], least_size: int) -> DataFrame:
    return maximal_sets(by_run(rows, _miner(share, least_size), pa.list_(pa.int64()), "members", "members array<bigint>"))


def quasi_cliques(edges: DataFrame, share: tuple[int, int], least_size: int) -> DataFrame:
    """``(members)``: the maximal ``share`` quasi-cliques of at least ``least_size`` (two or more) of normalised edges."""
    _checked(share)
    least = needed(share, least_size)
    core = dense_core(edges, least, least_size - 1)
    near = written(two_hop(core))
    group = near.where(F.col("b") > F.col("a")).select(F.col("a").alias("root"), F.col("b").alias("m"))
    inside = group.union(group.select("root", F.col("root").alias("m")).distinct())
    both = core.join(inside.select("root", F.col("m").alias("src")), "src").join(inside.select("root", F.col("m").alias("dst")), ["root", "dst"])
    rows = both.select(F.col("root").alias("id"), F.col("src").alias("u"), F.col("dst").alias("w"), F.array("root").alias("fixed"))
    return _mined(rows, share, least_size)


def common_two_hop(near: DataFrame, kernels: DataFrame) -> DataFrame:
    """``(kernel_id, v)``: the vertices within two steps of every member of ``kernels(kernel_id, members)``, without the members."""
    each = kernels.select("kernel_id", F.array_distinct("members").alias("members")).select("kernel_id", F.size("members").alias("_size"), "members", F.explode("members").alias("a"))
    met = each.join(near, "a").groupBy("kernel_id", "_size", "members", F.col("b").alias("v")).agg(F.count("*").alias("_n"))
    return met.where((F.col("_n") == F.col("_size")) & ~F.array_contains("members", F.col("v"))).select("kernel_id", "v")


def kernel_expand(edges: DataFrame, kernels: DataFrame, share: tuple[int, int], least_size: int, first: int | None = None) -> DataFrame:
    """``(members)``: the maximal quasi-cliques of at least ``least_size`` around the kernels ``(kernel_id, members)``, each containing one of them.

    Kernels are told apart by their members: ids may repeat or be null. With ``first`` only
    the ``first`` kernels in the order of id and members count. A kernel with a member that
    the pruning takes away, or that has none, gives nothing.
    """
    _checked(share)
    if first is not None:
        kernels = kernels.orderBy("kernel_id", "members").limit(first)
    core = dense_core(edges, needed(share, least_size), least_size - 1)
    near = written(two_hop(core))
    sets = kernels.select(F.array_sort(F.array_distinct("members")).alias("members")).distinct()
    given = written(sets.select(F.monotonically_increasing_id().alias("kernel_id"), "members"))
    inside = written(common_two_hop(near, given).union(given.select("kernel_id", F.explode("members").alias("v"))))
    both = core.join(inside.select("kernel_id", F.col("v").alias("src")), "src").join(inside.select("kernel_id", F.col("v").alias("dst")), ["kernel_id", "dst"])
    rows = both.join(given, "kernel_id").select(F.col("kernel_id").alias("id"), F.col("src").alias("u"), F.col("dst").alias("w"), F.col("members").alias("fixed"))
    return _mined(rows, share, least_size)
