from itertools import combinations

import pytest
from pyspark.sql import functions as F

from graphloom import queries
from graphloom.operators import quasi
from graphloom.operators.cliques import maximal_cliques
from graphloom.operators.graph import copurchase
from graphloom.tables import written

SMALL = "/root/testdata/sf0.001/lineitem.parquet"


@pytest.fixture(scope="module")
def large_orders(spark):
    return written(copurchase(spark.read.parquet(SMALL), F.col("l_quantity") >= 40))


def brute_force(edges, share, least_size):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    found = [set(c) for k in range(least_size, len(near) + 1) for c in combinations(sorted(near), k) if quasi.is_quasi_clique(set(c), near, share)]
    return {tuple(sorted(s)) for s in found if not any(s < t for t in found)}


@pytest.mark.parametrize(("share", "least_size", "number"), [((1, 1), 3, 128), ((9, 10), 4, 23), ((4, 5), 4, 23), ((4, 5), 5, 5), ((3, 5), 5, 10)])
def test_counts_on_the_graph_of_large_orders(large_orders, share, least_size, number):
    assert quasi.quasi_cliques(large_orders, share, least_size).count() == number


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize(("share", "least_size"), [((1, 2), 4), ((3, 5), 4), ((2, 3), 3), ((4, 5), 4)])
def test_miner_against_all_subsets(seed, share, least_size):
    import random

    rng = random.Random(seed)
    edges = [e for e in combinations(range(11), 2) if rng.random() < 0.45]
    near = {v: set() for e in edges for v in e}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    found = [set(s) for v in sorted(near) for s in quasi.mine({v}, {u for u in near if u > v}, near, share, least_size)]
    assert {tuple(sorted(s)) for s in found if not any(s < t for t in found)} == brute_force(edges, share, least_size)


def test_share_one_gives_cliques(large_orders):
    cliques = {tuple(r.members) for r in maximal_cliques(large_orders).where(F.size("members") >= 4).collect()}
    assert {tuple(r.members) for r in quasi.quasi_cliques(large_orders, (1, 1), 4).collect()} == cliques


def test_kernels(spark, large_orders):
    all_found = {tuple(r.members) for r in quasi.quasi_cliques(large_orders, (3, 5), 5).collect()}
    some = sorted(all_found)[0]
    kernels = spark.createDataFrame([(0, list(some[:2])), (1, [-1, -2])], "kernel_id long, members array<long>")
    found = {tuple(r.members) for r in quasi.kernel_expand(large_orders, kernels, (3, 5), 5).collect()}
    assert found == {s for s in all_found if set(some[:2]) <= set(s)}


def test_kernels_of_all_triangles_give_all(spark, large_orders):
    folder = SMALL.rsplit("/", 1)[0]
    kernels = queries.kernels(spark, folder)
    assert kernels.select("kernel_id").distinct().count() == kernels.count() == 226
    whole = {tuple(r.members) for r in quasi.quasi_cliques(large_orders, (4, 5), 4).collect()}
    one_id = kernels.withColumn("kernel_id", F.lit(0).cast("long"))
    assert {tuple(r.members) for r in quasi.kernel_expand(large_orders, one_id, (4, 5), 4).collect()} == whole
    assert len(whole) == queries.queries()["kernel_expand"](spark, folder).count() == 23


def test_refuses_small_shares(large_orders):
    with pytest.raises(ValueError):
        quasi.quasi_cliques(large_orders, (2, 5), 4)


def test_thresholds_are_whole_numbers():
    assert [quasi.needed((9, 10), n) for n in (2, 11, 12)] == [1, 9, 10]


@pytest.mark.parametrize("rule", sorted(quasi.RULES))
@pytest.mark.parametrize(("share", "least_size"), [((1, 2), 4), ((3, 5), 5), ((4, 5), 4)])
def test_rules_change_no_result_and_save_states(rule, share, least_size):
    import random

    rng, saved = random.Random(8), 0
    for _ in range(4):
        edges = [e for e in combinations(range(13), 2) if rng.random() < 0.5]
        near = {v: set() for e in edges for v in e}
        for a, b in edges:
            near[a].add(b)
            near[b].add(a)

        def found(rules, near=near):
            states = [0]
            all_found = [set(s) for v in sorted(near) for s in quasi.mine({v}, {u for u in near if u > v}, near, share, least_size, rules, states)]
            return {tuple(sorted(s)) for s in all_found if not any(s < t for t in all_found)}, states[0]

        (plain, many), (with_rule, fewer) = found(frozenset()), found(frozenset({rule}))
        everything, least = found(quasi.RULES)
        assert plain == with_rule == everything
        assert fewer <= many and least <= many
        saved += many - fewer
    assert saved > 0
