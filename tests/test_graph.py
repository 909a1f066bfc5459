import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from graphloom import tables
from graphloom.functions import arrays
from graphloom.operators import app, cliques, core, graph, sets
from graphloom.operators.graph import copurchase
from graphloom.tables import written

RAW = "src long, dst long, v int"


@pytest.fixture(scope="module")
def returned(spark):
    return written(copurchase(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"), F.col("l_returnflag") == "R"))


def edges_of(spark, edges):
    return spark.createDataFrame(sorted(edges), "src long, dst long")


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture(scope="module")
def some(spark):
    rng = random.Random(3)
    edges = {e for e in combinations(range(0, 80_000, 4000), 2) if rng.random() < 0.4}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return edges, near, written(edges_of(spark, edges))


def test_normalise(spark):
    raw = spark.createDataFrame([(2, 1, 0), (1, 2, 0), (1, 2, 0), (3, 3, 0), (None, 1, 0), (1, None, 0), (2**32 - 1, 1, 0)], RAW)
    assert rows(graph.edges_norm(raw)) == {(1, 2), (1, 2**32 - 1)}
    assert rows(graph.preprocessed(raw)) == {(0, 1), (0, 2)}
    assert graph.edges_norm(raw.where("false")).count() == 0


def test_basics(some):
    edges, near, df = some
    assert rows(graph.degrees(df)) == {(v, len(n)) for v, n in near.items()}
    assert graph.max_degree(df).first()[0] == max(map(len, near.values()))
    assert {r.v: r.nbrs for r in graph.adjacency(df).collect()} == {v: sorted(n) for v, n in near.items()}
    assert rows(graph.dense_ids(df)) == {(v, i) for i, v in enumerate(sorted(near))}
    assert tuple(graph.id_range(df).first()) == (min(near), max(near), len(near), len(edges))
    assert rows(graph.two_hop(df)) == {(a, b) for a in near for b in near if a != b and (b in near[a] or near[a] & near[b])}
    one = sorted(near)[0]
    within = {one} | near[one] | {c for b in near[one] for c in near[b]}
    assert rows(graph.k_hop(df, df.sparkSession.createDataFrame([(one,)], "v long"), 2)) == {(one, v) for v in within}
    oriented = rows(graph.degree_order(df))
    assert {tuple(sorted(e)) for e in oriented} == edges and all((len(near[a]), a) < (len(near[b]), b) for a, b in oriented)


def test_lookups(spark, some):
    edges, near, df = some
    a, b = sorted(edges)[0]
    asked = spark.createDataFrame([(a, b), (b, a), (a, a), (a, -1)], "a long, b long")
    assert rows(graph.existing_edges(asked, df)) == {(a, b), (b, a)}
    assert {r.nbr for r in graph.neighbours(df, spark.createDataFrame([(a,)], "v long")).collect()} == near[a]
    labels = spark.createDataFrame([(v, v // 4000 % 2) for v in near], "v long, label int")
    assert {r.nbr for r in graph.neighbours_by_label(df, labels, 1).where(F.col("v") == a).collect()} == {w for w in near[a] if w // 4000 % 2}
    assert sum(r.vertices for r in graph.label_counts(labels).collect()) == len(near)


def test_numbered_over_many_slices(spark):
    values = random.Random(1).sample(range(2**32), 3000)
    got = {r.x: r.n for r in graph.numbered(spark.createDataFrame([(x,) for x in values], "x long"), "x", "n").collect()}
    assert got == {x: i for i, x in enumerate(sorted(values))}


def brute_cliques(near):
    found = set()

    def grow(r, p):
        if not p:
            if not any(set(r) <= near[v] for v in near):
                found.add(tuple(sorted(r)))
            return
        for v in p:
            grow([*r, v], [u for u in p if u > v and u in near[v]])
        if not any(set(r) <= near[v] for v in near):
            found.add(tuple(sorted(r)))

    for v in near:
        grow([v], [u for u in near[v] if u > v])
    return found


def test_cliques(spark, some):
    edges, near, df = some
    want = brute_cliques(near)
    assert {tuple(r.members) for r in cliques.maximal_cliques(df).collect()} == want
    assert {tuple(r.members) for r in cliques.maximal_cliques_by_level(df).collect()} == want
    assert {tuple(r.members) for r in app.run(app.CliqueSearch(), df).collect()} == want
    covered = {e for c in want for e in combinations(c, 2)}
    assert covered == edges
    moved = {tuple(sorted((10**6 - a, 10**6 - b))) for a, b in edges}
    assert cliques.maximal_cliques(edges_of(spark, moved)).count() == len(want)


def test_clique_counts(returned):
    assert dict(map(tuple, cliques.clique_histogram(cliques.maximal_cliques(returned)).collect())) == {2: 163, 3: 395, 4: 65, 5: 11, 6: 4}
    assert tuple(cliques.clique_statistics(cliques.maximal_cliques(returned)).first()) == (638, 6)
    assert dict(map(tuple, core.core_histogram(returned).collect())) == {2: 1, 3: 5, 4: 10, 5: 6, 6: 10, 7: 26, 8: 142}


@pytest.mark.parametrize("k", range(3, 8))
def test_complete_graphs(spark, k):
    df = edges_of(spark, combinations(range(k), 2))
    assert {tuple(r.members) for r in cliques.maximal_cliques(df).collect()} == {tuple(range(k))}


def test_star_and_empty(spark):
    star = edges_of(spark, [(0, i) for i in range(1, 50)])
    assert cliques.maximal_cliques(star).count() == 49
    assert {r.core for r in core.core_numbers(star).collect()} == {1}
    none = star.where("false")
    assert cliques.maximal_cliques(none).count() == 0 and core.core_numbers(none).count() == 0 and core.kmax(none).first()[0] is None


def peel(near):
    near, out, k = {v: set(n) for v, n in near.items()}, {}, 0
    while near:
        v = min(near, key=lambda u: len(near[u]))
        k = max(k, len(near[v]))
        out[v] = k
        for w in near.pop(v):
            near[w].discard(v)
    return out


def test_cores(some):
    edges, near, df = some
    want = peel(near)
    assert dict(map(tuple, core.core_numbers(df).collect())) == want
    # a long path changes a few vertices in each of many rounds
    path = edges_of(df.sparkSession, [(i, i + 1) for i in range(40)] + [(100 + a, 100 + b) for a, b in combinations(range(5), 2)])
    assert {r.v: r.core for r in core.core_numbers(path, worth=0).collect()} == {**dict.fromkeys(range(41), 1), **dict.fromkeys(range(100, 105), 4)}
    assert dict(map(tuple, core.core_numbers(df, worth=0).collect())) == want
    order = sorted(near, key=lambda v: (want[v], len(near[v]), v))
    assert {r.v: r.id for r in core.degeneracy_order(df).collect()} == {v: i for i, v in enumerate(order)}
    k = max(want.values())
    assert {v for e in rows(core.k_core(df, k)) for v in e} == {v for v in want if want[v] >= k}
    at = {v: i for i, v in enumerate(order)}
    assert core.largest_later(core.degeneracy_recoded(df)).first()[0] == max(sum(at[w] > at[v] for w in near[v]) for v in near)
    bins = {r.v: r.bin for r in core.shell_bins(df, 3).collect()}
    for shell in set(want.values()):
        members = [v for v in order if want[v] == shell]
        run = len(members) // 3 + 1
        assert [bins[v] for v in members] == [i // run for i in range(len(members))]
    dealt = {r.v: r.bin for r in core.shell_bins(df, 3, dealt=True).collect()}
    assert max(dealt.values()) <= 2


def test_sets(spark):
    given = [[1, 2], [2, 1], [1, 2, 3], [3], [4, None], [4, 4], [], None, [5, 6], [6, 7], [1, 2, 3, 9], [1]]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(given)], "set_id long, members array<long>")
    assert {tuple(r.members) for r in sets.dedup_sets(df).collect()} == {(1, 2), (1, 2, 3), (3,), (4,), (5, 6), (6, 7), (1, 2, 3, 9), (1,)}
    assert {tuple(r.members) for r in sets.maximal_sets(df).collect()} == {(4,), (5, 6), (6, 7), (1, 2, 3, 9)}
    assert [(r.rank, r.members) for r in sets.top_sets(df).orderBy("rank").collect()] == [(1, [1, 2, 3, 9]), (2, [1, 2, 3])]
    assert sets.maximal_sets(df.where("false")).count() == 0


def test_arrays(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [2, 4, 6], [4, 2])], "a array<long>, b array<long>, c array<long>")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    got = df.select(F.array_sort(arrays.intersection(a, b, c)), arrays.intersection_size(a, b), arrays.probed(a, b), arrays.difference(a, b), arrays.is_subset(c, b)).first()
    assert tuple(got) == ([2, 4], 2, [2, 4], [1, 3], True)


def test_tables_of_rounds_go(some):
    edges, near, df = some
    for worth in (0, 10**9):
        before = set(tables._folders)
        found = core.core_numbers(df, worth=worth)
        assert len(set(tables._folders) - before) <= 2
        assert found.count() == len(near)
    before = set(tables._folders)
    inner = {r.v for r in core.core_numbers(df).where("core >= 3").collect()}
    assert rows(core.k_core(df, 3)) == {e for e in edges if inner.issuperset(e)}
    with tables.temporary_tables():
        core.core_numbers(df).collect()
        assert len(set(tables._folders) - before) > 1
    kept = set(tables._folders)
    written(df)
    assert len(set(tables._folders) - kept) == 1


def test_forget_leaves_other_tables(some):
    _, _, df = some
    own = written(df)
    tables.forget(own, df.limit(1), None)
    assert df.count() > 0
    with pytest.raises(Exception, match="(?i)exist|found"):
        own.count()
