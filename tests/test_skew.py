import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import skew

SCHEMA = "edge_id long, file_id int, src long, dst long, v int, entries int, row int"


def table(spark, pairs):
    return spark.createDataFrame([(i, i % 3, a, b, 0, 0, 0) for i, (a, b) in enumerate(pairs)], SCHEMA)


def brute_force(pairs):
    entries, near = {}, {}
    for a, b in pairs:
        for v, w in {(a, b), (b, a)}:
            if v is not None:
                entries[v] = entries.get(v, 0) + 1
                near.setdefault(v, set()).update({w} - {None, v})
    return {v: (n, len(near[v])) for v, n in entries.items()}


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(1)
    some = lambda: rng.choice([None, 5, 5, 5, *range(10, 60), 2**32 - 1])
    return [(some(), some()) for _ in range(2000)] + [(7, 8)] * 900


@pytest.mark.parametrize("tasks", [1, 3, 8])
def test_vertex_loads(spark, pairs, tasks):
    got = {r.v: (r.entries, r.neighbours) for r in skew.vertex_loads(table(spark, pairs), tasks).collect()}
    assert got == brute_force(pairs)


def test_loads_of_tasks_are_even(spark, pairs):
    ends = skew.edge_ends(table(spark, pairs))
    plan = skew.plan_load(ends, "v", 4)
    assert {7, 8} <= set(plan.shard_tasks) and len(plan.shard_tasks) <= 4 * skew.SHARDS_PER_TASK
    assert sum(plan.task_load) == ends.count()
    assert max(plan.task_load) <= 1.3 * sum(plan.task_load) / 4
    small, large = skew.fragment(ends, "v", plan, F.col("row"))
    sizes = {}
    for df in (small, large):
        for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect():
            sizes[r.p] = sizes.get(r.p, 0) + r["count"]
    assert max(sizes.values()) <= 1.4 * sum(sizes.values()) / 4


def test_rows_land_where_planned(spark, pairs):
    ends = skew.edge_ends(table(spark, pairs))
    small, large = skew.fragment(ends, "v", skew.plan_load(ends, "v", 4), F.col("row"))
    for df in (small, large):
        assert df.where(F.col("_task") != F.spark_partition_id()).count() == 0


def test_fragment_replicate_join(spark, pairs):
    ends = skew.edge_ends(table(spark, pairs))
    other = spark.createDataFrame([(5, "hub"), (7, "pair"), (7, "again"), (11, "small"), (999, "none"), (None, "null")], "v long, name string")
    got = sorted(map(tuple, skew.fragment_replicate_join(ends, other, "v", F.col("row")).select("v", "row", "name").collect()))
    assert got == sorted(map(tuple, ends.join(other, "v").select("v", "row", "name").collect()))
    assert len(got) > 1000


def test_found_and_max_degree(spark):
    pairs = [(1, 1)] + [(2, None)] * 2 + [(3, 100 + i) for i in range(97)]
    assert [r.v for r in skew.found_hubs(table(spark, pairs)).orderBy("v").collect()] == [2, 3]
    assert skew.max_degree(table(spark, pairs)).first()[0] == 97
    files = {r.file_id: r.hub_entries for r in skew.file_hub_entries(table(spark, pairs), 97).collect()}
    assert sum(files.values()) == 97


def test_empty(spark):
    df = table(spark, [(1, 2)]).where("false")
    assert skew.vertex_loads(df).count() == 0
    assert skew.found_hubs(df).count() == 0
    assert skew.max_degree(df).first()[0] is None
    assert skew.vertex_loads(table(spark, [(None, None)])).count() == 0


def test_pack_takes_the_largest_first():
    placed, totals = skew.pack([(5, "a"), (4, "b"), (3, "c"), (3, "d"), (3, "e")], 2)
    assert sorted(totals) == [8, 10]
    assert len(placed) == 5
