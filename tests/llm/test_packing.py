import random
from collections import defaultdict

import pytest

from graphloom.llm import packing

BINS = "bin_kind string, capacity int, tokens int"


@pytest.mark.parametrize("windows", [1, 2, 3, 7, 50])
def test_differencing_places_every_item_once(windows):
    rng = random.Random(windows)
    sizes = [rng.randint(1, 100) for _ in range(41)]
    parts = packing.differencing(sizes, windows)
    assert len(parts) <= windows
    assert sorted(i for p in parts for i in p) == list(range(41))


def test_differencing_balances():
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in packing.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]
    sizes = [random.Random(1).randint(1, 100) for _ in range(400)]
    sums = [sum(sizes[i] for i in p) for p in packing.differencing(sizes, 10)]
    assert max(sums) - min(sums) <= 3


def test_differencing_of_nothing():
    assert packing.differencing([], 3) == []
    assert packing.fill([], 10) == []


@pytest.mark.parametrize("capacity", [100, 256, 1024])
def test_fill(capacity):
    rng = random.Random(capacity)
    sizes = [min(capacity, rng.randint(1, 300)) for _ in range(700)] + [capacity] * 5 + [1] * 20
    parts = packing.fill(sizes, capacity)
    assert sorted(i for p in parts for i in p) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in p) <= capacity for p in parts)
    # first-fit decreasing, which knows no balance, as a measure
    rooms = []
    for s in sorted(sizes, reverse=True):
        at = next((i for i, r in enumerate(rooms) if r >= s), None)
        if at is None:
            rooms.append(capacity - s)
        else:
            rooms[at] -= s
    assert len(parts) <= 1.06 * len(rooms) + 2


def place(spark, counts, bins=(("a", 10, 0), ("b", 64, 0)), group=packing.GROUP):
    return packing.packed(spark.createDataFrame(counts, "doc_id long, tokens long, capacity int"), spark.createDataFrame(bins, BINS), group).collect()


def test_every_text_once_and_cut_only_above_the_capacity(spark):
    rng = random.Random(3)
    counts = [(i, rng.choice([0, 1, 5, 9, 10, 11, 64, 65, 300]), 0) for i in range(400)] + [(400, None, 0), (401, 0, 0)]
    rows = place(spark, counts, group=50)
    for kind, capacity in (("a", 10), ("b", 64)):
        pieces, loads = defaultdict(list), defaultdict(int)
        for r in rows:
            if r.bin_kind == kind:
                pieces[r.doc_id].append((r.first_token, r.tokens))
                loads[r.container] += r.tokens
        assert max(loads.values()) <= capacity
        for doc, n, _ in counts:
            got = sorted(pieces.get(doc, []))
            if not n:
                assert got == []
            else:
                assert [p[0] for p in got] == list(range(0, n, capacity))
                assert sum(p[1] for p in got) == n


def test_same_result_for_any_number_of_tasks(spark):
    counts = [(i, 1 + i % 9, 0) for i in range(200)]
    first = sorted(map(tuple, place(spark, counts)))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert sorted(map(tuple, place(spark, counts))) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_an_overflowing_group_is_split_over_all_sizes():
    sizes = sorted([60] * 20 + [40] * 20)
    columns = [["a"] * 40, [0] * 40, [100] * 40, list(range(40)), [0] * 40, sizes]
    names = ["bin_kind", "_group", "capacity", "doc_id", "first_token", "tokens"]
    batches = [packing.pa.RecordBatch.from_arrays([packing.pa.array(c[i : i + 16]) for c in columns], names) for i in range(0, 40, 16)]
    out = [r for b in packing._packer(20)(iter(batches)) for r in b.to_pylist()]
    assert sorted(r["doc_id"] for r in out) == list(range(40))
    assert len({r["container"] for r in out}) == 20  # 30 if the largest are packed apart


def test_a_group_of_any_size_is_packed_as_one(spark):
    rows = place(spark, [(i, 40 + i % 2 * 20, 0) for i in range(2200)], bins=[("a", 100, 0)], group=2200)
    assert len({r.container for r in rows}) == 1100


def test_no_texts_or_no_bins(spark):
    assert place(spark, [(1, None, 0)]) == []
    assert place(spark, [(1, 5, 0)], bins=[("z", None, 0), ("y", 0, 0)]) == []


def test_repeated_rows(spark):
    rows = place(spark, [(1, 7, 0)] * 3, bins=[("a", 10, 0)])
    assert sum(r.tokens for r in rows) == 21


def test_report(spark):
    counts = spark.createDataFrame([(1, 7), (2, 4), (3, 12), (4, None), (5, 0)], "doc_id long, tokens long")
    bins = spark.createDataFrame([("a", 10, 0), ("a", 12, 0)], BINS)
    placed = packing.packed(counts, bins)
    assert [tuple(r) for r in packing.fill_report(counts, placed, bins).collect()] == [("a", 3, 3, True, True, True)]
    for wrong, column in ((placed.where("doc_id <> 1"), "placed_once"), (placed.union(placed.where("doc_id = 2")), "placed_once"), (placed.withColumn("container", packing.F.lit("x")), "within")):
        assert not packing.fill_report(counts, wrong, bins).first()[column]
    apart = placed.withColumn("container", packing.F.concat("container", packing.F.col("doc_id").cast("string")))
    assert packing.fill_report(counts, apart, bins).first().containers == 4
