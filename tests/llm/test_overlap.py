import math
import random
from itertools import combinations

import numpy as np
import pytest

from graphloom.llm import overlap

OFFSETS, COLS = "slice_id long, v long, off long, deg int, n int", "pos long, nbr long, v long"


def tables(spark, sets, slices=2):
    offsets, cols, pos, slice_id = [], [], 0, 0
    for v, members in sets.items():
        members = list(members)
        size = max(1, len(members) // slices)
        for at in range(0, len(members), size):
            part = members[at : at + size] + [None]
            cols += [(pos + i, m, 0) for i, m in enumerate(part)]
            offsets.append((slice_id, v, pos, len(part), 0))
            pos, slice_id = pos + len(part), slice_id + 1
    offsets += [(slice_id, *offsets[0][1:]), (slice_id + 1, 99, 0, 0, 0), (slice_id + 2, None, 0, 5, 0), (slice_id + 3, 98, None, 5, 0), (slice_id + 4, 97, 3, None, 0)]
    return spark.createDataFrame(offsets, OFFSETS), spark.createDataFrame([*cols, (pos + 5, 77, 0)], COLS)


def expected(sets, least=100):
    large = {v: set(m) for v, m in sets.items() if len(set(m)) >= least}
    return {(a, b) for a, b in combinations(sorted(large), 2) if 2 * len(large[a] & large[b]) >= min(len(large[a]), len(large[b]))}


def found(offsets, cols):
    return {tuple(r) for r in overlap.found_overlaps(offsets, cols).collect()}


@pytest.fixture(scope="module")
def some_sets():
    rng = random.Random(4)
    sets = {v: set(rng.sample(range(50_000), rng.choice([5, 99, 100, 130, 400, 2500]))) for v in range(30)}
    for v in range(30, 45):
        base = sorted(sets[rng.choice(range(30))])
        sets[v] = set(rng.sample(base, int(len(base) * rng.uniform(0.3, 1)))) | set(rng.sample(range(50_000, 90_000), rng.choice([10, 100, 300])))
    for v in range(45):  # two members that every set has
        sets[v] |= {90_001, 90_002}
    return sets


def test_members(spark, some_sets):
    offsets, cols = tables(spark, some_sets)
    got = {tuple(r) for r in overlap.slices_to_members(offsets, cols).collect()}
    assert got == {(v, m) for v, members in some_sets.items() for m in members}


def test_found_is_exact(spark, some_sets):
    want = expected(some_sets)
    assert len(want) > 5
    assert found(*tables(spark, some_sets)) == want


def test_estimates(spark, some_sets):
    rows = {(r.v_a, r.v_b): r for r in overlap.overlap_report(*tables(spark, some_sets)).collect()}
    for a, b in expected(some_sets):
        r = rows[a, b]
        assert (r.n_a, r.n_b) == (len(some_sets[a]), len(some_sets[b]))
        assert abs(r.both - len(some_sets[a] & some_sets[b])) <= 6 * r.error


def test_report_compares_every_pair(spark):
    sets = {v: {0, *range(10_000 * v + 1, 10_000 * v + 2000 + v)} for v in range(1, 9)} | {9: set(range(100_000, 102_000))}
    rows = {(r.v_a, r.v_b): r for r in overlap.overlap_report(*tables(spark, sets)).collect()}
    assert set(rows) == set(combinations(range(1, 10), 2))
    assert all(abs(r.both - (r.v_b != 9)) <= 5 * r.error for r in rows.values())
    assert overlap.overlap_report(*tables(spark, sets), share=(1, 10)).count() == 0


def registers(hashes):
    p, out = overlap.PRECISION, {}
    for h in hashes.tolist():
        rest = (h << p) & (2**64 - 1)
        out[h >> (64 - p)] = max(out.get(h >> (64 - p), 0), 64 - rest.bit_length() + 1)
    return np.array([i * 64 + k for i, k in sorted(out.items())])


def test_paired_registers():
    one, other = np.zeros(8, dtype=np.int8), np.array([0 * 64 + 3, 2 * 64 + 1, 4 * 64 + 2])
    one[[0, 1, 2, 3]] = [3, 2, 2, 1]
    got = overlap.paired_registers(one, [other, np.zeros(0, dtype=np.int64)], 4)
    assert got["equal"].tolist() == [[3, 0, 0, 1], [4, 0, 0, 0]]
    assert got["more"].tolist() == [[0, 1, 2, 0], [0, 1, 2, 1]]
    assert got["less"].tolist() == [[0, 0, 1, 0], [0, 0, 0, 0]]


@pytest.mark.parametrize(("n_a", "n_b", "both"), [(100, 100, 50), (1000, 1000, 0), (1000, 1000, 500), (1000, 1000, 1000), (20_000, 5000, 3000), (500, 20_000, 250)])
def test_estimate_and_its_error(n_a, n_b, both):
    rng, m, off = np.random.default_rng(n_a + both), 1 << overlap.PRECISION, []
    for _ in range(12):
        h = rng.integers(0, 2**64, size=n_a + n_b - both, dtype=np.uint64)
        first, second = registers(h[:n_a]), registers(h[n_a - both :])
        dense = np.zeros(m, dtype=np.int8)
        dense[first >> 6] = first & 63
        x, error = overlap.joint_estimate(overlap.paired_registers(dense, [second], 40), np.array([n_a]), np.array([n_b]), m)
        off.append((x[0] - both) / error[0])
        assert error[0] < max(4, 0.05 * min(n_a, n_b))
    assert max(map(abs, off)) < 4
    assert np.sqrt(np.mean(np.square(off))) < 1.7


def test_no_set_meets_all_by_what_everyone_has(spark):
    rng = random.Random(7)
    sets = {v: {*range(20), *rng.sample(range(100, 50_000), rng.choice([80, 200, 380]))} for v in range(200)}
    sets[500] = {*range(20), *sorted(sets[3])[20:70], *range(60_000, 60_030)}
    rows = [(v, m) for v, members in sets.items() for m in members]
    members = spark.createDataFrame(rows, "v long, nbr long")
    sizes = members.groupBy("v").count().withColumnRenamed("count", "n")
    met = {(r.a, r.b) for r in overlap.meeting_pairs(overlap.counted_members(members), sizes, (1, 2)).collect()}
    assert (3, 500) in met
    assert len(met) < 200 * 199 / 20


def test_sets_of_popular_members_are_found(spark):
    sets = {v: {*range(100), *range(1000 * v, 1000 * v + v % 7)} for v in range(1, 90)}
    assert found(*tables(spark, sets)) == set(combinations(range(1, 90), 2))


def test_the_estimate_decides(spark, some_sets):
    sure, counts = overlap.decided(*tables(spark, some_sets))
    want = expected(some_sets)
    got = {(r.a, r.b) for r in sure.collect()}
    assert got <= want
    assert len(got) >= 0.6 * len(want)
    for r in counts.collect():
        assert r.shared == len(some_sets[r.a] & some_sets[r.b])


def test_least_meetings():
    for mean, n in ((84, 168), (84, 10_000)):
        t = overlap.least_meetings(mean)
        below = sum(math.comb(n, k) * (mean / n) ** k * (1 - mean / n) ** (n - k) for k in range(t))
        assert t > 10
        assert below <= math.exp(-28)


def test_empty(spark):
    offsets, cols = spark.createDataFrame([], OFFSETS), spark.createDataFrame([], COLS)
    assert found(offsets, cols) == set()
    assert overlap.overlap_report(offsets, cols).count() == 0


def test_sketch_is_bounded(spark):
    members = spark.range(500_000).selectExpr("1 as v", "id as nbr")
    assert len(overlap.sketches(members, "v", "nbr").first().regs) == 1 << overlap.PRECISION
