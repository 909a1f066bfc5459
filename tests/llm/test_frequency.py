import random
from collections import Counter

from graphloom.llm import frequency

SCHEMA = "graph_id long, labels array<int>, term int, n int"


def brute_force(rows):
    best = {}
    for g, labels, *_ in rows:
        if g is not None:
            for k, n in Counter(x for x in labels or [] if x is not None).items():
                best[g, k] = max(best.get((g, k), 0), n)
    return {k: (sum(n for (_, x), n in best.items() if x == k), sum(x == k for _, x in best)) for _, k in best}


def test_against_brute_force_over_many_partitions(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, []] + [[rng.choice([None, 7, 7, *range(30)]) for _ in range(rng.randrange(40))]] * 6), 0, 0) for _ in range(300)]
    got = {r.term: (r.occurrences, r.records) for r in frequency.term_frequency(spark.createDataFrame(rows, SCHEMA), "graph_id", "labels", 13).collect()}
    assert got == brute_force(rows)


def test_marks(spark):
    rows = [(g, [1] * (g < 2) + [2] * (g < 3) + [3] * (g < 4) + [4] * (g < 5), 0, 0) for g in range(9)] + [(9, None, 0, 0), (0, [1], 0, 0)]
    got = {r.label: r.mark for r in frequency.label_frequency(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: "rare", 2: None, 3: None, 4: "common"}
    assert {tuple(r) for r in frequency.found_labels(spark.createDataFrame(rows, SCHEMA)).collect()} == {(1, "rare"), (4, "common")}


def test_empty_tables_and_strings(spark):
    assert frequency.label_frequency(spark.createDataFrame([], SCHEMA)).count() == 0
    assert frequency.label_frequency(spark.createDataFrame([(1, None, 0, 0), (2, [], 0, 0), (None, [1], 0, 0)], SCHEMA)).count() == 0
    words = spark.createDataFrame([("a", ["x", "y", "x"]), ("b", ["x"])], "id string, w array<string>")
    assert {tuple(r) for r in frequency.term_frequency(words, "id", "w").collect()} == {("x", 3, 2), ("y", 1, 1)}


def test_one_term_in_all_records_and_long_lists(spark):
    rows = [(g, [5] * 50 + list(range(1000, 1000 + g)), 0, 0) for g in range(300)]
    got = {r.term: (r.occurrences, r.records) for r in frequency.term_frequency(spark.createDataFrame(rows, SCHEMA), "graph_id", "labels", 8).collect()}
    assert got == brute_force(rows)
