import pytest
from pyspark.sql import functions as F

from graphloom.llm import spelling

SCHEMA = "rec_id long, begin_name string, end_name string, copies int, kept_id string"


def pairs(df):
    return sorted((r.kept_id, r.rec_id) for r in df.collect())


@pytest.mark.parametrize("hot_keys", [1, 3, 10**6])
def test_groups_do_not_depend_on_what_is_hot(spark, hot_keys):
    rows = [
        (10, "Ab-1", "x", 0, ""), (3, "ab 1", "X!", 0, ""), (7, "X", "a​B1", 0, ""),  # one group, exchanged and respelled
        (4, "áb1", "x", 0, ""), (5, "ab01", "x", 0, ""), (6, "аb1", "x", 0, ""),  # accent, zero, Cyrillic a: others
        (1, None, "x", 0, ""), (2, None, "x", 0, ""), (8, "--", "x", 0, ""), (9, "", "", 0, ""),
        (11, "q", "q", 0, ""), (12, "Q", "Q ", 0, ""), (None, "q", "q", 0, ""),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert pairs(spelling.found_copies(df, hot_keys)) == [(3, 7), (3, 10), (11, 12)]
    assert sorted(map(tuple, spelling.collapse(df, hot_keys).collect())) == [(3, 3), (4, 1), (5, 1), (6, 1), (11, 2)]


def test_key_keeps_the_border_between_names(spark):
    df = spark.createDataFrame([(1, "ab", "c", 0, ""), (2, "a", "bc", 0, "")], SCHEMA)
    assert pairs(spelling.found_copies(df)) == []


def test_repeated_records_and_a_third_in_one_group(spark):
    df = spark.range(900).select(F.col("id").alias("rec_id"), F.when(F.col("id") % 3 == 0, "One").otherwise(F.concat(F.lit("n"), "id")).alias("begin_name"), F.lit("Two").alias("end_name"))
    df = df.union(df.where("rec_id = 3"))
    found = pairs(spelling.found_copies(df))
    assert found == sorted([(0, i) for i in range(3, 900, 3)] + [(0, 3)])
    hot = spelling.hot_hashes(spelling._keyed(df, "rec_id", spelling.edge_key()), 901, 512).collect()
    assert [r._salts for r in hot] == [172]  # 301 of 901 records, in parts of 901 / 512


def test_a_key_is_hot_by_the_share_of_a_task(spark):
    key = F.when(F.col("id") % 600 == 0, F.lit("hot")).otherwise(F.concat(F.lit("n"), F.col("id").cast("string")))
    df = spark.range(60_000).select(F.col("id").alias("rec_id"), key.alias("begin_name"), F.lit("Two").alias("end_name"))
    assert spelling._split(df, "rec_id", spelling.edge_key(), None)[1] is None  # 1/600 of the records is little for 8 tasks
    spark.conf.set("spark.sql.shuffle.partitions", "4096")
    try:
        light, heavy = spelling._split(df, "rec_id", spelling.edge_key(), None)
        assert {r[0] for r in heavy.select("_key").distinct().collect()} == {"hot two"}
        assert (heavy.count(), light.count()) == (100, 59_900)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_empty_and_very_long(spark):
    assert pairs(spelling.found_copies(spark.createDataFrame([], SCHEMA))) == []
    long = "x-" * 200_000
    df = spark.createDataFrame([(1, long, "b", 0, ""), (2, "B", "X" * 200_000, 0, "")], SCHEMA)
    assert pairs(spelling.found_copies(df)) == [(1, 2)]
