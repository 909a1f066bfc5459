"""Sets of vertices as rows ``(members)``: one of each, only the maximal ones, the largest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.arrays import is_subset
from graphloom.tables import written


def as_set(members: str = "members"):  # noqa: ANN201
    return F.array_sort(F.array_distinct(F.filter(members, lambda x: x.isNotNull())))


def dedup_sets(sets: DataFrame) -> DataFrame:
    """``(members)``: every set once, its members sorted, without nulls and repeats; rows without members are left out."""
    return sets.select(as_set().alias("members")).where(F.size("members") > 0).distinct()


def maximal_sets(sets: DataFrame) -> DataFrame:
    """``(members)``: the different sets that are no proper subset of another.

    A set can only be part of sets that have its rarest member, so it is held
    against those alone, and of them against the larger ones.
    """
    unique = written(dedup_sets(sets).withColumn("_key", F.xxhash64("members")))
    each = unique.select("members", "_key", F.explode("members").alias("_member"))
    often = each.groupBy("_member").agg(F.count("*").alias("_n"))
    rarest = each.join(often, "_member").groupBy("members").agg(F.min_by("_member", F.struct("_n", "_member")).alias("_member"), F.min("_n").alias("_n")).where(F.col("_n") > 1)
    other = each.select(F.col("members").alias("_larger"), "_member")
    within = (F.size("_larger") > F.size("members")) & is_subset(F.col("members"), F.col("_larger"))
    covered = rarest.select("members", "_member").join(other, "_member").where(within).select("members")
    return unique.select("members").join(covered, "members", "left_anti")


def top_sets(sets: DataFrame, number: int = 2) -> DataFrame:
    """``(rank, members)`` of the ``number`` largest different sets; equal sizes in the order of their members."""
    best = dedup_sets(sets).select(F.size("members").alias("_size"), "members").orderBy(F.desc("_size"), "members").limit(number)
    return best.select(F.row_number().over(Window.orderBy(F.desc("_size"), "members")).alias("rank"), "members")


def member_text(sets: DataFrame) -> DataFrame:
    """``(members)`` as text, separated by commas."""
    return sets.select(F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))
