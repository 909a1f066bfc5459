"""Operations on sorted neighbour lists, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def intersection(*lists: Column) -> Column:
    """Members of all lists; of any number of them."""
    return reduce(F.array_intersect, lists)


def intersection_size(*lists: Column) -> Column:
    return F.size(intersection(*lists)).cast("bigint")


def probed(items: Column, within: Column) -> Column:
    """The items, in their order and as often as they come, that are in ``within``."""
    return F.filter(items, lambda x: F.array_contains(within, x))


def difference(items: Column, without: Column) -> Column:
    return F.array_except(items, without)


def child_state(clique: Column, candidates: Column, excluded: Column, v: Column, near: Column) -> Column:
    """The search state ``(r, p, x)`` after ``v`` joins the clique: earlier candidates become excluded, later ones stay, both only if they are near ``v``."""
    earlier = F.filter(candidates, lambda u: u < v)
    later = F.filter(candidates, lambda u: u > v)
    return F.struct(F.concat(clique, F.array(v)).alias("r"), F.array_intersect(later, near).alias("p"), F.array_intersect(F.concat(excluded, earlier), near).alias("x"))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0
