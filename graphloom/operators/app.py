"""Own searches for subgraphs: give the first states, one step, and what a result is."""

from __future__ import annotations

from abc import ABC, abstractmethod
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.arrays import child_state
from graphloom.operators.graph import adjacency, split_by_order
from graphloom.tables import written


class SubgraphApp(ABC):
    """A search over a graph given as ``adj(v, nbrs, deg)``; a state is a row of whatever columns the app uses."""

    @abstractmethod
    def spawn(self, adj: DataFrame) -> DataFrame:
        """The first states."""

    @abstractmethod
    def expand(self, states: DataFrame, adj: DataFrame) -> DataFrame:
        """The states that follow from ``states``."""

    @abstractmethod
    def is_result(self) -> Column:
        """Whether a state is a result."""

    def result(self, states: DataFrame) -> DataFrame:
        """The rows to keep of the states that are results."""
        return states


def run(app: SubgraphApp, edges: DataFrame, most_levels: int = 1000) -> DataFrame:
    """All results; every level is written to the shared folder, so a lost executor costs one level at most."""
    adj = written(adjacency(edges))
    states, found = app.spawn(adj), []
    for _ in range(most_levels):
        states = written(states)
        found.append(app.result(states.where(app.is_result())))
        if states.isEmpty():
            return reduce(DataFrame.union, found)
        states = app.expand(states, adj)
    raise ValueError(f"not at an end after {most_levels} levels")


class CliqueSearch(SubgraphApp):
    """Maximal cliques by candidate and excluded lists, level by level."""

    def spawn(self, adj: DataFrame) -> DataFrame:
        return split_by_order(adj).select(F.array("v").alias("r"), F.col("later").alias("p"), F.col("earlier").alias("x"))

    def expand(self, states: DataFrame, adj: DataFrame) -> DataFrame:
        each = states.select("r", "p", "x", F.explode("p").alias("v")).join(adj.select("v", "nbrs"), "v")
        return each.select(child_state(F.col("r"), F.col("p"), F.col("x"), F.col("v"), F.col("nbrs")).alias("s")).select("s.*")

    def is_result(self) -> Column:
        return (F.size("p") == 0) & (F.size("x") == 0)

    def result(self, states: DataFrame) -> DataFrame:
        return states.select(F.array_sort("r").alias("members"))
