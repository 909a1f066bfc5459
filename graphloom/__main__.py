"""Command line: ``python -m graphloom COMMAND GRAPH [options]``; prints counts, or writes lines with ``--out``."""

from __future__ import annotations

import argparse
import time
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators import cliques, cluster, core, match, quasi, sets
from graphloom.plans.pattern import preset
from graphloom.sources import readers, writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    p.add_argument("command", choices=["match", "cliques", "cores", "quasi", "kernels", "maximal", "kmeans", "fennel", "convert"])
    p.add_argument("graph", help="graph file by suffix; for maximal a file of sets")
    p.add_argument("--kind", help="kind of the graph file, if its suffix doesn't tell")
    p.add_argument("-q", "--pattern", type=int, default=0)
    p.add_argument("--ratio", default="0.8", help="share of the others that each member of a quasi-clique is adjacent to")
    p.add_argument("--min-size", type=int, default=4)
    p.add_argument("--kernel-file")
    p.add_argument("--first", type=int, help="only the first so many kernels")
    p.add_argument("-k", "--parts", default="4", help="clusters or parts; for kmeans also 4x4 or 2^3")
    p.add_argument("-i", "--iterations", type=int, default=20)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--to", choices=["bin", "peregrine", "pangolin", "gsi", "adjacency", "labelled", "parquet"], default="parquet")
    p.add_argument("--out", help="where to write the result")
    return p


def _converted(edges: DataFrame, to: str, out: str) -> int:
    n = (edges.selectExpr("max(dst)").first()[0] or -1) + 1
    if to == "bin":
        writers.write_csr(edges, out, n)
    elif to == "parquet":
        writers.write_table(edges, out)
    elif to == "adjacency":
        writers.write_lines(writers.adjacency_lines(edges, n), out, "v", single=True)
    elif to in ("gsi", "labelled"):
        vertices = edges.sparkSession.range(n).withColumnRenamed("id", "v")
        lines = writers.gsi_lines(edges, vertices) if to == "gsi" else writers.labelled_lines(edges, writers.with_labels(vertices))
        writers.write_lines(lines, out, "kind", "a", "b", single=True)
    else:
        lines = writers.peregrine_edges(edges) if to == "peregrine" else writers.pangolin_edges(edges)
        writers.write_lines(lines, out, "src", "dst", single=True)
    return edges.count()


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    """The number that the command prints."""
    if a.command == "maximal":
        found = sets.maximal_sets(readers.read_sets(spark, a.graph))
    else:
        edges = readers.read_graph(spark, a.graph, a.kind)
        share = Fraction(a.ratio)
        ratio = (share.numerator, share.denominator)
        if a.command == "match":
            return match.match_count(edges, preset(a.pattern)).first()[0]
        if a.command == "convert":
            return _converted(edges, a.to, a.out)
        if a.command in ("cores", "kmeans", "fennel"):
            column, table = {"cores": ("core", lambda: core.core_numbers(edges)), "kmeans": ("cluster", lambda: cluster.kmeans(edges, a.parts, a.iterations, a.seed)), "fennel": ("part", lambda: cluster.fennel(edges, int(a.parts)))}[a.command]
            df = table()
            if a.out:
                writers.write_lines(writers.part_lines(df, column), a.out, "v")
            return df.select(column).distinct().count()
        if a.command == "cliques":
            found = cliques.maximal_cliques(edges)
        elif a.command == "quasi":
            found = quasi.quasi_cliques(edges, ratio, a.min_size)
        else:
            kernels = readers.read_sets(spark, a.kernel_file, a.first).withColumnRenamed("set_id", "kernel_id")
            found = quasi.kernel_expand(edges, kernels, ratio, a.min_size)
    if a.out:
        writers.write_lines(writers.set_lines(found), a.out, "members")
    return found.count()


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    began = time.time()
    print(f"{a.command}: {run(spark, a)}")
    print(f"seconds: {time.time() - began:.2f}")


if __name__ == "__main__":
    main()
