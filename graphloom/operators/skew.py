"""Per-key work without imbalance when a few keys hold most records.

The load of every key is known from exact partial counts. Keys above a fair
share are split into shards in proportion to their load; shards, and buckets of
the remaining keys, are bin-packed onto tasks. In a join the other side's rows
are replicated only to the tasks that hold shards of their key.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.tables import shuffle_partitions

#: Hash buckets of small keys per task; the unit in which small keys are packed.
BUCKETS_PER_TASK = 16
#: A key is split when it has more than a task's fair share divided by this.
SHARDS_PER_TASK = 4


@dataclass
class LoadPlan:
    """Which task does what: ``bucket_task`` by bucket of small keys, ``shard_tasks`` by large key."""

    tasks: int
    bucket_task: list[int]
    shard_tasks: dict = field(default_factory=dict)
    task_load: list[int] = field(default_factory=list)

    @property
    def buckets(self) -> int:
        return len(self.bucket_task)


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def pack(loads: list[tuple[int, object]], tasks: int) -> tuple[list[tuple[object, int]], list[int]]:
    """Largest load first onto the least loaded task: ``[(item, task)]`` and the load of each task."""
    heap = [(0, t) for t in range(tasks)]
    out, total = [], [0] * tasks
    for load, item in sorted(loads, key=lambda x: (-x[0], str(x[1]))):
        _, task = heap[0]
        total[task] += load
        heapq.heapreplace(heap, (total[task], task))
        out.append((item, task))
    return out, total


def plan_load(df: DataFrame, key: str, tasks: int | None = None) -> LoadPlan:
    """The plan for the rows of ``df`` by ``key``; rows with a null key have no load.

    Two counting passes over the key column, both aggregated before the shuffle:
    rows per bucket, then rows per key in the buckets above the fair share. The
    driver gets one number per bucket and at most ``tasks * SHARDS_PER_TASK``
    large keys, as each has more than that part of all rows.
    """
    tasks = tasks or shuffle_partitions(df.sparkSession)
    buckets = tasks * BUCKETS_PER_TASK
    keyed = df.select(F.col(key).alias("_key")).where(F.col("_key").isNotNull()).withColumn("_bucket", bucket_of(F.col("_key"), buckets))
    load = dict.fromkeys(range(buckets), 0)
    load.update((r[0], r[1]) for r in keyed.groupBy("_bucket").count().collect())
    fair = max(1, math.ceil(sum(load.values()) / (tasks * SHARDS_PER_TASK)))
    heavy = [b for b, n in load.items() if n > fair]
    large: dict = {}
    if heavy:
        counts = keyed.where(F.col("_bucket").isin(heavy)).groupBy("_key", "_bucket").count()
        for k, b, n in counts.where(F.col("count") > fair).collect():
            large[k] = n
            load[b] -= n
    items: list[tuple[int, object]] = [(n, ("bucket", b)) for b, n in load.items()]
    for k, n in large.items():
        shards = math.ceil(n / fair)
        items += [(n // shards + (i < n % shards), ("key", k)) for i in range(shards)]
    placed, totals = pack(items, tasks)
    plan = LoadPlan(tasks, [0] * buckets, {}, totals)
    for (kind, what), task in placed:
        if kind == "bucket":
            plan.bucket_task[what] = task
        else:
            plan.shard_tasks.setdefault(what, []).append(task)
    return plan


def _large(spark: SparkSession, plan: LoadPlan, kind: T.DataType) -> DataFrame:
    """The large keys and the tasks of their shards: at most ``tasks * SHARDS_PER_TASK`` rows."""
    schema = T.StructType([T.StructField("_large", kind), T.StructField("_shard_tasks", T.ArrayType(T.IntegerType()))])
    return spark.createDataFrame([(k, tasks) for k, tasks in plan.shard_tasks.items()], schema)


def _bucket_task(key: Column, plan: LoadPlan) -> Column:
    tasks = F.expr(f"array({','.join(map(str, plan.bucket_task))})")
    return F.element_at(tasks, bucket_of(key, plan.buckets) + 1)


def split_by_load(df: DataFrame, key: str, plan: LoadPlan) -> tuple[DataFrame, DataFrame | None]:
    """The rows of small keys and those of large keys; rows with a null key are in neither."""
    rows = df.where(F.col(key).isNotNull())
    if not plan.shard_tasks:
        return rows, None
    large = F.broadcast(_large(df.sparkSession, plan, df.schema[key].dataType))
    same = F.col(key) == F.col("_large")
    return rows.join(large, same, "left_anti"), rows.join(large, same).drop("_large")


def on_task(df: DataFrame, plan: LoadPlan, task: Column) -> DataFrame:
    """``df`` with its rows on the partition that the column ``task`` names."""
    return df.withColumn("_task", task).repartitionById(plan.tasks, F.col("_task"))


def fragment(df: DataFrame, key: str, plan: LoadPlan, spread: Column) -> tuple[DataFrame, DataFrame | None]:
    """Both parts of ``split_by_load``, each on its tasks; ``spread`` tells which shard a row of a large key joins."""
    small, large = split_by_load(df, key, plan)
    small = on_task(small, plan, _bucket_task(F.col(key), plan))
    if large is None:
        return small, None
    shard = F.pmod(F.xxhash64(spread), F.size("_shard_tasks")).cast("int") + 1
    large = large.withColumn("_task", F.element_at("_shard_tasks", shard)).drop("_shard_tasks")
    return small, on_task(large, plan, F.col("_task"))


def fragment_replicate_join(df: DataFrame, other: DataFrame, key: str, spread: Column, plan: LoadPlan | None = None) -> DataFrame:
    """Inner join of ``df`` and ``other`` on the column ``key`` of both.

    Rows of ``df`` lie on the tasks of their key's shards; each row of ``other``
    is sent to the one task of its small key, or to every task that has a shard
    of its large key, and to no other. Null keys match nothing. Names that both
    sides have besides ``key`` are an error of the caller, as in any join.
    """
    plan = plan or plan_load(df, key)
    small, large = fragment(df, key, plan, spread)
    other_small, other_large = split_by_load(other, key, plan)
    out = small.join(on_task(other_small, plan, _bucket_task(F.col(key), plan)), ["_task", key])
    if large is not None:
        copies = other_large.withColumn("_task", F.explode(F.array_distinct("_shard_tasks"))).drop("_shard_tasks")
        out = out.unionByName(large.join(on_task(copies, plan, F.col("_task")), ["_task", key]))
    return out.drop("_task")


def edge_ends(edges: DataFrame, *also: str) -> DataFrame:
    """``(v, nbr, row)`` and the columns ``also``: one row for each end of each edge row; a self loop is one row without a neighbour."""
    src, dst = F.col("src"), F.col("dst")
    none = F.lit(None).cast(edges.schema["src"].dataType)
    both = F.array(F.struct(src.alias("v"), dst.alias("nbr")), F.struct(dst.alias("v"), src.alias("nbr")))
    loop = F.array(F.struct(src.alias("v"), none.alias("nbr")))
    ends = edges.select(F.col("edge_id").alias("row"), *also, F.explode(F.when(src == dst, loop).otherwise(both)).alias("e"))
    return ends.select("e.v", "e.nbr", "row", *also).where(F.col("v").isNotNull())


def vertex_loads(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """``(v, entries, neighbours)`` of every vertex.

    ``entries``: rows of which ``v`` is an end, repeated rows and rows with a null
    other end too, a self loop once. ``neighbours``: distinct vertices at the other
    ends, without ``v`` itself. Null is no vertex; an empty table gives no rows.

    The rows of a large vertex are dealt out to its shards by row, so repeated
    rows of one edge spread as well; each shard reduces its rows to one per
    neighbour before the neighbours meet.
    """
    ends = edge_ends(edges)
    plan = plan_load(ends, "v", tasks)
    small, large = fragment(ends, "v", plan, F.col("row"))
    out = small.groupBy("_task", "v").agg(F.count("*").alias("entries"), F.count_distinct("nbr").alias("neighbours")).drop("_task")
    if large is not None:
        per_neighbour = large.groupBy("v", "nbr").agg(F.count("*").alias("n"))
        out = out.unionByName(per_neighbour.groupBy("v").agg(F.sum("n").alias("entries"), F.count("nbr").alias("neighbours")))
    return out


def max_degree(edges: DataFrame) -> DataFrame:
    """``(max_degree)``: the largest number of distinct neighbours; null for a table without vertices."""
    return vertex_loads(edges).agg(F.max("neighbours").alias("max_degree"))


def found_hubs(edges: DataFrame, share: tuple[int, int] = (1, 100)) -> DataFrame:
    """``(v)``: the vertices that are an end of more than ``share`` of all rows."""
    over, of = share
    rows = edges.count()
    return vertex_loads(edges).where(F.col("entries") * of > F.lit(rows * over)).select("v")


def file_hub_entries(edges: DataFrame, least: int = 1000) -> DataFrame:
    """``(file_id, hub_entries)``: per file the edge ends at vertices with ``least`` entries or more, by a fragment-replicate join."""
    ends = edge_ends(edges, "file_id")
    busy = vertex_loads(edges).where(F.col("entries") >= least).select("v")
    joined = fragment_replicate_join(ends, busy, "v", F.col("row"))
    return joined.groupBy("file_id").agg(F.count("*").alias("hub_entries"))
