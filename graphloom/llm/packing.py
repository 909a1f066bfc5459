"""Texts of varying length in containers of fixed capacity (problem 7).

Containers are filled by multiway differencing: every item starts as a partial
partition of its own, and the two with the largest differences between their
windows are merged so that these offset each other. The windows come out nearly
equal; where one exceeds the capacity, there are more windows at the next try.
"""

from __future__ import annotations

import heapq
import math
from bisect import insort
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.encoding import TOKENIZERS, VOCABULARY, token_counts
from graphloom.tables import shuffle_partitions, written

#: Items packed together.
GROUP = 2048
#: A window whose unused part is at most this share of the capacity is closed.
UNUSED = 0.02
#: Kinds of container that a job takes at most; every text is placed once for each.
MOST_KINDS = 64


#: A window is one number, its load times 2^32 plus the node that names its items: lists of windows sort and search as lists of numbers.
_NODE = (1 << 32) - 1


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """The items (as positions in ``sizes``) of each window, by largest differencing; windows without items are left out.

    A partial partition lists its windows that have items, smallest first; the
    others are empty. Merging puts the smallest windows of the longer one with the
    windows of the other in opposite order, and moves only these: a single item
    that joins a full partition costs one search.
    """
    if not sizes:
        return []
    made: list[tuple[int, int]] = []  # the two nodes behind each node that is no item
    heap = [(-size, i, [size << 32 | i]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    at = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heap[0][2]
        if len(a) < len(b):
            a, b = b, a
        shared = max(0, len(a) + len(b) - windows)
        joined = b[shared:]
        for x, y in zip(reversed(a[:shared]), b, strict=False):
            joined.append((x >> 32) + (y >> 32) << 32 | len(sizes) + len(made))
            made.append((x & _NODE, y & _NODE))
        del a[:shared]
        if 8 * len(joined) < len(a):
            for x in joined:
                insort(a, x)
        else:
            a += joined
            a.sort()
        smallest = a[0] >> 32 if len(a) == windows else 0
        heapq.heapreplace(heap, (smallest - (a[-1] >> 32), at, a))
        at += 1
    out = []
    for window in heap[0][2]:
        items, todo = [], [window & _NODE]
        while todo:
            node = todo.pop()
            if node < len(sizes):
                items.append(node)
            else:
                todo.extend(made[node - len(sizes)])
        out.append(items)
    return out


def fill(sizes: list[int], capacity: int, unused: float = UNUSED) -> list[list[int]]:
    """The items of each container, none above ``capacity``; every size must be from 1 to ``capacity``.

    The number of windows starts at the least possible. Windows that came out
    full are closed and the other items parted anew; if none did and some exceed
    the capacity, there is one window more. No item is left out.
    """
    pool, more, closed = list(range(len(sizes))), 0, []
    while pool:
        windows = max(1, math.ceil(sum(sizes[i] for i in pool) / capacity)) + more
        parts = [[pool[i] for i in part] for part in differencing([sizes[i] for i in pool], windows)]
        loads = [sum(sizes[i] for i in part) for part in parts]
        if max(loads) <= capacity:
            return closed + parts
        full = [capacity * (1 - unused) <= load <= capacity for load in loads]
        if any(full):
            closed += [part for part, f in zip(parts, full, strict=True) if f]
            pool = [i for part, f in zip(parts, full, strict=True) if not f for i in part]
        else:
            more += 1
    return closed


def kinds_of(bins: DataFrame) -> DataFrame:
    """``(bin_kind, capacity)``: kinds with a positive capacity; of a kind given twice the smaller one holds."""
    return bins.where(F.col("capacity") > 0).groupBy("bin_kind").agg(F.min(F.col("capacity").cast("bigint")).alias("capacity"))


def pieces(counts: DataFrame, bins: DataFrame) -> DataFrame:
    """``(bin_kind, capacity, doc_id, first_token, tokens)``: what is to be placed for each kind of container.

    A text longer than the capacity is cut into full containers and a rest; any
    other is one piece. Texts without tokens, and kinds with a null or
    non-positive capacity, have none.
    """
    listed = [(r.bin_kind, r.capacity) for r in kinds_of(bins).sort("bin_kind").limit(MOST_KINDS + 1).collect()]
    if len(listed) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of container")
    all_kinds = F.array(*(F.struct(F.lit(k).alias("bin_kind"), F.lit(c).cast("bigint").alias("capacity")) for k, c in listed)) if listed else F.expr("cast(array() as array<struct<bin_kind:string,capacity:bigint>>)")
    each = counts.where(F.col("tokens") > 0).select("doc_id", F.col("tokens").alias("_all"), F.explode(all_kinds).alias("_kind")).select("doc_id", "_all", "_kind.*")
    last = F.floor((F.col("_all") - 1) / F.col("capacity")).cast("bigint")
    cut = each.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_i"))
    first = (F.col("_i") * F.col("capacity")).alias("first_token")
    return cut.select("bin_kind", "capacity", "doc_id", first, F.least("capacity", F.col("_all") - first).alias("tokens"))


def _packer(group: int, unused: float = UNUSED):  # noqa: ANN202
    """Packs the rows of each kind and group, the partition being sorted by both; of more than ``group`` every so-manyth row goes together."""

    def packed(held: list[tuple]) -> pa.RecordBatch:
        kind, _, capacity = held[0][:3]
        containers = fill([r[5] for r in held], capacity, unused)
        names = [min((held[i][3], held[i][4]) for i in c) for c in containers]
        rows = [(kind, f"{kind}-{name[0]}-{name[1]}", *held[i][3:]) for c, name in zip(containers, names, strict=True) for i in c]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["bin_kind", "container", "doc_id", "first_token", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, same in groupby(rows, key=lambda r: r[:2]):
            held = list(same)
            parts = math.ceil(len(held) / group)
            for i in range(parts):
                yield packed(held[i::parts])

    return run


def packed(counts: DataFrame, bins: DataFrame, group: int = GROUP, unused: float = UNUSED) -> DataFrame:
    """``(bin_kind, container, doc_id, first_token, tokens)``: every piece of every text in one container of each kind.

    ``counts`` has ``(doc_id, tokens)``. Pieces that fill a container are alone in
    it and need no packing. The others fall by a hash of text and piece into
    groups of about ``group``, and one that has more is split evenly over all
    sizes. They are packed one by one, so a task holds only the rows of one hash
    at once, and the result doesn't depend on the number of tasks. A
    container is named by its kind and its first piece. ``unused``: see ``fill``. Repeated rows of
    ``counts`` are placed as often as they come; they may share a name, though a
    repeated doc_id is against the data's definition. Null counts count as none.
    """
    todo = pieces(counts.select("doc_id", "tokens"), bins)
    full = todo.where(F.col("tokens") == F.col("capacity"))
    alone = full.select("bin_kind", F.concat_ws("-", "bin_kind", F.col("doc_id").cast("string"), F.col("first_token").cast("string")).alias("container"), "doc_id", "first_token", "tokens")
    rest = todo.where(F.col("tokens") < F.col("capacity"))
    groups = max(1, math.ceil(counts.where(F.col("tokens") > 0).count() / group))
    grouped = rest.select("bin_kind", F.pmod(F.xxhash64("doc_id", "first_token"), F.lit(groups)).alias("_group"), "capacity", "doc_id", "first_token", "tokens")
    tasks = max(shuffle_partitions(counts.sparkSession), 1)
    # the groups of a kind go round the tasks one by one, so that each has as many as any other
    task = F.pmod(F.col("_group") + F.pmod(F.xxhash64("bin_kind"), F.lit(tasks)), F.lit(tasks)).cast("int")
    ordered = grouped.repartitionById(tasks, task).sortWithinPartitions("bin_kind", "_group", "tokens", "doc_id", "first_token")
    shared = ordered.mapInArrow(_packer(group, unused), "bin_kind string, container string, doc_id bigint, first_token bigint, tokens bigint")
    return alone.unionByName(shared)


def packed_documents(documents: DataFrame, bins: DataFrame, name: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """``packed`` for the texts of ``documents``, measured in tokens; each text is encoded once."""
    return packed(written(token_counts(documents, name, folder)), bins)


#: How many containers above the least number possible the report accepts.
ACCEPTED = 1.02


def fill_report(counts: DataFrame, placed: DataFrame, bins: DataFrame, accepted: float = ACCEPTED) -> DataFrame:
    """``(bin_kind, containers, least_containers, placed_once, within, near_least)`` of the result of ``packed`` for ``counts(doc_id, tokens)``.

    Whether every token is placed once, in pieces that follow one another; no
    container is above the capacity; and there are at most ``accepted`` times as
    many as the least possible, whatever the method (all tokens must fit), rounded
    up, and one.
    """
    wanted = counts.where(F.col("tokens") > 0).select("doc_id", F.col("tokens").alias("_all"))
    kinds = kinds_of(bins)
    per_text = placed.groupBy("bin_kind", "doc_id").agg(F.sum("tokens").alias("_placed"), F.max(F.col("first_token") + F.col("tokens")).alias("_end"), F.count_distinct("first_token").alias("_firsts"), F.count("*").alias("_pieces"))
    every = wanted.crossJoin(F.broadcast(kinds))  # a text is placed once for each kind, and there are few kinds
    right = (F.col("_placed") == F.col("_all")) & (F.col("_end") == F.col("_all")) & (F.col("_firsts") == F.col("_pieces"))
    texts = every.join(per_text, ["bin_kind", "doc_id"], "left").groupBy("bin_kind").agg(F.min(F.coalesce(right, F.lit(False))).alias("placed_once"), F.sum("_all").alias("_tokens"))
    loads = placed.groupBy("bin_kind", "container").agg(F.sum("tokens").alias("_load")).groupBy("bin_kind").agg(F.count("*").alias("containers"), F.max("_load").alias("_most"))
    least = F.ceil(F.col("_tokens") / F.col("capacity")).cast("bigint")
    found = texts.join(loads, "bin_kind").join(kinds, "bin_kind")
    return found.select("bin_kind", "containers", least.alias("least_containers"), "placed_once", (F.col("_most") <= F.col("capacity")).alias("within"), (F.col("containers") <= F.ceil(least * accepted) + 1).alias("near_least"))


def packed_report(documents: DataFrame, bins: DataFrame, name: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """``fill_report`` for the texts of ``documents``."""
    counts = written(token_counts(documents, name, folder))
    return fill_report(counts, written(packed(counts, bins)), bins)
