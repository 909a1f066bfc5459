"""How many members large sets share, pair by pair (problem 4).

Every set gets a register sketch (the largest number of leading zeros of the
hashes that fall in each register). For two sketches the sizes of both
differences and of the intersection are estimated together, by maximum
likelihood over the paired registers, under the condition that difference and
intersection make up the sizes of the sets, which are known. No intersection is
built for that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.tables import shuffle_partitions, written

#: Registers per sketch, as a power of two.
PRECISION = 14
#: Expected meetings of a pair that shares just the least share.
MEETINGS = 84
#: A pair with the least share has fewer meetings than asked for with probability exp(-MISSED) at most.
MISSED = 28
#: A member of more sets is popular: what it has in common is asked for last, and its sets are dealt to several tasks.
POPULAR = 64
#: Sets per block of sketches compared in one task.
BLOCK = 256
#: Positions of the value table that are joined as one bucket.
BUCKET = 256
#: Standard errors within which the estimate leaves a pair undecided.
SLACK = 4.0


def slices_to_members(offsets: DataFrame, cols: DataFrame, least: int = 0, bucket: int = BUCKET) -> DataFrame:
    """``(v, nbr)``, distinct and without nulls: the members that the slices of ``offsets`` hold in ``cols``.

    A slice holds ``off <= pos < off + deg``. Vertices whose slices together are
    shorter than ``least`` are left out before the join: they can't have that
    many members. Slices are cut at the borders of buckets of positions, so a
    list of any length spreads over the tasks and the range condition becomes an
    equality on the bucket. Null ends, a null or non-positive ``deg`` hold nothing.
    """
    whole = offsets.select("v", "off", "deg").where(F.col("v").isNotNull() & F.col("off").isNotNull() & (F.col("deg") > 0)).distinct()
    if least:
        long_enough = whole.groupBy("v").agg(F.sum(F.col("deg").cast("bigint")).alias("_sum")).where(F.col("_sum") >= least).select("v")
        whole = whole.join(long_enough, "v", "left_semi")
    last = F.col("off") + F.col("deg") - 1
    at = lambda c: F.floor(c / F.lit(bucket)).cast("bigint")
    cut = whole.select("v", F.col("off").alias("_from"), last.alias("_to"), F.explode(F.sequence(at(F.col("off")), at(last))).alias("_bucket"))
    values = cols.select("pos", "nbr").where(F.col("pos").isNotNull() & F.col("nbr").isNotNull()).withColumn("_bucket", at(F.col("pos")))
    joined = cut.join(values, "_bucket").where(F.col("pos").between(F.col("_from"), F.col("_to")))
    return joined.select("v", "nbr").distinct()


def sketches(members: DataFrame, set_col: str, member_col: str, precision: int = PRECISION) -> DataFrame:
    """``(set, regs)``: of each set the registers that are not zero, as ``index * 64 + value``.

    The maximum per register is taken before the shuffle as well as after it; a
    row holds at most ``2**precision`` numbers, however large the set.
    """
    h = F.xxhash64(F.lit(7), F.col(member_col))
    index = F.shiftrightunsigned(h, 64 - precision)
    rest = F.shiftleft(h, precision)
    zeros = F.when(rest == 0, F.lit(64 - precision)).otherwise(64 - F.length(F.bin(rest)))
    registers = members.groupBy(F.col(set_col).alias("set"), index.cast("int").alias("_i")).agg(F.max((zeros + 1).cast("int")).alias("_k"))
    return registers.groupBy("set").agg(F.collect_list((F.col("_i") * 64 + F.col("_k")).cast("int")).alias("regs"))


def _unit(member: Column, salt: Column) -> Column:
    """A number in [0, 1) fixed by member and salt."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(11), salt, member), 11) / F.lit(float(1 << 53))


def least_meetings(expected: int, missed: float = MISSED) -> int:
    """The largest number that a sum of independent draws with this expectation is below with probability ``exp(-missed)`` at most (by Chernoff's bound, so for any number of draws)."""
    t = 1
    while t < expected and t + t * math.log(expected / t) - expected <= -missed:
        t += 1
    return t


def counted_members(members: DataFrame) -> DataFrame:
    """``members(v, nbr)`` with ``sets``, the number of sets that have the member."""
    return members.join(members.groupBy("nbr").agg(F.count("*").alias("sets")), "nbr").select("v", "nbr", "sets")


def meeting_pairs(members: DataFrame, sizes: DataFrame, share: tuple[int, int], meetings: int = MEETINGS, popular: int = POPULAR) -> DataFrame:
    """``(a, b, n_a, n_b)``, a < b: the pairs that may share ``share`` of the smaller set; ``members(v, nbr, sets)``, ``sizes(v, n)``.

    Each set looks up some of its members, chosen by hash with the expected
    number ``meetings / share``, in the index of all members; a set with fewer
    looks up all of them. A pair is kept if it meets often enough: a pair with
    the share fails that with probability ``exp(-MISSED)``, and never if the
    smaller set is looked up whole. Members of more than ``popular`` sets are not
    looked up by a set that must share at least as many others; for these the
    others alone must meet often enough, so members that nearly all sets have
    make no pairs. Other sets look them up too; the index entries of such a
    member are dealt to several tasks and its lookups sent to each of them.
    """
    over, of = share
    rare = members.groupBy("v").agg(F.count(F.when(F.col("sets") > popular, 1)).alias("_popular"))
    need = F.floor((F.col("n") * over + of - 1) / of)
    without = F.col("_popular") * 2 <= F.col("_need")
    asked = F.greatest(F.when(F.col("_without"), F.col("_need") - F.col("_popular")).otherwise(F.col("_need")), F.lit(1))
    facts = sizes.join(rare, "v").withColumn("_need", need).withColumn("_without", without).withColumn("_asked", asked)
    facts = facts.select("v", "n", "_without", F.least(F.lit(1.0), F.lit(float(meetings)) / F.col("_asked")).alias("_rate"), F.when(F.col("_asked") <= meetings, F.col("_asked")).otherwise(least_meetings(meetings)).alias("_least"))
    salts = F.ceil(F.col("sets") / popular).cast("int")
    looked = members.join(facts, "v").where(~(F.col("_without") & (F.col("sets") > popular)) & (_unit(F.col("nbr"), F.col("v")) < F.col("_rate")))
    anchors = looked.select(F.col("v").alias("_by"), F.col("n").alias("_n_by"), "_least", "nbr", F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"))
    index = members.join(sizes, "v").select("v", "n", "nbr", F.pmod(F.xxhash64("v"), salts).cast("int").alias("_salt"))
    met = anchors.join(index, ["nbr", "_salt"]).where((F.col("_n_by") < F.col("n")) | ((F.col("_n_by") == F.col("n")) & (F.col("_by") < F.col("v"))))
    often = met.groupBy("_by", "_n_by", "_least", "v", "n").agg(F.count("*").alias("_met")).where(F.col("_met") >= F.col("_least"))
    first = F.col("_by") < F.col("v")
    return often.select(F.least("_by", "v").alias("a"), F.greatest("_by", "v").alias("b"), F.when(first, F.col("_n_by")).otherwise(F.col("n")).alias("n_a"), F.when(first, F.col("n")).otherwise(F.col("_n_by")).alias("n_b"))


def _levels(m: int, top: int) -> np.ndarray:
    return 1.0 / (m * np.exp2(np.arange(top)))


def paired_registers(one: np.ndarray, others: list[np.ndarray], top: int) -> dict[str, np.ndarray]:
    """How many pairs of registers of ``one`` and each of the ``others`` are ``less`` (by the other's value), ``more`` (by the one's) and ``equal``, at each level below ``top``.

    ``one`` has all registers, the others only those that are not zero, as
    ``index * 64 + value``; the rest follows from the numbers of the one.
    """
    flat = np.concatenate(others) if others else np.zeros(0, dtype=np.int64)
    pair = np.repeat(np.arange(len(others)) * top, [len(x) for x in others])
    value, mine = flat & 63, one[flat >> 6].astype(np.int64)

    def by_level(values: np.ndarray, where: np.ndarray | slice = slice(None)) -> np.ndarray:
        return np.bincount((pair + values)[where], minlength=len(others) * top).reshape(len(others), top).astype(float)

    left = np.bincount(one, minlength=top)[None, :] - by_level(mine)  # registers that the other has not
    equal, more = by_level(value, value == mine), by_level(mine, mine > value)
    equal[:, 0] = left[:, 0]
    more[:, 1:] += left[:, 1:]
    return {"less": by_level(value, mine < value), "more": more, "equal": equal}


def joint_estimate(registers: dict[str, np.ndarray], n_a: np.ndarray, n_b: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The intersection of each pair of sets of ``n_a`` and ``n_b`` members with the paired ``registers`` out of ``m``, and its standard error.

    The most likely differences and intersection given the registers, where
    each difference and the intersection add up to the size of the set. The
    likelihood of a pair of registers is that of the smaller one being above all
    that only its set has, or, of equal ones, of either set reaching the level.
    Newton steps within a bracket, all pairs at once.
    """
    less, more, equal = registers["less"][:, 1:], registers["more"][:, 1:], registers["equal"]
    z = _levels(m, equal.shape[1])
    z0, z1 = z[0], z[1:]
    n_a, n_b = n_a.astype(float), n_b.astype(float)
    highest = np.minimum(n_a, n_b)
    low, high, x = np.zeros_like(highest), highest.copy(), highest / 2
    moving = np.arange(len(x))
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        for _ in range(80):
            now, na, nb = x[moving, None], n_a[moving, None], n_b[moving, None]
            e3 = np.exp(-(na + nb - now) * z1)
            inner = np.maximum(1.0 - np.exp(-na * z1) - np.exp(-nb * z1) + e3, 1e-300)
            grow_a, grow_b = (np.expm1(np.maximum(n - now, 1e-9) * z1) for n in (na, nb))
            score = equal[moving, 0] * z0 + (equal[moving, 1:] * z1 * (1.0 + e3 / inner) + less[moving] * z1 * (1.0 - 1.0 / grow_b) + more[moving] * z1 * (1.0 - 1.0 / grow_a)).sum(1)
            slope = (equal[moving, 1:] * z1 * z1 * e3 * (inner - e3) / inner**2 - less[moving] * z1 * z1 * (1.0 + 1.0 / grow_b) / grow_b - more[moving] * z1 * z1 * (1.0 + 1.0 / grow_a) / grow_a).sum(1)
            up = score > 0
            low[moving], high[moving] = np.where(up, now[:, 0], low[moving]), np.where(up, high[moving], now[:, 0])
            ahead = now[:, 0] - score / slope
            inside = np.isfinite(ahead) & (slope < 0) & (ahead > low[moving]) & (ahead < high[moving])
            ahead = np.where(inside, ahead, (low[moving] + high[moving]) / 2)
            step = np.abs(ahead - now[:, 0])
            x[moving] = ahead
            moving = moving[(step > 1e-3) & (high[moving] - low[moving] > 1e-3)]
            if not len(moving):
                break
    return x, _error(n_a, n_b, x, m)


def _error(n_a: np.ndarray, n_b: np.ndarray, x: np.ndarray, m: int) -> np.ndarray:
    """Standard error of the intersection, from the expected information of the three sizes.

    The registers are taken as those of Poisson numbers of members, for which the
    information is a sum over all pairs of levels; the part of the variance that
    comes from these numbers is then taken out, as the sizes are fixed. At least 1.
    """
    largest = max(float(n_a.max(initial=1)), float(n_b.max(initial=1)))
    z = _levels(m, max(3, math.ceil(math.log2(1 + largest / m)) + 8))
    z[-1] = 0.0  # nothing is above the last level
    rates = np.stack([np.maximum(n_a - x, 0.5), np.maximum(n_b - x, 0.5), np.maximum(x, 0.5)], 1)
    a, b, both = (rates[:, i, None, None] for i in range(3))
    za, zb, zx = z[:, None], z[None, :], np.maximum(z[:, None], z[None, :])

    def cells(up_to: np.ndarray) -> np.ndarray:
        """Of the pair of levels itself, from what holds up to each pair of levels."""
        return np.diff(np.diff(up_to, axis=1, prepend=0.0), axis=2, prepend=0.0)

    up_to = np.exp(-(a * za + b * zb + both * zx))
    chance = np.maximum(cells(up_to), 1e-300)
    slopes = np.stack([cells(-w * up_to) for w in (za, zb, zx)], 1)
    information = m * np.einsum("puij,pvij->puv", slopes, slopes / chance[:, None])
    toward = information @ np.array([-1.0, -1.0, 1.0])
    known = toward @ np.array([-1.0, -1.0, 1.0])
    spread = np.maximum(known - (rates * toward**2).sum(1), 0.0)
    return np.maximum(np.sqrt(spread) / np.maximum(known, 1e-300), 1.0)


_ESTIMATES = [("a", pa.int64()), ("b", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("both", pa.float64()), ("error", pa.float64())]
_ESTIMATED = "a long, b long, n_a long, n_b long, both double, error double"
#: Pairs estimated at once, for memory.
CHUNK = 256


class _Sketches:
    """The sketches of one task."""

    def __init__(self, held: pa.Table, precision: int) -> None:
        self.m = 1 << precision
        self.regs = {s: r.values.to_numpy() for s, r in zip(held.column("set").to_pylist(), held.column("regs"), strict=True)}
        self.top = 1 + max((int((r & 63).max()) for r in self.regs.values() if len(r)), default=0)

    def estimates(self, one: int, n_one: int, others: list[tuple[int, int]]) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray]]:
        """``one`` against the ``others`` (set and size): these, their sizes, intersections and errors."""
        dense = np.zeros(self.m, dtype=np.int8)
        dense[self.regs[one] >> 6] = self.regs[one] & 63
        for at in range(0, len(others), CHUNK):
            part, n = map(list, zip(*others[at : at + CHUNK], strict=True))
            registers = paired_registers(dense, [self.regs[s] for s in part], self.top)
            yield part, n, *joint_estimate(registers, np.full(len(n), n_one), np.array(n), self.m)

    def table(self, against: dict[tuple[int, int], list[tuple[int, int]]]) -> pa.Table:
        out: list[pa.Table] = []
        schema = pa.schema(_ESTIMATES)
        for (one, n_one), others in against.items():
            for part, n, both, error in self.estimates(one, n_one, others):
                own, own_n = np.full(len(part), one), np.full(len(part), n_one)
                first = own < np.array(part)
                columns = [np.minimum(own, part), np.maximum(own, part), np.where(first, own_n, n), np.where(first, n, own_n), both, error]
                out.append(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()


def _listed(precision: int):  # noqa: ANN202
    """The pairs given."""

    def of_block(pairs: pa.Table, held: pa.Table) -> pa.Table:
        against: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for a, b, n_a, n_b in zip(*(pairs.column(c).to_pylist() for c in ("a", "b", "n_a", "n_b")), strict=True):
            against.setdefault((a, n_a), []).append((b, n_b))
        return _Sketches(held, precision).table(against)

    return of_block


def _all_pairs(precision: int):  # noqa: ANN202
    """Each pair of a set of the first and one of the second block, or of two sets of the block if there is but one."""

    def of_block(held: pa.Table) -> pa.Table:
        rows = sorted(zip(*(held.column(c).to_pylist() for c in ("_block", "set", "n")), strict=True))
        first = [(s, n) for block, s, n in rows if block == rows[0][0]]
        second = [(s, n) for block, s, n in rows if block != rows[0][0]]
        if second or held.column("_p")[0].as_py() != held.column("_q")[0].as_py():
            against = {x: second for x in first} if second else {}
        else:
            against = {x: first[i + 1 :] for i, x in enumerate(first)}
        return _Sketches(held, precision).table(against)

    return of_block


def estimate_pairs(pairs: DataFrame, sketched: DataFrame, sets: int, precision: int = PRECISION, block: int = BLOCK) -> DataFrame:
    """``(a, b, n_a, n_b, both, error)`` of the ``pairs(a, b, n_a, n_b)`` of set ids.

    Sets fall into ``sets / block`` blocks by hash; a task has one pair of blocks
    and only the sketches that its pairs name.
    """
    blocks = max(1, math.ceil(sets / block))
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    placed = pairs.withColumns({"_p": F.least(of("a"), of("b")), "_q": F.greatest(of("a"), of("b"))})
    ends = placed.select("_p", "_q", F.col("a").alias("set")).union(placed.select("_p", "_q", F.col("b").alias("set"))).distinct()
    needed = ends.join(sketched, "set").select(F.col("_p").alias("_p_of"), F.col("_q").alias("_q_of"), "set", "regs")
    return placed.groupBy("_p", "_q").cogroup(needed.groupBy("_p_of", "_q_of")).applyInArrow(_listed(precision), _ESTIMATED)


def estimate_all(sketched: DataFrame, sizes: DataFrame, precision: int = PRECISION, block: int = BLOCK) -> DataFrame:
    """The same for each pair of the sets of ``sizes(v, n)``: sketches against sketches, a pair of blocks a task. No member is joined."""
    sets, tasks = sizes.count(), shuffle_partitions(sizes.sparkSession)
    blocks = max(1, min(sets, max(math.ceil(sets / block), math.ceil(math.sqrt(4 * tasks)))))
    own = sketched.join(sizes.withColumnRenamed("v", "set"), "set").withColumn("_block", F.pmod(F.xxhash64("set"), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_other")
    each = own.select("set", "n", "regs", "_block", other).select("set", "n", "regs", "_block", F.least("_block", "_other").alias("_p"), F.greatest("_block", "_other").alias("_q"))
    return each.groupBy("_p", "_q").applyInArrow(_all_pairs(precision), _ESTIMATED)


def large_sets(offsets: DataFrame, cols: DataFrame, least_members: int) -> tuple[DataFrame, DataFrame]:
    """``members(v, nbr)`` and ``sizes(v, n)`` of the vertices with ``least_members`` neighbours or more."""
    all_members = written(slices_to_members(offsets, cols, least_members))
    sizes = written(all_members.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") >= least_members))
    return all_members.join(sizes.select("v"), "v", "left_semi"), sizes


def estimated_overlaps(members: DataFrame, sizes: DataFrame, share: tuple[int, int], precision: int = PRECISION) -> DataFrame:
    """``(a, b, n_a, n_b, both, error)``: the pairs that may share ``share`` of the smaller set (see ``meeting_pairs``), with the estimate."""
    pairs = meeting_pairs(written(counted_members(members)), sizes, share)
    return estimate_pairs(pairs, sketches(members, "v", "nbr", precision), sizes.count(), precision)


def counted(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``pairs(a, b, n_a, n_b, ...)`` with ``shared``, the exact number of members that both have; the smaller set's are looked for in the larger one."""
    smaller = F.when(F.col("n_a") <= F.col("n_b"), F.col("a")).otherwise(F.col("b"))
    sides = pairs.select("a", "b", smaller.alias("v"), F.when(smaller == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("_other"))
    asked = sides.join(members, "v").select("a", "b", F.col("_other").alias("v"), "nbr")
    shared = asked.join(members, ["v", "nbr"], "left_semi").groupBy("a", "b").agg(F.count("*").alias("shared"))
    return pairs.join(shared, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))


def overlap_report(offsets: DataFrame, cols: DataFrame, least_members: int = 100, share: tuple[int, int] | None = None) -> DataFrame:
    """``(v_a, v_b, n_a, n_b, both, error)``: of each pair of vertices with ``least_members`` neighbours how many they share, ``both`` and its standard error being estimates.

    Every pair of the large sets is a row, also those that share none. It is
    compared sketch by sketch, so time and result grow with the square of the
    number of sets, but not with their sizes. With ``share`` only the pairs that
    share that part of the smaller set, by the estimate, come out, and only those
    that meet in an index are compared. Repeated members count once, null ones
    not; empty tables give no rows.
    """
    members, sizes = large_sets(offsets, cols, least_members)
    if share is None:
        kept = estimate_all(sketches(members, "v", "nbr"), sizes)
    else:
        kept = estimated_overlaps(members, sizes, share).where(F.col("both") * share[1] >= F.least("n_a", "n_b") * share[0])
    return kept.select(F.col("a").alias("v_a"), F.col("b").alias("v_b"), "n_a", "n_b", F.round("both").cast("bigint").alias("both"), "error")


def decided(offsets: DataFrame, cols: DataFrame, least_members: int = 100, share: tuple[int, int] = (1, 2), slack: float = SLACK) -> tuple[DataFrame, DataFrame]:
    """The pairs ``(a, b, n_a, n_b, both, error)`` that reach ``share`` of the smaller set by the estimate, and those that it leaves open, with ``shared``, which is counted for them."""
    members, sizes = large_sets(offsets, cols, least_members)
    estimated = written(estimated_overlaps(members, sizes, share).withColumn("_need", F.least("n_a", "n_b") * (share[0] / share[1])))
    is_open = F.abs(F.col("both") - F.col("_need")) <= slack * F.col("error")
    return estimated.where(~is_open & (F.col("both") >= F.col("_need"))).drop("_need"), counted(estimated.where(is_open).drop("_need"), members)


def found_overlaps(offsets: DataFrame, cols: DataFrame, least_members: int = 100, share: tuple[int, int] = (1, 2), slack: float = SLACK) -> DataFrame:
    """``(v_a, v_b)``: the pairs that share at least ``share`` of the smaller set.

    The estimate decides wherever it is more than ``slack`` standard errors off
    the share; the shared members of the few other pairs are counted.
    """
    sure, counts = decided(offsets, cols, least_members, share, slack)
    reached = counts.where(F.col("shared") * share[1] >= F.least("n_a", "n_b") * share[0])
    return sure.select("a", "b").union(reached.select("a", "b")).select(F.col("a").alias("v_a"), F.col("b").alias("v_b"))


def checked_overlaps(offsets: DataFrame, cols: DataFrame, least_members: int = 100, share: tuple[int, int] = (1, 10), slack: float = SLACK) -> DataFrame:
    """``(v_a, v_b, n_a, n_b, shared, close)``: the pairs that share ``share`` of the smaller set, counted, and whether the estimate is within ``slack`` standard errors of that."""
    members, sizes = large_sets(offsets, cols, least_members)
    near = F.col("both") + 2 * slack * F.col("error") >= F.least("n_a", "n_b") * (share[0] / share[1])
    exact = counted(written(estimated_overlaps(members, sizes, share).where(near)), members)
    kept = exact.where(F.col("shared") * share[1] >= F.least("n_a", "n_b") * share[0])
    return kept.select(F.col("a").alias("v_a"), F.col("b").alias("v_b"), "n_a", "n_b", "shared", (F.abs(F.col("both") - F.col("shared")) <= slack * F.col("error")).alias("close"))
