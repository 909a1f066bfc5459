"""Subgraph matching: all placements of a pattern in a graph, one of each automorphism class.

Matches are injective and need not be induced. Three plans give the same result:
``expand`` joins edge by edge; ``prefix`` keeps the possible extensions of a row
as a list until they are needed; ``candidate`` first reduces the vertices that
each pattern vertex can be matched with.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import cycles
from graphloom.operators.graph import adjacency, arcs, degree_order, degree_recoded, degrees, existing_edges
from graphloom.plans.matchplan import PREFIX, Level, MatchPlan, candidate_order, filter_order, one_sided, plan, side_needed, tree
from graphloom.plans.pattern import Pattern, preset
from graphloom.tables import forget, written


def _tests(level: Level, x: Column) -> list[Column]:
    return [x < F.col(f"q{w}") for w in level.less] + [x > F.col(f"q{w}") for w in level.greater] + [x != F.col(f"q{w}") for w in level.other]


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _keeps(level: Level) -> Callable[[Column], Column]:
    return lambda x: _all(_tests(level, x))


def _columns(p: Pattern) -> list[str]:
    return [f"q{u}" for u in range(p.n)]


def expand_rows(edges: DataFrame, p: Pattern, order: list[int] | None = None) -> DataFrame:
    """Matches ``(q0, q1, ...)`` by one join per pattern edge.

    Of several matched neighbours the one with fewest neighbours itself, row by
    row, gives what the next vertex can be, and the edges to all are then looked
    up: rows that meet a hub don't run through its neighbours.
    """
    deg = degrees(edges)
    step, levels = arcs(edges), plan(p, order=order).levels
    with_degree = step.join(deg.select(F.col("v").alias("dst"), "deg"), "dst")
    rows = deg.select(F.col("v").alias(f"q{levels[0].vertex}"), F.col("deg").alias(f"d{levels[0].vertex}"))
    for level in levels[1:]:
        u = level.vertex
        ends = [F.struct(F.col(f"d{b}").alias("d"), F.col(f"q{b}").alias("q")) for b in level.backward]
        start = F.least(*ends) if len(ends) > 1 else ends[0]
        ahead = with_degree.select(F.col("src").alias("_from"), F.col("dst").alias(f"q{u}"), F.col("deg").alias(f"d{u}"))
        rows = rows.withColumn("_from", start["q"]).join(ahead, "_from").where(_all(_tests(level, F.col(f"q{u}")))).drop("_from")
        for b in level.backward if len(ends) > 1 else ():
            rows = rows.join(step.select(F.col("src").alias(f"q{b}"), F.col("dst").alias(f"q{u}")), [f"q{b}", f"q{u}"], "left_semi")
    return rows.select(*_columns(p))


def _nb(u: int) -> str:
    return f"nb{u}"


def _shared_by_later(levels: tuple[Level, ...], i: int, held: frozenset[int]) -> bool:
    return len(held) > 1 and any(held <= set(x.backward) for x in levels[i + 1 :])


def _held(name: frozenset[int]) -> str:
    return "both" + "_".join(map(str, sorted(name)))


def _walk(edges: DataFrame, mp: MatchPlan) -> DataFrame:
    """Rows of all vertices but the last, and ``ext``, the list of what the last can be.

    A vertex's neighbour list, or the part of it that the order conditions leave,
    is joined in when it is bound and dropped after the last level that looks at it. An intersection of lists that later levels need
    too is kept beside the row and taken from there.
    """
    adj = written(adjacency(edges).select("v", "nbrs"))
    levels = mp.levels

    def lists_of(u: int) -> DataFrame:
        side = side_needed(mp, u)
        nbrs = F.col("nbrs") if side == "all" else F.filter("nbrs", lambda x: x > F.col("v") if side == "above" else x < F.col("v"))
        lists = adj.select(F.col("v").alias(f"q{u}"), nbrs.alias(_nb(u)))
        return lists if side == "all" else lists.where(F.size(_nb(u)) > 0)

    def with_list(rows: DataFrame, u: int) -> DataFrame:
        return rows.join(lists_of(u), f"q{u}")

    u = levels[0].vertex
    rows = lists_of(u)
    pending: list[int] = []  # levels whose extensions are still lists
    held: set[frozenset[int]] = set()  # intersections kept

    def unfold(rows: DataFrame, w: int) -> DataFrame:
        return rows.withColumn(f"q{w}", F.explode(F.col(f"ext{w}"))).drop(f"ext{w}")

    for i, level in enumerate(levels[1:], 1):
        touched = {*level.backward, *level.less, *level.greater, *level.other}
        for w in [w for w in pending if w in touched]:
            rows = unfold(rows, w)
            pending.remove(w)
            if w in level.backward or w in mp.needed_after(i - 1):
                rows = with_list(rows, w)
        wanted = frozenset(level.backward)
        base = max((h for h in held if h <= wanted), key=len, default=frozenset())
        lists = [F.col(_held(base))] * bool(base) + [F.col(_nb(b)) for b in level.backward if b not in base]
        found = reduce(F.array_intersect, lists)
        if wanted not in held and _shared_by_later(levels, i, wanted):
            rows = rows.withColumn(_held(wanted), found)
            held.add(wanted)
            found = F.col(_held(wanted))
        rows = rows.withColumn(f"ext{level.vertex}", F.filter(found, _keeps(level)))
        if i == len(levels) - 1:
            for w in pending:
                rows = unfold(rows, w)
            return rows.withColumnRenamed(f"ext{level.vertex}", "ext")
        rows = rows.where(F.size(f"ext{level.vertex}") > 0)
        for w in [w for w in mp.order[:i] if _nb(w) in rows.columns and w not in mp.needed_after(i)]:
            rows = rows.drop(_nb(w))
        for h in [h for h in held if not _shared_by_later(levels, i, h)]:
            rows = rows.drop(_held(h))
            held.remove(h)
        if level.store == PREFIX:
            pending.append(level.vertex)
        else:
            rows = unfold(rows, level.vertex)
            if level.vertex in mp.needed_after(i):
                rows = with_list(rows, level.vertex)
    return rows.withColumn("ext", F.array(F.col(f"q{u}")))


def prefix_rows(edges: DataFrame, p: Pattern, strategy: str = "hybrid") -> DataFrame:
    """Matches ``(q0, q1, ...)`` with lists of extensions, unfolded at the end."""
    mp = plan(p, strategy)
    return _walk(edges, mp).withColumn(f"q{mp.order[-1]}", F.explode("ext")).select(*_columns(p))


def prefix_count(edges: DataFrame, p: Pattern, strategy: str = "hybrid") -> DataFrame:
    """``(n)``: the number of matches; those of the last vertex are counted and never made into rows."""
    return _walk(edges, plan(p, strategy)).agg(F.coalesce(F.sum(F.size("ext").cast("bigint")), F.lit(0)).alias("n"))


#: A graph is uneven when its largest degree is more than so many times the mean.
UNEVEN = 16
#: Entries that the list at the end of an arc may have on average, for lists to travel in rows.
MEAN_LIST = 256


def _leveled(edges: DataFrame) -> tuple[DataFrame, float, bool, int]:
    """The edges written, and numbered by degree if the graph is uneven; how many neighbours an arc's end has on average; whether they were numbered; how many edges."""
    own = written(edges)
    most, mean, squares, ends = degrees(own).agg(F.max("deg"), F.avg("deg"), F.sum(F.col("deg") * F.col("deg")) / F.sum("deg"), F.sum("deg")).first()
    uneven = bool(most and most > UNEVEN * mean)
    if uneven:
        before, own = own, written(degree_recoded(own))
        forget(before)
    return own, squares or 0, uneven, (ends or 0) // 2


def match_count(edges: DataFrame, p: Pattern, mean_list: float = MEAN_LIST) -> DataFrame:
    """``(n)``: the number of matches, by lists of extensions or edge by edge.

    The vertices of an uneven graph are numbered by degree first, which leaves the
    number of matches as it is and lets the order conditions turn away from hubs.
    Lists are taken if the pattern only needs the neighbours on one side of each
    vertex, which are few then, or if the whole lists are short: an arc's end has
    sum(deg^2) / sum(deg) neighbours on average. Otherwise no list leaves its vertex.
    Squares are counted without being made, and so are cycles of six if the graph
    is not uneven and a task may hold its edges.
    """
    if p.edges == preset(1).edges:
        return square_count(edges)
    own, squares, uneven, number = _leveled(edges)
    if p.edges == preset(17).edges and not uneven and number <= cycles.MOST_EDGES:
        return cycles.hexagon_count(own)
    return prefix_count(own, p) if one_sided(plan(p)) or squares <= mean_list else expand_count(own, p)


def square_count(edges: DataFrame) -> DataFrame:
    """``(n)``: the number of squares, each counted at its last vertex in the order of degrees and the one opposite.

    The two share so many neighbours that come before the last; any two of them
    close a square. Each edge makes as many rows as its end of smaller degree has
    neighbours at most, so a hub's pairs of neighbours are never made.
    """
    own = written(edges)
    up = written(degree_recoded(own))
    forget(own)
    middle = arcs(up).select(F.col("src").alias("v"), F.col("dst").alias("far"))
    paths = middle.join(up.select(F.col("src").alias("v"), F.col("dst").alias("last")), "v").where(F.col("far") < F.col("last"))
    shared = paths.groupBy("far", "last").agg(F.count("*").alias("c")).where(F.col("c") > 1)
    return shared.agg(F.coalesce(F.sum(F.shiftright(F.col("c") * (F.col("c") - 1), 1)), F.lit(0).cast("bigint")).alias("n"))


def expand_count(edges: DataFrame, p: Pattern) -> DataFrame:
    return expand_rows(edges, p).agg(F.count("*").alias("n"))


def ldf_candidates(edges: DataFrame, p: Pattern, labels: DataFrame | None = None, pattern_labels: list[int] | None = None) -> DataFrame:
    """``(u, v)``: the vertices v with at least the degree of pattern vertex u, and with its label where ``labels(v, label)`` are given."""
    vertices = degrees(edges)
    wanted = [(u, p.degree(u), (pattern_labels or [0] * p.n)[u]) for u in range(p.n)]
    asked = F.explode(F.array(*(F.struct(F.lit(u).alias("u"), F.lit(d).alias("least"), F.lit(x).alias("want")) for u, d, x in wanted)))
    if labels is not None:
        vertices = vertices.join(labels.select("v", "label"), "v")
    rows = vertices.select("*", asked.alias("a")).where(F.col("deg") >= F.col("a.least"))
    if labels is not None:
        rows = rows.where(F.col("label") == F.col("a.want"))
    return rows.select(F.col("a.u").alias("u"), "v")


def _bit(u: int) -> int:
    return 1 << u


def _marked(edges: DataFrame, p: Pattern, by_degree: bool = False) -> tuple[DataFrame, dict[int, int]]:
    """``(v, mask)``, a written table: bit u of the mask is set if v is a candidate of pattern vertex u after three passes of refinement; and how many candidates each u has.

    All candidates are held in one table, with a neighbour of each vertex that has
    most neighbours itself: if that one is a candidate of all that a step looks for,
    the step is over for the vertex. Only the arcs of the others are looked
    through. A step is left out as far as nothing that it looked at has changed since.
    ``by_degree``: the vertices are numbered by degree, so a vertex's last neighbour is that one.
    """
    if p.n > 63:
        raise ValueError(f"a pattern of {p.n} vertices; 63 is the most")
    step = arcs(edges)
    ahead = step if by_degree else step.join(degrees(edges).select(F.col("v").alias("dst"), F.col("deg").alias("_deg")), "dst")
    top = F.max("dst") if by_degree else F.max(F.struct("_deg", "dst"))["dst"]
    first = ahead.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("deg"), top.alias("top"))
    bits = [F.when(F.col("deg") >= p.degree(u), F.lit(_bit(u)).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for u in range(p.n)]
    state = written(first.select("v", reduce(Column.bitwiseOR, bits).alias("mask"), "top").where(F.col("mask") != 0))

    def sizes() -> dict[int, int]:
        found = state.agg(*(F.count_if(F.col("mask").bitwiseAND(_bit(u)) != 0).alias(f"n{u}") for u in range(p.n))).first()
        return {u: found[u] for u in range(p.n)}

    now = sizes()
    order = filter_order(p, [now[u] for u in range(p.n)])
    around, changed, seen_at = tree(p, order), dict.fromkeys(range(p.n), 0), {}
    steps = [(u, around[u][side]) for sequence, side in ((order, 1), (order[::-1], 2), (order, 1)) for u in sequence]
    for at, (u, near) in enumerate(steps, 1):
        want = sum(_bit(w) for w in near if seen_at.get((u, w), -1) < changed[w])
        seen_at |= {(u, w): at for w in near}
        if not want or not now[u]:
            continue
        has_all = F.col("_seen").bitwiseAND(want) == want
        own = state.where(F.col("mask").bitwiseAND(_bit(u)) != 0)
        clear = own.join(state.select(F.col("v").alias("top"), F.col("mask").alias("_seen")).where(has_all), "top", "left_anti").select("v")
        unsure = written(clear)
        lost = None
        if not unsure.isEmpty():
            met = step.join(unsure.withColumnRenamed("v", "src"), "src", "left_semi").join(state.select(F.col("v").alias("dst"), "mask"), "dst")
            found = met.groupBy(F.col("src").alias("v")).agg(F.bit_or("mask").alias("_seen")).where(has_all)
            lost = written(unsure.join(found, "v", "left_anti"))
        if lost is not None and not lost.isEmpty():
            kept = state.join(lost.withColumn("_lost", F.lit(_bit(u)).cast("bigint")), "v", "left")
            mask = F.col("mask").bitwiseXOR(F.coalesce("_lost", F.lit(0).cast("bigint")))
            before, state = state, written(kept.select("v", mask.alias("mask"), "top").where(F.col("mask") != 0))
            forget(before)
            now, changed[u] = sizes(), at
        forget(unsure, lost)
    return state, now


def dpiso_candidates(edges: DataFrame, p: Pattern) -> dict[int, DataFrame]:
    """Of each pattern vertex its candidates ``(v)``, after three passes of refinement.

    A candidate stays if it has a neighbour among the candidates of every pattern
    neighbour that the pass looks at: those earlier in breadth-first order in the
    first and third pass, the later ones in the second.
    """
    state, _ = _marked(edges, p)
    return {u: state.where(F.col("mask").bitwiseAND(_bit(u)) != 0).select("v") for u in range(p.n)}


def candidate_sizes(of: dict[int, DataFrame]) -> DataFrame:
    """``(u, candidates)``."""
    return reduce(DataFrame.union, [df.agg(F.count("*").alias("candidates")).select(F.lit(u).alias("u"), "candidates") for u, df in sorted(of.items())])


def candidate_edges(edges: DataFrame, p: Pattern, of: dict[int, DataFrame]) -> DataFrame:
    """``(u, u2, v, v2)``: for each pattern edge (u, u2) the arcs between candidates of both."""
    step = arcs(edges)
    parts = []
    for u, w in sorted(p.edges):
        ends = step.join(of[u].select(F.col("v").alias("src")), "src", "left_semi").join(of[w].select(F.col("v").alias("dst")), "dst", "left_semi")
        parts.append(ends.select(F.lit(u).alias("u"), F.lit(w).alias("u2"), F.col("src").alias("v"), F.col("dst").alias("v2")))
    return reduce(DataFrame.union, parts)


def candidate_rows(edges: DataFrame, p: Pattern, by_degree: bool = False) -> DataFrame:
    """Matches ``(q0, q1, ...)`` along the arcs between candidates, from the vertex with fewest candidates on.

    The arcs between candidates are stored once, with what their ends are candidates
    of; each level joins the arcs of one of its edges and keeps the rows that the
    arcs of the others have too, so no level sees a vertex that is not a candidate.
    Where an order condition holds between the ends, only arcs that keep it are joined,
    and if one holds for every pattern edge in the order of the levels, no others are stored.
    """
    state, sizes = _marked(edges, p, by_degree)
    levels = plan(p, order=candidate_order(p, [sizes[u] for u in range(p.n)])).levels
    ends = [state.select(F.col("v").alias(end), F.col("mask").alias(f"_{end}")) for end in ("src", "dst")]
    upward = all(set(x.backward) <= set(x.greater) for x in levels)
    between = written((edges if upward else arcs(edges)).join(ends[0], "src").join(ends[1], "dst"))

    def arcs_to(level: Level, b: int) -> DataFrame:
        own = between.where((F.col("_src").bitwiseAND(_bit(b)) != 0) & (F.col("_dst").bitwiseAND(_bit(level.vertex)) != 0))
        if b in level.greater:
            own = own.where(F.col("dst") > F.col("src"))
        elif b in level.less:
            own = own.where(F.col("dst") < F.col("src"))
        return own.select(F.col("src").alias(f"q{b}"), F.col("dst").alias(f"q{level.vertex}"))

    u = levels[0].vertex
    rows = state.where(F.col("mask").bitwiseAND(_bit(u)) != 0).select(F.col("v").alias(f"q{u}"))
    for level in levels[1:]:
        u = level.vertex
        last = next((b for b in level.backward[::-1] if b in level.greater), level.backward[-1])
        rows = rows.join(arcs_to(level, last), f"q{last}").where(_all(_tests(level, F.col(f"q{u}"))))
        for b in level.backward:
            if b != last:
                rows = rows.join(arcs_to(level, b), [f"q{b}", f"q{u}"], "left_semi")
    return rows.select(*_columns(p))


def candidate_count(edges: DataFrame, p: Pattern) -> DataFrame:
    """``(n)``; the vertices of an uneven graph are numbered by degree first, as in ``match_count``."""
    own, _, by_degree, _ = _leveled(edges)
    return candidate_rows(own, p, by_degree).agg(F.count("*").alias("n"))


def triangles(edges: DataFrame) -> DataFrame:
    """``(a, b, c)``: each triangle once, along arcs that go from smaller to larger degree, so that a hub starts no wedge."""
    out = written(degree_order(edges))
    ab, ac = out.select(F.col("src").alias("a"), F.col("dst").alias("b")), out.select(F.col("src").alias("a"), F.col("dst").alias("c"))
    wedge = ab.join(ac, "a").where(F.col("b") < F.col("c"))
    closed = existing_edges(wedge.select(F.col("a").alias("_a"), F.col("b").alias("a"), F.col("c").alias("b")), edges).select(F.col("_a").alias("a"), F.col("a").alias("b"), F.col("b").alias("c"))
    sides = F.array_sort(F.array("a", "b", "c"))
    return closed.select(sides.alias("t")).select(F.col("t")[0].alias("a"), F.col("t")[1].alias("b"), F.col("t")[2].alias("c"))
