"""In which order and how the vertices of a pattern are matched. Runs on the driver; holds no data."""

from __future__ import annotations

from dataclasses import dataclass

from graphloom.plans.pattern import Pattern, levels_from

EXPAND, PREFIX = "expand", "prefix"


@dataclass(frozen=True)
class Level:
    """``vertex`` is matched against the neighbours of ``backward``; ``less`` and ``greater`` are matched vertices it must stay below or above, ``other`` those it must only differ from."""

    vertex: int
    backward: tuple[int, ...]
    less: tuple[int, ...]
    greater: tuple[int, ...]
    other: tuple[int, ...]
    store: str


@dataclass(frozen=True)
class MatchPlan:
    pattern: Pattern
    levels: tuple[Level, ...]

    @property
    def order(self) -> list[int]:
        return [x.vertex for x in self.levels]

    def needed_after(self, level: int) -> set[int]:
        """Vertices whose neighbours a later level looks at."""
        return {b for x in self.levels[level + 1 :] for b in x.backward}


def side_needed(mp: MatchPlan, w: int) -> str:
    """Which neighbours of a matched vertex the plan ever looks for: only ``above`` or ``below`` it, or ``all``."""
    users = [x for x in mp.levels if w in x.backward]
    if all(w in x.greater for x in users):
        return "above"
    return "below" if all(w in x.less for x in users) else "all"


def one_sided(mp: MatchPlan) -> bool:
    return all(side_needed(mp, w) != "all" for w in mp.order)


def radius(p: Pattern, root: int) -> int:
    """Levels below ``root``; one more if an edge lies within the last of them."""
    level = levels_from(p, root)
    last = max(level.values())
    return last + any(level[a] == level[b] == last for a, b in p.edges)


def choose_root(p: Pattern) -> int:
    """The least radius, then the largest degree, then the first."""
    return min(range(p.n), key=lambda u: (radius(p, u), -p.degree(u), u))


def search_order(p: Pattern, root: int | None = None) -> list[int]:
    """By distance from the root, then degree descending, then number."""
    level = levels_from(p, choose_root(p) if root is None else root)
    return sorted(range(p.n), key=lambda u: (level[u], -p.degree(u), u))


def candidate_order(p: Pattern, candidates: list[int]) -> list[int]:
    """Always the adjacent vertex with fewest candidates next, of equals the one of larger degree, then the first."""
    rank = lambda u: (candidates[u], -p.degree(u), u)
    order = [min(range(p.n), key=rank)]
    while len(order) < p.n:
        order.append(min((u for u in range(p.n) if u not in order and any(p.adjacent(u, w) for w in order)), key=rank))
    return order


def before_and_at(backward: tuple[int, ...], previous: int) -> tuple[list[int], list[int]]:
    """Backward neighbours matched before ``previous``, whose common neighbours serve all rows that differ in ``previous`` only, and ``previous`` itself if it is one."""
    return [b for b in backward if b != previous], [b for b in backward if b == previous]


def plan(p: Pattern, strategy: str = "hybrid", order: list[int] | None = None) -> MatchPlan:
    """``strategy``: hybrid keeps the extensions of a level as one list where the intersection behind it serves several rows, expand never does.

    A list serves several rows if the level has more than two backward
    neighbours, or two of which none is the vertex matched just before.
    """
    if strategy not in ("hybrid", EXPAND):
        raise ValueError(strategy)
    order = order or search_order(p)
    below = set(p.conditions)
    levels = []
    for i, u in enumerate(order):
        before = order[:i]
        backward = tuple(w for w in before if p.adjacent(u, w))
        shares = i > 0 and len(before_and_at(backward, order[i - 1])[0]) > 1
        less = tuple(w for w in before if (u, w) in below)
        greater = tuple(w for w in before if (w, u) in below)
        other = tuple(w for w in before if w not in less and w not in greater and w not in backward)
        levels.append(Level(u, backward, less, greater, other, PREFIX if shares and strategy == "hybrid" else EXPAND))
    return MatchPlan(p, tuple(levels))


def filter_order(p: Pattern, candidates: list[int]) -> list[int]:
    """Breadth-first from the vertex with fewest candidates for its degree (degree 1 can't start, unless there is no other)."""
    roots = [u for u in range(p.n) if p.degree(u) > 1] or [0]
    root = min(roots, key=lambda u: (candidates[u] / p.degree(u), u))
    order, seen = [root], {root}
    for u in order:
        for w in p.neighbours[u]:
            if w not in seen:
                seen.add(w)
                order.append(w)
    return order


def tree(p: Pattern, order: list[int]) -> dict[int, tuple[int | None, list[int], list[int]]]:
    """Of each vertex its parent, and its neighbours earlier and later in ``order``."""
    at = {u: i for i, u in enumerate(order)}
    out: dict[int, tuple[int | None, list[int], list[int]]] = {}
    for u in order:
        earlier = sorted((w for w in p.neighbours[u] if at[w] < at[u]), key=at.get)
        out[u] = (earlier[0] if earlier else None, earlier, [w for w in p.neighbours[u] if at[w] > at[u]])
    return out


def match_sql(p: Pattern, edges_cte: str, rows: bool = False) -> str:
    """The same count, or the matches, in SQL: a chain of joins in the plan's order, with the order conditions. ``edges_cte`` defines ``g(src, dst)``, src < dst."""
    levels = plan(p).levels
    parts = [edges_cte, "arc AS MATERIALIZED (SELECT src, dst FROM g UNION ALL SELECT dst, src FROM g)", f"m0 AS MATERIALIZED (SELECT DISTINCT src AS q{levels[0].vertex} FROM arc)"]
    for i, x in enumerate(levels[1:], 1):
        u, first, rest = x.vertex, x.backward[-1], x.backward[:-1]
        tests = [f"t.dst {op} m.q{w}" for op, ws in (("<", x.less), (">", x.greater), ("<>", x.other)) for w in ws]
        tests += [f"(m.q{b}, t.dst) IN (SELECT (src, dst) FROM arc)" for b in rest]
        parts.append(f"m{i} AS MATERIALIZED (SELECT m.*, t.dst AS q{u} FROM m{i - 1} m JOIN arc t ON t.src = m.q{first}" + (" WHERE " + " AND ".join(tests) if tests else "") + ")")
    what = ", ".join(f"q{u}" for u in range(p.n)) if rows else "count(*) AS n"
    return "WITH " + ", ".join(parts) + f" SELECT {what} FROM m{p.n - 1}"
