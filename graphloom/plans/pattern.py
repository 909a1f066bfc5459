"""Patterns to look for in a graph: the catalogue, their symmetries and the order conditions that follow."""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import cached_property
from itertools import permutations

import numpy as np

# Numbers, names and edges of the preset patterns, vertices numbered as `remapped` numbers them.
PRESETS = {
    0: ("triangle", "0-1 0-2 1-2"),
    1: ("square", "0-1 0-2 1-3 2-3"),
    2: ("chordal square", "0-1 0-2 0-3 1-2 1-3"),
    3: ("2-tails triangle", "0-1 0-2 0-3 1-2 3-4"),
    4: ("house", "0-1 0-2 0-3 1-2 1-4 3-4"),
    5: ("chordal house", "0-1 0-2 0-3 0-4 1-2 1-3 1-4 2-3"),
    6: ("chordal roof", "0-1 0-2 0-3 1-2 1-3 2-4 3-4"),
    7: ("three triangles", "0-1 0-2 0-3 0-4 1-2 1-3 2-4"),
    8: ("solar square", "0-1 0-2 0-3 0-4 1-2 1-4 2-3 3-4"),
    9: ("near 5-clique", "0-1 0-2 0-3 0-4 1-2 1-3 1-4 2-3 2-4"),
    10: ("four triangles", "0-1 0-2 0-3 0-4 0-5 1-2 1-4 2-3 3-5"),
    11: ("one in three triangles", "0-1 0-2 0-3 0-4 1-2 1-3 1-5 2-4 2-5"),
    12: ("near 6-clique", "0-1 0-2 0-3 0-4 0-5 1-2 1-3 1-4 1-5 2-3 2-4"),
    13: ("square on top", "0-1 0-2 0-3 0-4 1-3 1-4 1-5 2-5"),
    14: ("near 7-clique", "0-1 0-2 0-3 0-4 0-5 0-6 1-2 1-3 1-4 1-5 1-6 2-3 2-4 2-5 3-4"),
    15: ("5-clique on top", "0-1 0-2 0-3 0-4 0-5 0-6 1-2 1-3 1-4 1-5 1-6 2-3 2-4 3-4"),
    16: ("5-cycle", "0-1 0-2 1-3 2-4 3-4"),
    17: ("6-cycle", "0-1 0-2 1-3 2-4 3-5 4-5"),
    18: ("hourglass", "0-1 0-2 0-3 1-2 1-5 2-4 3-4 3-5 4-5"),
}
CLIQUES = {23: 3, 24: 4, 25: 5, 26: 6, 27: 7}


@dataclass(frozen=True)
class Pattern:
    """A connected simple graph on the vertices 0..n-1; edges as pairs (a, b), a < b."""

    n: int
    edges: frozenset[tuple[int, int]]
    name: str = ""

    @staticmethod
    def of(edges: list[tuple[int, int]], name: str = "") -> Pattern:
        kept = frozenset((min(e), max(e)) for e in edges if e[0] != e[1])
        return Pattern(1 + max(max(e) for e in kept), kept, name)

    @cached_property
    def neighbours(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in range(self.n)]
        for a, b in self.edges:
            out[a].append(b)
            out[b].append(a)
        return [sorted(x) for x in out]

    def degree(self, u: int) -> int:
        return len(self.neighbours[u])

    def adjacent(self, a: int, b: int) -> bool:
        return (min(a, b), max(a, b)) in self.edges

    @cached_property
    def automorphisms(self) -> list[tuple[int, ...]]:
        """All permutations that map edges to edges, the identity among them."""
        out: list[tuple[int, ...]] = []

        def extend(image: tuple[int, ...]) -> None:
            u = len(image)
            if u == self.n:
                out.append(image)
                return
            for v in range(self.n):
                if v not in image and self.degree(u) == self.degree(v) and all(self.adjacent(u, w) == self.adjacent(v, image[w]) for w in range(u)):
                    extend((*image, v))

        extend(())
        return out

    @cached_property
    def conditions(self) -> list[tuple[int, int]]:
        """Pairs (a, b) that stand for f(a) < f(b) and keep one match of every automorphism class.

        The smallest vertex that some automorphism moves must come before all others
        of its orbit; then only the automorphisms that fix it are left, and so on.
        """
        group, out = self.automorphisms, set()
        for u in range(self.n):
            orbit = {p[u] for p in group}
            out |= {(u, v) for v in orbit if v != u}
            group = [p for p in group if p[u] == u]
        return sorted(out)


def preset(number: int) -> Pattern:
    """Pattern 0-18, or clique 23-27; the numbers between stand for none."""
    if number in PRESETS:
        name, text = PRESETS[number]
        return Pattern.of([tuple(map(int, e.split("-"))) for e in text.split()], name)
    if number in CLIQUES:
        k = CLIQUES[number]
        return Pattern.of([(a, b) for b in range(k) for a in range(b)], f"{k}-clique")
    raise ValueError(f"there is no pattern {number}")


def preset_numbers() -> list[int]:
    return [*PRESETS, *CLIQUES]


def levels_from(p: Pattern, root: int) -> dict[int, int]:
    """Distance of each vertex from ``root``."""
    level, front = {root: 0}, [root]
    while front:
        front = [w for u in front for w in p.neighbours[u] if w not in level and not level.update({w: level[u] + 1})]
    return level


def remapped(p: Pattern) -> Pattern:
    """The pattern numbered anew: by distance from the first vertex of largest degree, within a level by degree, then by neighbours not beyond the next level, both descending, then by number."""
    root = max(range(p.n), key=lambda u: (p.degree(u), -u))
    level = levels_from(p, root)
    seen_with = lambda u: sum(level[w] <= level[u] + 1 for w in p.neighbours[u])
    order = sorted(range(p.n), key=lambda u: (level[u], -p.degree(u), -seen_with(u), u))
    new = {u: i for i, u in enumerate(order)}
    return Pattern.of([(new[a], new[b]) for a, b in p.edges], p.name)


def brute_force(p: Pattern, edges: set[tuple[int, int]], conditions: bool = True) -> int:
    """Matches by trying all placements; for small graphs in tests. Without ``conditions`` each class counts as often as it has members."""
    both = edges | {(b, a) for a, b in edges}
    vertices = sorted({v for e in edges for v in e})
    return sum(all((f[a], f[b]) in both for a, b in p.edges) and (not conditions or all(f[a] < f[b] for a, b in p.conditions)) for f in permutations(vertices, p.n))


def sampled_patterns(edges: list[tuple[int, int]], seed: int, vertices: int = 8, least_edges: int = 15, number: int = 20, tries: int = 20_000) -> list[Pattern]:
    """Induced subgraphs met by random walks with the given numbers of vertices and edges; fewer than ``number`` if ``tries`` walks don't meet more."""
    rng, nbrs = random.Random(seed), {}
    for a, b in edges:
        nbrs.setdefault(a, set()).add(b)
        nbrs.setdefault(b, set()).add(a)
    starts, out = sorted(nbrs), []
    for _ in range(tries if starts else 0):
        at = rng.choice(starts)
        met = [at]
        for _ in range(vertices * 8):
            at = rng.choice(sorted(nbrs[at]))
            if at not in met:
                met.append(at)
            if len(met) == vertices:
                break
        inner = [(i, j) for j in range(len(met)) for i in range(j) if met[j] in nbrs[met[i]]]
        if len(met) == vertices and len(inner) >= least_edges:
            out.append(Pattern.of(inner, f"sample {len(out)}"))
            if len(out) == number:
                break
    return out


def adjacency(p: Pattern) -> np.ndarray:
    out = np.zeros((p.n, p.n), dtype=bool)
    for a, b in p.edges:
        out[a, b] = out[b, a] = True
    return out


def as_text(p: Pattern) -> str:
    """The pattern in the labelled graph format, all labels 0."""
    lines = [f"t {p.n} {len(p.edges)}", *(f"v {u} 0 {p.degree(u)}" for u in range(p.n)), *(f"e {a} {b}" for a, b in sorted(p.edges))]
    return "\n".join(lines) + "\n"
