"""Counting the cycles of six vertices without making them."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks that the vertices are dealt to; each gets all edges, packed.
SHARES = 12
#: Edges of a graph that a task may hold.
MOST_EDGES = 10_000_000
#: Walks of three steps that are looked at together.
WALKS = 1_000_000


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch of edges as one text for every share."""
    for batch in batches:
        if not batch.num_rows:
            continue
        src, dst = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
        order = np.lexsort((dst, src))
        text = zlib.compress(np.diff(src[order], prepend=0).tobytes() + dst[order].tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(SHARES), pa.int32()), pa.array([text] * SHARES, pa.binary())], ["share", "part"])


def _lists(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(starts, ends)``: the neighbours of vertex v, numbered densely, are ``ends[starts[v] : starts[v + 1]]``, ascending."""
    halves = [np.frombuffer(zlib.decompress(x), np.int64).reshape(2, -1) for x in parts]
    src, dst = np.concatenate([np.cumsum(x[0]) for x in halves]), np.concatenate([x[1] for x in halves])
    del halves
    ids = np.union1d(np.unique(src), np.unique(dst))
    src, dst, n = np.searchsorted(ids, src), np.searchsorted(ids, dst), len(ids)
    keys = np.empty(2 * len(src), np.int64)
    for half, a, b in ((keys[: len(src)], src, dst), (keys[len(src) :], dst, src)):
        np.multiply(a, n, out=half)
        half += b
    del src, dst, half, a, b
    keys.sort()
    starts = np.searchsorted(keys, np.arange(n + 1) * n)
    keys %= n
    return starts, keys.astype(np.int32)


def _ahead(starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vertex of ``at`` its neighbours: the place in ``at``, and the neighbour."""
    many = starts[at + 1] - starts[at]
    place = np.repeat(np.arange(len(at)), many)
    first = np.cumsum(many) - many
    return place, ends[np.arange(len(place)) + np.repeat(starts[at] - first, many)]


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and how often each comes."""
    keys = np.sort(keys)
    cuts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[cuts], np.diff(cuts, append=len(keys))


def _found(keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The counts of the ``wanted`` keys, 0 of those that are not there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, counts[at], 0)


def _pairs(x: np.ndarray) -> int:
    return int((x * (x - 1) // 2).sum())


def _hexagons_at(starts: np.ndarray, ends: np.ndarray, tops: np.ndarray) -> int:
    """The six-cycles whose last vertex is one of ``tops``.

    Two paths u-a-b-w and u-c-d-w below u, with no vertex between u and w in
    common, make one. Of all pairs of paths those with a = c, with b = d, and
    with a = d or b = c are taken away, which exclude each other but for the last two.
    """
    n = len(starts) - 1
    u, a = _ahead(starts, ends, tops)
    own = a < tops[u]
    u, a = u[own], a[own]
    spoke = u * n + a  # ascending
    ua, b = _ahead(starts, ends, a)
    own = b < tops[u[ua]]
    ua, b = ua[own], b[own]
    wedge = ua * n + b  # ascending
    uab, w = _ahead(starts, ends, b)
    own = (w < tops[u[ua[uab]]]) & (w != a[ua[uab]])
    uab, w = uab[own], w[own]
    total = _pairs(_counted(u[ua[uab]] * n + w)[1])
    by_a, times = _counted(ua[uab] * n + w)  # the b of each (u, a, w)
    total -= _pairs(times)
    far, shared = _counted(u[ua] * n + b)  # the a of each (u, b)
    top, mid = far // n, far % n
    many = shared > 1
    if many.any():
        top, mid, c = top[many], mid[many], shared[many]
        place, end = _ahead(starts, ends, mid)
        below = np.bincount(place[end < tops[top[place]]], minlength=len(mid))
        total -= int(((below - c) * (c * (c - 1) // 2) + c * ((c - 1) * (c - 2) // 2)).sum())  # c of those w are neighbours of u, and no path to them goes through them
    closed = _found(far, shared, spoke)[ua]  # the c next to u and a
    some = closed > 0
    w_next = _found(spoke, np.ones(len(spoke), np.int64), u[ua[some]] * n + b[some])
    total -= int((_found(by_a, times, wedge[some]) * (closed[some] - w_next)).sum())
    some = np.flatnonzero(_found(spoke, np.ones(len(spoke), np.int64), u[ua] * n + b))  # b next to u
    place, end = _ahead(starts, ends, b[some])
    both = _found(wedge, np.ones(len(wedge), np.int64), ua[some][place] * n + end)
    return total + int(both[end < tops[u[ua[some]]][place]].sum()) // 2


def _hexagons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shares: dict[int, list[bytes]] = {}
    for batch in batches:
        for share, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shares.setdefault(share, []).append(part)
    total = 0
    for share in list(shares):
        starts, ends = _lists(shares.pop(share))
        walks = np.diff(starts)
        for _ in range(2):
            walks = np.add.reduceat(walks[ends], starts[:-1])  # no list is empty
        tops = np.arange(share, len(starts) - 1, SHARES)
        batch_of = np.cumsum(walks[tops]) // WALKS
        for some in np.split(tops, np.flatnonzero(np.diff(batch_of)) + 1):
            total += _hexagons_at(starts, ends, some)
    yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["n"])


def hexagon_count(edges: DataFrame) -> DataFrame:
    """``(n)``: the number of six-cycles of normalised edges, each counted at its last vertex.

    Every task gets all edges and counts at its share of the vertices, so what is
    moved are ``SHARES`` packed copies of the edges and no walk leaves a task. A task holds
    the graph and about ``WALKS`` walks, or those of one vertex.
    """
    packed = edges.select("src", "dst").mapInArrow(_packed, "share int, part binary")
    found = packed.repartitionById(SHARES, "share").mapInArrow(_hexagons, "n bigint")
    return found.agg(F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("n"))
