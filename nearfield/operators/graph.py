"""Approximate search by proximity graphs with layers, one graph for each shard of a table.

A beam search hops from node to node, which as joins would be a shuffle a hop.
Rows are therefore dealt to shards of bounded size; a worker builds, changes or
searches its shard's graph whole, and shards' results are merged by rank. Shards
are cells around coarse centres, large cells in several parts, and stored by
cell: a query looks into the shards of its nearest cells, others aren't read.
Levels come from a hash of the key and ties are broken by key, so a table always
has one graph.

``GraphIndex.build`` chooses links from each node's exact nearest neighbours in
the shard, which a matrix product gives at once. ``apply`` changes a built graph
where it stands: new nodes are inserted by the construction beam, nodes that go
or move are taken out of their neighbours' lists, which choose anew among their
neighbours' neighbours.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from nearfield.functions.space import AT_ONCE, SPACES, Space
from nearfield.functions.storage import materialized, shared_folder
from nearfield.functions.vectors import matrix
from nearfield.operators.exact import Best, ShortResult, _query_blocks, checked, checked_dim, collected, knn, nearest_in, ranked, survivors
from nearfield.operators.ivf import SAMPLE, _nearest, fit_centres

#: Rows of a shard at most, about; cells, whatever the size of the table.
SHARD, CELLS = 20_000, 1024
#: Cells up to which queries look into all by default, and the share of them beyond.
ALL_CELLS, SOME_CELLS = 16, 8
#: A shard of which a filter leaves no more than this share, and so many rows for each place of the beam, isn't walked: those rows are looked at.
FEW_SHARE, FEW_ROWS = 1 / 16, 32
#: Cells of a matrix of queries and nodes that walk together.
TOGETHER = 4_000_000
FORMAT = 1
FOUND = "query_id bigint, vec_id bigint, dist double, hops bigint, distances bigint"
OWN = ("cell", "part", "level", "links", "widths", "deleted")


class GraphError(ValueError):
    """A stored graph that isn't whole or isn't the one that was asked for."""


def level_of(key: str = "vec_id", M: int = 16, seed: int = 100) -> Column:
    """A node's top layer: floor(-ln(u) / ln(M)), with u from a hash of its key."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key).cast("long")), 11).cast("double") + 1) / F.lit(float(1 << 53))
    return F.floor(-F.log(u) / math.log(max(M, 2))).cast("int")


def _near(space: Space, x: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` nearest other members of ``rows`` for each of them, closest first, ties by number."""
    b = x[rows]
    n = min(n, len(rows) - 1)
    ids, dist = np.empty((len(rows), n), np.int64), np.empty((len(rows), n))
    for top in range(0, len(rows), 512):
        d, _ = space.candidates(b[top : top + 512], b)
        d = np.array(d)
        d[np.arange(len(d)), np.arange(top, top + len(d))] = np.inf
        first = np.argpartition(d, n - 1, 1)[:, :n] if n < len(rows) - 1 else np.tile(np.arange(len(rows)), (len(d), 1))
        order = np.lexsort((first, np.take_along_axis(d, first, 1)), axis=1)[:, :n]
        first = np.take_along_axis(first, order, 1)
        ids[top : top + 512], dist[top : top + 512] = rows[first], np.take_along_axis(d, first, 1)
    return ids, dist


def select(space: Space, x: np.ndarray, candidates: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` candidates, closest first, none nearer to one chosen before than to the node itself."""
    if len(candidates) < most:
        return candidates
    chosen, alive = [], np.ones(len(candidates), bool)
    while len(chosen) < most and alive.any():
        i = int(np.argmax(alive))
        chosen.append(candidates[i])
        alive[i] = False
        rest = np.flatnonzero(alive)
        if len(rest):
            alive[rest] = space.rows(x[candidates[i]][None, :], x[candidates[rest]]) >= dist[rest] if space.bulk is None else space.bulk(x[candidates[i]][None, :], x[candidates[rest]])[0] >= dist[rest]
    return np.array(chosen, np.int64)


def _between(space: Space, x: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Distances of rows by number: looked up in one product of all with all where that isn't large."""
    if space.bulk is None or len(x) ** 2 > TOGETHER:
        return lambda a, b: space.rows(x[a], x[b])
    every = space.bulk(x, x)
    return lambda a, b: every[a, b]


def select_many(between: Callable[[np.ndarray, np.ndarray], np.ndarray], candidates: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """``select`` of many nodes at once: which candidates are chosen. A row holds a node's candidates, closest first, and -1 beyond them."""
    alive = candidates >= 0
    chosen = np.zeros(alive.shape, bool)
    few = alive.sum(1) < most
    chosen[few] = alive[few]
    rows = np.flatnonzero(~few)
    for _ in range(most):
        rows = rows[alive[rows].any(1)]
        if not len(rows):
            break
        i = alive[rows].argmax(1)
        chosen[rows, i], alive[rows, i] = True, False
        r, j = np.nonzero(alive[rows])
        alive[rows[r], j] = between(candidates[rows, i][r], candidates[rows[r], j]) >= dist[rows[r], j]
    return chosen


def select_of(space: Space, x: np.ndarray, between: Callable[[np.ndarray, np.ndarray], np.ndarray], nodes: list[int], lists: list[list[int]], most: int) -> list[list[int]]:
    """What each of ``nodes`` chooses of its own list of candidates, closest first."""
    out: list[list[int]] = [[] for _ in nodes]
    size = np.array([len(c) for c in lists], np.int64)
    order = np.argsort(size, kind="stable")
    lo = 0
    while lo < len(order):  # lists of like length together, of bounded size
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * size[order[hi]] <= TOGETHER // 8:
            hi += 1
        mine = order[lo:hi]
        lo = hi
        width = int(size[mine[-1]])
        if not width:
            continue
        fits = np.arange(width)[None, :] < size[mine][:, None]
        c = np.concatenate([np.asarray(lists[k], np.int64) for k in mine])
        owner = np.repeat(np.arange(len(mine)), size[mine])
        d = space.rows(x[np.array([nodes[k] for k in mine], np.int64)[owner]], x[c])
        first = np.lexsort((c, d, owner))
        candidates, dist = np.full(fits.shape, -1, np.int64), np.full(fits.shape, np.inf)
        candidates[fits], dist[fits] = c[first], d[first]
        chosen = select_many(between, candidates, dist, most)
        for k, row, is_in in zip(mine.tolist(), candidates, chosen, strict=True):
            out[k] = row[is_in].tolist()
    return out


def build_layer(space: Space, x: np.ndarray, rows: np.ndarray, M: int, most: int, ef: int, between: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> dict[int, np.ndarray]:
    """Links of one layer: ``M`` by choice, back links up to ``most``, and every node reachable from the first."""
    if len(rows) < 2:
        return {int(r): np.empty(0, np.int64) for r in rows}
    between = between or _between(space, x)
    near, dist = _near(space, x, rows, max(ef, M))
    size = max(1, TOGETHER // 4 // near.shape[1])
    links: dict[int, list] = {}
    for lo in range(0, len(rows), size):
        part = near[lo : lo + size]
        for r, out, chosen in zip(rows[lo : lo + size].tolist(), part, select_many(between, part, dist[lo : lo + size], M), strict=True):
            links[r] = out[chosen].tolist()
    back: dict[int, list] = {r: [] for r in links}
    for r, out in links.items():
        for o in out:
            back[o].append(r)
    full = []
    for r, extra in back.items():
        links[r] = list(dict.fromkeys([*links[r], *extra]))
        if len(links[r]) > most:
            full.append(r)
    links.update(zip(full, select_of(space, x, between, full, [links[r] for r in full], most), strict=True))
    _connect(space, x, rows, links, most)
    return {r: np.array(sorted(map(int, out)), np.int64) for r, out in links.items()}


def _connect(space: Space, x: np.ndarray, rows: np.ndarray, links: dict[int, list], most: int) -> None:
    """Gives every node an inbound link, and a way from the first node.

    A node that lacks one is linked from its nearest node with room; where none
    has room, from the nearest one that can spare a link to a node with others.
    """
    inbound = dict.fromkeys(links, 0)
    for out in links.values():
        for o in out:
            inbound[int(o)] += 1

    def spread(start: int, reached: set[int]) -> None:
        todo = [start]
        reached.add(start)
        while todo:
            for o in map(int, links[todo.pop()]):
                if o not in reached:
                    reached.add(o)
                    todo.append(o)

    def join(r: int, others: list[int]) -> bool:
        every = np.array(others, np.int64)
        full = np.array([len(links[o]) >= most for o in others])
        for o in every[np.lexsort((every, space.rows(x[r][None, :], x[every]), full))].tolist():
            if len(links[o]) >= most:
                spare = next((t for t in reversed(links[o]) if inbound[int(t)] > 1), None)
                if spare is None:
                    continue
                links[o].remove(spare)
                inbound[int(spare)] -= 1
            links[o].append(r)
            inbound[r] += 1
            if o not in links[r] and len(links[r]) < most:
                links[r].append(o)
                inbound[o] += 1
            return True
        return False

    # a link that was spared may have been another node's only way
    for _ in range(4):
        reached: set[int] = set()
        spread(int(rows[0]), reached)
        apart = [r for r in map(int, rows) if r not in reached]
        if not apart:
            break
        for r in apart:
            if r not in reached and join(r, sorted(reached)):
                spread(r, reached)
    for r in map(int, rows):
        if not inbound[r]:
            join(r, [o for o in map(int, rows) if o != r])


class Walker:
    """Walks over a shard's graph; ``near(node, layer)`` gives a node's neighbours by local number."""

    def __init__(self, space: Space, ids: np.ndarray, x: np.ndarray, allowed: np.ndarray | None = None) -> None:
        self.space, self.ids, self.x, self.allowed = space, ids, x, allowed
        self.stamp, self.seen = 0, np.zeros(len(ids), np.int64)
        self.hops = self.distances = 0
        self.entry = -1

    def near(self, node: int, layer: int) -> np.ndarray:
        raise NotImplementedError

    def layers(self, node: int) -> int:
        raise NotImplementedError

    def _dist(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        self.distances += len(rows)
        return self.space.rows(q[None, :], self.x[rows])

    def descend(self, q: np.ndarray, above: int = 0) -> tuple[int, float]:
        """The node that greedy steps reach on the layers above ``above``, and its distance."""
        at = self.entry
        best = float(self._dist(q, np.array([at]))[0])
        for layer in range(self.layers(at) - 1, above, -1):
            moved = True
            while moved:
                self.hops += 1
                near = self.near(at, layer)
                d = self._dist(q, near)
                moved = len(d) > 0 and float(d.min()) < best
                if moved:
                    at, best = int(near[int(d.argmin())]), float(d.min())
        return at, best

    def walk(self, q: np.ndarray, stop: Callable[[float, list], bool], trim: Callable[[list], None], layer: int = 0, start: tuple[int, float] | None = None) -> list[tuple[float, int]]:
        """Nodes found from the entry on; ``stop(head, found)`` ends it, ``trim`` drops what is too many.

        Nodes that aren't allowed are walked through, not returned. ``found`` is a
        heap of (-dist, -number).
        """
        if self.entry < 0:
            return []
        self.stamp += 1
        at, d = start or self.descend(q)
        self.seen[at] = self.stamp
        frontier, found = [(d, at)], []
        if self.allowed is None or self.allowed[at]:
            heapq.heappush(found, (-d, -at))
        while frontier:
            d, at = heapq.heappop(frontier)
            if stop(d, found):
                break
            self.hops += 1
            near = self.near(at, layer)
            near = near[self.seen[near] != self.stamp]
            self.seen[near] = self.stamp
            for o, e in zip(near.tolist(), self._dist(q, near).tolist(), strict=True):
                if not stop(e, found):
                    heapq.heappush(frontier, (e, o))
                    if self.allowed is None or self.allowed[o]:
                        heapq.heappush(found, (-e, -o))
                        trim(found)
        return sorted((-a, -b) for a, b in found)

    def beam(self, q: np.ndarray, width: int, layer: int = 0, start: tuple[int, float] | None = None) -> list[tuple[float, int]]:
        def trim(found: list) -> None:
            if len(found) > width:
                heapq.heappop(found)

        return self.walk(q, lambda d, found: len(found) >= width and d > -found[0][0], trim, layer, start)

    def radius(self, q: np.ndarray, eps: float, least: int) -> list[tuple[float, int]]:
        """What is found within ``eps``, going on beyond it until ``least`` nodes are found."""
        out = self.walk(q, lambda d, found: len(found) >= least and d > max(eps, -found[0][0]), lambda found: None)
        return [x for x in out if x[0] <= eps]


@dataclass
class Found:
    """What walks of some queries found: query and node numbers with distances; each query's hops and distances taken."""

    query: np.ndarray
    node: np.ndarray
    dist: np.ndarray
    hops: np.ndarray
    taken: np.ndarray

    @classmethod
    def joined(cls, parts: list[tuple[np.ndarray, ...]], n: int) -> Found:
        """Parts for (some of ``n`` queries, numbers among these, nodes, distances, hops, distances taken)."""
        hops, taken = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for mine, _, _, _, h, t in parts:
            hops[mine], taken[mine] = h, t
        cat = lambda x, kind: np.concatenate([np.empty(0, kind), *x]).astype(kind)
        return cls(cat([p[0][p[1]] for p in parts], np.int64), cat([p[2] for p in parts], np.int64), cat([p[3] for p in parts], np.float64), hops, taken)


class Searcher(Walker):
    """A stored shard: all links in one array, cut by node and layer."""

    def __init__(self, space: Space, ids: np.ndarray, x: np.ndarray, links: pa.Array, widths: pa.Array, allowed: np.ndarray | None = None) -> None:
        super().__init__(space, ids, x, allowed)
        self.links = np.searchsorted(ids, links.flatten().to_numpy(zero_copy_only=False))
        self.widths = widths.flatten().to_numpy(zero_copy_only=False)
        count = widths.value_lengths().to_numpy(zero_copy_only=False)
        self.own = np.cumsum(count) - count
        self.count = count
        self.begin = np.concatenate([[0], np.cumsum(self.widths)])
        self.entry = int(np.argmax(count)) if len(ids) else -1
        self.tables: dict[int, np.ndarray] = {}
        self.spreads: dict[int, np.ndarray] = {}
        self.whole: bool | None = None

    def near(self, node: int, layer: int) -> np.ndarray:
        k = self.own[node] + layer
        return self.links[self.begin[k] : self.begin[k + 1]]

    def layers(self, node: int) -> int:
        return int(self.count[node])

    def _padded(self, layer: int) -> np.ndarray:
        """(nodes, most): each node's neighbours on a layer, -1 beyond them."""
        if layer not in self.tables:
            on = np.flatnonzero(self.count > layer)
            k = self.own[on] + layer
            width = self.widths[k]
            fits = np.arange(width.max(initial=0))[None, :] < width[:, None]
            out = np.full((len(self.ids), fits.shape[1]), -1, np.int64)
            part = out[on]
            part[fits] = self.links[(self.begin[k][:, None] + np.arange(fits.shape[1]))[fits]]
            out[on] = part
            self.tables[layer] = out
        return self.tables[layer]

    def reached(self, start: int) -> np.ndarray:
        """Whether the lowest layer's links lead from ``start`` to a node."""
        near = self._padded(0)
        if self.whole is None:
            # from the entry to all nodes and back means from any node to all
            back, n = np.arange(len(self.ids)) == self.entry, 0
            while n != (n := int(back.sum())):
                back |= (back[near] & (near >= 0)).any(1)
            self.whole = n == len(back) and bool(self._spread(self.entry).all())
        if self.whole:
            return np.ones(len(self.ids), bool)
        if start not in self.spreads:
            self.spreads[start] = self._spread(start)
        return self.spreads[start]

    def _spread(self, start: int) -> np.ndarray:
        near, mask, front = self._padded(0), np.arange(len(self.ids)) == start, np.array([start])
        while len(front):
            out = near[front]
            out = np.unique(out[out >= 0])
            front = out[~mask[out]]
            mask[front] = True
        return mask

    def descend_all(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``descend`` of many queries, step by step together: nodes, their distances, hops and distances taken."""
        at = np.full(len(q), self.entry)
        best, hops, taken = self.space.rows(q, self.x[at]), np.zeros(len(q), np.int64), np.ones(len(q), np.int64)
        for layer in range(self.layers(self.entry) - 1, 0, -1):
            near, moving = self._padded(layer), np.arange(len(q))
            while len(moving):
                hops[moving] += 1
                out = near[at[moving]]
                if not out.shape[1]:
                    break
                i, j = np.nonzero(out >= 0)
                d = np.full(out.shape, np.inf)
                d[i, j] = self.space.rows(q[moving[i]], self.x[out[i, j]])
                taken[moving] += (out >= 0).sum(1)
                first = d.argmin(1)
                low = d[np.arange(len(d)), first]
                go = low < best[moving]
                at[moving[go]], best[moving[go]] = out[go, first[go]], low[go]
                moving = moving[go]
        return at, best, hops, taken

    def endless(self, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, allowed nodes, hops, distances) of walks that nothing ends: they take in what the links lead to."""
        if self.entry < 0:
            return []
        at, _, hops, taken = self.descend_all(q)
        groups: dict[bytes, tuple[np.ndarray, list]] = {}
        for start in np.unique(at).tolist():
            mask = self.reached(start)
            groups.setdefault(mask.tobytes(), (mask, []))[1].append(start)
        out = []
        for mask, starts in groups.values():
            mine = np.flatnonzero(np.isin(at, starts))
            n = int(mask.sum())
            out.append((mine, np.flatnonzero(mask if self.allowed is None else mask & self.allowed), hops[mine] + n, taken[mine] + n - 1))
        return out

    def _nearest_of(self, q: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        best = Best(len(q), min(k, max(1, len(rows))))
        nearest_in(self.space, rows, self.x[rows], q, best)
        return best.rows()

    def beams(self, q: np.ndarray, width: int, k: int) -> Found:
        """The ``k`` nearest nodes of the ``beam`` of each query, which walk together.

        A step takes the nearest node off each query's frontier. A beam with room for
        all allowed nodes never ends early: what it finds depends on the links alone.
        """
        can = len(self.ids) if self.allowed is None else int(self.allowed.sum())
        if self.entry < 0 or not can:
            return Found.joined([], len(q))
        if self.allowed is not None and can <= min(FEW_SHARE * len(self.ids), FEW_ROWS * width):
            i, node, d = self._nearest_of(q, np.flatnonzero(self.allowed), k)
            return Found(i, node, d, np.zeros(len(q), np.int64), np.full(len(q), can))
        if width > can:
            return Found.joined([(mine, *self._nearest_of(q[mine], rows, k), hops, taken) for mine, rows, hops, taken in self.endless(q)], len(q))
        size = max(1, min(512, TOGETHER // len(self.ids)))
        blocks = [np.arange(lo, min(len(q), lo + size)) for lo in range(0, len(q), size)]
        return Found.joined([(b, *self._walked(q[b], width, min(k, width))) for b in blocks], len(q))

    def _walked(self, q: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        near, can = self._padded(0), self.allowed
        at, d, hops, taken = self.descend_all(q)
        r = np.arange(len(q))
        known = np.full((len(q), len(self.ids)), np.inf)
        known[r, at] = d
        frontier, seen = known.copy(), np.isin(known, np.inf, invert=True)
        seen[r, at] = True
        # the distances of the nearest allowed nodes so far, the largest of them last
        top = np.full((len(q), width), np.inf)
        top[:, 0] = d if can is None else np.where(can[at], d, np.inf)
        mine, own = r, r  # queries that still walk, and their rows of what follows
        while len(mine):
            if len(own) * 2 < len(frontier):  # leave out the rows of those that ended
                frontier, top, own = frontier[own], top[own], np.arange(len(own))
            at = frontier.argmin(1)[own]
            d = frontier[own, at]
            goes = np.isfinite(d) & ~(d > top[own, -1])
            mine, own, at = mine[goes], own[goes], at[goes]
            if not len(mine):
                break
            hops[mine] += 1
            frontier[own, at] = np.inf
            out = near[at]
            fresh = (out >= 0) & ~seen[mine[:, None], out]
            i, j = np.nonzero(fresh)
            node = out[i, j]
            e = self.space.rows(q[mine[i]], self.x[node])
            taken[mine] += fresh.sum(1)
            seen[mine[i], node] = True
            known[mine[i], node] = e
            frontier[own[i], node] = e
            new = np.full(out.shape, np.inf)
            new[i, j] = e if can is None else np.where(can[node], e, np.inf)
            better = np.flatnonzero((new < top[own, -1:]).any(1))
            top[own[better]] = np.partition(np.hstack([top[own[better]], new[better]]), width - 1, 1)[:, :width]
        if can is not None:
            known[:, ~can] = np.inf
        last = np.partition(known, k - 1, 1)[:, k - 1 : k]
        i, node = np.nonzero((known <= last) & np.isfinite(known))
        order = np.lexsort((node, known[i, node], i))
        i, node = i[order], node[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        i, node = i[first], node[first]
        return i, node, known[i, node], hops, taken

    def within(self, q: np.ndarray, eps: float, least: int, most: int | None = None) -> Found:
        """``radius`` of each query, the nearest ``most`` nodes of it if given."""
        can = len(self.ids) if self.allowed is None else int(self.allowed.sum())
        if least <= can:
            return self.each(q, lambda one: self.radius(one, eps, least)[:most])

        def limit(approx: np.ndarray, error: np.ndarray) -> np.ndarray:
            if most is None or most >= approx.shape[1]:
                return np.full(len(approx), eps)
            return np.minimum(eps, np.partition(approx, most - 1, 1)[:, most - 1] + error[:, 0])

        parts = []
        for mine, rows, hops, taken in self.endless(q):
            i, j, d = self._near_enough(q[mine], rows, limit)
            keep = d <= eps
            if most is not None:  # ties by number, which is the order of ids
                order = np.lexsort((j, d, i))
                order = order[keep[order]]
                i, j, d = i[order], j[order], d[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < most
            parts.append((mine, i[keep], rows[j[keep]], d[keep], hops, taken))
        return Found.joined(parts, len(q))

    def _near_enough(self, q: np.ndarray, rows: np.ndarray, limit: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, number in ``rows``, distance) of pairs that may be within each query's ``limit``, a function of all distances up to rounding."""
        x, out = self.x[rows], []
        size = max(1, TOGETHER // max(1, len(rows)))
        for lo in range(0, len(q), size):
            part = q[lo : lo + size]
            approx, error = self.space.candidates(part, x)
            i, j = np.nonzero(approx <= (limit(approx, error) + error[:, 0])[:, None])
            out.append((i + lo, j, self.space.rows(part[i], x[j])))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))

    def documents(self, q: np.ndarray, docs: np.ndarray, n: int, num_docs: int) -> Found:
        """Nodes nearest to each query, by a beam that is widened until they belong to more than ``n`` documents (``docs``: a number for each node).

        Of those found, nodes up to the nearest one of document ``num_docs + 1`` in
        this shard: what is farther is beyond the limit of all shards too.
        """
        can = len(self.ids) if self.allowed is None else int(self.allowed.sum())
        if self.entry < 0 or not can:
            return Found.joined([], len(q))
        width, left, parts = max(16, 2 * n), np.arange(len(q)), []
        while len(left) and width <= can:
            found = self.beams(q[left], width, width)
            held = np.bincount(np.unique(np.stack([found.query, docs[found.node]]), axis=1)[0].astype(np.int64), minlength=len(left))
            done = held > n
            keep = done[found.query] & ~_beyond(found.query, docs[found.node], found.dist, num_docs, len(left))
            at = np.cumsum(done) - 1
            parts.append((left[done], at[found.query[keep]], found.node[keep], found.dist[keep], found.hops[done], found.taken[done]))
            left, width = left[~done], 2 * width
        for mine, rows, hops, taken in self.endless(q[left]) if len(left) else []:
            own, code = np.unique(docs[rows], return_inverse=True)
            order = np.argsort(code, kind="stable")
            starts = np.searchsorted(code[order], np.arange(len(own)))

            def limit(approx: np.ndarray, error: np.ndarray, order=order, starts=starts) -> np.ndarray:
                low = np.minimum.reduceat(approx[:, order], starts, axis=1)
                return np.partition(low, num_docs, 1)[:, num_docs] + error[:, 0] if num_docs < low.shape[1] else np.full(len(approx), np.inf)

            i, j, d = self._near_enough(q[left][mine], rows, limit) if len(rows) else self._near_enough(q[:0], rows, limit)
            keep = ~_beyond(i, docs[rows[j]], d, num_docs, len(mine))
            parts.append((left[mine], i[keep], rows[j[keep]], d[keep], hops, taken))
        return Found.joined(parts, len(q))

    def each(self, q: np.ndarray, one: Callable[[np.ndarray], list]) -> Found:
        """What ``one`` walk after the other finds, as (distance, node)."""
        hops, taken, i, node, dist = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), [], [], []
        for n in range(len(q)):
            self.hops = self.distances = 0
            found = one(q[n])
            hops[n], taken[n] = self.hops, self.distances
            i += [n] * len(found)
            dist += [d for d, _ in found]
            node += [x for _, x in found]
        return Found(np.array(i, np.int64), np.array(node, np.int64), np.array(dist, np.float64), hops, taken)


def _beyond(query: np.ndarray, doc: np.ndarray, dist: np.ndarray, n: int, queries: int) -> np.ndarray:
    """Whether a node is farther from its query than the nearest node of the query's document number ``n + 1``."""
    order = np.lexsort((dist, doc, query))
    a, b = query[order], doc[order]
    first = order[np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])] if len(order) else order
    first = first[np.lexsort((dist[first], query[first]))]
    place = np.arange(len(first)) - np.searchsorted(query[first], query[first])
    limit = np.full(queries, np.inf)
    limit[query[first[place == n]]] = dist[first[place == n]]
    return dist > limit[query]


class Net(Walker):
    """A shard's graph that changes: links by node and layer as lists."""

    def __init__(self, space: Space, ids: np.ndarray, x: np.ndarray, links: list[list[list[int]]], M: int, ef: int) -> None:
        super().__init__(space, ids, x)
        self.links, self.M, self.ef = links, M, ef
        self.between: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
        #: The distances of the node that is inserted from all others, where the shard is small.
        self.known: np.ndarray | None = None
        self._enter()

    def _enter(self) -> None:
        count = [len(x) for x in self.links]
        self.entry = int(np.argmax(count)) if any(count) else -1

    def near(self, node: int, layer: int) -> np.ndarray:
        return np.array(self.links[node][layer], np.int64)

    def layers(self, node: int) -> int:
        return len(self.links[node])

    def _most(self, layer: int) -> int:
        return 2 * self.M if layer == 0 else self.M

    def _between(self) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """Distances of nodes by number; they have their vectors by the time of the first change."""
        self.between = self.between or _between(self.space, self.x)
        return self.between

    def _dist(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if self.known is None:
            return super()._dist(q, rows)
        self.distances += len(rows)
        return self.known[rows]

    def insert(self, node: int, level: int) -> None:
        """Links a node on each of its layers with what the construction beam finds, and back."""
        q, self.links[node] = self.x[node], []
        if self.entry < 0:
            self.links[node] = [[] for _ in range(level + 1)]
            self.entry = node
            return
        self.known = self.space.rows(q[None, :], self.x) if len(self.x) <= AT_ONCE else None
        between = self._between()
        top = self.layers(self.entry) - 1
        at = self.descend(q, min(level, top))
        own: list[list[int]] = [[] for _ in range(level + 1)]
        for layer in range(min(level, top), -1, -1):
            found = self.beam(q, self.ef, layer, at)
            c, d = np.array([i for _, i in found], np.int64), np.array([d for d, _ in found])
            own[layer] = c[select_many(between, c[None, :], d[None, :], self.M)[0]].tolist()
            at = found[0][1], found[0][0]
        self.links[node] = own
        self.known = None
        for layer, out in enumerate(own):
            full = []
            for o in out:
                back = self.links[o][layer]
                back.append(node)
                if len(back) > self._most(layer):
                    full.append(o)
            for o, kept in zip(full, select_of(self.space, self.x, between, full, [self.links[o][layer] for o in full], self._most(layer)), strict=True):
                self.links[o][layer] = kept
        if level > top:
            self.entry = node

    def take_out(self, gone: set[int]) -> None:
        """Removes nodes; who linked to one chooses anew among its own and the removed nodes' neighbours."""
        before = self.links
        self.links = [[] if i in gone else node for i, node in enumerate(before)]
        anew: dict[int, list[tuple[int, int, list[int]]]] = {}
        for i, node in enumerate(self.links):
            for layer, out in enumerate(node):
                lost = gone.intersection(out)
                if lost:
                    kept = dict.fromkeys(o for o in out if o not in gone)
                    for g in lost:
                        kept.update(dict.fromkeys(o for o in before[g][layer] if o != i and o not in gone))
                    anew.setdefault(self._most(layer), []).append((i, layer, list(kept)))
        for most, changed in anew.items():
            for (i, layer, _), out in zip(changed, select_of(self.space, self.x, self._between(), [i for i, _, _ in changed], [kept for _, _, kept in changed], most), strict=True):
                self.links[i][layer] = out
        self._enter()

    def connected(self) -> list[list[list[int]]]:
        """The links once every node of every layer can be reached."""
        count = np.array([len(x) for x in self.links])
        for layer in range(int(count.max(initial=0))):
            rows = np.flatnonzero(count > layer)
            if len(rows) > 1:
                links = {int(r): self.links[r][layer] for r in rows}
                _connect(self.space, self.x, rows, links, self._most(layer))
        return self.links


class Stop:
    """Ends a walk; subclass it for conditions of one's own. A new one is made for each query and shard.

    ``ends(dist, found)`` tells whether a walk that has found so many nodes, a heap
    of (-dist, ...), need not look at a node at ``dist``; ``trim`` may drop
    the worst of them by ``heapq.heappop``. With ``endless``, ``ends`` is never true
    and isn't asked; nodes then come in order of distance.
    """

    endless = False

    def ends(self, dist: float, found: list) -> bool:
        raise NotImplementedError

    def trim(self, found: list) -> None:
        pass


def _flat(links: list[list[list[int]]], ids: np.ndarray, rows: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Columns ``links`` (ids, layer after layer) and ``widths`` (links on each layer)."""
    flat = [[int(ids[o]) for layer in links[r] for o in sorted(layer)] for r in rows.tolist()]
    return pa.array(flat, pa.list_(pa.int64())), pa.array([[len(layer) for layer in links[r]] for r in rows.tolist()], pa.list_(pa.int32()))


def build_shard(space: Space, x: np.ndarray, levels: np.ndarray, M: int, ef: int) -> list[list[list[int]]]:
    """Links of every node on each of its layers, by number."""
    out: list[list[list[int]]] = [[] for _ in x]
    between = _between(space, x)
    for layer in range(int(levels.max(initial=-1)) + 1):
        for r, found in build_layer(space, x, np.flatnonzero(levels >= layer), M, 2 * M if layer == 0 else M, ef, between).items():
            out[r].append(found.tolist())
    return out


def layered(links: str = "links", widths: str = "widths") -> Column:
    """The links of each layer as an array of arrays."""
    before = lambda n: F.aggregate(F.slice(F.col(widths), 1, n), F.lit(0), lambda t, w: t + w)
    return F.transform(F.sequence(F.lit(0), F.size(widths) - 1), lambda n: F.slice(F.col(links), before(n) + 1, F.element_at(widths, n + 1)))


def _by_shard(rows: DataFrame, cells: int) -> DataFrame:
    """``rows`` dealt by shard to a set number of tasks: shards are few and small, but take long, so Spark must not bring them together."""
    spark = rows.sparkSession
    return rows.repartition(max(2 * cells, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "cell", "part")


def _written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to the shared folder and read again."""
    path = shared_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _ddl(df: DataFrame, *without: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in without)


@dataclass
class GraphIndex:
    """``rows``: the base's columns with ``cell, part, level, links`` (ids, layer after layer), ``widths`` (links on each layer) and ``deleted``.

    Deleted rows are walked through, not returned.
    """

    rows: DataFrame
    space: Space
    dim: int
    centres: np.ndarray
    M: int = 16
    ef: int = 10
    ef_construction: int = 100
    seed: int = 100
    shard_rows: int = SHARD
    probes: int | None = None

    @classmethod
    def build(cls, base: DataFrame, space: str | Space = "l2", M: int = 16, ef_construction: int = 100, ef: int = 10, seed: int = 100, shard_rows: int = SHARD, dim: int | None = None, probes: int | None = None) -> GraphIndex:
        """Graphs of shards of about ``shard_rows`` rows, written to the shared folder at once.

        Rows go to the cell of their nearest centre (at most ``CELLS``, fitted on a
        bounded sample) and, where a cell has more rows than a shard, to one of its
        parts by a hash of the key. A column ``deleted`` of ``base`` is kept.
        """
        s = Space.parse(space)
        dim = checked_dim(base, dim)
        n = base.count()
        cells = min(CELLS, max(1, math.ceil(n / shard_rows)))
        centres = np.zeros((1, dim))
        if cells > 1:
            taken = base.select("embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
            centres = fit_centres(s.prepare(matrix(taken["embedding"], dim)), cells)
        M = min(M, 10_000)
        index = cls(base, s, dim, centres, M, ef, max(ef_construction, M), seed, shard_rows, probes)
        base = base if "deleted" in base.columns else base.withColumn("deleted", F.lit(False))
        placed = index._placed(base)
        if len(centres) > 1 or n > shard_rows:
            sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
            parts = F.element_at(F.lit([max(1, math.ceil(sizes.get(c, 0) / shard_rows)) for c in range(len(centres))]), F.col("cell") + 1)
        else:
            parts = F.lit(1)
        rows = placed.withColumn("part", F.pmod(F.xxhash64("vec_id"), parts).cast("int")).withColumn("level", level_of("vec_id", M, seed))
        return replace(index, rows=index._stored(index._built(rows)))

    def _built(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with cell, part and level) with the links of each shard's graph."""
        s, dim, M, ef = self.space, self.dim, self.M, self.ef_construction

        def build(group: pa.Table) -> pa.Table:
            group = group.sort_by("vec_id")
            ids = group["vec_id"].to_numpy().astype(np.int64)
            links = build_shard(s, s.prepare(matrix(group["embedding"], dim)), group["level"].to_numpy(), M, ef)
            flat, widths = _flat(links, ids, np.arange(len(ids)))
            return group.append_column("links", flat).append_column("widths", widths)

        return _by_shard(rows, len(self.centres)).groupBy("cell", "part").applyInArrow(build, _ddl(rows) + ", links array<bigint>, widths array<int>")

    def _placed(self, base: DataFrame) -> DataFrame:
        """``base`` with the cell of each row's nearest centre."""
        s, dim, centres = self.space, self.dim, self.centres
        if len(centres) == 1:
            return base.withColumn("cell", F.lit(0))
        names = base.columns

        def place(batches):
            for b in batches:
                cell = _nearest(s.prepare(matrix(b.column("embedding"), dim)), centres)[:, 0] if b.num_rows else np.empty(0, int)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], [*names, "cell"])

        return base.mapInArrow(place, _ddl(base) + ", cell int")

    def _stored(self, rows: DataFrame) -> DataFrame:
        """``rows`` written by cell to the shared folder and read again, so that no search makes them anew."""
        spark, path = rows.sparkSession, shared_folder(rows.sparkSession, "graph")
        rows.write.partitionBy("cell").parquet(path)
        return spark.read.schema(rows.schema).parquet(path).select(rows.columns)

    # --- changing ---------------------------------------------------------

    def apply(self, changes: DataFrame) -> GraphIndex:
        """The graph after ``changes``: rows with ``op`` 'upsert' (all columns of the base) or 'remove' (``vec_id``), each key once.

        Only shards that a change falls into are read and written. A new version
        that is nearest to another centre moves to that cell. A cell whose shards
        would hold twice ``shard_rows`` on average is dealt to more of them, which are built anew.
        """
        s, dim, M, ef = self.space, self.dim, self.M, self.ef_construction
        kept = [f.name for f in self.rows.schema if f.name not in ("links", "widths")]
        known = self.rows.select("vec_id", F.col("cell").alias("_cell"), F.col("part").alias("_part"))
        for f in self.rows.schema:  # removals alone need no more than keys
            if f.name not in OWN and f.name not in changes.columns:
                changes = changes.withColumn(f.name, F.lit(None).cast(f.dataType))
        new = changes.where("op = 'upsert'")
        if "deleted" not in new.columns:
            new = new.withColumn("deleted", F.lit(False))
        shards = {r["cell"]: r["parts"] for r in self.rows.groupBy("cell").agg((F.max("part") + 1).alias("parts")).collect()}
        parts = F.element_at(F.lit([shards.get(c, 1) for c in range(len(self.centres))]), F.col("cell") + 1)
        new = self._placed(new.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.rows.schema if f.name not in OWN or f.name == "deleted")))
        new = new.withColumn("part", F.pmod(F.xxhash64("vec_id"), parts).cast("int"))
        new = new.withColumn("level", level_of("vec_id", M, self.seed)).select(*kept).withColumn("op", F.lit("upsert"))
        # what is stored under a changed key goes out of its shard, or is updated there
        old = known.join(changes.select("vec_id").distinct(), "vec_id", "left_semi")
        moved = old.join(new.select("vec_id", "cell", "part"), "vec_id", "left").where("cell is null or cell <> _cell or part <> _part")
        gone = moved.select(F.col("vec_id"), F.col("_cell").alias("cell"), F.col("_part").alias("part"))
        out = [F.col(c) if c in gone.columns else F.lit("remove").alias(c) if c == "op" else F.lit(None).cast(new.schema[c].dataType).alias(c) for c in new.columns]
        delta = materialized(new.unionByName(gone.select(*out)))
        # cells that outgrow their shards: one count a cell comes to the driver
        changed = delta.select("vec_id").distinct()
        after = known.join(changed, "vec_id", "left_anti").select(F.col("_cell").alias("cell")).unionByName(delta.where("op = 'upsert'").select("cell"))
        grown = {r["cell"]: math.ceil(r["count"] / self.shard_rows) for r in after.groupBy("cell").count().collect() if r["count"] > 2 * self.shard_rows * shards.get(r["cell"], 1)}
        rows, built = self.rows, None
        if grown:
            names = [c for c in kept if c != "part"]
            of = F.col("cell").isin(list(grown))
            whole = rows.where(of).join(changed, "vec_id", "left_anti").select(names).unionByName(delta.where(of & (F.col("op") == "upsert")).select(names))
            n = F.element_at(F.create_map(*(F.lit(x) for pair in grown.items() for x in pair)), F.col("cell"))
            whole = whole.withColumn("part", F.pmod(F.xxhash64("vec_id"), n).cast("int"))
            built = self._stored(self._built(whole).select([f.name for f in self.rows.schema]))
            rows, delta = rows.where(~of), delta.where(~of)
        touched = F.broadcast(materialized(delta.select("cell", "part").distinct()))  # no more rows than there are shards
        schema = _ddl(self.rows)
        order = [f.name for f in self.rows.schema]

        def change(old: pa.Table, new: pa.Table) -> pa.Table:
            if not new.num_rows:
                return old.select(order)
            added = new.filter(pc.equal(new["op"], "upsert")).sort_by("vec_id").select(kept)
            old = old.sort_by("vec_id")
            before, upserts = old["vec_id"].to_numpy().astype(np.int64), added["vec_id"].to_numpy().astype(np.int64)
            ids = np.union1d(before, upserts)
            x = np.zeros((len(ids), dim))
            was, now = np.searchsorted(ids, before), np.searchsorted(ids, upserts)
            x[was] = s.prepare(matrix(old["embedding"], dim)) if len(was) else x[was]
            links: list[list[list[int]]] = [[] for _ in ids]
            for i, out, widths in zip(was.tolist(), old["links"].to_pylist(), old["widths"].to_pylist(), strict=True):
                cut = np.cumsum([0, *widths])
                out = np.searchsorted(ids, np.array(out, np.int64))
                links[i] = [out[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            x[now] = s.prepare(matrix(added["embedding"], dim)) if len(now) else x[now]
            net = Net(s, ids, x, links, M, ef)
            lost = set(np.searchsorted(ids, np.intersect1d(before, new["vec_id"].to_numpy())).tolist())
            net.take_out(lost)
            for i, level in zip(now.tolist(), added["level"].to_pylist(), strict=True):
                net.insert(i, level)
            links = net.connected()
            stay = np.array([i for i in was.tolist() if i not in lost], np.int64)
            rows = pa.concat_tables([old.select(kept).take(pa.array(np.searchsorted(before, ids[stay]))).cast(added.schema), added])
            flat, widths = _flat(links, ids, np.concatenate([stay, now]).astype(np.int64))
            return rows.append_column("links", flat).append_column("widths", widths).select(order)

        mine = rows.join(touched, ["cell", "part"], "left_semi").select(order)
        cells = len(self.centres)
        changed = _by_shard(mine, cells).groupBy("cell", "part").cogroup(_by_shard(delta, cells).groupBy("cell", "part")).applyInArrow(change, schema)
        out = rows.join(touched, ["cell", "part"], "left_anti").select(order).unionByName(self._stored(changed))
        return replace(self, rows=out if built is None else out.unionByName(built))

    def mark(self, keys: DataFrame, deleted: bool = True) -> GraphIndex:
        """Rows of ``keys`` marked as deleted, or restored; links stay."""
        marked = keys.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(deleted).alias("_to")).distinct()
        marked = materialized(marked)
        rows = self.rows.join(marked, "vec_id", "left").withColumn("deleted", F.coalesce("_to", "deleted")).select(self.rows.columns)
        return replace(self, rows=rows)

    # --- storing ----------------------------------------------------------

    def save(self, path: str) -> None:
        """Rows by cell, then parameters and the row count as one JSON line, then centres."""
        spark = self.rows.sparkSession
        self.rows.write.partitionBy("cell").parquet(f"{path}/rows")
        meta = {"format": FORMAT, "rows": spark.read.parquet(f"{path}/rows").count(), "columns": self.rows.schema.json(), "space": self.space.name} | {k: getattr(self, k) for k in ("dim", "M", "ef", "ef_construction", "seed", "shard_rows", "probes")}
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/parameters")

    @classmethod
    def load(cls, spark, path: str, space: str | Space | None = None, dim: int | None = None, **options) -> GraphIndex:
        """A saved graph with its parameters, or others given; ``GraphError`` if it isn't whole or has another space, dimension or format.

        A space of one's own has to be given again.
        """
        try:
            meta = json.loads(spark.read.text(f"{path}/parameters").first()["value"])
            centres = np.array([r["centre"] for r in sorted(spark.read.parquet(f"{path}/centres").collect())])
            rows = spark.read.schema(StructType.fromJson(json.loads(meta.pop("columns")))).parquet(f"{path}/rows")
        except Exception as e:
            raise GraphError(f"no graph can be opened at {path}") from e
        n, names = meta.pop("rows"), {"vec_id", "embedding", *OWN}
        if meta.pop("format") != FORMAT or not names <= {*rows.columns} or rows.count() != n:
            raise GraphError(f"the graph at {path} isn't whole, or of another format")
        named = meta.pop("space")
        asked = named if space is None else space.name if isinstance(space, Space) else space
        if asked != named or dim not in (None, meta["dim"]) or centres.shape[1:] != (meta["dim"],):
            raise GraphError(f"the graph at {path} is of space {named!r} and {meta['dim']} dimensions")
        if not isinstance(space, Space) and named not in SPACES:
            raise GraphError(f"the space {named!r} has to be given")
        return cls(rows, Space.parse(space or named), meta.pop("dim"), centres, **(meta | options))

    # --- searching --------------------------------------------------------

    def _probed(self, q: np.ndarray, probes: int | None) -> np.ndarray:
        """(query, cell): whether a query looks into a cell."""
        cells = len(self.centres)
        n = probes or self.probes or (cells if cells <= ALL_CELLS else max(ALL_CELLS, cells // SOME_CELLS))
        out = np.zeros((len(q), cells), bool)
        if len(q):
            np.put_along_axis(out, _nearest(q, self.centres, min(n, cells)), True, 1)
        return out

    def share_read(self, queries: DataFrame, probes: int | None = None) -> float:
        """The share of all rows in the cells that a query looks into, on average."""
        _, q = collected(queries, self.dim, self.space)
        sizes = {r["cell"]: r["count"] for r in self.rows.groupBy("cell").count().collect()}
        each = np.array([sizes.get(c, 0) for c in range(len(self.centres))])
        return float((self._probed(q, probes) @ each).mean() / max(1, each.sum())) if len(q) else 0.0

    def _search(self, queries: DataFrame, where: Column | str | None, walks: Callable[[Searcher, np.ndarray, pa.Table], Found], more: str | None = None, probes: int | None = None) -> DataFrame:
        dim, n = checked(queries, self.dim)
        return _query_blocks(queries, n, dim, lambda q: self._search_block(q, where, walks, more, probes))

    def _search_block(self, queries: DataFrame, where: Column | str | None, walks: Callable[[Searcher, np.ndarray, pa.Table], Found], more: str | None, probes: int | None) -> DataFrame:
        s, dim = self.space, self.dim
        ids, vectors = collected(queries, dim, s)
        into = self._probed(vectors, probes)
        shared = self.rows.sparkSession.sparkContext.broadcast((ids, vectors, into))
        allowed = F.lit(True) if where is None else F.expr(where) if isinstance(where, str) else where
        allowed = F.coalesce(allowed, F.lit(False)) & ~F.col("deleted")
        used = np.flatnonzero(into.any(0)).tolist()
        rows = self.rows if len(used) == len(self.centres) else self.rows.where(F.col("cell").isin(used))
        rows = rows.select("cell", "part", F.col("vec_id").cast("long").alias("vec_id"), "embedding", "links", "widths", allowed.alias("allowed"), *([more] if more else []))

        def run(group: pa.Table) -> pa.Table:
            group = group.sort_by("vec_id").combine_chunks()
            qid, q, into = shared.value
            mine = np.flatnonzero(into[:, group["cell"][0].as_py()])
            can = group["allowed"].to_numpy()
            column = lambda name: group[name].chunk(0)
            shard = Searcher(s, group["vec_id"].to_numpy(), s.prepare(matrix(group["embedding"], dim)), column("links"), column("widths"), None if can.all() else can)
            found = walks(shard, q[mine], group)
            arrays = [pa.array(qid[mine[found.query]]), pa.array(shard.ids[found.node]), pa.array(found.dist), pa.array(found.hops[found.query]), pa.array(found.taken[found.query])]
            if more:
                arrays.append(group[more].take(pa.array(found.node)).combine_chunks())
            return pa.table(arrays, ["query_id", "vec_id", "dist", "hops", "distances", *([more] if more else [])])

        kind = f", `{more}` {self.rows.schema[more].dataType.simpleString()}" if more else ""
        return _by_shard(rows, len(self.centres)).groupBy("cell", "part").applyInArrow(run, FOUND + kind)

    def knn(self, queries: DataFrame, k: int = 1, ef: int | None = None, where: Column | str | None = None, on_short: str = "exact", probes: int | None = None) -> DataFrame:
        """(query_id, vec_id, dist, hops, distances, rank): each shard's beam of width max(ef, k), merged.

        Deleted rows and rows that ``where`` refuses are walked through. Queries that
        find fewer than ``k`` are answered by exact search with ``on_short='exact'``
        (their counters are null), raise ``ShortResult`` with 'error' and keep what
        they found with 'partial'.
        """
        if on_short not in ("exact", "error", "partial"):
            raise ValueError("on_short is 'exact', 'error' or 'partial'")
        ef = ef or self.ef
        found = ranked(self._search(queries, where, lambda shard, q, _: shard.beams(q, max(ef, k), k), probes=probes), k)
        if on_short == "partial":
            return found
        found = _written(found, "found")  # few rows, used up to three times
        full = found.groupBy("query_id").count().where(F.col("count") == k).select("query_id")
        missing = queries.join(full, "query_id", "left_anti")
        n = missing.count()
        if not n:
            return found
        if on_short == "error":
            raise ShortResult(f"{n} queries have fewer than {k} neighbours")
        base = self.rows.where("not deleted")
        if where is not None:
            base = base.where(where)
        exact = knn(base.select("vec_id", "embedding"), missing, k, self.space, None, "blocked", dim=self.dim).select("query_id", "vec_id", "dist", F.lit(None).cast("bigint").alias("hops"), F.lit(None).cast("bigint").alias("distances"), "rank")
        return found.join(full, "query_id", "left_semi").select(exact.columns).unionByName(exact)

    def search_until(self, queries: DataFrame, stop: Callable[[], Stop], where: Column | str | None = None, probes: int | None = None) -> DataFrame:
        """(query_id, vec_id, dist, hops, distances, rank): what each shard's walk finds until a condition of one's own ends it."""

        def walked(shard: Searcher, q: np.ndarray) -> list:
            condition = stop()
            return shard.walk(q, condition.ends, condition.trim)

        def walks(shard: Searcher, q: np.ndarray, _: pa.Table) -> Found:
            if not stop().endless:
                return shard.each(q, lambda one: walked(shard, one))
            parts = []
            for mine, rows, hops, taken in shard.endless(q):
                i, d, node = [], [], []
                for n, at in enumerate(mine.tolist()):
                    dist = shard.space.rows(q[at][None, :], shard.x[rows])
                    order = np.lexsort((rows, dist))
                    trim, found = stop().trim, []
                    for e, x in zip(dist[order].tolist(), rows[order].tolist(), strict=True):
                        heapq.heappush(found, (-e, -x))
                        trim(found)
                    i += [n] * len(found)
                    d += [-a for a, _ in found]
                    node += [-b for _, b in found]
                parts.append((mine, np.array(i, np.int64), np.array(node, np.int64), np.array(d, np.float64), hops, taken))
            return Found.joined(parts, len(q))

        found = self._search(queries, where, walks, probes=probes)
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "vec_id")))

    def radius(self, queries: DataFrame, eps: float, min_candidates: int = 100, max_results: int | None = None, where: Column | str | None = None, probes: int | None = None) -> DataFrame:
        """Rows that each shard's walk finds within ``eps``; it goes on until it has ``min_candidates``."""
        found = self._search(queries, where, lambda shard, q, _: shard.within(q, eps, min_candidates, max_results), probes=probes)
        if max_results is not None:
            return ranked(found, max_results)
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "vec_id")))

    def top_docs(self, queries: DataFrame, num_docs: int, doc: str = "doc_id", ef_collection: int = 10, where: Column | str | None = None, probes: int | None = None) -> DataFrame:
        """Vectors of the nearest ``num_docs`` documents, cut as in exact search; a shard goes on until it has more than max(ef_collection, num_docs)."""
        n = max(ef_collection, num_docs)

        def walks(shard: Searcher, q: np.ndarray, group: pa.Table) -> Found:
            coded = group[doc].combine_chunks().dictionary_encode(null_encoding="encode")
            coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
            return shard.documents(q, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), n, num_docs)

        found = self._search(queries, where, walks, doc, probes)
        low = found.groupBy("query_id", doc).agg(F.min("dist").alias("low"))
        nth = low.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("low"))).where(F.col("n") == num_docs + 1)
        kept = found.join(nth.select("query_id", F.col("low").alias("cutoff")), "query_id", "left").where(F.col("cutoff").isNull() | (F.col("dist") < F.col("cutoff")))
        order = Window.partitionBy("query_id").orderBy("dist", "vec_id")
        return kept.select("query_id", "vec_id", doc, "dist").withColumn("rank", F.row_number().over(order))

    def integrity(self) -> DataFrame:
        """One row a layer: nodes, links, faulty links of each kind, nodes without inbound link, and inbound counts."""
        layers = self.rows.select("cell", "part", F.col("vec_id").alias("node"), F.posexplode(layered()).alias("layer", "out"))
        nodes = layers.select("cell", "part", "layer", "node")
        links = layers.select("cell", "part", "layer", "node", F.explode("out").alias("to"))
        known = links.join(nodes.withColumnRenamed("node", "to").withColumn("known", F.lit(1)), ["cell", "part", "layer", "to"], "left")
        per_link = known.groupBy("layer").agg(F.count("*").alias("links"), F.count(F.when(F.col("node") == F.col("to"), 1)).alias("self_links"), F.count(F.when(F.col("known").isNull(), 1)).alias("unknown_links"), (F.count("*") - F.countDistinct("cell", "part", "node", "to")).alias("repeated_links"))
        inbound = nodes.join(links.groupBy("cell", "part", "layer", F.col("to").alias("node")).agg(F.count("*").alias("n")), ["cell", "part", "layer", "node"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
        sizes = nodes.groupBy("cell", "part", "layer").agg(F.count("*").alias("size"))
        lone = inbound.join(sizes, ["cell", "part", "layer"]).groupBy("layer").agg(F.count("*").alias("nodes"), F.count(F.when((F.col("n") == 0) & (F.col("size") > 1), 1)).alias("unlinked"), F.min("n").alias("min_inbound"), F.max("n").alias("max_inbound"))
        return lone.join(per_link, "layer", "left").na.fill(0)
