"""Shortest paths on directed edge lists, over arrays.

Costs are corrected in rounds: all arcs that leave nodes whose cost has just fallen are followed at once.
Costs are not negative, so the rounds end, and the costs are those of any label-setting search.
"""

from __future__ import annotations

import math

import numpy as np

from .model import GeometryError


class Graph:
    """Arcs by node; a negative cost closes a direction, and without ``back`` there is one direction only."""

    def __init__(self, ids, source, target, cost, back=None):
        ids, source, target = (np.asarray(v, np.int64) for v in (ids, source, target))
        cost = np.asarray(cost, float)
        back = None if back is None else np.asarray([math.nan if v is None else v for v in back] if isinstance(back, (list, tuple)) else back, float)
        if not np.isfinite(cost).all() or (back is not None and np.isinf(back).any()):
            raise GeometryError("edge costs must be finite")
        self.nodes, ends = np.unique(np.concatenate([source, target]), return_inverse=True)
        s, t = ends[: len(source)], ends[len(source) :]
        out = cost >= 0
        tail, head, eid, c = s[out], t[out], ids[out], cost[out]
        if back is not None:
            way = back >= 0  # not a number: closed
            tail, head, eid, c = np.concatenate([tail, t[way]]), np.concatenate([head, s[way]]), np.concatenate([eid, ids[way]]), np.concatenate([c, back[way]])
        order = np.argsort(tail, kind="stable")
        self.tail, self.head, self.eid, self.cost = tail[order], head[order], eid[order], c[order]
        self.first = np.searchsorted(self.tail, np.arange(len(self.nodes) + 1))

    def number(self, node) -> int | None:
        k = int(np.searchsorted(self.nodes, node))
        return k if k < len(self.nodes) and self.nodes[k] == node else None

    def search(self, start: int, stop: int | None = None, limit: float = math.inf) -> tuple[np.ndarray, np.ndarray]:
        """Costs (infinite: not reached) and the arc that each node was reached by (-1: none)."""
        dist = np.full(len(self.nodes), math.inf)
        came = np.full(len(self.nodes), -1)
        dist[start] = 0.0
        front = np.array([start])
        while len(front):
            n = self.first[front + 1] - self.first[front]
            upto = np.cumsum(n)
            if not upto[-1]:
                break
            arc = np.repeat(self.first[front] - (upto - n), n) + np.arange(upto[-1])
            new = dist[self.tail[arc]] + self.cost[arc]
            most = limit if stop is None else min(limit, dist[stop])
            better = (new < dist[self.head[arc]]) & (new <= most)
            arc, new = arc[better], new[better]
            if not len(arc):
                break
            head = self.head[arc]
            np.minimum.at(dist, head, new)
            won = new == dist[head]
            came[head[won][::-1]] = arc[won][::-1]  # of equals the first arc
            front = np.unique(head)
        return dist, came

    def chain(self, came: np.ndarray, start: int, end: int) -> list[int]:
        """Arcs from the start to the end."""
        out = []
        while end != start:
            out.append(int(came[end]))
            end = int(self.tail[came[end]])
        return out[::-1]

    def steps(self, dist, came, start: int, end: int) -> list[tuple] | None:
        """Rows (seq, node, edge, cost, agg_cost); edge -1 and cost 0 on arrival."""
        if not math.isfinite(dist[end]):
            return None
        rows, total = [], 0.0
        for k, arc in enumerate(self.chain(came, start, end), 1):
            cost = float(self.cost[arc])
            rows.append((k, int(self.nodes[self.tail[arc]]), int(self.eid[arc]), cost, total))
            total += cost
        return [*rows, (len(rows) + 1, int(self.nodes[end]), -1, 0.0, total)]


def graph(edges) -> Graph:
    """The graph of rows (id, source, target, cost[, cost back])."""
    rows = edges if isinstance(edges, list) else list(edges)
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return Graph(*columns)


def shortest_path(edges, start, end) -> list[tuple] | None:
    return shortest_path_many(edges, [(start, end)])[0]


def shortest_path_many(edges, requests: list[tuple]) -> list[list[tuple] | None]:
    """Paths for (start, end) pairs on one graph (a Graph or rows): it is built once, and each start searched once."""
    g = edges if isinstance(edges, Graph) else graph(edges)
    by: dict = {}
    for k, (a, b) in enumerate(requests):
        u, v = g.number(a), g.number(b)
        if a != b and u is not None and v is not None:
            by.setdefault(u, []).append((k, v))
    out: list = [None] * len(requests)
    for u, wanted in by.items():
        dist, came = g.search(u, wanted[0][1] if len(wanted) == 1 else None)
        for k, v in wanted:
            out[k] = g.steps(dist, came, u, v)
    return out


def path_cost(edges, start, end) -> float | None:
    path = shortest_path(edges, start, end)
    return None if path is None else path[-1][4]


def driving_distance(edges, start, limit: float) -> list[tuple] | None:
    """Rows (seq, depth, start, pred, node, edge, cost, agg_cost) of the nodes within the limit."""
    if limit != limit or limit < 0:
        return None
    g = edges if isinstance(edges, Graph) else graph(edges)
    if not len(g.nodes):
        return None
    u = g.number(start)
    if u is None:
        return [(1, 0, start, start, start, -1, 0.0, 0.0)]
    dist, came = g.search(u, limit=limit)
    reached = np.flatnonzero(np.isfinite(dist))
    depth = {u: 0}

    def deep(n: int) -> int:
        chain = []
        while n not in depth:
            chain.append(n)
            n = int(g.tail[came[n]])
        for m in reversed(chain):
            depth[m] = depth[int(g.tail[came[m]])] + 1
        return depth[chain[0]] if chain else depth[n]

    rows = []
    for n in reached[np.lexsort((reached, dist[reached]))].tolist():
        arc = int(came[n])
        pred, eid, cost = (start, -1, 0.0) if n == u else (int(g.nodes[g.tail[arc]]), int(g.eid[arc]), float(g.cost[arc]))
        rows.append((len(rows) + 1, deep(n), start, pred, int(g.nodes[n]), eid, cost, float(dist[n])))
    return rows
