"""Cover trees over vectors, for the largest inner products: vectors of any norms become points of one norm, so that what lies near
a query is what has a large product with it."""

from __future__ import annotations

import heapq

import numpy as np

#: Points up to which a node keeps all of its own.
LEAF = 16


class Tree:
    """Nodes cover balls of points: a node's points lie within its radius of its centre, its children's centres lie more than half that radius
    apart. Arrays by node: centre (a point), radius, child and own (where its children and its own points begin; they end where the next node's
    begin), uniform (whether all points below have one label). Points are ordered by the node that owns them."""

    FIELDS = ("x", "ids", "rows", "labels", "centre", "radius", "child", "own", "uniform")

    def __init__(self, **arrays):
        for f in self.FIELDS:
            setattr(self, f, arrays[f])


def augmented(x: np.ndarray) -> np.ndarray:
    """The points with one more coordinate that gives all of them the largest norm; a query's is 0, so products stay."""
    w = x.astype(np.float64)
    n = (w * w).sum(axis=1)
    return np.column_stack((w, np.sqrt(np.maximum(n.max(initial=0.0) - n, 0.0))))


def net(w: np.ndarray, members: np.ndarray, reach: float) -> list[np.ndarray]:
    """The members dealt to centres more than reach apart, each to one within reach; a centre is the first of its list, the
    first member is the first centre."""
    out = []
    while len(members):
        c = members[0]
        near = np.sqrt(((w[members] - w[c]) ** 2).sum(axis=1)) <= reach
        near[0] = True
        out.append(members[near])
        members = members[~near]
    return out


def build(x: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> Tree:
    """Level by level: what a node covers is dealt to a net of half its radius, until LEAF points or a single place are left. Points that
    would be a node of their own stay with their parent."""
    w = augmented(x)
    todo = [np.arange(len(x))]
    centre, radius, child, own, uniform, order, placed = [], [], [1], [0], [], [], 0
    for members in todo:  # grows while it is read: breadth first, so that children lie side by side
        c = members[0]
        # a little more than measured, for what floating point leaves out
        r = float(np.sqrt(((w[members] - w[c]) ** 2).sum(axis=1)).max()) * (1 + 1e-9) + 1e-9
        centre.append(c)
        radius.append(r)
        uniform.append(bool((labels[members] == labels[c]).all()))
        if len(members) <= LEAF or r < 1e-6:
            parts, mine = [], members
        else:
            dealt = net(w, members, r / 2)
            parts, mine = [p for p in dealt if len(p) > 1], np.concatenate([np.zeros(0, np.int64), *(p for p in dealt if len(p) == 1)])
        todo += parts
        order.append(mine)
        placed += len(mine)
        child.append(len(todo))
        own.append(placed)
    order = np.concatenate(order)
    where = np.empty(len(x), np.int64)
    where[order] = np.arange(len(x))
    return Tree(x=x[order], ids=ids[order], rows=rows[order], labels=labels[order], centre=where[np.array(centre)], radius=np.array(radius), child=np.array(child), own=np.array(own), uniform=np.array(uniform))


def descend(tree: Tree, q: np.ndarray, norm: float, wanted) -> int:
    """Offer wanted every point that it may want, the node of the highest bound first; returns how many points were met.

    wanted.may(least, most, label) says of nodes (as arrays) whether points of products in that range, of one label where it isn't None, may
    be wanted; wanted.take(scores, tree, from, to) is given points with their exact products."""
    at = int(tree.centre[0])
    first = float(q @ tree.x[at])
    heap, met = [(-(first + norm * tree.radius[0]), 0, first)], 0
    while heap:
        _, node, s = heapq.heappop(heap)
        reach = norm * tree.radius[node]
        label = tree.labels[tree.centre[node]] if tree.uniform[node] else None
        if not wanted.may(s - reach, s + reach, label):
            continue
        lo, hi = tree.own[node], tree.own[node + 1]
        if hi > lo:
            met += int(hi - lo)
            wanted.take(tree.x[lo:hi] @ q, tree, lo, hi)
        lo, hi = int(tree.child[node]), int(tree.child[node + 1])
        if hi > lo:
            products = tree.x[tree.centre[lo:hi]] @ q
            bounds = products + norm * tree.radius[lo:hi]
            for k in range(hi - lo):
                heapq.heappush(heap, (-float(bounds[k]), lo + k, float(products[k])))
    return met


class Best:
    """The k best of what is offered: scores fall, ids rise among equals (rows among equal ids)."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.rows = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> float:
        """What a score must reach to matter; equal ones may, by their ids."""
        return self.scores[-1] if len(self.scores) == self.k else -np.inf

    def add(self, scores, ids, rows) -> None:
        s, i, r = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.rows, rows)))
        order = np.lexsort((r, i, -s))[: self.k]
        self.scores, self.ids, self.rows = s[order], i[order], r[order]


class Positives:
    """The k best other rows of a row's own label."""

    def __init__(self, row: int, label: int, k: int):
        self.row, self.label, self.best = row, label, Best(k)

    def may(self, least, most, label) -> bool:
        return (label is None or label == self.label) and most >= self.best.least

    def take(self, scores, tree, lo, hi) -> None:
        own = np.flatnonzero((tree.labels[lo:hi] == self.label) & (tree.rows[lo:hi] != self.row) & (scores >= self.best.least))
        if len(own):
            self.best.add(scores[own].astype(np.int64), tree.ids[lo:hi][own], tree.rows[lo:hi][own])


class Negatives:
    """For each window [low, high] of scores the k best rows of other labels in it."""

    def __init__(self, label: int, windows: list[tuple[int, int]], k: int):
        self.label, self.windows, self.best = label, windows, [Best(k) for _ in windows]

    def may(self, least, most, label) -> bool:
        if label is not None and label == self.label:
            return False
        return any(most >= max(lo, b.least) and least <= hi for (lo, hi), b in zip(self.windows, self.best, strict=True))

    def take(self, scores, tree, lo, hi) -> None:
        other = tree.labels[lo:hi] != self.label
        for (low, high), b in zip(self.windows, self.best, strict=True):
            own = np.flatnonzero(other & (scores >= max(low, b.least)) & (scores <= high))
            if len(own):
                b.add(scores[own].astype(np.int64), tree.ids[lo:hi][own], tree.rows[lo:hi][own])
