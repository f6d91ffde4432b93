"""Nearest-neighbour mutual information of two continuous samples (helper inside tasks)."""

from __future__ import annotations

import numpy as np


def _digamma(n: np.ndarray) -> np.ndarray:
    """Of whole numbers from 1: harmonic sums below 64, the asymptotic series from there."""
    n = np.asarray(n).astype(int)
    harmonic = np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, 64))])
    z = np.maximum(n, 64).astype(float)
    w = 1 / (z * z)
    series = np.log(z) - 0.5 / z - w * (1 / 12 - w * (1 / 120 - w / 252))
    return np.where(n < 64, harmonic[np.minimum(n, 64) - 1] - 0.57721566490153286, series)


#: Points of a rectangle whose distances are all taken, at most.
LEAF = 32


def nearest(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Max-norm distances to the k nearest neighbours (inf where there are fewer), ascending.

    Points are compared with those of their own small rectangle, then of the rectangles within the distance found,
    so the work for a point does not grow with their number.
    """
    if len(x) <= LEAF:
        return _outwards(x, y, k)
    held = _Held(x, y, k)
    leaves, width = held.at.shape
    best = np.empty((leaves, width, k))
    for i in _pieces(leaves, 65_536 // width**2 + 1):
        d = np.maximum(np.abs(held.px[i, :, None] - held.x[i, None]), np.abs(held.py[i, :, None] - held.y[i, None]))
        d[:, np.arange(width), np.arange(width)] = np.inf
        best[i] = _least(d, k)
    reach = np.where(held.real, best[..., -1], -np.inf)
    # rectangles near that of a point first, then near the point
    own, other = held.near(held.px.min(1), held.px.max(1), held.py.min(1), held.py.max(1), reach.max(1))
    own, other = own[own != other], other[own != other]
    left, right, low, high = held.boxes[0]
    found = []
    for i in _pieces(len(own), 65_536 // width + 1):
        a, b = own[i], other[i, None]
        gap = np.maximum(np.maximum(left[b] - held.px[a], held.px[a] - right[b]), np.maximum(low[b] - held.py[a], held.py[a] - high[b]))
        pair, place = np.nonzero(gap < reach[a])
        found.append((a[pair] * width + place, other[i][pair]))
    q, leaf = (np.concatenate(c) for c in zip(*found)) if found else (own, other)
    best = held.nearer(best.reshape(-1, k), held.px.ravel(), held.py.ravel(), q, leaf)
    out = np.empty((len(x), k))
    out[held.at[held.real]] = best[held.real.ravel()]
    return out


def _pieces(n: int, size: int) -> list[slice]:
    return [slice(i, i + size) for i in range(0, n, size)]


def _least(d: np.ndarray, k: int) -> np.ndarray:
    return np.sort(np.partition(d, k - 1, axis=-1)[..., :k], axis=-1)


class _Held:
    """Points halved into small rectangles of as many each, a row of coordinates for each rectangle."""

    def __init__(self, x: np.ndarray, y: np.ndarray, k: int):
        n = len(x)
        levels = max(0, int(np.ceil(np.log2(n / LEAF))))
        width = -(-n // 2**levels)
        spare = width * 2**levels - n  # so many points stand in two places
        at, real = np.append(np.arange(n), np.linspace(0, n - 1, spare).astype(int))[None], (np.arange(n + spare) < n)[None]
        for _ in range(levels):
            px, py = x[at], y[at]
            v = np.where((np.ptp(px, axis=1) >= np.ptp(py, axis=1))[:, None], px, py)
            half = v.shape[1] // 2
            order = np.argpartition(v, half, axis=1)
            at, real = (np.take_along_axis(c, order, 1).reshape(-1, half) for c in (at, real))
        self.at, self.real, self.px, self.py = at, real, x[at], y[at]
        self.x, self.y = np.full((2, len(at), max(width, k)), np.inf)  # second places are far from all
        self.x[:, :width], self.y[:, :width] = np.where(real, self.px, np.inf), np.where(real, self.py, np.inf)
        self.boxes = [(self.px.min(1), self.px.max(1), self.py.min(1), self.py.max(1))]
        for _ in range(levels):
            two = [c.reshape(-1, 2) for c in self.boxes[-1]]
            self.boxes.append((two[0].min(1), two[1].max(1), two[2].min(1), two[3].max(1)))

    def near(self, x0, x1, y0, y1, reach) -> tuple[np.ndarray, np.ndarray]:
        """(query, rectangle) of points nearer than ``reach`` to the box of a query."""
        q, node = np.arange(len(x0)), np.zeros(len(x0), int)
        for level, (left, right, low, high) in enumerate(reversed(self.boxes)):
            if level:
                q, node = np.repeat(q, 2), (2 * node[:, None] + [0, 1]).ravel()
            r = reach[q]
            ok = (left[node] - x1[q] < r) & (x0[q] - right[node] < r) & (low[node] - y1[q] < r) & (y0[q] - high[node] < r)
            q, node = q[ok], node[ok]
        return q, node

    def nearer(self, best: np.ndarray, x, y, q, leaf) -> np.ndarray:
        """``best`` with the points of rectangle ``leaf`` for each query ``q``, which may come more than once."""
        k = best.shape[1]
        order = np.argsort(q, kind="stable")
        q, leaf = q[order], leaf[order]
        turn = np.arange(len(q)) - np.searchsorted(q, q)
        for i in range(turn.max(initial=-1) + 1):
            now = np.flatnonzero(turn == i)
            for part in _pieces(len(now), 65_536 // self.x.shape[1] + 1):
                at, to = q[now[part]], leaf[now[part]]
                d = np.maximum(np.abs(self.x[to] - x[at, None]), np.abs(self.y[to] - y[at, None]))
                best[at] = np.sort(np.concatenate([best[at], np.partition(d, k - 1, axis=1)[:, :k]], axis=1), axis=1)[:, :k]
        return best


def _outwards(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """As :func:`nearest`, searching outwards in the order of x."""
    order = np.argsort(x, kind="stable")
    xs, ys = x[order], y[order]
    n = len(x)
    best = np.full((n, k), np.inf)
    live = np.arange(n)
    step = 1
    while len(live) and step < n:
        gap = np.full((2, len(live)), np.inf)
        for s, sign in enumerate((1, -1)):
            j = live + sign * step
            ok = (j >= 0) & (j < n)
            i, j = live[ok], j[ok]
            dx = np.abs(xs[j] - xs[i])
            gap[s, ok] = dx
            d = np.maximum(dx, np.abs(ys[j] - ys[i]))
            worst = best[i].argmax(1)
            nearer = d < best[i, worst]
            best[i[nearer], worst[nearer]] = d[nearer]
        live = live[gap.min(0) < best[live].max(1)]
        step += 1
    out = np.empty((n, k))
    out[order] = np.sort(best, 1)
    return out


def _within(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    s = np.sort(x)
    return np.searchsorted(s, x + r, "right") - np.searchsorted(s, x - r, "left")


def mutual_information(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """Estimate in nats, at least 0; 0 for too few points."""
    n = len(x)
    if n <= k + 1:
        return 0.0
    r = nearest(x, y, k)[:, -1] * (1 - 1e-10)
    nx, ny = _within(x, r), _within(y, r)
    full = np.array([n, k])
    psi_n, psi_k = _digamma(full)
    return max(0.0, float(psi_n + psi_k - _digamma(nx).mean() - _digamma(ny).mean()))


def nearest_of(qx: np.ndarray, qy: np.ndarray, reach: np.ndarray, x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """For each query the k smallest max-norm distances to points, those below ``reach`` at least; inf where there are fewer."""
    best = np.full((len(qx), k), np.inf)
    if not len(x):
        return best
    held = _Held(x, y, k)
    return held.nearer(best, qx, qy, *held.near(qx, qx, qy, qy, reach))


class Tiles:
    """A plane cut into rectangles by halving a sample of its points, the wider side first."""

    def __init__(self, x: np.ndarray, y: np.ndarray, leaf: int):
        self.axis, self.at, self.child, self.box = [], [], [], []
        root = self._split(np.stack([x, y]), leaf, (-np.inf, -np.inf, np.inf, np.inf))
        # leaves are nodes after the others that lead to themselves
        inner, self.leaves = len(self.axis), len(self.box)
        self.inner, self.box = inner, np.array(self.box)
        child = np.array(self.child, int).reshape(-1, 2)
        ends = inner + np.arange(self.leaves)
        self.child = np.concatenate([np.where(child < 0, inner - 1 - child, child), np.stack([ends, ends], 1)])
        self.axis, self.at = np.append(np.array(self.axis, int), 0 * ends), np.append(np.array(self.at, float), 0.0 * ends)
        self.root = inner - 1 - root if root < 0 else root

    def _split(self, p: np.ndarray, leaf: int, box: tuple) -> int:
        """Number of a node, or -1 - leaf."""
        if p.shape[1] > leaf:
            for axis in np.argsort(-np.ptp(p, axis=1), kind="stable").tolist():
                v = p[axis]
                at = np.median(v)
                low = v < at
                if not low.any():  # more than half are equal
                    low = v <= at
                    if low.all():
                        continue
                    at = v[~low].min()
                node = len(self.axis)
                self.axis.append(axis), self.at.append(at), self.child.append(None)
                below, above = list(box), list(box)
                below[2 + axis] = above[axis] = at
                self.child[node] = (self._split(p[:, low], leaf, tuple(below)), self._split(p[:, ~low], leaf, tuple(above)))
                return node
        self.box.append(box)
        return -len(self.box)

    def touched(self, x: np.ndarray, y: np.ndarray, reach: np.ndarray, own=None) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) wherever the square of half side ``reach`` meets a leaf, but the ``own`` leaf of each."""
        q = np.arange(len(x))
        if own is not None:  # most meet no other
            left, low, right, high = self.box[own].T
            q = np.flatnonzero((x - left <= reach) | (right - x <= reach) | (y - low <= reach) | (high - y <= reach))
        node = np.full(len(q), self.root)
        done = [(q[:0], q[:0])]
        while len(q):
            end = node >= self.inner
            done.append((q[end], node[end] - self.inner))
            q, node = q[~end], node[~end]
            v, r, at = np.where(self.axis[node] == 0, x[q], y[q]), reach[q], self.at[node]
            low, high = v - at <= r, at - v <= r
            child = self.child[node]
            q, node = np.concatenate([q[low], q[high]]), np.concatenate([child[low, 0], child[high, 1]])
        q, leaf = (np.concatenate(c) for c in zip(*done))
        other = slice(None) if own is None else leaf != own[q]
        return q[other], leaf[other]

    def leaf(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        node = np.full(len(x), self.root)
        while (node < self.inner).any():
            node = self.child[node, (np.where(self.axis[node] == 0, x, y) >= self.at[node]).astype(int)]
        return node - self.inner


def pack(v: np.ndarray) -> bytes:
    """8-byte numbers with all their first bytes first, then the second ...: those of near numbers are equal and compress."""
    return np.ascontiguousarray(v).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(packed: bytes, kind: type = float) -> np.ndarray:
    return np.frombuffer(packed, np.uint8).reshape(8, -1).T.copy().view(kind).ravel()
