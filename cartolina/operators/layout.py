"""Force-directed layout, one task a group; deterministic for the same nodes and links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed parameters of the layout.
WIDTH, HEIGHT, TICKS = 1600.0, 1000.0, 300
LINK_DISTANCE, CHARGE, PADDING = 95.0, -330.0, 24.0
PULL, ANCHORED_PULL = 0.07, 0.08
GOLDEN_ANGLE = np.pi * (3 - np.sqrt(5))


def radius_of(kind: str, count: Column) -> Column:
    """Node radii: a module by its symbols, a repository by all of its symbols."""
    return {"module": 12 + 5 * F.sqrt(count), "repo": 26 + 4 * F.sqrt(count)}[kind]


def anchors(ids: DataFrame) -> DataFrame:
    """id, ax, ay: ids (0, 1, ...) spread over a ring from the top on."""
    n = ids.agg(F.count("*").alias("n"))
    angle = -F.pi() / 2 + 2 * F.pi() * F.col("id") / F.col("n")
    r = min(WIDTH, HEIGHT) / 4
    return ids.join(F.broadcast(n)).select("id", (WIDTH / 2 + r * F.cos(angle)).alias("ax"), (HEIGHT / 2 + r * F.sin(angle)).alias("ay"))


#: Groups of up to so many nodes are reckoned pair by pair; in larger ones far charges act through a mesh, and only near pairs singly.
PAIRS = 512
#: Pairs reckoned at once (arrays that fit a cache), and pairs kept from tick to tick at most; neither bears on which pairs count.
CHUNK, HELD = 1 << 16, 1 << 22
#: The width of a smoothed charge and the reach of what smoothing takes away, in meshes: beyond it less than a thousandth of a pair's force is left.
SOFT, NEAR = 1.4, 3.8


def _expanded(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges that begin at first: the number of the range, and each of its places."""
    which = np.repeat(np.arange(len(first)), count)
    return which, np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[which]


def _candidates(at: np.ndarray, size: float) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """An order of the nodes, and pairs of places in it, each pair once and in parts: every pair nearer than the size is among them."""
    cell = np.floor((at - at.min(axis=0)) / (size / 2)).astype(np.int64)
    width = int(cell[:, 1].max()) + 5
    key = cell[:, 0] * width + cell[:, 1] + 2
    order = np.argsort(key, kind="stable")
    held = key[order]
    # Two cells on in the own row, five in each of the next two rows.
    ranges = [(np.arange(1, len(at) + 1), np.searchsorted(held, held + 2, side="right"))]
    ranges += [(np.searchsorted(held, held + d * width - 2), np.searchsorted(held, held + d * width + 2, side="right")) for d in (1, 2)]

    def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for lo, hi in ranges:
            done = np.concatenate([[0], np.cumsum(hi - lo)])
            begin = 0
            while begin < len(lo):
                end = max(begin + 1, int(np.searchsorted(done, done[begin] + CHUNK, side="right")) - 1)
                i, j = _expanded(lo[begin:end], (hi - lo)[begin:end])
                if len(i):
                    yield i + begin, j
                begin = end

    return order, parts()


class Near:
    """Pairs of nodes within a reach, from tick to tick: they are searched with room to spare, and again once a node has used that room up."""

    def __init__(self) -> None:
        self.order, self.kept, self.was, self.last, self.room, self.reach = None, None, None, None, 0.0, 0.0

    def parts(self, at: np.ndarray, reach: float) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
        """An order of the nodes, and pairs of places in it, each pair once and in parts; all pairs nearer than the reach are among them."""
        moved = lambda a: float(np.sqrt(((at - a) ** 2).sum(axis=1).max()))
        step = moved(self.last) if self.last is not None else np.inf
        self.last = at
        if self.kept is not None and reach + 2 * moved(self.was) <= self.reach:
            return self.order, iter(self.kept)
        self.kept, self.room = None, min(8 * step, reach / 3)
        if 3 * step > self.room:  # not worth keeping
            return _candidates(at, reach)
        self.reach = reach + self.room
        self.order, found = _candidates(at, self.reach)
        x, y = at[self.order].T.copy()
        kept, n = [], 0
        for i, j in found:
            near = np.flatnonzero((x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2 <= self.reach**2)
            kept.append((i[near], j[near]))
            n += len(near)
            if n > HELD:
                return _candidates(at, reach)
        self.kept, self.was = kept, at
        return self.order, iter(kept)


def near_pairs(at: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
    """Ordered pairs of near nodes; every pair nearer than the size is among them."""
    order, parts = _candidates(at, size)
    found = [*parts]
    i, j = (order[np.concatenate([p[k] for p in found])] if found else np.zeros(0, np.int64) for k in (0, 1))
    return np.concatenate([i, j]), np.concatenate([j, i])


def _added(force: np.ndarray, at: np.ndarray, change: np.ndarray) -> None:
    low = int(at.min())
    got = np.bincount(at - low, change)
    force[low : low + len(got)] += got


class Mesh:
    """Charges smoothed by a Gaussian, spread over a square mesh by splines and convolved with their force; the mesh suits a number of nodes."""

    def __init__(self, n: int):
        self.cells = next(k for k in range(int(2 * np.sqrt(n)), 8 * n) if _smooth(k)) + 6
        while not _smooth(self.cells):
            self.cells += 1
        size = 2 * self.cells
        k = np.fft.fftfreq(size, 1 / size)
        x, y = np.meshgrid(k, k, indexing="ij")
        square = np.maximum(x * x + y * y, 1e-9)
        pull = np.expm1(-square / SOFT**2) / square
        spline = 0.75 + 0.25 * np.cos(2 * np.pi * k / size)
        spread = (spline[:, None] * spline[None, : size // 2 + 1]) ** 2
        self.kernels = [(np.fft.rfft2(g * pull) / spread).astype(np.complex64) for g in (x, y)]

    def forces(self, at: np.ndarray, low: np.ndarray, h: float) -> np.ndarray:
        """The forces of unit charges on each other; all nodes lie within the mesh that begins at low."""
        u = (at - low) / h + 2
        base = np.rint(u).astype(np.int64)
        d = u - base
        w = [(0.5 * (0.5 - d) ** 2), 0.75 - d * d, 0.5 * (0.5 + d) ** 2]
        spots = [((base[:, 0] + a - 1) * self.cells + base[:, 1] + b - 1, w[a][:, 0] * w[b][:, 1]) for a in range(3) for b in range(3)]
        charge = sum(np.bincount(s, v, self.cells**2) for s, v in spots).reshape(self.cells, self.cells)
        size = 2 * self.cells
        wave = np.fft.rfft2(charge.astype(np.float32), (size, size))
        out = np.zeros_like(at)
        for k, kernel in enumerate(self.kernels):
            field = np.fft.irfft2(wave * kernel, (size, size))[: self.cells, : self.cells].ravel()
            for s, v in spots:
                out[:, k] += field[s] * v
        return out / h


def _smooth(k: int) -> bool:
    """Whether a length suits the Fourier transform."""
    for p in (2, 3, 5):
        while k % p == 0:
            k //= p
    return k == 1


def _repelled(at: np.ndarray, strength: float, mesh: Mesh | None = None, near: Near | None = None) -> np.ndarray:
    """The charge forces on all nodes: smoothed ones over a mesh, and what smoothing takes from near pairs singly."""
    n = len(at)
    if n <= PAIRS:
        gap = at[None] - at[:, None]
        square = np.maximum((gap**2).sum(axis=2), 1.0)
        np.fill_diagonal(square, np.inf)
        return (gap * (strength / square)[:, :, None]).sum(axis=1)
    mesh, near = mesh or Mesh(n), near or Near()
    low = at.min(axis=0)
    h = max(float(np.ptp(at, axis=0).max()) / (mesh.cells - 6), 0.25)
    order, parts = near.parts(at, NEAR * h)
    x, y = at[order].T.copy()
    fx, fy = np.zeros(n), np.zeros(n)
    for i, j in parts:
        dx, dy = x[j] - x[i], y[j] - y[i]
        square = dx * dx + dy * dy
        kept = np.flatnonzero(square < (NEAR * h) ** 2)
        if not len(kept):
            continue
        i, j, dx, dy, square = i[kept], j[kept], dx[kept], dy[kept], square[kept]
        part = 1 / np.maximum(square, 1.0) + np.expm1(-square / (SOFT * h) ** 2) / np.maximum(square, 1e-12)
        dx *= part
        dy *= part
        _added(fx, i, dx)
        _added(fy, i, dy)
        _added(fx, j, -dx)
        _added(fy, j, -dy)
    force = mesh.forces(at, low, h)
    force[order, 0] += fx
    force[order, 1] += fy
    return force * strength


def _parted(ahead: np.ndarray, radius: np.ndarray, near: Near | None = None) -> np.ndarray:
    """What moves overlapping nodes apart, the smaller the more."""
    n = len(ahead)
    if n <= PAIRS:
        i, j = np.triu_indices(n, 1)
        order, parts = np.arange(n), iter([(i, j)] if n > 1 else [])
    else:
        order, parts = (near or Near()).parts(ahead, 2 * float(radius.max()) + 2 * PADDING)
    x, y = ahead[order].T.copy()
    r = radius[order]
    same = 2 * float(r[0]) + 2 * PADDING if n and (r == r[0]).all() else None
    fx, fy, gx, gy = (np.zeros(n) for _ in range(4))
    for i, j in parts:
        dx, dy = x.take(i) - x.take(j), y.take(i) - y.take(j)
        square = dx * dx + dy * dy
        reach = same or r.take(i) + r.take(j) + 2 * PADDING
        kept = np.flatnonzero(square < reach * reach)
        if not len(kept):
            continue
        i, j, dx, dy = i.take(kept), j.take(kept), dx.take(kept), dy.take(kept)
        length = np.sqrt(np.maximum(square.take(kept), 1e-12))
        over = ((reach if same else reach.take(kept)) - length) / length / 2
        share = 0.5 if same else r[j] ** 2 / (r[i] ** 2 + r[j] ** 2)
        first = over * share
        other = first if same else over - first
        _added(fx, i, dx * first)
        _added(fy, i, dy * first)
        _added(gx, j, dx * other)
        _added(gy, j, dy * other)
    force = np.zeros((n, 2))
    force[order, 0] = fx - gx
    force[order, 1] = fy - gy
    return force


def simulate(radius: np.ndarray, ax: np.ndarray, ay: np.ndarray, links: np.ndarray, ticks: int = TICKS) -> np.ndarray:
    """Positions after TICKS cooling steps of spring, charge, pull and collision forces."""
    n = len(radius)
    i = np.arange(n)
    spiral = 10 * np.sqrt(0.5 + i)
    at = np.stack([WIDTH / 2 + spiral * np.cos(i * GOLDEN_ANGLE), HEIGHT / 2 + spiral * np.sin(i * GOLDEN_ANGLE)], axis=1)
    speed = np.zeros((n, 2))
    degree = np.bincount(links.ravel(), minlength=n) if len(links) else np.ones(n)
    goal = np.stack([np.where(np.isnan(ax), WIDTH / 2, ax), np.where(np.isnan(ay), HEIGHT / 2, ay)], axis=1)
    pull = np.where(np.isnan(ax), PULL, ANCHORED_PULL)[:, None]
    charge = CHARGE * min(1.0, 30 / max(n, 1))
    heat, cooling = 1.0, 1 - 0.001 ** (1 / TICKS)
    mesh, charged, touching = Mesh(n) if n > PAIRS else None, Near(), Near()
    for _ in range(ticks):
        heat -= heat * cooling
        if len(links):
            a, b = links[:, 0], links[:, 1]
            d = (at[b] + speed[b]) - (at[a] + speed[a])
            length = np.maximum(np.hypot(d[:, 0], d[:, 1]), 1e-6)
            force = d * ((length - LINK_DISTANCE) / length * heat / np.minimum(degree[a], degree[b]))[:, None]
            share = (degree[a] / (degree[a] + degree[b]))[:, None]
            np.add.at(speed, b, -force * share)
            np.add.at(speed, a, force * (1 - share))
        speed += _repelled(at, charge * heat, mesh, charged)
        speed += (goal - at) * pull * heat
        speed += _parted(at + speed, radius, touching)
        speed *= 0.6
        at = at + speed
    return np.round(at, 2)


def placed(nodes: DataFrame, links: DataFrame, group: str = "repo") -> DataFrame:
    """group, id, x, y. nodes: group, id, radius, ax, ay (null without an anchor); links: group, from, to, of which others than between nodes are left out."""
    schema = f"`{group}` string, id string, x double, y double"

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("id", kind="stable").drop_duplicates("id")
        at = {v: i for i, v in enumerate(left["id"])}
        own = right[right["from"].isin(at) & right["to"].isin(at) & (right["from"] != right["to"])]
        pairs = np.unique(np.stack([own["from"].map(at).to_numpy(int), own["to"].map(at).to_numpy(int)], axis=1).reshape(-1, 2), axis=0)
        if not len(left):
            return pd.DataFrame({group: [], "id": [], "x": [], "y": []})
        xy = simulate(left["radius"].to_numpy(float), left["ax"].to_numpy(float), left["ay"].to_numpy(float), pairs)
        return pd.DataFrame({group: [key[0]] * len(left), "id": left["id"], "x": xy[:, 0], "y": xy[:, 1]})

    return nodes.groupBy(group).cogroup(links.select(group, "from", "to").toDF("_group", "from", "to").groupBy("_group")).applyInPandas(run, schema)
