"""Exact nearest neighbours of very many points: a join over a distributed tree of boxes.

Points are dealt to the cells of a k-d tree that is fitted on a bounded sample;
a cell's points, in the order of a space-filling code, are cut into chunks. No
chunk has points of two cells, so that its box is as small as they are. The k-d
tree with the least boxes around its nodes' points, ``CELLS`` leaves at most, is
known to each task; boxes around chunks of a cell, around ``FAN`` of those, and
so on up to one a cell, are tables. A query goes down to its nearest cell and
chunk first; what it finds there is a proved radius, and it then goes down
again, to those nodes only whose box lies within that radius. No point meets a
chunk that its radius excludes, and no task has more than one chunk and ``TEAM``
queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durable import drop_cut, materialise
from ..functions.ranks import global_rank

#: Points of a chunk, children of a node, queries of a task, and the most cells of the k-d tree and rows of its sample.
CHUNK, FAN, TEAM, CELLS, SAMPLE = 512, 64, 4096, 4096, 65_536
#: Bits, most bits a dimension, and dimensions, of the code within a cell.
BITS, FINEST, DIMS = 60, 16, 15
#: Queries that go down the k-d tree together, and rows of a batch that leave it.
TOGETHER, ROWS = 1024, 100_000


class _Cells:
    """A k-d tree over a sample: arrays of dimension, cut and children; cells are numbered from left to right, with the sample's box.

    ``surround`` gives it the boxes of all points; inner nodes come first in them, cells after.
    """

    def __init__(self, sample: np.ndarray, cells: int):
        self.dim, self.cut, self.child, self.low, self.high = [], [], [], [], []
        self.depth = 0
        self._split(sample, max(1, cells), 0)
        self.dim, self.cut, self.child = np.array(self.dim), np.array(self.cut), np.array(self.child).reshape(-1, 2)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _split(self, x: np.ndarray, cells: int, depth: int) -> int:
        """The number of the node for ``x``; a cell has its number, less 1, below zero."""
        self.depth = max(self.depth, depth)
        spread = x.max(axis=0) - x.min(axis=0)
        d = int(np.argmax(spread))
        if cells < 2 or spread[d] == 0:
            self.low.append(x.min(axis=0))
            self.high.append(x.max(axis=0))
            return -len(self.low)
        cut = np.median(x[:, d])
        left = x[:, d] <= cut
        if left.all():
            cut = x[:, d][x[:, d] < cut].max()
            left = x[:, d] <= cut
        at = len(self.dim)
        self.dim.append(d)
        self.cut.append(cut)
        self.child.append([0, 0])
        # Cells by rows, so that a cut beside a few rows makes no small cells of them.
        share = min(cells - 1, max(1, round(cells * left.mean())))
        self.child[at] = [self._split(x[left], share, depth + 1), self._split(x[~left], cells - share, depth + 1)]
        return at

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row, and a code by interleaved bits of its place in the cell's box."""
        at = np.zeros(len(x), int) if len(self.dim) else np.full(len(x), -1)
        for _ in range(self.depth):
            inner = np.flatnonzero(at >= 0)
            n = at[inner]
            at[inner] = self.child[n, (x[inner, self.dim[n]] > self.cut[n]).astype(int)]
        cell = -at - 1
        low, wide = self.low[cell][:, :DIMS], (self.high - self.low)[cell][:, :DIMS]
        place = np.clip(np.divide(x[:, :DIMS] - low, wide, out=np.zeros_like(low), where=wide > 0), 0, 1)
        bits = min(FINEST, BITS // place.shape[1])
        step = np.minimum((place * (1 << bits)).astype(np.int64), (1 << bits) - 1)
        code = np.zeros(len(x), np.int64)
        for b in range(bits - 1, -1, -1):
            for j in range(step.shape[1]):
                code = (code << 1) | ((step[:, j] >> b) & 1)
        return cell, code

    def surround(self, cell: np.ndarray, low: np.ndarray, high: np.ndarray, count: np.ndarray) -> None:
        """Boxes and numbers of points of cells, and from them those of inner nodes."""
        inner, leaves = len(self.dim), len(self.low)
        self.box_low, self.box_high = np.full((inner + leaves, low.shape[1]), np.inf), np.full((inner + leaves, low.shape[1]), -np.inf)
        self.count = np.zeros(inner + leaves, np.int64)
        self.box_low[inner + cell], self.box_high[inner + cell], self.count[inner + cell] = low, high, count
        # A node's number is less than its children's.
        for n in range(inner - 1, -1, -1):
            at = self._row(self.child[n])
            self.box_low[n], self.box_high[n], self.count[n] = self.box_low[at].min(axis=0), self.box_high[at].max(axis=0), self.count[at].sum()

    def _row(self, node: np.ndarray) -> np.ndarray:
        return np.where(node >= 0, node, len(self.dim) - node - 1)

    def _root(self, n: int) -> np.ndarray:
        return np.full(n, 0 if len(self.dim) else -1)

    def nearest(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """A cell near each row, and a squared radius that has k points beside the row itself: that of the least box on the way with so many."""
        node = self._root(len(x))
        r = np.full(len(x), np.inf)
        every = np.arange(len(x))
        for level in range(self.depth + 1):
            row = self._row(node)
            many = self.count[row] > k
            r[many] = _reach(x, every[many], self.box_low, self.box_high, row[many])
            if level == self.depth:
                break
            inner = np.flatnonzero(node >= 0)
            n = node[inner]
            left, right = (_away(x, inner, self.box_low, self.box_high, self._row(self.child[n, side])) for side in (0, 1))
            beyond = x[inner, self.dim[n]] > self.cut[n]
            node[inner] = self.child[n, ((right < left) | ((right == left) & beyond)).astype(int)]
        return -node - 1, r

    def within(self, x: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) numbers: all cells whose box lies within the row's squared radius."""
        q, node = np.arange(len(x)), self._root(len(x))
        rows, found = [], []
        while len(q):
            keep = _away(x, q, self.box_low, self.box_high, self._row(node)) <= r[q]
            q, node = q[keep], node[keep]
            inner = node >= 0
            rows.append(q[~inner])
            found.append(-node[~inner] - 1)
            q, node = np.repeat(q[inner], 2), self.child[node[inner]].ravel()
        return np.concatenate(rows), np.concatenate(found)


def _away(x: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances of rows ``q`` to boxes ``at``, pair by pair; as ``_gap``."""
    out = np.zeros(len(q))
    for j in range(x.shape[1]):
        d = np.maximum(np.maximum(low[at, j] - x[q, j], x[q, j] - high[at, j]), 0.0)
        out += d * d
    return out


def _reach(x: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances of rows ``q`` to the farthest points of boxes ``at``, pair by pair."""
    out = np.zeros(len(q))
    for j in range(x.shape[1]):
        d = np.maximum(x[q, j] - low[at, j], high[at, j] - x[q, j])
        out += d * d
    return out


def _gap(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes; summed in the order of dimensions, as ``_squares``, so that rounding keeps them bounds."""
    out = np.zeros((len(x), len(low)))
    for j in range(x.shape[1]):
        d = np.maximum(np.maximum(low[None, :, j] - x[:, j, None], x[:, j, None] - high[None, :, j]), 0.0)
        out += d * d
    return out


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        d = x[:, j, None] - y[None, :, j]
        out += d * d
    return out


def _reached(x: np.ndarray, r: np.ndarray, low: np.ndarray, high: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query, box) numbers: the nearest box of each query, of several that with the nearest centre, or all within its radius."""
    gap = _gap(x, low, high)
    if not first:
        return np.nonzero(gap <= r[:, None])
    centre = np.where(gap == gap.min(axis=1, keepdims=True), _squares(x, (low + high) / 2), np.inf)
    return np.arange(len(x)), np.argmin(centre, axis=1)


_FRONTIER = "q long, v array<double>, r double, own long, node long"


def _met(frontier: DataFrame, nodes: DataFrame, key: str, run: Callable, schema: str) -> DataFrame:
    """``run`` for the rows of both tables with the same key; a key with many frontier rows is dealt to teams of about ``TEAM``, each with the node's rows."""
    teams = frontier.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / TEAM).cast("long").alias("_teams"))
    teams = materialise(teams, "teams")
    left = frontier.join(teams, key).withColumn("_team", F.pmod(F.xxhash64("q"), F.col("_teams"))).drop("_teams")
    right = nodes.join(teams, key).withColumn("_team", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_teams") - 1))).drop("_teams")
    return left.groupBy(key, "_team").cogroup(right.groupBy(key, "_team")).applyInPandas(run, schema)


class Tree:
    """The tree over points (id long, v array<double>), ids distinct and vectors of one length."""

    def __init__(self, points: DataFrame, chunk: int = CHUNK, fan: int = FAN):
        points = materialise(points.select(F.col("id").cast("long").alias("id"), "v"), "tree-points")
        self.n = points.count()
        self.cells: _Cells | None = None
        self.levels: list[DataFrame] = []
        if not self.n:
            return
        sample = points.orderBy(F.xxhash64("id")).limit(SAMPLE).select("v").toPandas()
        cells = self.cells = _Cells(np.vstack(sample.v.to_numpy()).astype(float), min(CELLS, -(-self.n // chunk)))
        self.d = len(sample.v[0])

        def ordered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    cell, code = cells.of(np.vstack(b.v.to_numpy()).astype(float))
                    yield pd.DataFrame({"id": b.id, "v": b.v, "cell": cell, "code": code})

        placed = materialise(points.mapInPandas(ordered, "id long, v array<double>, cell long, code long"), "placed")
        # A row a cell.
        sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"))
        sizes = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("cell")) - F.col("_n")).withColumn("_chunks", F.ceil(F.col("_n") / chunk).cast("long"))
        sizes = materialise(sizes, "cell-sizes")
        most = sizes.agg(F.max("_chunks")).first()[0]
        ranked = global_rank(placed, [F.col("cell"), F.col("code"), F.col("id")], "_r").join(F.broadcast(sizes), "cell")
        # A node's number is its cell's and its own within it.
        own = F.floor((F.col("_r") - 1 - F.col("_before")) * F.col("_chunks") / F.col("_n")).cast("long")
        own = F.least(own, F.col("_chunks") - 1)
        self.points = materialise(ranked.select("id", "v", (F.shiftleft("cell", 32) + own).alias("node")), "tree-chunks")
        drop_cut(points)
        drop_cut(placed)
        low, high = ([f(F.col("v")[i]).alias(f"{n}{i}") for i in range(self.d)] for n, f in (("l", F.min), ("h", F.max)))
        boxes = self.points.groupBy("node").agg(*low, *high)
        boxes = boxes.select("node", F.array(*(f"l{i}" for i in range(self.d))).alias("low"), F.array(*(f"h{i}" for i in range(self.d))).alias("high"))
        boxes = materialise(boxes, "boxes")
        while most > 1:
            # A row a child, FAN of them a node, all of one cell.
            up = F.shiftleft(F.shiftright("node", 32), 32) + F.floor(F.col("node").bitwiseAND(0xFFFFFFFF) / fan).cast("long")
            self.levels.append(boxes.select(up.alias("node"), F.col("node").alias("child"), "low", "high"))
            low, high = ([f(F.col(n)[i]).alias(f"{n}{i}") for i in range(self.d)] for n, f in (("low", F.min), ("high", F.max)))
            up = self.levels[-1].groupBy("node").agg(*low, *high)
            boxes = materialise(up.select("node", F.array(*(f"low{i}" for i in range(self.d))).alias("low"), F.array(*(f"high{i}" for i in range(self.d))).alias("high")), "boxes")
            most = -(-most // fan)
        # CELLS boxes at most.
        top = boxes.select(F.shiftright("node", 32).alias("cell"), "low", "high").join(sizes.select("cell", "_n"), "cell").toPandas()
        cells.surround(top.cell.to_numpy(), np.vstack(top.low.to_numpy()), np.vstack(top.high.to_numpy()), top._n.to_numpy())

    def _down(self, queries: DataFrame, k: int) -> DataFrame:
        """(q, v, r, own, node): queries (q, v, r, own) with a near chunk and a radius that has k points; if k is 0, with all but ``own`` within r."""
        cells = self.cells

        def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for s in range(0, len(b), TOGETHER):
                    part = b.iloc[s : s + TOGETHER]
                    x = np.vstack(part.v.to_numpy()).astype(float)
                    if k:
                        at, r = cells.nearest(x, k)
                        yield part.assign(r=r, node=at << 32)
                    else:
                        rows, at = cells.within(x, part.r.to_numpy())
                        for t in range(0, len(rows), ROWS):
                            yield part.iloc[rows[t : t + ROWS]].assign(node=at[t : t + ROWS] << 32)

        def step(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"q": [], "v": [], "r": [], "own": [], "node": []})
            right = right.sort_values("child")
            x, at = _reached(np.vstack(left.v.to_numpy()).astype(float), left.r.to_numpy(), np.vstack(right.low.to_numpy()), np.vstack(right.high.to_numpy()), k > 0)
            return left.iloc[x][["q", "v", "r", "own"]].assign(node=right.child.to_numpy()[at])

        out = queries.mapInPandas(start, _FRONTIER)
        for level in reversed(self.levels):
            out = _met(materialise(out, "frontier"), level, "node", step, _FRONTIER)
        return materialise(out if k else out.filter("node <> own"), "frontier")

    def _nearest_in(self, frontier: DataFrame, k: int, same: bool) -> DataFrame:
        """(q, id, d2): the k nearest of each chunk that a query has reached, those within its radius."""

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = {"q": [np.zeros(0, int)], "id": [np.zeros(0, int)], "d2": [np.zeros(0)]}
            if len(right):
                right = right.sort_values("id")
                y, ids = np.vstack(right.v.to_numpy()).astype(float), right.id.to_numpy()
                for s in range(0, len(left), 1024):
                    part = left.iloc[s : s + 1024]
                    q = part.q.to_numpy()
                    d = _squares(np.vstack(part.v.to_numpy()).astype(float), y)
                    if not same:
                        d[q[:, None] == ids[None, :]] = np.inf
                    m = min(k, len(ids))
                    at = np.argmin(d, axis=1)[:, None] if m == 1 else np.argsort(d, axis=1, kind="stable")[:, :m]
                    near = np.take_along_axis(d, at, 1)
                    keep = (near <= part.r.to_numpy()[:, None]) & np.isfinite(near)
                    out["q"].append(np.repeat(q, m).reshape(-1, m)[keep])
                    out["id"].append(ids[at][keep])
                    out["d2"].append(near[keep])
            return pd.DataFrame({c: np.concatenate(v) for c, v in out.items()})

        return _met(frontier, self.points, "node", run, "q long, id long, d2 double")

    def nearest(self, queries: DataFrame, k: int, same: bool = False) -> DataFrame:
        """(q, id, d2, r): exactly the k nearest points of each query (q long, v), r from 1, by squared distance and id; fewer if there aren't k.

        A point with the query's own number is no neighbour of it unless ``same``.
        """
        if not self.n:
            return queries.sparkSession.createDataFrame([], "q long, id long, d2 double, r int")
        best = Window.partitionBy("q").orderBy("d2", "id")
        start = queries.select(F.col("q").cast("long").alias("q"), "v", F.lit(float("inf")).alias("r"), F.lit(-1).cast("long").alias("own"))
        home = self._down(start, k)
        found = self._nearest_in(home, k, same)
        found = materialise(found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k), "home-neighbours")
        radius = found.filter(F.col("r") == k).select(F.col("q").alias("_q"), F.col("d2").alias("_d"))
        # A query whose chunk has fewer than k others keeps the radius of a box that has them.
        wider = home.join(radius, F.col("q") == F.col("_q"), "left").select("q", "v", F.least("_d", "r").alias("r"), F.col("node").alias("own"))
        away = self._nearest_in(self._down(wider, 0), k, same)
        out = found.drop("r").unionByName(away).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k)
        return materialise(out, "neighbours")
