"""Hard negatives from an inverted multi-index: exact windowed top-k by integer inner product.

Vectors are cut into two halves; a codebook of each half space names a row's cell
(i, j). For an anchor, a half's score with any row of code i is at most
``a.c_i + |a| * r_i`` with the code's radius r_i, so a cell's score is at most the
sum of two such bounds. A multi-sequence heap over the two sorted lists of bounds
yields the cells from the greatest sum down, and a search stops when the next
bound proves that no window it serves can change.

The index is a table in the order of cells, cut into blocks of ``BLOCK`` rows,
each a small multi-index with radii of its own; anchors come in groups of
``GROUP``. Every group of anchors meets every block in a task of bounded size. A
first round meets each anchor with its own block only, and its results are
floors that let most searches of the second round end at once where vectors are
clustered. Codebooks are fitted on a bounded sample, which decides how fast
searches are, never what they find.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import global_rank
from .common import materialise

#: Rows of a block of the index, anchors of a group, rows that the codebooks are fitted on, and codes of a half at least and at most.
BLOCK, GROUP, SAMPLE, CODES = 2048, 1024, 20_000, (8, 256)
#: Largest |floor(scale * x)| of a component: 64 products of such numbers fit in a long.
LARGEST = 1 << 28
#: Windows at or above the limits of a long.
LOW, HIGH = -(1 << 62), 1 << 62
#: Rows that are scored at once when cells are visited.
BATCH = 256


def prepared(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """(rid, vec_id, label, q): integer vectors of the rows that take part, q as int32 bytes; rid tells rows that repeat an id apart.

    Without a part are rows with a null id, label or vector, with a null or
    non-finite component, with a length that isn't the most frequent one (the
    longer of equally frequent ones), or with a component too large for a score
    in a long. Other columns are not read.
    """
    x = F.transform(vec_col, lambda v: v.cast("double"))
    fit = F.forall("x", lambda v: F.coalesce(~F.isnan(v) & (F.abs(F.floor(v * scale)) < LARGEST) & (F.abs(v) < float(LARGEST)), F.lit(False)))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), x.alias("x")).filter("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").filter(fit & (F.size("x") > 0))
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", F.transform("x", lambda v: F.floor(v * scale).cast("int")).alias("v"))
    rows = materialise(rows, "vectors")
    # A row a length.
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "d")).alias("m")).select(F.col("m.d").alias("_d"))
    return rows.join(F.broadcast(lengths), F.size("v") == F.col("_d")).drop("_d")


def _codebook(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's centroids of a bounded sample, started from rows spread over it."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmin((c**2).sum(1)[None, :] - 2 * x @ c.T, axis=1)
        for j in np.unique(near):
            c[j] = x[near == j].mean(axis=0)
    return c


def fit_codebooks(rows: DataFrame, seed: int = 42, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of the two half spaces, from at most ``sample`` rows drawn by hash of their id; as many as four times the fourth root of the rows."""
    n = rows.count()
    if not n:
        return np.zeros((1, 1)), np.zeros((1, 1))
    some = rows.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "rid").limit(sample).select("v").toPandas()
    x = np.vstack(some.v.to_numpy()).astype(float)
    h = x.shape[1] // 2
    k = min(len(x), max(CODES[0], min(CODES[1], int(4 * n**0.25))))
    return _codebook(x[:, :h], k), _codebook(x[:, h:], k)


def build_index(rows: DataFrame, codebooks: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(block, i, j, rid, vec_id, label, q): every row with its cell, in blocks of ``BLOCK`` rows in the order of cells; a hot cell takes several blocks."""
    first, second = codebooks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = np.vstack(b.column("v").to_numpy(zero_copy_only=False)).astype(np.int32)
            h = v.shape[1] // 2
            codes = [np.argmin((c**2).sum(1)[None, :] - 2 * part.astype(float) @ c.T, axis=1) for c, part in ((first, v[:, :h]), (second, v[:, h:]))]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in codes), b.column("rid"), b.column("vec_id"), b.column("label"), pa.array([r.tobytes() for r in v], pa.binary())], names=["i", "j", "rid", "vec_id", "label", "q"])

    coded = rows.mapInArrow(run, "i int, j int, rid long, vec_id long, label long, q binary")
    ranked = global_rank(coded, [F.col("i"), F.col("j"), F.col("vec_id"), F.col("rid")], "_r")
    return materialise(ranked.withColumn("block", F.floor((F.col("_r") - 1) / BLOCK)).drop("_r"), "multi-index")


class _Block:
    """A block of the index as arrays: rows by cell, codes with centre and radius."""

    def __init__(self, pdf: pd.DataFrame, codebooks: tuple[np.ndarray, np.ndarray]):
        pdf = pdf.sort_values(["i", "j", "vec_id", "rid"])
        self.rid, self.vec_id, self.label = (pdf[c].to_numpy() for c in ("rid", "vec_id", "label"))
        self.q = np.frombuffer(b"".join(pdf.q), np.int32).reshape(len(pdf), -1).astype(np.int64)
        h = self.q.shape[1] // 2
        i, j = pdf.i.to_numpy(), pdf.j.to_numpy()
        starts = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        ends = np.r_[starts[1:], len(i)]
        self.codes, self.centres, self.radii, self.halves = [], [], [], (slice(0, h), slice(h, None))
        for code, book, at in zip((i, j), codebooks, self.halves, strict=True):
            present, where = np.unique(code, return_inverse=True)
            away = np.sqrt(((self.q[:, at] - book[code]) ** 2).sum(axis=1))
            radius = np.zeros(len(present))
            np.maximum.at(radius, where, away)
            self.codes.append(where)
            self.centres.append(book[present])
            self.radii.append(radius)
        self.cells = {(int(self.codes[0][s]), int(self.codes[1][s])): (int(s), int(e)) for s, e in zip(starts, ends, strict=True)}
        # Products of doubles are exact below 2^53.
        self.exact = float(np.abs(self.q).max(initial=0))
        self.real = self.q.astype(float)

    def scores(self, a: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.exact * float(np.abs(a).max(initial=0)) * len(a) < 2**53:
            return (self.real[at] @ a.astype(float)).astype(np.int64)
        return self.q[at] @ a

    def visits(self, a: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(bound, start, end) of the cells from the greatest bound down, by the multi-sequence heap."""
        order, bounds = [], []
        for at, centre, radius in zip(self.halves, self.centres, self.radii, strict=True):
            part = a[at].astype(float)
            b = centre @ part + np.sqrt((part**2).sum()) * radius
            # Room for rounding of doubles.
            b = b + 1e-9 * (np.abs(centre) @ np.abs(part) + np.sqrt((part**2).sum()) * radius) + 1e-3
            by = np.argsort(-b, kind="stable")
            order.append(by.tolist())
            bounds.append(b[by].tolist())
        (oi, oj), (bi, bj) = order, bounds
        heap, seen = [(-(bi[0] + bj[0]), 0, 0)], {(0, 0)}
        while heap:
            bound, x, y = heapq.heappop(heap)
            if (cell := self.cells.get((oi[x], oj[y]))) is not None:
                yield -bound, *cell
            for nx, ny in ((x + 1, y), (x, y + 1)):
                if nx < len(bi) and ny < len(bj) and (nx, ny) not in seen:
                    seen.add((nx, ny))
                    heapq.heappush(heap, (-(bi[nx] + bj[ny]), nx, ny))


def _search(block: _Block, a: np.ndarray, rid: int, label: int, same: bool, k: int, windows: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """For each window (low, high, floor) the k best (score, vec_id, rid) of the block with low <= score <= high, ties by vec_id; scores below the floor are no loss."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in windows]
    # A window is open as long as a score up to the bound may enter it.
    gates = [max(low, floor) for low, _, floor in windows]
    pending: list[np.ndarray] = []
    rows = 0

    def score() -> None:
        at = np.concatenate(pending)
        at = at[(block.label[at] == label) & (block.rid[at] != rid)] if same else at[block.label[at] != label]
        s = block.scores(a, at)
        for w, (low, high, _) in enumerate(windows):
            inside = np.flatnonzero((s >= max(low, gates[w])) & (s <= high))
            if len(inside) > k:
                # Ties of the k-th stay.
                inside = inside[s[inside] >= np.partition(s[inside], -k)[-k]]
            if len(inside):
                best = found[w] + [(-int(s[x]), int(block.vec_id[at[x]]), int(block.rid[at[x]])) for x in inside]
                found[w] = sorted(best)[:k]
                if len(found[w]) == k:
                    gates[w] = max(gates[w], -found[w][-1][0])

    for bound, start, end in block.visits(a):
        if all(bound < g for g in gates):
            break
        pending.append(np.arange(start, end))
        rows += end - start
        if rows >= BATCH:
            score()
            pending, rows = [], 0
    if rows:
        score()
    return [[(-s, v, r) for s, v, r in x] for x in found]


def _meet(anchors: DataFrame, index: DataFrame, keys: list[str], same: bool, k: int, codebooks: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(a, w, score, vec_id, rid): what each anchor finds in the blocks that its keys name."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            block = _Block(right, codebooks)
            for rid, label, q, windows in zip(left.rid, left.label, left.q, left.windows, strict=True):
                found = _search(block, np.frombuffer(q, np.int32).astype(np.int64), rid, label, same, k, [(x["low"], x["high"], x["floor"]) for x in windows])
                out += [(rid, x["w"], *f) for x, best in zip(windows, found, strict=True) for f in best]
        return pd.DataFrame(out, columns=["a", "w", "score", "vec_id", "rid"]).astype("int64")

    # Both come from the index; named anew, its columns are the anchors' own.
    anchors = anchors.select(*(F.col(c).alias(c) for c in anchors.columns))
    return anchors.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInPandas(run, "a long, w int, score long, vec_id long, rid long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and window; each block has sent k at most."""
    order = Window.partitionBy("a", "w").orderBy(F.desc("score"), "vec_id", "rid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def windowed_top(anchors: DataFrame, index: DataFrame, codebooks: tuple[np.ndarray, np.ndarray], same: bool, k: int) -> DataFrame:
    """(a, w, rank, score, vec_id, rid): exactly the k best rows of each window of each anchor, of the same label (but the anchor itself) or of others.

    ``anchors`` are rows of the index (block, rid, label, q) with windows of
    (w, low, high, floor); the first round searches each one's own block, the
    second all others with the floors that the first has proved.
    """
    home = materialise(_best(_meet(anchors, index, ["block"], same, k, codebooks), k), "home")
    floors = home.filter(F.col("rank") == k).groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("f"))
    raised = F.transform("windows", lambda x: F.struct(x["w"].alias("w"), x["low"].alias("low"), x["high"].alias("high"), F.greatest(x["floor"], F.try_element_at("f", x["w"])).alias("floor")))
    groups = anchors.join(floors, F.col("rid") == F.col("a"), "left").withColumn("windows", F.when(F.col("f").isNull(), F.col("windows")).otherwise(raised)).drop("a", "f")
    groups = materialise(global_rank(groups, [F.col("block"), F.col("vec_id"), F.col("rid")], "_r").withColumn("g", F.floor((F.col("_r") - 1) / GROUP)).drop("_r"), "anchors")
    # Numbers of blocks and groups, which follow from the counts.
    blocks, teams = (x.agg(F.coalesce(F.max(c) + 1, F.lit(0))).first()[0] for x, c in ((index, "block"), (groups, "g")))
    upto = [F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, n - 1)).cast("long"))) for n in (blocks, teams)]
    left = groups.withColumnRenamed("block", "own").withColumn("block", upto[0])
    right = index.withColumn("g", upto[1])
    away = _meet(left.filter("own <> block").drop("own"), right, ["g", "block"], same, k, codebooks)
    return materialise(_best(home.drop("rank").unionByName(away), k), "windowed-top")


def mine(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors whose id ``every`` divides.

    ``rows`` are those of ``prepared``. Positives are an anchor's best rows of its
    label, negatives the best rows of other labels with
    low * positive <= 100 * negative <= high * positive; ties by the smaller id,
    then by row. A positive without such negatives, or an anchor without
    positives, has no rows; repeated rows are rows of their own.
    """
    codebooks = fit_codebooks(rows)
    index = build_index(rows, codebooks)
    window = F.struct(F.lit(0).alias("w"), F.lit(LOW).alias("low"), F.lit(HIGH).alias("high"), F.lit(LOW).alias("floor"))
    anchors = index.filter(F.col("vec_id") % every == 0).select("block", "rid", "vec_id", "label", "q", F.array(window).alias("windows"))
    near = windowed_top(anchors, index, codebooks, True, positives)
    # 100 n >= low s and 100 n <= high s, in integers; a negative positive has an empty window.
    s = F.col("score")
    down, up = -F.expr(f"(-{low} * score) div 100 - IF((-{low} * score) % 100 < 0, 1, 0)"), F.expr(f"({high} * score) div 100 - IF(({high} * score) % 100 < 0, 1, 0)")
    wanted = near.filter(down <= up).groupBy(F.col("a").alias("rid")).agg(F.collect_list(F.struct(F.col("rank").alias("w"), down.alias("low"), up.alias("high"), F.lit(LOW).alias("floor"))).alias("windows"))
    hard = windowed_top(anchors.drop("windows").join(wanted, "rid"), index, codebooks, False, negatives)
    who = anchors.select(F.col("rid").alias("_a"), F.col("vec_id").alias("anchor_id"))
    pos = near.select("a", F.col("rank").alias("w"), F.col("vec_id").alias("positive_id"), s.alias("positive_score"))
    out = hard.select("a", "w", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(pos, ["a", "w"]).join(who, F.col("a") == F.col("_a"))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
