"""Nearest neighbours by the tree of boxes against brute force, and what it need not read."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilwright.operators import attack, neighbours, utility
from veilwright.operators.neighbours import Tree


def frame(spark, x, name):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in enumerate(x)], f"{name} long, v array<double>")


def brute(points, queries, k, same):
    out = {}
    for n, x in enumerate(queries):
        d = neighbours._squares(x[None], points)[0]
        if not same:
            d[n] = np.inf
        out[n] = [(int(i), float(d[i])) for i in np.lexsort((np.arange(len(d)), d))[:k] if np.isfinite(d[i])]
    return out


@pytest.mark.parametrize(("n", "d", "k", "chunk", "fan"), [(700, 3, 5, 16, 3), (300, 1, 4, 8, 4), (120, 17, 3, 16, 4), (5, 2, 20, 4, 2), (1, 2, 3, 4, 2)])
def test_neighbours_equal_brute_force(spark, n, d, k, chunk, fan):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=(n, d)) * rng.choice([0.1, 3], size=(n, 1)), 1)  # many ties and equal points
    x[: n // 3] = x[0]
    df = frame(spark, x, "id")
    got = {}
    for r in Tree(df, chunk, fan).nearest(df.withColumnRenamed("id", "q"), k).orderBy("q", "r").collect():
        got.setdefault(r.q, []).append((r.id, r.d2))
    want = {q: v for q, v in brute(x, x, k, False).items() if v}
    assert got == want


def test_far_queries_and_none(spark):
    rng = np.random.default_rng(1)
    x, far = rng.normal(size=(400, 4)), 50 + rng.normal(size=(60, 4))
    tree = Tree(frame(spark, x, "id"), 16, 4)
    got = {(r.q, r.id) for r in tree.nearest(frame(spark, far, "q"), 2, same=True).collect()}
    assert got == {(q, i) for q, v in brute(x, far, 2, True).items() for i, _ in v}
    assert tree.nearest(frame(spark, far, "q").limit(0), 2).count() == 0
    assert Tree(frame(spark, x, "id").limit(0)).nearest(frame(spark, far, "q"), 2).count() == 0


def test_rows_far_away_meet_few_chunks(spark, monkeypatch):
    """The low-utility fixture: all synthetic rows lie beyond one end of the real ones."""
    rng = np.random.default_rng(0)
    n = 20_000
    real = [(int(a), float(b)) for a, b in zip(rng.integers(18, 80, n), np.round(rng.normal(50000, 15000, n), 2), strict=True)]
    low = [(int(a), float(b)) for a, b in zip(rng.integers(60, 90, n), np.round(rng.normal(200000, 5000, n), 2), strict=True)]
    met = []
    down = Tree._down

    def counted(self, queries, first):
        out = down(self, queries, first)
        met.append(out.count())
        return out

    monkeypatch.setattr(Tree, "_down", counted)
    got = utility.nndr(*(spark.createDataFrame(v, "age int, income double") for v in (real, low)), ["age", "income"]).first()
    r, s = np.array(real, float), np.array(low, float)
    mean, sd = r.mean(0), r.std(0)
    r, s = (r - mean) / sd, (s - mean) / sd
    near = np.concatenate([np.sqrt(neighbours._squares(s[i : i + 500], r).min(1)) for i in range(0, n, 500)])
    assert got["synthetic_mean"] == pytest.approx(near.mean()) and got["synthetic_least"] == pytest.approx(near.min())
    chunks = n // neighbours.CHUNK
    assert met[1] < 0.25 * 2 * n * chunks


def counting(monkeypatch):
    """Rows of the tables of chunks that queries meet: first each one's nearest, then all others within its radius."""
    met, down = [], Tree._down

    def counted(self, *args):
        out = down(self, *args)
        met.append(out.count())
        return out

    monkeypatch.setattr(Tree, "_down", counted)
    return met


def test_rows_on_levels_meet_no_more_chunks_in_larger_tables(spark, monkeypatch):
    """One column has few values, as a nation, so that near rows are those of the same level."""
    met = counting(monkeypatch)
    rng = np.random.default_rng(7)
    for n in (3_000, 12_000):
        x, q = (np.column_stack([rng.uniform(-1.7, 1.7, n), rng.integers(0, 25, n) / 7.2]) for _ in range(2))
        got = {r.q: r.d2 for r in Tree(frame(spark, x, "id"), 32, 8).nearest(frame(spark, q, "q"), 1, same=True).collect()}
        want = np.concatenate([neighbours._squares(q[i : i + 500], x).min(1) for i in range(0, n, 500)])
        assert len(got) == n and all(got[i] == d for i, d in enumerate(want))
        assert met[-2] == n and met[-1] < 2 * n


def test_few_rows_apart_have_a_radius(spark, monkeypatch):
    """Rows whose cell has fewer than k others meet only what a box with k others reaches."""
    met = counting(monkeypatch)
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(3000, 2)), [30, 0] + rng.normal(size=(4, 2)), [0, -40] + rng.normal(size=(3, 2))])
    got = {}
    for r in Tree(frame(spark, x, "id"), 16, 4).nearest(frame(spark, x, "q"), 7).orderBy("q", "r").collect():
        got.setdefault(r.q, []).append((r.id, r.d2))
    assert got == brute(x, x, 7, False)
    assert met[-1] < 0.1 * len(x) * len(x) / 16


def lof(x, k):
    at, near = np.zeros((len(x), k), int), np.zeros((len(x), k))
    for i in range(0, len(x), 1000):
        d = np.sqrt(neighbours._squares(x[i : i + 1000], x))
        d[np.arange(len(d)), i + np.arange(len(d))] = np.inf
        part = np.argpartition(d, k, axis=1)[:, :k]
        by = np.argsort(np.take_along_axis(d, part, 1), axis=1)
        at[i : i + 1000] = np.take_along_axis(part, by, 1)
        near[i : i + 1000] = np.take_along_axis(d, at[i : i + 1000], 1)
    reach = np.maximum(near, near[:, -1][at])
    lrd = 1 / (reach.mean(1) + 1e-10)
    f = lrd[at].mean(1) / lrd
    return (f - f.min()) / (f.max() - f.min())


def test_outlier_factor_of_many_tuples(spark):
    rng = np.random.default_rng(4)
    took = []
    for n in (6_000, 12_000):
        x = rng.normal(size=(n, 3))
        df = spark.createDataFrame([tuple(map(float, r)) for r in x], "id double, d double, n double")  # names that the operator uses itself
        began = time.perf_counter()
        got = {(r.id, r.d, r.n): r.lof for r in attack.local_outlier_factor(df, ["id", "d", "n"]).collect()}
        took.append(time.perf_counter() - began)
        z = (x - x.mean(0)) / x.std(0, ddof=1)  # a rotation changes no distance
        want = lof(z, 20)
        assert len(got) == n and max(abs(got[tuple(map(float, r))] - w) for r, w in zip(x, want, strict=True)) < 1e-6
    assert took[1] < 3 * took[0]


def test_outlier_factor_of_few(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), (None, 1.0)], "c string, x double")
    assert {r.lof for r in attack.local_outlier_factor(df.limit(2), ["c", "x"]).collect()} == {0.0}
    assert attack.local_outlier_factor(df.filter(F.lit(False)), ["c", "x"]).collect() == []
