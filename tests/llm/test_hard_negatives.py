"""Hard negatives against brute force over all rows, in integers."""

import math
from collections import Counter

import numpy as np

from veilwright.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, q string, block long"


def brute(rows, every=50, low=50, high=95):
    lengths = Counter()
    part = []
    for i, x, label in rows:
        if i is None or label is None or not x or any(v is None or not math.isfinite(v) or abs(math.floor(256 * v)) >= 1 << 28 for v in x):
            continue
        lengths[len(x)] += 1
        part.append((i, [math.floor(256 * float(np.float32(v))) for v in x], label))
    d = max(lengths, key=lambda k: (lengths[k], k), default=0)
    part = [p for p in part if len(p[1]) == d]
    out = []
    for n, (a, q, label) in enumerate(part):
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, w, strict=True)), i, m, la) for m, (i, w, la) in enumerate(part) if m != n)
        for s, p, _, la in [x for x in scored if x[3] == label][:5]:
            hard = [x for x in scored if x[3] != label and low * -s <= 100 * -x[0] <= high * -s][:3]
            out += [(a, p, k + 1, x[1], -s, -x[0]) for k, x in enumerate(hard)]
    return Counter(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(4)
    return Counter(tuple(r) for r in hard_negatives.mine(hard_negatives.prepared(df), **more).collect())


def clustered(n, seed=3, d=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    x = centres[rng.integers(0, 6, n)] + 0.2 * rng.normal(size=(n, d))
    return [(int(i), [float(v) for v in np.float32(row)], int(rng.integers(0, 4))) for i, row in enumerate(x)]


def test_equals_brute_force_with_odd_rows(spark, monkeypatch):
    rows = clustered(900)
    hot = [float(v) for v in np.float32(rows[50][1])]
    rows += [(1000 + i, hot, i % 3) for i in range(300)]
    rows += [(50, hot, 1), (50, hot, 1), (100, rows[100][1], 2), (None, hot, 1), (2000, None, 1), (2050, [], 1), (2100, hot, None), (2150, [1.0] * 3, 1), (2200, [float("nan")] * 8, 0), (2250, [float("inf")] + [0.0] * 7, 0), (2300, [None] + [0.0] * 7, 1), (2350, [0.0] * 8, 1), (2400, [-x for x in hot], 0), (2450, [3e30] * 8, 0), (2500, [2000.5] * 8, 0)]
    # Small blocks, so that several rounds, cells over blocks and floors are met.
    monkeypatch.setattr(hard_negatives, "BLOCK", 200)
    monkeypatch.setattr(hard_negatives, "GROUP", 10)
    want = brute(rows)
    assert want and mined(spark, rows) == want


def test_search_of_a_block_is_exact_and_stops_early():
    rows = clustered(3000, seed=9, d=16)
    q = np.array([[math.floor(256 * v) for v in x] for _, x, _ in rows], np.int64)
    books = tuple(hard_negatives._codebook(q[:, at].astype(float), 16) for at in (slice(0, 8), slice(8, None)))
    i, j = (np.argmin(((q[:, None, at] - b[None]) ** 2).sum(2), axis=1) for b, at in zip(books, (slice(0, 8), slice(8, None)), strict=True))
    import pandas as pd

    pdf = pd.DataFrame({"i": i, "j": j, "rid": range(3000), "vec_id": [r[0] for r in rows], "label": [r[2] for r in rows], "q": [r.astype(np.int32).tobytes() for r in q]})
    block = hard_negatives._Block(pdf, books)
    seen = []
    exact = block.scores
    block.scores = lambda a, at: (seen.append(len(at)), exact(a, at))[1]
    for n in range(0, 3000, 300):
        s = sorted(((-int(q[m] @ q[n]), m) for m in range(3000) if m != n and rows[m][2] == rows[n][2]))[:5]
        got = hard_negatives._search(block, q[n], n, rows[n][2], True, 5, [(hard_negatives.LOW, hard_negatives.HIGH, hard_negatives.LOW)])[0]
        assert [(-a, v) for a, v, _ in got] == s
        bounds = [b for b, _, _ in block.visits(q[n])]
        assert bounds == sorted(bounds, reverse=True)
    assert sum(seen) < 0.5 * 10 * 3000 / 4


def test_few_rows_and_none(spark):
    assert mined(spark, []) == Counter()
    one = [(0, [1.0, 2.0], 1)]
    assert mined(spark, one) == Counter()
    few = [(0, [1.0, 2.0], 1), (1, [1.0, 1.5], 1), (2, [0.5, 1.0], 2), (3, [-1.0, 0.0], 2)]
    assert mined(spark, few) == brute(few) and sum(brute(few).values()) > 0
