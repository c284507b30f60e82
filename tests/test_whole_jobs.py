"""Operators that must do the whole job, against brute force over tables with hot keys and more rows than any sample."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilwright.functions.ranks import exact_quantiles, quantiles, value_ranks
from veilwright.operators import attack, linkage, risk, utility


def test_nndr_is_of_all_rows(spark):
    rng = random.Random(5)
    real = [(rng.lognormvariate(0, 2), float(rng.randrange(4))) for _ in range(1500)] + [(1.0, 1.0)] * 700 + [(None, 2.0)]
    # One synthetic row of many copies a real one.
    synthetic = [(rng.lognormvariate(0, 2), float(rng.randrange(4))) for _ in range(1500)] + [(60.0, 2.0)] * 500 + [real[77]]
    x, y = (np.array([(np.nan if a is None else a, b) for a, b in t]) for t in (real, synthetic))
    m, s = np.nanmean(x, axis=0), np.nanstd(x, axis=0)
    x, y = (np.where(np.isnan(v), 0.0, (v - m) / s) for v in (x, y))
    rr = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
    np.fill_diagonal(rr, np.inf)
    r, t = np.sqrt(rr.min(1)), np.sqrt(((y[:, None, :] - x[None, :, :]) ** 2).sum(2).min(1))
    got = utility.nndr(*(spark.createDataFrame(v, "a double, b double") for v in (real, synthetic)), ["a", "b"]).first()
    assert got["real_least"] == 0 and got["synthetic_least"] == 0
    assert (got["real_mean"], got["synthetic_mean"], got["ratio"]) == pytest.approx((r.mean(), t.mean(), t.mean() / r.mean()))
    few = spark.createDataFrame([(1.0,)], "a double")
    assert tuple(utility.nndr(few, few, ["a"]).first()) == (None, None, 0.0, 0.0, None)
    assert utility.nndr(few.filter(F.lit(False)), few, ["a"]).first()["synthetic_mean"] is None


def test_matching_leaves_no_candidates(spark):
    rng = random.Random(9)
    # One tuple has a third of all rows on both sides, and a generalised value meets many different ones.
    aux = [(i, "n", 50.0) if i % 3 == 0 else (i, rng.choice("nm"), float(rng.randint(20, 80))) for i in range(150)]
    anon = [(i, "n", 50.0) if i % 3 == 0 else (i, "m", 40.0) if i % 3 == 1 else (i, rng.choice("nm"), float(rng.randint(20, 80))) for i in range(120)]
    sides = [spark.createDataFrame(t, "id long, g string, v double") for t in (aux, anon)]
    pairs = linkage.candidates(*sides, "id", "id", ["g", "v"], ["g"]).cache()
    scores = {(r[0], r[1]): r[2] for r in pairs.select("aux_index", "anon_index", linkage.similarity(linkage.kinds(sides[0], ["g", "v"]))).collect()}
    first = [{t[1:]: min(u[0] for u in rows if u[1:] == t[1:]) for t in rows} for rows in (aux, anon)]
    ta, tb = ({t[0]: first[k][t[1:]] for t in rows} for k, rows in enumerate((aux, anon)))
    free_a, free_b, want = set(ta), set(tb), {}
    for (i, j), s in sorted(((k, s) for k, s in scores.items() if s >= 0.6), key=lambda x: (-x[1], ta[x[0][0]], tb[x[0][1]])):
        if i in free_a and j in free_b:
            free_a.remove(i)
            free_b.remove(j)
            want[ta[i], tb[j]] = want.get((ta[i], tb[j]), 0) + 1
    assert max(want.values()) >= 40 and sum(want.values()) > 100
    edges = {(ta[i], tb[j]) for (i, j), s in scores.items() if s >= 0.6}
    for few in (500_000, len(edges) // 2):
        got = linkage.best_matches(pairs, linkage.kinds(sides[0], ["g", "v"]), in_one_task=few).collect()
        assert len({r.aux_index for r in got}) == len({r.anon_index for r in got}) == len(got)
        assert all(r.similarity == scores[r.aux_index, r.anon_index] >= 0.6 for r in got)
        found = {}
        for r in got:
            found[ta[r.aux_index], tb[r.anon_index]] = found.get((ta[r.aux_index], tb[r.anon_index]), 0) + 1
        assert found == want
    assert linkage.best_matches(pairs.filter(F.lit(False)), linkage.kinds(sides[0], ["g", "v"])).count() == 0


def test_every_pair_is_explained(spark):
    rng = random.Random(2)
    rows = [(i, i, i % 2, rng.random() + i % 2, rng.random()) for i in range(620)]
    pairs = spark.createDataFrame(rows, "aux_index long, anon_index long, label int, x_match double, y_match double")
    features = attack.features_of(pairs)
    for name in ("logreg", "rf"):
        model = attack._pipeline(attack.models(trees=3)[name], features).fit(attack.cleaned(pairs, features))
        importance, local = attack.contributions(attack.Attack(name, model, features, (1.0, 0.0), {}, {}, {}), pairs)
        got = local.collect()
        assert {(r.aux_index, r.feature) for r in got} == {(i, f) for i in range(620) for f in features} and len(got) == 1240
        mean = {f: sum(abs(r.contribution) for r in got if r.feature == f) / 620 for f in features}
        assert {r.feature: r.importance for r in importance.collect()} == pytest.approx(mean)
        assert mean["x_match"] > mean["y_match"]


@pytest.mark.parametrize(("few", "names"), [(100_000, ["g", "h"]), (2, ["g", "h"]), (100_000, ["Q", "r"]), (2, ["c", "class_size"])])
def test_emd_equals_a_walk_along_all_values(spark, few, names):
    rng = random.Random(12)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice([1, 2]), rng.choice([3.0, -1.5, 20.0, 7.0, 0.25, 100.0]) if rng.random() < 0.9 else None) for _ in range(300)]
    rows += [("lone", 1, 7.0), ("odd", 9, None)]
    df = spark.createDataFrame(rows, f"{names[0]} string, {names[1]} int, v double")
    got = {(r[0], r[1]): r.distance for r in risk.class_distances(df, names, "v", "emd", few=few).collect()}
    values = sorted({v for _, _, v in rows if v is not None})
    known = [(g, h, v) for g, h, v in rows if v is not None]
    want = {}
    for key in {(g, h) for g, h, _ in known}:
        own = [v for g, h, v in known if (g, h) == key]
        total = sum(abs(sum(x <= v for x in own) / len(own) - sum(x[2] <= v for x in known) / len(known)) for v in values)
        want[key] = min(1.0, total / (2 * (len(values) - 1)))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_quantiles_equal_numpy(spark):
    rng = random.Random(5)
    data = {k: [rng.choice([rng.random(), 0.5, 2.0]) for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 101), ("d", 400))}
    rows = spark.createDataFrame([(k, v) for k, vs in data.items() for v in [*vs, None]], "key string, x double")
    shares = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = {r.key: list(r)[1:] for r in quantiles(value_ranks(rows), shares).collect()}
    assert all(np.allclose(got[k], np.quantile(vs, shares)) for k, vs in data.items()) and len(got) == 4
    assert quantiles(value_ranks(rows.limit(0)), [0.5]).count() == 0
    for few in (100_000, 3):
        got = {r.key: list(r)[1:] for r in exact_quantiles(rows, shares, 16, few).collect()}
        assert all(np.allclose(got[k], np.quantile(vs, shares)) for k, vs in data.items()) and len(got) == 4
    assert exact_quantiles(rows.limit(0), [0.5]).count() == 0
    odd = spark.createDataFrame([("a", v) for v in (1.0, float("nan"), 3.0, float("inf"), -float("inf"), 2.0, 2.0)] + [("b", 5.0)] * 3, "key string, x double")
    for p in (0.0, 0.5, 0.75):
        one, other = ({r.key: r.q0 for r in x.collect()} for x in (exact_quantiles(odd, [p]), quantiles(value_ranks(odd), [p])))
        assert one == other or all(one[k] == other[k] or one[k] != one[k] for k in other)


def test_many_classes_of_one_row_are_dealt_evenly(spark):
    df = spark.range(30_000).selectExpr("id as q", "cast(id % 17 as double) as v")
    for few in (100_000, 3):
        got = risk.class_distances(df, ["q"], "v", "emd", few=few)
        assert got.count() == 30_000 and got.select("distance").distinct().count() <= 17
    assert risk.class_distances(df.filter("q < 0"), ["q"], "v", "emd").count() == 0


def test_two_threads_leave_the_setting_as_it_was(spark):
    from concurrent.futures import ThreadPoolExecutor

    from veilwright.functions import durable

    before = spark.conf.get(durable._CLEANUP, None)
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda n: durable.materialise(spark.range(n).groupBy((F.col("id") % 3).alias("k")).count(), "threads").count(), [5, 600, 7, 900, 3, 800]))
    assert got == [3] * 6 and spark.conf.get(durable._CLEANUP, None) == before and not durable._writers and not durable._before
    assert durable.exists(spark, durable.cuts_dir(spark)) and not durable.exists(spark, durable.cuts_dir(spark) + "/none")
