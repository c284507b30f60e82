"""Value partitions, samples, the attack's store, execution, pipelines and the batched search."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilwright.operators import anonymize, attack, hierarchy, pareto, profile
from veilwright.plans import expert


def split(rows, k):
    """Splits one by one: the first QI with a label of k rows on both sides, its most frequent label first, smallest of equals."""
    todo, done = [rows], []
    while todo:
        part = todo.pop()
        for q in range(2):
            n = Counter(r[q] for r in part)
            good = sorted((-c, "" if v is None else "=" + v, v) for v, c in n.items() if c >= k and len(part) - c >= k)
            if good:
                v = good[0][2]
                todo += [[r for r in part if r[q] == v], [r for r in part if r[q] != v]]
                break
        else:
            done.append(part)
    return done


def test_value_partitions_equal_splits_one_by_one(spark):
    rng = random.Random(1)
    m = hierarchy.HierarchyManager()
    m.add(hierarchy.categorical_hierarchy("_p", {}))
    m.add(hierarchy.categorical_hierarchy("n", {"x": ["a", "b"]}))
    for seed in range(3):
        rows = [(rng.choice([None, "u", "v", "w"] + ["s"] * 6 + list("defgh")), rng.choice("aaaab" + "cdef"[: seed + 1]), i) for i in range(150)]
        df = spark.createDataFrame(rows, "_p string, n string, partition int")
        got = {}
        for r in hierarchy.value_partitions(df, m, ["_p", "n", "partition"], 9).collect():
            got.setdefault(r.partition, []).append((r._p, r.n))
        key = lambda x: sorted(map(str, x))
        assert sorted(map(key, got.values())) == sorted(key([r[:2] for r in p]) for p in split(rows, 9))
        assert all(len(p) >= 9 for p in got.values()) and len(got) > 4
    m.set_level("n", 9)
    assert {r.partition for r in hierarchy.value_partitions(df, m, ["n"], 2).collect()} == {"0"}
    assert hierarchy.value_partitions(df.limit(0), m, ["_p"], 2).count() == 0


def test_samples_are_the_same_on_any_partitioning(spark):
    rows = [(i % 37, "x" * 60 + str(i % 3), None, f"v{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "value int, column string, nothing string, d string")
    got = [{r["column"]: tuple(r["samples"]) for r in profile.sample_values(df.repartition(n), 5, 50).collect()} for n in (1, 7)]
    assert got[0] == got[1] and got[0]["nothing"] == () and len(got[0]["value"]) == 5 and got[0]["column"] == ("x" * 50,) * 3
    import hashlib

    assert got[0]["d"] == tuple(sorted((f"v{i}" for i in range(500)), key=lambda v: hashlib.md5(v.encode()).hexdigest())[:5])
    s = {r["column"]: r for r in profile.column_summaries(df).collect()}
    assert len(s["d"]["values"]) == 10 and s["value"]["max"] == 36 and s["column"]["max"] is None and s["nothing"]["missing"] == 500


@pytest.mark.parametrize("name", ["logreg", "gbm"])
def test_loaded_attack_scores_as_the_saved_one(spark, tmp_path, name):
    rng = random.Random(4)
    pairs = spark.createDataFrame([(i, i, i % 2, rng.random() + i % 2, rng.random()) for i in range(120)], "aux_index long, anon_index long, label int, x_match double, y_match double")
    features = attack.features_of(pairs)
    model = attack._pipeline(attack.models(trees=4)[name], features).fit(attack.cleaned(pairs, features))
    saved = attack.Attack(name, model, features, (1.5, -0.25), {name: {"mean_pr_auc": 0.5}}, {"f1": 0.75, "tp": 3}, {"f1": 0.5})
    for _ in range(2):  # over what is there
        saved.save(f"file://{tmp_path}/store")
    back = attack.Attack.load(f"file://{tmp_path}/store")
    assert (back.name, back.features, back.platt, back.cv, back.test, back.baseline) == (saved.name, saved.features, saved.platt, saved.cv, saved.test, saved.baseline)
    score = lambda a: [(r.aux_index, r.attack_score) for r in a.score(pairs).orderBy("aux_index").collect()]
    assert score(back) == score(saved)
    spark.createDataFrame([(99, "{}")], "version int, attack string").write.mode("overwrite").json(f"file://{tmp_path}/store/attack")
    with pytest.raises(ValueError):
        attack.Attack.load(f"file://{tmp_path}/store")


def people(spark, n=400):
    rng = random.Random(8)
    rows = [(i, rng.randint(18, 80), rng.choice(["n", "s", "e", "w"]), rng.choice(["flu", "cold", "ache"]), rng.choice(["yes", "no", "perhaps"]), round(rng.gauss(50, 9), 1)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, age int, region string, disease string, answer string, income double")


@pytest.mark.parametrize("primary", ["k_anonymity", "l_diversity", "hybrid"])
def test_execution_checks_every_sensitive_column(spark, primary):
    df = people(spark)
    e = expert.execute(df, ["age", "region"], ["disease", "answer", "income"], primary, 4, 2, 0.9, key="id")
    assert e.success and e.data.count() == 400
    classes = {}
    for r in e.data.collect():
        classes.setdefault((r.age, r.region), []).append(r)
    assert min(map(len, classes.values())) >= 4
    by = {(c["constraint"], c["column"]): c for c in e.checks}
    assert by["k_anonymity", None]["actual"] == min(map(len, classes.values()))
    for c in ("disease", "answer", "income"):
        least = min(len({r[c] for r in x}) for x in classes.values())
        assert by["l_diversity", c]["actual"] == least
        assert primary == "k_anonymity" or least >= 2
    # Numeric sensitive columns are microaggregated.
    assert max(Counter(r.income for r in e.data.collect()).values()) >= 4


def test_execution_escalates_and_gives_up(spark):
    df = people(spark, 60)
    e = expert.execute(df, ["age", "region"], ["disease"], "l_diversity", 5, 4, most=2)
    assert not e.success and e.iterations == 2 and e.parameters["k"] == 6 and e.parameters["level"] == pytest.approx(0.6)
    assert [c["valid"] for c in e.checks if c["constraint"] == "l_diversity"] == [False]
    with pytest.raises(ValueError):
        expert.execute(df, ["age", "lost"], [])


def test_pipelines_are_distinct_and_as_many_as_asked(spark):
    rules = [r.name for r in expert.rule_base()]
    cases = [([], []), (["l_diversity", "k_anonymity", "unheard"], rules[:5]), (["pram"], ["PSU Detected at Release Level"]), (["generalization", "suppression", "t_closeness"], rules)]
    for methods, fired in cases:
        for n in (1, 7, 40, 400):
            got = expert.generate_pipelines(["age"], methods, n, fired)
            assert len(got) == n == len({repr(p.to_dict()["steps"]) for p in got})
            assert len({id(s) for p in got for s in p.steps}) == sum(len(p.steps) for p in got)
    got = {p.name: [s.method for s in p.steps] for p in expert.generate_pipelines(["age"], ["l_diversity"], 9, rules)}
    assert got["l_diversity"] == ["generalization", "k_anonymity", "l_diversity"] and got["High Cardinality in QI"] == ["generalization", "suppression"]
    done = expert.generate_pipelines(["age", "region"], ["l_diversity"], 3, ["Rare QI Combinations"])
    assert all(p.apply(people(spark, 80), key="id", sensitive="disease").count() == 80 for p in done[:2])


def test_search_in_batches_equals_settings_one_by_one(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, *range(40)]), rng.choice("aaaabbbccd"), str(rng.randint(1, 30)) if rng.random() < 0.95 else None) for _ in range(700)]
    df, qi = spark.createDataFrame(rows, "_n2 int, c string, o string"), ["_n2", "c", "o"]
    calls = []
    both = pareto.measured_objectives(df, qi)

    def counted(settings):
        calls.append(len(settings))
        return both(settings)

    best, front = pareto.search(counted, 6, 3)
    assert len(calls) <= 4 and best in [x for x, _ in front]

    def entropy(values):
        n = Counter(values)
        return -sum(m / 700 * math.log2(m / 700 + 1e-10) for m in n.values())

    settings = [{"k": 3, "l": 2, "t": 0.3, "level": 0.0}, {"k": 9, "l": 2, "t": 0.3, "level": 0.4}, {"k": 30, "l": 2, "t": 0.3, "level": 1.0}]
    for x, got in zip(settings, both(settings), strict=True):
        g = anonymize.generalize_level(df, qi, x["level"]) if x["level"] else df
        out = [tuple(r) for r in g.select(*qi).collect()]
        n = Counter(out)
        kept = [m for m in n.values() if m >= x["k"]]
        gone = sum(m for m in n.values() if m < x["k"])
        loss = sum(1 - entropy([r[i] for r in out]) / entropy([r[i] for r in rows]) for i in range(3)) / 3
        assert got == pytest.approx((1 / min(kept) if kept else 0.0, 0.5 * loss + 0.5 * gone / 700), abs=1e-9)
    assert pareto.grid_search(both)["k"] in (3, 10)
    assert both([settings[0]]) and pareto.measured_objectives(df.filter(F.lit(False)), qi)(settings)
