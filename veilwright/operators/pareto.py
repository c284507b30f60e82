"""Privacy and utility of parameter choices: scoring, skyline, selection and search."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def closed_form_scores(grid: DataFrame) -> DataFrame:
    """X11: privacy 5 / k and utility .7 * generalisation + .3, both to be small; a missing level is .5."""
    return grid.select("*", (5.0 / F.col("k")).alias("privacy_risk"), (0.7 * F.coalesce("level", F.lit(0.5)) + 0.3).alias("utility_loss"))


def pareto_front(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows that no other row betters in one of two minimised columns without being worse in the other.

    The least b of each a is taken first; a row stays if its b is that least, and
    below the least b of every smaller a. The running minimum goes range by
    range, so the table is never in one task.
    """
    from ..functions.durable import materialise

    low = df.groupBy(F.col(a).alias("_a")).agg(F.min(b).alias("_b"))
    dealt = materialise(low.repartitionByRange("_a").withColumn("_p", F.spark_partition_id()), "skyline")
    parts = dealt.groupBy("_p").agg(F.min("_b").alias("_m"))
    # One row per range partition.
    before = parts.select("_p", F.min("_m").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    local = F.min("_b").over(Window.partitionBy("_p").orderBy("_a").rowsBetween(Window.unboundedPreceding, -1))
    front = dealt.withColumn("_local", local).join(F.broadcast(before), "_p")
    best = F.least("_before", "_local")
    front = front.filter(best.isNull() | (F.col("_b") < best)).select("_a", "_b")
    return df.join(front, (F.col(a) == F.col("_a")) & (F.col(b) == F.col("_b"))).drop("_a", "_b")


def weighted_scores(front: DataFrame, a: str, b: str, weights: tuple[float, float] = (0.6, 0.4), normalize: str = "max") -> DataFrame:
    """``front`` with a weighted score of two columns, scaled by their maximum or to 0..1."""
    edge = front.agg(*(f(c).alias(f"_{n}_{c}") for c in (a, b) for n, f in (("lo", F.min), ("hi", F.max))))

    def scaled(c: str):
        if normalize == "max":
            return F.coalesce(F.try_divide(F.col(c), F.col(f"_hi_{c}")), F.lit(0.0))
        return F.coalesce(F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")), F.lit(0.0))

    return front.join(F.broadcast(edge)).withColumn("score", weights[0] * scaled(a) + weights[1] * scaled(b)).drop(*edge.columns)


def select_solution(front: DataFrame, a: str, b: str, weights: tuple[float, float] = (0.6, 0.4), normalize: str = "max", top: int = 1) -> DataFrame:
    """The ``top`` rows of least weighted score; ties by all columns."""
    return weighted_scores(front, a, b, weights, normalize).orderBy("score", a, b, *front.columns).limit(top)


def reoptimized(k: int, l: int, t: float) -> dict[str, float]:  # noqa: E741
    """X14."""
    return {"k": min(20, k + 2), "l": min(10, l + 1), "t": max(0.1, 0.8 * t)}


#: Both objectives of each of a list of settings, together.
Objectives = Callable[[list[dict]], list[tuple[float, float]]]

#: Ranges of the search.
SPACE = {"k": (2, 20), "l": (2, 10), "t": (0.1, 0.5), "level": (0.0, 1.0)}


def _dominates(x: tuple, y: tuple) -> bool:
    return x[0] <= y[0] and x[1] <= y[1] and x != y


def search(objectives: Objectives, population: int = 15, generations: int = 8, seed: int = 42) -> tuple[dict, list[tuple[dict, tuple[float, float]]]]:
    """A small non-dominated sorting genetic search; all new settings of a generation are evaluated together, each once. Returns the setting nearest to the ideal point, and the front."""
    rng = random.Random(seed)

    def fresh() -> dict:
        return {"k": rng.randint(*SPACE["k"]), "l": rng.randint(*SPACE["l"]), "t": round(rng.uniform(*SPACE["t"]), 3), "level": round(rng.uniform(*SPACE["level"]), 2)}

    def child(a: dict, b: dict) -> dict:
        x = {n: rng.choice((a[n], b[n])) for n in SPACE}
        n = rng.choice(list(SPACE))
        x[n] = fresh()[n]
        return x

    known: dict[tuple, tuple[float, float]] = {}

    def learn(xs: list[dict]) -> list[dict]:
        new = {key: x for x in xs if (key := tuple(x[n] for n in SPACE)) not in known}
        if new:
            known.update(zip(new, objectives(list(new.values())), strict=True))
        return xs

    def value(x: dict) -> tuple[float, float]:
        return known[tuple(x[n] for n in SPACE)]

    def ranked(xs: list[dict]) -> list[dict]:
        left, out = list(xs), []
        while left:
            front = [x for x in left if not any(_dominates(value(y), value(x)) for y in left)]
            # Within a front those with most room around them come first.
            front.sort(key=value)
            v = [value(x) for x in front]
            room = {id(x): float("inf") if i in (0, len(front) - 1) else abs(v[i + 1][0] - v[i - 1][0]) + abs(v[i + 1][1] - v[i - 1][1]) for i, x in enumerate(front)}
            out += sorted(front, key=lambda x: -room[id(x)])
            left = [x for x in left if all(x is not y for y in front)]
        return out

    people = learn([fresh() for _ in range(population)])
    for _ in range(generations):
        people = ranked(people + learn([child(rng.choice(people), rng.choice(people)) for _ in range(population)]))[:population]
    front = [x for x in people if not any(_dominates(value(y), value(x)) for y in people)]
    lo, hi = ([f(value(x)[i] for x in front) for i in (0, 1)] for f in (min, max))

    def far(x: dict) -> float:
        return sum(((value(x)[i] - lo[i]) / (hi[i] - lo[i]) if hi[i] > lo[i] else 0.0) ** 2 for i in (0, 1))

    best = min(front, key=lambda x: (far(x), tuple(x.values())))
    return best, [(x, value(x)) for x in front]


def _labels(base: DataFrame, c: str, levels: DataFrame) -> DataFrame:
    """(_level, _v, _g): the group of each distinct value of a QI at each level, as ``anonymize.generalize_level`` has it; level 0 keeps values."""
    from ..functions.ranks import prefix_sums
    from .anonymize import OTHER, frequency_level, is_numeric, level_bins

    own = F.col("_v").cast("string")
    values = base.groupBy(F.col(c).alias("_v")).agg(F.sum("_n").alias("_c"))
    if is_numeric(base, c):
        from ..functions.expressions import bin_right_closed

        x = F.col("_v").cast("double")
        ends = base.agg(F.min(F.col(c).cast("double")).alias("_lo"), F.max(F.col(c).cast("double")).alias("_hi"))
        bins = F.element_at(F.create_map(*(y for r in levels.collect() for y in (F.lit(r[0]), F.lit(level_bins(r[0]) if r[0] > 0 else 1)))), F.col("_level"))
        label = bin_right_closed(x, F.col("_lo"), F.col("_hi"), bins).cast("string")
        return values.join(F.broadcast(ends)).join(F.broadcast(levels)).select("_level", "_v", F.when(F.col("_level") > 0, label).otherwise(own).alias("_g"))
    known = values.filter("_v IS NOT NULL")
    number = F.col("_v").cast("string").try_cast("double")
    facts = known.agg(F.count(F.lit(1)).alias("_u"), (F.sum(F.when(number.isNotNull(), F.col("_c")).otherwise(0)) / F.sum("_c")).alias("_num"), F.sum("_c").alias("_all"))
    row = facts.first()
    if (row["_num"] or 0) > 0.8 and row["_u"] > 5:
        # By the rows up to a value.
        run = prefix_sums(known, [number, own], {"_to": "_c"}).select(F.col("_v").alias("_rv"), F.col("_to").alias("_r"))
        cut = F.element_at(F.create_map(*(y for r in levels.collect() for y in (F.lit(r[0]), F.lit(max(3, int(row["_u"] * (1 - 0.7 * r[0]))))))), F.col("_level"))
        label = F.concat(F.lit("Level_"), frequency_level(F.col("_r"), F.lit(row["_all"]), cut).cast("string"))
        ranked = values.join(run, F.col("_v").eqNullSafe(F.col("_rv")), "left").drop("_rv")
        return ranked.join(F.broadcast(levels)).select("_level", "_v", F.when((F.col("_level") > 0) & F.col("_r").isNotNull(), label).otherwise(own).alias("_g"))
    least = F.greatest(F.lit(1.0), F.lit(float(row["_all"] or 0)) * (0.2 - 0.15 * F.col("_level")))
    label = F.when((F.col("_level") > 0) & F.col("_v").isNotNull() & (F.col("_c") < least), OTHER).otherwise(own)
    return values.join(F.broadcast(levels)).select("_level", "_v", label.alias("_g"))


def measured_objectives(df: DataFrame, qi: list[str]) -> Objectives:
    """Risk as 1 / least class that is kept, and half the mean entropy loss of the QIs plus half the suppressed share, of generalisation at a level with suppression below k.

    The settings of a call are rows: the distinct QI values with their counts, read
    once, are grouped at every level of the settings in one pass, and each setting
    is an aggregate of its level's groups. Nothing is collected but two numbers a
    setting.
    """
    from ..functions.durable import materialise

    base = materialise(df.groupBy(*qi).agg(F.count(F.lit(1)).alias("_n")), "search")
    spark, n = df.sparkSession, base.agg(F.sum("_n")).first()[0] or 1
    keys = [f"_g{i}" for i in range(len(qi))]

    def evaluate(settings: list[dict]) -> list[tuple[float, float]]:
        levels = sorted({0.0, *(float(x["level"]) for x in settings)})
        table = spark.createDataFrame([(x,) for x in levels], "_level double")
        rows = base.join(F.broadcast(table))
        for c, key in zip(qi, keys, strict=True):
            labels = _labels(base, c, table).select(F.col("_level").alias("_at"), "_v", F.col("_g").alias(key))
            rows = rows.join(labels, (F.col("_level") == F.col("_at")) & F.col(c).eqNullSafe(F.col("_v"))).drop("_at", "_v")
        groups = materialise(rows.groupBy("_level", *keys).agg(F.sum("_n").alias("_n")), "search-groups")
        some = spark.createDataFrame([(i, float(x["level"]), x["k"]) for i, x in enumerate(settings)], "_i int, _level double, _k int")
        # As many rows as settings.
        kept = groups.join(F.broadcast(some), "_level").groupBy("_i").agg(F.min(F.when(F.col("_n") >= F.col("_k"), F.col("_n"))).alias("s"), F.sum(F.when(F.col("_n") < F.col("_k"), F.col("_n")).otherwise(0)).alias("gone"))
        each = groups.select("_level", "_n", F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col(k).alias("v")) for i, k in enumerate(keys)))).alias("x")).groupBy("_level", "x.c", "x.v").agg(F.sum("_n").alias("m"))
        share = F.col("m") / n
        entropy = {(r["_level"], r["c"]): r["h"] for r in each.groupBy("_level", "c").agg((-F.sum(share * F.log2(share + 1e-10))).alias("h")).collect()}
        got = {r["_i"]: r for r in kept.collect()}

        def loss(level: float) -> float:
            parts = [1 - entropy[level, i] / entropy[0.0, i] if entropy.get((0.0, i), 0.0) > 0 else 0.0 for i in range(len(qi))]
            return sum(parts) / len(qi)

        return [(1 / got[i]["s"] if i in got and got[i]["s"] else 0.0, 0.5 * loss(float(x["level"])) + 0.5 * (got[i]["gone"] or 0 if i in got else 0) / n) for i, x in enumerate(settings)]

    return evaluate


def grid_search(objectives: Objectives) -> dict:
    """The best of four settings by the sum of both objectives."""
    points = [{"k": k, "l": 2, "t": 0.3, "level": g} for k in (3, 10) for g in (0.3, 0.7)]
    values = objectives(points)
    return min(zip(points, values, strict=True), key=lambda x: (sum(x[1]), x[0]["k"]))[0]
