"""Utility and confidentiality of synthetic data compared with the real table."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.durable import materialise
from ..functions.ranks import global_rank, prefix_sums
from ..functions.rng import uniform
from .anonymize import is_numeric
from .neighbours import Tree


def tvd(a: DataFrame, b: DataFrame, c: str) -> DataFrame:
    """Half the sum of differences of the shares of values."""
    rows = a.select(F.col(c).cast("string").alias("v"), F.lit(1).alias("s")).unionByName(b.select(F.col(c).cast("string").alias("v"), F.lit(2).alias("s"))).filter("v IS NOT NULL")
    counts = rows.groupBy("v").agg(F.count_if(F.col("s") == 1).alias("x"), F.count_if(F.col("s") == 2).alias("y"))
    total = counts.agg(F.sum("x").alias("n"), F.sum("y").alias("m"))
    p, q = F.coalesce(F.try_divide(F.col("x"), F.col("n")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("y"), F.col("m")), F.lit(0.0))
    return counts.join(F.broadcast(total)).agg((0.5 * F.sum(F.abs(p - q))).alias("tvd"))


def ks(a: DataFrame, b: DataFrame, c: str) -> DataFrame:
    """Largest difference of the two distribution functions; 1 if either side is empty. Values are counted first, then summed up in order range by range."""
    rows = a.select(F.col(c).cast("double").alias("v"), F.lit(1).alias("s")).unionByName(b.select(F.col(c).cast("double").alias("v"), F.lit(2).alias("s"))).filter("v IS NOT NULL")
    counts = rows.groupBy("v").agg(F.count_if(F.col("s") == 1).alias("x"), F.count_if(F.col("s") == 2).alias("y"))
    counts = materialise(counts, "ks-values")
    total = counts.agg(F.coalesce(F.sum("x"), F.lit(0)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("m"))
    run = prefix_sums(counts, [F.col("v")], {"fx": "x", "fy": "y"})
    d = F.abs(F.try_divide(F.col("fx"), F.col("n")) - F.try_divide(F.col("fy"), F.col("m")))
    return run.join(F.broadcast(total)).agg(F.coalesce(F.max(d), F.lit(1.0)).alias("ks"))


def missingness(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """Y10."""
    def one(df: DataFrame, n: str) -> DataFrame:
        row = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols))
        return row.unpivot([], cols, "column", n)

    return one(a, "real").join(one(b, "synthetic"), "column").withColumn("difference", F.abs(F.col("real") - F.col("synthetic")))


def _design(df: DataFrame, cols: list[str], label: str):
    """A pipeline of label encoding, median imputation and standardisation."""
    from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler

    num = [c for c in cols if is_numeric(df, c)]
    cat = [c for c in cols if c not in num]
    df = df.withColumns({c: F.col(c).cast("double") for c in num} | {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cat})
    stages = []
    if cat:
        stages.append(StringIndexer(inputCols=cat, outputCols=[f"_i_{c}" for c in cat], stringOrderType="alphabetAsc", handleInvalid="keep"))
    if num:
        stages.append(Imputer(inputCols=num, outputCols=[f"_i_{c}" for c in num], strategy="median"))
    stages.append(VectorAssembler(inputCols=[f"_i_{c}" for c in cols], outputCol="_raw", handleInvalid="keep"))
    stages.append(StandardScaler(inputCol="_raw", outputCol="features", withMean=True))
    return df, stages


def propensity(real: DataFrame, synthetic: DataFrame, cols: list[str], c: float = 1.0, test_share: float = 0.2, seed: int = 42) -> dict:
    """Mean of (p - .5)^2 of a logistic regression that tells synthetic from real rows, with accuracies on a held-out share, a histogram of p, and a band."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    both = real.select(*cols, F.lit(0.0).alias("label")).unionByName(synthetic.select(*cols, F.lit(1.0).alias("label")))
    both = materialise(both.withColumn("_u", uniform(seed, "split", F.xxhash64("label", *cols))), "propensity")
    counts = {r["label"]: r["count"] for r in both.groupBy("label").count().collect()}
    n = sum(counts.values())
    weight = F.when(F.col("label") == 1, n / (2 * max(1, counts.get(1.0, 1)))).otherwise(n / (2 * max(1, counts.get(0.0, 1))))
    df, stages = _design(both.withColumn("w", weight), cols, "label")
    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="w", regParam=1 / (c * max(1, n)), standardization=False, maxIter=100)
    train = df.filter(F.col("_u") >= test_share) if test_share > 0 else df
    model = Pipeline(stages=[*stages, lr]).fit(train)
    scored = model.transform(df).select("label", "_u", vector_to_array("probability")[1].alias("p"), "prediction")
    scored = materialise(scored, "propensity-scores")
    right = F.avg((F.col("prediction") == F.col("label")).cast("double"))
    u = scored.agg(F.avg(F.pow(F.col("p") - 0.5, F.lit(2)))).first()[0]
    test = scored.filter(F.col("_u") < test_share).agg(right).first()[0] if test_share > 0 else None
    train_acc = scored.filter(F.col("_u") >= test_share).agg(right).first()[0]
    band = "excellent" if u < 0.01 else "good" if u < 0.05 else "moderate" if u < 0.1 else "poor"
    histogram = scored.groupBy(F.least(F.lit(29), F.floor(F.col("p") * 30).cast("int")).alias("bin"), "label").count()
    return {"u": u, "band": band, "accuracy_train": train_acc, "accuracy_test": test, "scores": scored.drop("_u"), "histogram": histogram}


def nndr(real: DataFrame, synthetic: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and least distance to the nearest real row, from all real rows (not themselves) and from all synthetic rows, and their ratio.

    Columns are standardised by the real table. Distances are found once for each
    distinct tuple and weighted by its rows; a real tuple of several rows, and a
    synthetic one that is also real, are at distance 0. Nearest tuples come from a
    tree of boxes, so that rows far from all real ones meet the nearest boxes only.
    """
    value = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in cols}
    stats = real.agg(*(f(value[c]).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    xs = [f"x{i}" for i in range(len(cols))]

    def scaled(df: DataFrame, is_real: int) -> DataFrame:
        mean = {c: stats[f"m_{c}"] or 0.0 for c in cols}
        # Adding 0 makes one of the two zeros.
        return df.select(*(((F.coalesce(value[c], F.lit(mean[c])) - mean[c]) / (stats[f"s_{c}"] or 1.0) + 0.0).alias(x) for c, x in zip(cols, xs, strict=True)), F.lit(is_real).alias("is_real"))

    both = scaled(real, 1).unionByName(scaled(synthetic, 0))
    points = both.groupBy(*xs).agg(F.sum("is_real").alias("nr"), F.sum(1 - F.col("is_real")).alias("ns"))
    points = materialise(points.select(F.monotonically_increasing_id().alias("id"), F.array(*xs).alias("v"), "nr", "ns"), "nndr-points")
    others = Tree(points.filter("nr > 0")).nearest(points.filter("nr <= 1").select(F.col("id").alias("q"), "v"), 1)
    near = points.join(others.select(F.col("q").alias("id"), F.sqrt("d2").alias("d")), "id", "left")
    near = near.withColumns({"real": F.when(F.col("nr") > 1, 0.0).when(F.col("nr") == 1, F.col("d")), "synthetic": F.when(F.col("ns") > 0, F.when(F.col("nr") > 0, 0.0).otherwise(F.col("d")))})
    out = near.agg(*(f for side, n in (("real", "nr"), ("synthetic", "ns")) for f in (F.try_divide(F.sum(F.col(side) * F.col(n)), F.sum(F.when(F.col(side).isNotNull(), F.col(n)))).alias(f"{side}_mean"), F.min(side).alias(f"{side}_least"))))
    return out.withColumn("ratio", F.try_divide(F.col("synthetic_mean"), F.col("real_mean")))


def canonical_correlations(pairs: DataFrame, left: list[str], right: list[str], most: int = 10) -> list[float]:
    """From the covariances of both sides, one aggregate; the rest is linear algebra on as many rows as columns."""
    cols = [*left, *right]
    items = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = pairs.agg(*(F.covar_pop(F.col(cols[i]).cast("double"), F.col(cols[j]).cast("double")).alias(f"{i}_{j}") for i, j in items)).first()
    s = np.zeros((len(cols), len(cols)))
    for i, j in items:
        s[i, j] = s[j, i] = row[f"{i}_{j}"] or 0.0
    p = len(left)

    def root(m: np.ndarray) -> np.ndarray:
        w, v = np.linalg.eigh(m)
        inv = np.where(w > 1e-10 * max(1.0, w.max(initial=0)), 1 / np.sqrt(np.maximum(w, 1e-300)), 0)
        return v @ np.diag(inv) @ v.T

    rho = np.linalg.svd(root(s[:p, :p]) @ s[:p, p:] @ root(s[p:, p:]), compute_uv=False)
    return [float(min(1.0, x)) for x in rho[: min(most, p, len(cols) - p)]]


def cm3(real: DataFrame, synthetic: DataFrame, cols: list[str]) -> dict:
    """Per column, both tables in the order of that column are paired by position and CM2 = prod(1 - rho^2) is taken; CM3 is the least of them. None with fewer than two numeric columns."""
    cols = [c for c in cols if is_numeric(real, c)]
    if len(cols) < 2:
        return {"cm3": None, "cm2": {}, "min_column": None, "band": None, "note": "at least two numeric columns are needed"}
    def filled(df: DataFrame, side: str) -> DataFrame:
        means = df.agg(*(F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(f"m_{c}") for c in cols))
        return df.select(*cols).join(F.broadcast(means)).select(*(F.coalesce(F.col(c).cast("double"), F.col(f"m_{c}")).alias(f"{side}_{c}") for c in cols))

    x, y = materialise(filled(real, "x"), "cm3-real"), materialise(filled(synthetic, "y"), "cm3-synthetic")
    cm2 = {}
    for c in cols:
        # Ties by the other columns; rows that are equal in all may change places.
        a, b = (global_rank(t, [F.col(f"{side}_{k}") for k in [c, *(x for x in cols if x != c)]], "_r") for t, side in ((x, "x"), (y, "y")))
        rho = canonical_correlations(a.join(b, "_r"), x.columns, y.columns)
        cm2[c] = float(reduce(lambda p, r: p * (1 - r * r), rho, 1.0))
    low = min(cm2, key=lambda k: (cm2[k], k))
    band = "high" if cm2[low] >= 0.75 else "medium" if cm2[low] >= 0.4 else "low"
    return {"cm3": cm2[low], "cm2": cm2, "min_column": low, "band": band, "note": None}


def report(real: DataFrame, synthetic: DataFrame, columns: list[str], epsilon: float, seed: int = 42) -> dict:
    """Parameters, distance per column, missingness, propensity, confidentiality, and the data of the charts."""
    num = [c for c in columns if is_numeric(real, c)]
    per = {c: ks(real, synthetic, c).first()[0] if c in num else tvd(real, synthetic, c).first()[0] for c in columns}
    p = propensity(real, synthetic, columns, seed=seed)
    return {
        "parameters": {"epsilon": epsilon, "composed_epsilon": epsilon * len(columns), "seed": seed},
        "utility": per,
        "missingness": {r["column"]: r["difference"] for r in missingness(real, synthetic, columns).collect()},
        "propensity": {k: p[k] for k in ("u", "band", "accuracy_train", "accuracy_test")},
        "propensity_histogram": [(r["bin"], r["label"], r["count"]) for r in p["histogram"].orderBy("bin", "label").collect()],
        "nndr": nndr(real, synthetic, num).first().asDict() if num else None,
        "confidentiality": cm3(real, synthetic, num),
    }
