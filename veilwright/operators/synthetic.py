"""Differentially private synthetic data from noisy marginals.

Each marginal has its own noise stream. The whole budget is spent on every
column, so the composed budget of a table is epsilon times its columns; it is
returned by ``composed_epsilon`` and belongs in any report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durable import materialise
from ..functions.expressions import bin_left_closed
from ..functions.ranks import global_rank
from ..functions.rng import laplace, uniform
from .anonymize import is_numeric

BINS, BUCKETS = 20, 1000


def _check(epsilon: float) -> None:
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")


def composed_epsilon(epsilon: float, columns: list[str]) -> float:
    return epsilon * len(columns)


def _normalized(noisy: DataFrame) -> DataFrame:
    """Noise floored at 0; shares of the total, alike if that is 0."""
    floored = noisy.withColumn("noisy", F.greatest(F.lit(0.0), "noisy"))
    total = floored.agg(F.sum("noisy").alias("_t"), F.count(F.lit(1)).alias("_m"))
    p = F.when(F.col("_t") > 0, F.col("noisy") / F.col("_t")).otherwise(1 / F.col("_m"))
    return floored.join(F.broadcast(total)).withColumn("p", p).drop("_t", "_m")


def categorical_marginal(df: DataFrame, c: str, epsilon: float = 1.0, seed: int = 42) -> DataFrame:
    """Y2: (value, noisy, p)."""
    _check(epsilon)
    counts = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return _normalized(counts.select("value", (F.col("count") + laplace(seed, f"dp-{c}", F.col("value"), 1 / epsilon)).alias("noisy")))


def numeric_marginal(df: DataFrame, c: str, epsilon: float = 1.0, seed: int = 42, bins: int = BINS) -> DataFrame:
    """(bin, lo, hi, noisy, p) over equal bins from least to largest value, the last one closed; a constant column has one bin of +- .5."""
    _check(epsilon)
    x = F.col(c).cast("double")
    edge = df.agg(F.min(x).alias("a"), F.max(x).alias("b"))
    rows = df.filter(x.isNotNull()).select(x.alias("x")).join(F.broadcast(edge))
    counts = rows.groupBy(bin_left_closed(F.col("x"), F.col("a"), F.col("b"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = edge.filter("a IS NOT NULL").select("a", "b", F.explode(F.sequence(F.lit(0), F.when(F.col("a") < F.col("b"), F.lit(bins - 1)).otherwise(F.lit(0)))).alias("bin"))
    w = (F.col("b") - F.col("a")) / bins
    grid = grid.select("bin", F.when(F.col("a") < F.col("b"), F.col("a") + w * F.col("bin")).otherwise(F.col("a") - 0.5).alias("lo"), F.when(F.col("a") < F.col("b"), F.col("a") + w * (F.col("bin") + 1)).otherwise(F.col("a") + 0.5).alias("hi"))
    full = grid.join(counts, "bin", "left")
    return _normalized(full.select("bin", "lo", "hi", (F.coalesce("count", F.lit(0)) + laplace(seed, f"dp-{c}", F.col("bin"), 1 / epsilon)).alias("noisy")))


def _cells(marginal: DataFrame, order: str, keep: list[str]) -> DataFrame:
    """The marginal as intervals of [0, 1) by hundredths of buckets, so that a draw finds its interval by an equi-join."""
    from ..functions.ranks import prefix_sums

    run = prefix_sums(marginal.filter("p > 0"), [F.col(order)], {"_to": "p"})
    run = run.select(*keep, (F.col("_to") - F.col("p")).alias("_from"), "_to")
    last = F.least(F.lit(BUCKETS - 1), F.floor(F.col("_to") * BUCKETS).cast("int"))
    return run.withColumn("_bucket", F.explode(F.sequence(F.least(F.lit(BUCKETS - 1), F.floor(F.col("_from") * BUCKETS).cast("int")), last)))


def sample_marginal(ids: DataFrame, marginal: DataFrame, c: str, numeric: bool, seed: int = 42, key: str = "id") -> DataFrame:
    """``ids`` with a draw for each: the category, or a uniform number within the bin."""
    u = uniform(seed, f"sample-{c}", F.col(key))
    drawn = ids.withColumn("_u", u * (1 - 1e-12)).withColumn("_bucket", F.floor(F.col("_u") * BUCKETS).cast("int"))
    cells = _cells(marginal, "bin" if numeric else "value", ["lo", "hi"] if numeric else ["value"])
    hit = drawn.join(cells, "_bucket").filter((F.col("_u") >= F.col("_from") - 1e-15) & (F.col("_u") < F.col("_to")))
    value = F.col("lo") + uniform(seed, f"within-{c}", F.col(key)) * (F.col("hi") - F.col("lo")) if numeric else F.col("value")
    return hit.withColumn(c, value).drop("_u", "_bucket", "_from", "_to", "lo", "hi", "value")


def stratified_permutation(df: DataFrame, c: str, strata: list[str], key: str, seed: int = 42) -> DataFrame:
    """The values of ``c`` are shuffled within each stratum.

    Rows in the order of stratum and key meet values in the order of stratum and
    random number at the same position; no stratum is gathered in one task.
    """
    level = [F.col(s) for s in strata]
    a = global_rank(df.drop(c), [*level, F.col(key)], "_r")
    b = global_rank(df.select(*strata, key, c), [*level, uniform(seed, f"shuffle-{c}", F.col(key)), F.col(key)], "_r").select("_r", c)
    return a.join(b, "_r").select(*df.columns)


def generate(df: DataFrame, columns: list[str], others: list[str], n: int | None = None, epsilon: float = 1.0, seed: int = 42, strata: list[str] | None = None, key: str | None = None) -> DataFrame:
    """N rows with an id; ``columns`` from noisy marginals, shuffled within ``strata``; ``others`` from real rows, each at most once while n rows or fewer are asked for."""
    _check(epsilon)
    rows = df.count()
    n = rows if n is None else n
    out = df.sparkSession.range(n)
    for c in dict.fromkeys([*columns, *(strata or [])]):
        numeric = is_numeric(df, c)
        m = materialise((numeric_marginal if numeric else categorical_marginal)(df, c, epsilon, seed), f"marginal-{c}")
        out = sample_marginal(out, m, c, numeric, seed)
    out = materialise(out, "synthetic")
    for c in columns if strata else []:
        if c not in strata:
            out = materialise(stratified_permutation(out, c, strata, "id", seed), "shuffled")
    if others and rows:
        order = F.col(key) if key else F.xxhash64(*df.columns)
        real = global_rank(df.select(*others, order.alias("_k")), [uniform(seed, "resample", F.col("_k")), F.col("_k")], "_r").drop("_k")
        out = out.withColumn("_r", F.col("id") % rows + 1).join(real, "_r").drop("_r")
    return out.select("id", *dict.fromkeys([*columns, *(strata or []), *others]))


def self_check(synthetic: DataFrame, direct: list[str], n: int, epsilon: float) -> dict[str, bool]:
    """Y7."""
    missing = synthetic.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in synthetic.columns)).first()
    return {"no_identifiers": not set(direct) & set(synthetic.columns), "row_count": synthetic.count() == n, "few_nulls": all((missing[c] or 0) < 0.5 for c in synthetic.columns), "epsilon": epsilon > 0}


def apply_codebook(df: DataFrame, codebook: dict[str, dict[str, str]]) -> DataFrame:
    """<column>_lbl with the label of each code; codes of numeric columns are compared as numbers."""
    spark: SparkSession = df.sparkSession
    for c, labels in codebook.items():
        if c not in df.columns:
            continue
        book = spark.createDataFrame(sorted(labels.items()), "code string, label string")
        if is_numeric(df, c):
            on: Column = F.col(c).cast("double") == F.col("code").try_cast("double")
        else:
            on = F.col(c) == F.col("code")
        # A code book is written by hand.
        df = df.join(F.broadcast(book), on, "left").withColumn(f"{c}_lbl", F.col("label")).drop("code", "label")
    return df
