"""Re-identification risk, read from the table of equivalence classes.

Every metric is an aggregate over classes, not rows: the classes are computed
once, and their number is what the second step grows with.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.durable import materialise
from ..functions.ranks import prefix_sums
from .classes import DROP, KEEP, equivalence_classes, null_safe, usable

def _s() -> Column:
    return F.col("class_size")


def size_level(s: Column) -> Column:
    return F.when(s == 1, "CRITICAL").when(s < 3, "HIGH").when(s < 5, "MEDIUM").otherwise("LOW")


def k_metrics(df: DataFrame, qi: list[str], nulls: str = KEEP) -> DataFrame:
    """k, largest, mean and median class, classes, singletons and their share of records and of classes, level."""
    out = equivalence_classes(df, qi, nulls).agg(
        F.min(_s()).alias("k"),
        F.max(_s()).alias("max_size"),
        F.avg(_s()).alias("avg_size"),
        F.percentile(_s(), F.lit(0.5)).alias("median_size"),
        F.count(F.lit(1)).alias("total_classes"),
        F.count_if(_s() == 1).alias("unique_records"),
        F.sum(_s()).alias("total_records"),
    )
    pct = F.round(100 * F.col("unique_records") / F.col("total_records"), 2)
    level = F.when((F.col("k") == 1) & (pct >= 50), "CRITICAL").when((F.col("k") == 1) & (pct >= 20), "HIGH").when((F.col("k") <= 2) & (pct >= 10), "MEDIUM").otherwise("LOW")
    return out.select("*", pct.alias("unique_record_pct"), F.round(100 * F.col("unique_records") / F.col("total_classes"), 2).alias("unique_class_pct"), level.alias("risk_level"))


def validated(df: DataFrame, qi: list[str], nulls: str = KEEP) -> DataFrame:
    """The metrics of ``k_metrics`` with a level by k alone, UNDEFINED for a table without classes, and what it means; the riskiest classes are ``riskiest_classes``."""
    x = k_metrics(df, qi, nulls).drop("risk_level").withColumn("k", F.coalesce("k", F.lit(0)))
    k = F.col("k")
    level = F.when(k == 0, "UNDEFINED").when(k == 1, "CRITICAL").when(k < 3, "HIGH").when(k < 5, "MEDIUM").otherwise("LOW")
    share = F.format_string("%.2f", F.coalesce("unique_record_pct", F.lit(0.0)))
    told = F.when(k == 0, "no class of records").when(k == 1, F.concat(share, F.lit(" % of the records are unique"))).otherwise(F.concat(F.lit("every record shares its class with at least "), (k - 1).cast("string"), F.lit(" others")))
    return x.withColumns({"risk_level": level, "description": told})


def riskiest_classes(df: DataFrame, qi: list[str], n: int = 10, nulls: str = KEEP) -> DataFrame:
    """The n smallest classes with a level each; ties by the QI values."""
    return equivalence_classes(df, qi, nulls).withColumn("risk_level", size_level(_s())).orderBy(_s(), *(F.col(c).asc_nulls_first() for c in qi)).limit(n)


def combination_search(df: DataFrame, qi: list[str], most: int = 3, nulls: str = KEEP) -> DataFrame:
    """Risk of every combination of 1..most QIs, by one GROUPING SETS over the classes of all QIs."""
    sets = [c for m in range(1, min(most, len(qi)) + 1) for c in combinations(qi, m)]
    base = usable(df, qi, nulls).groupBy(*qi).agg(F.count(F.lit(1)).alias("n"))
    cols = [F.col(c) for c in qi]
    by_set = base.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(F.sum("n").alias("class_size"), F.grouping_id(*cols).alias("gid"))
    names = {sum(1 << (len(qi) - 1 - i) for i, c in enumerate(qi) if c not in s): s for s in sets}
    named = F.create_map(*[x for g, s in names.items() for x in (F.lit(g), F.lit(",".join(s)))])
    out = by_set.groupBy("gid").agg(F.min(_s()).alias("k_min"), F.count_if(_s() == 1).alias("unique_groups"), F.count(F.lit(1)).alias("total_groups"), F.avg(_s()).alias("avg_size"), F.max(_s()).alias("max_size"))
    out = out.withColumn("combination", F.element_at(named, F.col("gid").cast("int"))).withColumn("n_columns", F.size(F.split("combination", ",")))
    pct = F.round(100 * F.col("unique_groups") / F.col("total_groups"), 2)
    k = F.col("k_min")
    level = F.when((k == 1) & (pct >= 50), "CRITICAL").when((k == 1) & (pct >= 20), "HIGH").when((k <= 2) & (pct >= 10), "MEDIUM").otherwise("LOW")
    return out.select("combination", "n_columns", "k_min", pct.alias("unique_class_pct"), "total_groups", "avg_size", "max_size", "unique_groups", level.alias("risk_level")).orderBy("k_min", F.desc("unique_class_pct"), "combination")


def l_diversity(df: DataFrame, qi: list[str], sensitive: str, nulls: str = KEEP) -> DataFrame:
    """Distinct non-null sensitive values per class, and the least."""
    return equivalence_classes(df, qi, nulls, sensitive).withColumnRenamed("n_distinct", "l_value")


def l_summary(df: DataFrame, qi: list[str], sensitive: str, nulls: str = KEEP) -> DataFrame:
    x = l_diversity(df, qi, sensitive, nulls)
    return x.agg(F.min("l_value").alias("l_min"), F.avg("l_value").alias("l_avg"), F.count(F.lit(1)).alias("total_classes"), F.count_if(F.col("l_value") < 2).alias("homogeneous_classes"))


def worst_l(df: DataFrame, qi: list[str], sensitive: str, n: int = 20) -> DataFrame:
    return l_diversity(df, qi, sensitive).orderBy("l_value", *qi).limit(n)


def size_histogram(df: DataFrame, qi: list[str], nulls: str = KEEP) -> DataFrame:
    return equivalence_classes(df, qi, nulls).groupBy("class_size").agg(F.count(F.lit(1)).alias("n_classes"))


def risk_profile(df: DataFrame, qi: list[str], sensitive: str, nulls: str = DROP) -> DataFrame:
    """One row with all class-based risks: summary, uniqueness, prosecutor, journalist, marketer, attribute, linkage, overall."""
    n, e = F.col("n"), F.col("n_classes")
    base = equivalence_classes(df, qi, nulls, sensitive)
    # The population terms need n, the sum of the sizes: one row, joined by broadcast.
    total = usable(df, qi, nulls).agg(F.count(F.lit(1)).alias("n"))
    one = F.pow((n - 1) / n, n)
    two = F.pow((n - 2) / n, n)
    out = base.join(F.broadcast(total)).groupBy("n").agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.min(_s()).alias("min_group_size"),
        F.avg(_s()).alias("avg_group_size"),
        F.max(_s()).alias("max_group_size"),
        F.avg((_s() < 5).cast("double")).alias("rare_combinations_ratio"),
        F.sum(F.when(_s() == 1, 1 - one).when(_s() == 2, 0.5 * (1 - two)).otherwise(1 / _s())).alias("pop"),
        F.sum(F.when(_s() <= 5, _s()).otherwise(0)).alias("small"),
        F.sum(F.pow(_s() / n, F.lit(2))).alias("gini"),
        F.max((F.col("n_distinct") < 2).cast("int")).alias("homogeneous"),
        F.max(F.when(F.col("n_distinct") == 1, F.least(F.lit(1.0), _s() / 10)).otherwise(0.0)).alias("attribute_disclosure_risk"),
        F.min("n_distinct").alias("sensitive_distinct_min"),
    )
    out = out.withColumns(
        {
            "unique_records_ratio": e / n,
            "population_uniqueness": F.least(F.lit(1.0), F.col("pop") / n),
            "prosecutor_risk": F.least(F.lit(1.0), 10 * e / n),
            "journalist_risk": F.col("small") / n,
            "marketer_risk": F.when(n <= 1, 0.0).otherwise(F.least(F.lit(1.0), 1 - F.col("gini") + F.when(F.col("homogeneous") == 1, 0.3).otherwise(0.0))),
            "linkage_risk": F.least(F.lit(1.0), e / n * min(2.0, 1 + 0.1 * (len(qi) - 1))),
        }
    )
    overall = 0.25 * F.col("prosecutor_risk") + 0.2 * F.col("journalist_risk") + 0.15 * F.col("marketer_risk") + 0.2 * F.col("attribute_disclosure_risk") + 0.2 * F.col("linkage_risk")
    return out.withColumn("overall_risk", overall).drop("pop", "small", "gini", "homogeneous")


def column_uniqueness(df: DataFrame, qi: list[str]) -> DataFrame:
    """Distinct values over rows of each QI, and of all, by one wide aggregate."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_distinct(c).alias(c) for c in qi))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n_unique"), (F.col(c) / F.col("n")).alias("unique_ratio")) for c in qi))).alias("x")).select("x.*")


def constraint_checks(df: DataFrame, qi: list[str], sensitive: str | None = None, k: int = 5, l: int = 2, t: float = 0.3, distance: str = "tvd", nulls: str = KEEP) -> DataFrame:  # noqa: E741
    """(constraint, required, actual, compliant_classes, total_classes, rate, valid) for k, and for l and t with a sensitive column."""
    def summary(x: DataFrame, name: str, need: float, value: Column, good: Column, worst) -> DataFrame:
        got = x.agg(worst(value).cast("double").alias("actual"), F.count_if(good).alias("compliant_classes"), F.count(F.lit(1)).alias("total_classes"))
        rate = F.col("compliant_classes") / F.col("total_classes")
        return got.select(F.lit(name).alias("constraint"), F.lit(float(need)).alias("required"), "actual", "compliant_classes", "total_classes", rate.alias("rate"), (F.col("compliant_classes") == F.col("total_classes")).alias("valid"))

    out = summary(equivalence_classes(df, qi, nulls), "k_anonymity", k, _s(), k <= _s(), F.min)
    if sensitive:
        d = F.col("l_value")
        out = out.unionByName(summary(l_diversity(df, qi, sensitive, nulls), "l_diversity", l, d, d >= l, F.min))
        x = F.col("distance")
        out = out.unionByName(summary(class_distances(df, qi, sensitive, distance, nulls), "t_closeness", t, x, x <= t + 1e-12, F.max))
    return out


#: Distinct sensitive values that are sent to tasks; with more of them the EMD is merged in ranges.
FEW_VALUES = 100_000


def class_distances(df: DataFrame, qi: list[str], sensitive: str, kind: str = "tvd", nulls: str = KEEP, few: int = FEW_VALUES) -> DataFrame:
    """(qi..., class_size, distance) of each class's sensitive distribution to that of all rows; null values don't count.

    tvd: half the sum of |p - q|. A class is joined to the values that it has;
    those it lacks add their q, in all 1 less the sum of q over those it has.
    emd: the sum of |P - Q| over the ordered values (numbers by size, others by
    name), divided by 2 (m - 1), by 2 if m is 1, at most 1; see ``_emd``.
    """
    keys = [f"_k{i}" for i in range(len(qi))]
    # Under names of their own, no column of the table clashes with those made here.
    rows = usable(df, qi, nulls).select(*(F.col(c).alias(k) for c, k in zip(qi, keys, strict=True)), F.col(sensitive).alias("_v")).filter("_v IS NOT NULL")
    cells = materialise(rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")), "cells")
    total = cells.agg(F.sum("_c").alias("_n"))
    values = cells.groupBy(F.col("_v").alias("_w")).agg(F.sum("_c").alias("_g")).join(F.broadcast(total))
    if kind == "emd":
        # A class has at most as many cells as there are values.
        small = values.limit(few + 1).count() <= few
        out = (_emd_of_few if small else _emd)(_sized(cells, keys), values, keys)
    else:
        q = values.select("_w", (F.col("_g") / F.col("_n")).alias("_q"))
        p = F.col("_c") / F.col("_s")
        x = _sized(cells, keys).join(q, F.col("_v") == F.col("_w"))
        out = x.groupBy(*keys, "_s").agg((0.5 * (F.sum(F.abs(p - F.col("_q"))) + 1 - F.sum("_q"))).alias("_d"))
    return out.select(*(F.col(k).alias(c) for c, k in zip(qi, keys, strict=True)), F.col("_s").alias("class_size"), F.col("_d").alias("distance"))


def _sized(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``cells`` with the rows _s of their class."""
    own = [f"_o{i}" for i in range(len(keys))]
    sizes = cells.groupBy(*(F.col(k).alias(o) for k, o in zip(keys, own, strict=True))).agg(F.sum("_c").alias("_s"))
    return cells.join(sizes, null_safe(cells, sizes, list(zip(keys, own, strict=True)))).drop(*own)


def _order() -> list[Column]:
    return [F.coalesce(F.col("_w").cast("string").try_cast("double"), F.lit(0.0)), F.col("_w").cast("string")]


def _emd_of_few(cells: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., _s, _d) where the values are few enough for every task: one sort of each class's cells, no other.

    Between two values that a class has next to each other its own share P is
    constant, so the sum of |P - Q| over the values between follows from the running
    sum of Q at both ends and at the place where Q passes P.
    """
    ordered = values.orderBy(*_order()).select("_w", "_g", "_n").collect()
    ranks = cells.sparkSession.createDataFrame([(r["_w"], i) for i, r in enumerate(ordered)], T.StructType([T.StructField("_w", values.schema["_w"].dataType), T.StructField("_r", T.LongType())]))
    q = np.cumsum([r["_g"] for r in ordered], dtype=float) / (ordered[0]["_n"] if ordered else 1)
    sums = np.r_[0.0, np.cumsum(q)]
    m = len(q)
    by = Window.partitionBy(*keys).orderBy("_r")
    x = cells.join(F.broadcast(ranks), F.col("_v") == F.col("_w"))
    x = x.select(*keys, "_s", F.col("_r").alias("_from"), F.lead("_r", 1, m).over(by).cast("long").alias("_to"), (F.row_number().over(by) == 1).alias("_first"), (F.sum("_c").over(by.rowsBetween(Window.unboundedPreceding, 0)) / F.col("_s")).alias("_p"))

    schema = T.StructType([*(x.schema[k] for k in keys), x.schema["_s"], T.StructField("_x", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low, high, p, first = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_from", "_to", "_p", "_first"))
            at = np.clip(np.searchsorted(q, p, side="right"), low, high)
            part = p * (at - low) - (sums[at] - sums[low]) + (sums[high] - sums[at]) - p * (high - at)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), b.column("_s"), pa.array(part + np.where(first, sums[low], 0.0))], names=[f.name for f in schema.fields])

    return x.mapInArrow(run, schema).groupBy(*keys, "_s").agg(F.least(F.lit(1.0), F.sum("_x") / (2 * max(1, m - 1))).alias("_d"))


def _emd(cells: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """As ``_emd_of_few`` for any number of values: Q's place for P comes from a merge of all P and Q in ranges of their order.

    Work and shuffles follow the number of (class, value) cells; nothing is sent along
    with every class. Cells of one share are dealt over ranges by a hash of their class.
    """
    ranked = prefix_sums(values.withColumn("_one", F.lit(1).cast("long")), _order(), {"_G": "_g", "_r": "_one"})
    ranked = materialise(ranked.select("_w", "_r", (F.col("_G") / F.col("_n")).alias("_Q")), "emd-values")
    ranked = materialise(prefix_sums(ranked, [F.col("_r")], {"_A": "_Q"}), "emd-sums")
    ends = ranked.agg(F.coalesce(F.max("_r"), F.lit(0)).alias("m"), F.coalesce(F.max("_A"), F.lit(0.0)).alias("all")).first()
    x = cells.join(ranked, F.col("_v") == F.col("_w")).drop("_v", "_w").withColumn("_one", F.lit(1).cast("long"))
    x = materialise(prefix_sums(x, [*(F.col(k) for k in keys), F.col("_r")], {"_cum": "_c", "_pos": "_one"}), "emd-cells")
    own = [f"_o{i}" for i in range(len(keys))]
    first = x.groupBy(*(F.col(k).alias(o) for k, o in zip(keys, own, strict=True))).agg(F.min(F.col("_cum") - F.col("_c")).alias("_start"), F.min(F.struct("_r", (F.col("_A") - F.col("_Q")).alias("before"))).alias("_first"))
    first = materialise(first, "emd-classes")
    later = x.select((F.col("_pos") - 1).alias("_p"), (F.col("_r") - 1).alias("_to"), (F.col("_A") - F.col("_Q")).alias("_A_to"), *(F.col(k).alias(f"_l{i}") for i, k in enumerate(keys)))
    y = x.join(first, null_safe(x, first, list(zip(keys, own, strict=True)))).drop(*own, "_first")
    y = y.join(later, (F.col("_pos") == F.col("_p")) & null_safe(y, later, [(k, f"_l{i}") for i, k in enumerate(keys)]), "left")
    y = y.select(
        *keys, "_s", (F.col("_r") - 1).alias("_from"), (F.col("_A") - F.col("_Q")).alias("_A_from"), F.coalesce("_to", F.lit(ends["m"])).alias("_to"), F.coalesce("_A_to", F.lit(ends["all"])).alias("_A_to"),
        ((F.col("_cum") - F.col("_start")) / F.col("_s")).alias("_at"), F.lit(0).cast("long").alias("_q"), F.lit(0.0).alias("_share"),
    )
    points = ranked.select(F.col("_Q").alias("_at"), F.lit(1).cast("long").alias("_q"), F.col("_Q").alias("_share"))
    both = y.unionByName(points, allowMissingColumns=True)
    # Points before cells of the same share, as Q <= P counts as passed; it changes no sum.
    merged = prefix_sums(both, [F.col("_at"), -F.col("_q"), F.xxhash64(*keys)], {"_x": "_q", "_A_x": "_share"}).filter("_q = 0")
    low, high, p = F.col("_from"), F.col("_to"), F.col("_at")
    split = F.least(F.greatest(F.col("_x"), low), high)
    at_split = F.when(F.col("_x") <= low, F.col("_A_from")).when(F.col("_x") >= high, F.col("_A_to")).otherwise(F.col("_A_x"))
    part = p * (split - low) - (at_split - F.col("_A_from")) + (F.col("_A_to") - at_split) - p * (high - split)
    sums = merged.groupBy(*keys, "_s").agg(F.sum(part).alias("_sum"))
    out = sums.join(first, null_safe(sums, first, list(zip(keys, own, strict=True))))
    total = F.col("_sum") + F.col("_first.before")
    return out.select(*keys, "_s", F.least(F.lit(1.0), total / (2 * max(1, ends["m"] - 1))).alias("_d"))


def suppression_ratio(df: DataFrame, qi: list[str], star: str = "*") -> DataFrame:
    """Share of QI cells that are suppressed."""
    cells = sum((F.sum((F.col(c).cast("string") == star).cast("int")) for c in qi), F.lit(0))
    return df.agg(F.coalesce(F.try_divide(cells, F.count(F.lit(1)) * len(qi)), F.lit(0.0)).alias("suppression_ratio"))


def improvement(before: Column, after: Column) -> Column:
    return F.greatest(F.lit(0.0), before - after)


def compare(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per column: distinct values before and after, nulls, suppressed and generalised cells, changed cells; rows are matched by ``key``."""
    a = before.select(F.col(key).alias("_ka"), *(F.col(c).cast("string").alias(f"a_{c}") for c in columns))
    b = after.select(F.col(key).alias("_kb"), *(F.col(c).cast("string").alias(f"b_{c}") for c in columns))
    both = a.join(b, F.col("_ka").eqNullSafe(F.col("_kb")))

    def one(c: str) -> Column:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        return F.struct(
            F.lit(c).alias("column"),
            F.count_distinct(x).alias("unique_before"),
            F.count_distinct(y).alias("unique_after"),
            F.count_if(x.isNull()).alias("nulls_before"),
            F.count_if(y.isNull()).alias("nulls_after"),
            F.count_if(y == "*").alias("suppressed"),
            F.count_if(y.rlike(r"^\d+-\d+|^Range_|^Level_|^Bin_")).alias("generalized"),
            F.count_if(~x.eqNullSafe(y)).alias("changed"),
        )

    return both.agg(F.array(*(one(c) for c in columns)).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def modified_rows(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with any change, and by how much the number of distinct combinations fell, in per cent."""
    a = before.select(F.col(key).alias("_ka"), F.struct(*(F.col(c).cast("string").alias(c) for c in columns)).alias("a"))
    b = after.select(F.col(key).alias("_kb"), F.struct(*(F.col(c).cast("string").alias(c) for c in columns)).alias("b"))
    both = a.join(b, F.col("_ka").eqNullSafe(F.col("_kb")))
    out = both.agg(F.count_if(F.col("a") != F.col("b")).alias("modified_rows"), F.count_distinct("a").alias("combinations_before"), F.count_distinct("b").alias("combinations_after"))
    return out.withColumn("combination_reduction_pct", F.round(100 * (1 - F.col("combinations_after") / F.col("combinations_before")), 2))


def rare_values_ratio(df: DataFrame, qi: list[str]) -> DataFrame:
    """Values with fewer rows than min(5, max(1, 5 % of rows)), over all values of the QIs."""
    n = df.agg(F.count(F.lit(1)).alias("n"))
    long = df.select(*(F.col(c).cast("string").alias(c) for c in qi)).unpivot([], qi, "column", "value").filter("value IS NOT NULL")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(n))
    limit = F.least(F.lit(5.0), F.greatest(F.lit(1.0), 0.05 * F.col("n")))
    return counts.agg(F.coalesce(F.try_divide(F.count_if(F.col("c") < limit), F.count(F.lit(1))), F.lit(0.0)).alias("rare_values_ratio"))


def categorical_risk(df: DataFrame, qi: list[str]) -> DataFrame:
    """Per categorical QI the mean of a band of its uniqueness and one of its cardinality."""
    x = column_uniqueness(df, qi)
    u, n = F.col("unique_ratio"), F.col("n_unique")
    by_ratio = F.when(u < 0.01, 0.3).when(u < 0.05, 0.4).when(u < 0.2, 0.8).otherwise(F.least(F.lit(1.0), 2 * u))
    by_count = F.when(n <= 3, 0.3).when(n <= 10, 0.6).when(n <= 50, 0.8).otherwise(1.0)
    return x.select("column", "n_unique", "unique_ratio", ((by_ratio + by_count) / 2).alias("risk_score"))
