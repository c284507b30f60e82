"""Equivalence classes: the rows that share all quasi-identifier (QI) values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.durable import materialise
from ..functions.ranks import global_rank

KEEP, DROP = "keep", "drop"


def usable(df: DataFrame, qi: list[str], nulls: str = KEEP) -> DataFrame:
    """Rows that count: with ``drop``, those without a null QI only."""
    return df.dropna(subset=qi) if nulls == DROP else df


def equivalence_classes(df: DataFrame, qi: list[str], nulls: str = KEEP, sensitive: str | None = None) -> DataFrame:
    """(qi..., class_size[, n_distinct]): counts are combined before the shuffle, so a class with most rows costs no more."""
    aggs = [F.count(F.lit(1)).alias("class_size")]
    if sensitive:
        aggs.append(F.count_distinct(sensitive).alias("n_distinct"))
    return usable(df, qi, nulls).groupBy(*qi).agg(*aggs)


def numbered_classes(df: DataFrame, qi: list[str], nulls: str = KEEP) -> DataFrame:
    """Classes with an id from 0 in the order of their values."""
    ranked = global_rank(equivalence_classes(df, qi, nulls), [F.col(c) for c in qi], "equivalence_class")
    return ranked.withColumn("equivalence_class", F.col("equivalence_class") - 1)


def null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, (left[x].eqNullSafe(right[y]) for x, y in pairs))


def with_class_size(df: DataFrame, qi: list[str], name: str = "class_size", extra: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with the size of each row's class, and ``extra`` aggregates over the class.

    By aggregate and join rather than by a window: the aggregate is combined
    before the shuffle, and the join is broadcast if there are few classes, or
    else split by AQE where a class is large.
    """
    aggs = [F.count(F.lit(1)).alias(name), *(c.alias(k) for k, c in (extra or {}).items())]
    sizes = df.groupBy(*(F.col(c).alias(f"_vw_{c}") for c in qi)).agg(*aggs)
    return df.join(sizes, null_safe(df, sizes, [(c, f"_vw_{c}") for c in qi]), "left").drop(*(f"_vw_{c}" for c in qi))


def class_table(df: DataFrame, qi: list[str], nulls: str = KEEP, sensitive: str | None = None) -> DataFrame:
    """The classes, computed once for all metrics that read them."""
    return materialise(equivalence_classes(df, qi, nulls, sensitive), "classes")
