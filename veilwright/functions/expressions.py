"""Scalar expressions: binning, equality, similarity, status labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand for a missing value.
NULL_WORDS = ("na", "n/a", "null", "none", "nan", "missing", "unknown", "")


def clean_string(c: Column) -> Column:
    """Trimmed lower case; words for a missing value are null."""
    low = F.lower(F.trim(c.cast("string")))
    return F.when(~low.isin(*NULL_WORDS), low)


def bin_right_closed(x: Column, lo: Column, hi: Column, bins: int | Column) -> Column:
    """1..bins; edges belong to the bin below, the lowest value to the first; a constant column has bin 1."""
    width = (hi - lo) / bins
    return F.when(x.isNotNull(), F.when(width > 0, F.least(F.lit(bins) if isinstance(bins, int) else bins, F.greatest(F.lit(1), F.ceil((x - lo) / width).cast("int")))).otherwise(F.lit(1)))


def bin_left_closed(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0..bins-1; the highest value belongs to the last bin."""
    width = (hi - lo) / bins
    return F.when(x.isNotNull(), F.when(width > 0, F.least(F.lit(bins - 1), F.floor((x - lo) / width).cast("int"))).otherwise(F.lit(0)))


def numeric_diff(a: Column, b: Column) -> Column:
    """|a - b| / max(|a|, |b|, 1)."""
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0))


def numeric_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def numeric_close(a: Column, b: Column, pooled_std: Column | float) -> Column:
    """1 if the difference is at most 5 % of the pooled standard deviation; with no deviation, of 1.0."""
    std = F.lit(pooled_std) if isinstance(pooled_std, float) else pooled_std
    scale = F.when((std > 0) & ~F.isnan(std), std).otherwise(F.lit(1.0))
    return F.coalesce((F.abs(a - b) <= 0.05 * scale).cast("int"), F.lit(0))


def days_between(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def same_year(a: Column, b: Column) -> Column:
    return F.coalesce((F.year(a) == F.year(b)).cast("int"), F.lit(0))


def category_match(a: Column, b: Column) -> Column:
    """Equal without case and outer spaces; a missing value matches nothing."""
    return F.coalesce((clean_string(a) == clean_string(b)).cast("int"), F.lit(0))


def both_missing(a: Column, b: Column) -> Column:
    return (clean_string(a).isNull() & clean_string(b).isNull()).cast("int")


def min_max(x: Column, lo: Column, hi: Column) -> Column:
    """To 0..1; 0 for a constant column and for nulls."""
    return F.coalesce(F.when(hi > lo, (x - lo) / (hi - lo)), F.lit(0.0))


def cell_status(before: Column, after: Column) -> Column:
    """match, close (numbers at most 1 apart), changed or missing."""
    a, b = clean_string(before), clean_string(after)
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.when(a.isNull() | b.isNull(), "missing").when(a == b, "match").when(F.abs(x - y) <= 1, "close").otherwise("changed")


def attack_label(score: Column) -> Column:
    return F.when(score >= 0.7, "High").when(score >= 0.4, "Medium").otherwise("Low")


def entropy_term(p: Column) -> Column:
    """-p log2 p, with the small shift that keeps it finite at 0."""
    return -p * F.log2(p + 1e-10)


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation over the rows that have both; null, not an error, where either is constant."""
    x, y = a.cast("double"), b.cast("double")
    x, y = F.when(y.isNotNull() & ~F.isnan(y), x), F.when(x.isNotNull() & ~F.isnan(x), y)
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    # The deviation of a constant may be a rounding error above 0.
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies & ~F.isnan(r), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
