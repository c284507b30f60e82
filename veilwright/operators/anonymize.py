"""Anonymisation transforms. QIs become strings; suppressed cells are '*'.

Each is a lazy DataFrame transform. Row counts of values and classes come from
aggregates joined back (see ``with_class_size``), positions in an order from
``global_rank``; random choices are functions of the row's key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.durable import materialise
from ..functions.expressions import bin_right_closed, correlation
from ..functions.ranks import column_values, exact_quantiles, global_rank, prefix_sums
from ..functions.rng import laplace, uniform
from .classes import equivalence_classes, null_safe, with_class_size

STAR, OTHER = "*", "Other"
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")

TRANSFORMS: dict[str, Callable[..., DataFrame]] = {}


def register_transform(name: str, fn: Callable[..., DataFrame]) -> None:
    """Make ``fn(df, **parameters)`` known to pipelines under ``name``."""
    TRANSFORMS[name] = fn


def transform(name: str) -> Callable:
    def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        register_transform(name, fn)
        return fn

    return add


def is_numeric(df: DataFrame, c: str) -> bool:
    kind = dict(df.dtypes)[c]
    return kind in NUMERIC or kind.startswith("decimal")


def as_strings(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


def value_share(df: DataFrame, c: str, name: str = "_share") -> DataFrame:
    """``df`` with the share of rows that have the row's value of ``c``, among rows with a value."""
    counts = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    shares = counts.join(F.broadcast(total)).select("_v", (F.col("_c") / F.col("_n")).alias(name))
    return df.join(shares, F.col(c) == F.col("_v"), "left").drop("_v")


@transform("generalization")
def generalize_rare(df: DataFrame, cols: list[str], threshold: float = 0.05, label: str = OTHER) -> DataFrame:
    """A1: values with less than ``threshold`` of the rows become 'Other'."""
    for c in cols:
        df = value_share(as_strings(df, [c]), c)
        df = df.withColumn(c, F.when(F.col("_share") < threshold, label).otherwise(F.col(c))).drop("_share")
    return df


def suppress_rare(df: DataFrame, cols: list[str], threshold: float = 0.05) -> DataFrame:
    """A4: the same with '*'."""
    return generalize_rare(df, cols, threshold, STAR)


def _bounds(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.agg(*(f(F.col(c).cast("double")).alias(f"_{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))))


@transform("bucketization")
def numeric_binning(df: DataFrame, cols: list[str], bins: int = 5, prefix: str = "Bin_") -> DataFrame:
    """A2: equal widths, right-closed, labels from 0; a constant column has the single bin 0."""
    out = df.join(F.broadcast(_bounds(df, cols)))
    for c in cols:
        i = bin_right_closed(F.col(c).cast("double"), F.col(f"_lo_{c}"), F.col(f"_hi_{c}"), bins) - 1
        out = out.withColumn(c, F.when(F.col(c).isNotNull(), F.concat(F.lit(prefix), i.cast("string"))))
    return out.drop(*(f"_{n}_{c}" for c in cols for n in ("lo", "hi")))


def custom_ranges(df: DataFrame, c: str, ranges: list[tuple[float, float]]) -> DataFrame:
    """A3: the first inclusive range gives 'lo-hi', else 'Other'; nulls stay."""
    x = F.col(c).cast("double")
    label = F.when(x.isNull(), None)
    for lo, hi in ranges:
        label = label.when((x >= lo) & (x <= hi), f"{lo}-{hi}")
    return df.withColumn(c, label.otherwise(OTHER))


def level_bins(level: float) -> int:
    return max(2, int(10 * (1 - level) + 2))


def generalize_level(df: DataFrame, qi: list[str], level: float, numeric: list[str] | None = None, by_row: bool = False) -> DataFrame:
    """A5: one step of generalisation at 0 < level <= 1.

    Numbers become ``level_bins`` equal ranges 'Range_i'; ordinal strings (those
    that are numbers) with more than 5 values get equal-frequency 'Level_i' of
    ``max(3, int(u * (1 - 0.7 level)))`` levels; others lose values with fewer
    rows than max(1, n (0.2 - 0.15 level)) to 'Other'. Levels are a function of the
    value, by the rows up to it; ``by_row`` cuts by row number instead, as equal
    values may then part.
    """
    for c in qi:
        if numeric is not None and c in numeric or numeric is None and is_numeric(df, c):
            df = numeric_binning(df, [c], level_bins(level), "Range_")
            continue
        df = as_strings(df, [c])
        facts = df.agg(F.count_distinct(c).alias("u"), F.avg(F.when(F.col(c).isNotNull(), F.col(c).try_cast("double").isNotNull().cast("double"))).alias("num"), F.count(c).alias("n")).first()
        if (facts["num"] or 0) > 0.8 and facts["u"] > 5:
            df = equal_frequency(df, c, max(3, int(facts["u"] * (1 - 0.7 * level))), by_row)
        else:
            least = max(1.0, facts["n"] * (0.2 - 0.15 * level))
            counts = df.groupBy(F.col(c).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
            df = df.join(counts, F.col(c) == F.col("_v"), "left").withColumn(c, F.when(F.col("_c") < least, OTHER).otherwise(F.col(c))).drop("_v", "_c")
    return df


def frequency_level(r: Column, n: Column, q: int | Column) -> Column:
    """0-based level of 1-based row number r among n, in q levels: max(1, ceil((r - 1) q / (n - 1))) - 1, in integers."""
    num = (F.lit(q) if isinstance(q, int) else q).cast("long") * (r - 1)
    den = F.greatest(F.lit(1).cast("long"), n - 1)
    ceil = F.floor((num + den - 1) / den)
    return F.greatest(F.lit(1), ceil).cast("int") - 1


def equal_frequency(df: DataFrame, c: str, levels: int, by_row: bool = False) -> DataFrame:
    """'Level_i' of equal frequency over the numeric order of ``c``."""
    x = F.col(c).cast("string").try_cast("double")
    if by_row:
        total = df.agg(F.count(c).alias("_n"))
        ranked = global_rank(df.withColumn("_null", F.col(c).isNull()), [F.col("_null"), x, F.col(c).cast("string"), F.xxhash64(*df.columns)], "_r").drop("_null").join(F.broadcast(total))
        return ranked.withColumn(c, F.when(F.col(c).isNotNull(), F.concat(F.lit("Level_"), frequency_level(F.col("_r"), F.col("_n"), levels).cast("string")))).drop("_r", "_n")
    counts = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    total = counts.agg(F.sum("_c").alias("_n"))
    order = [F.col("_v").cast("string").try_cast("double"), F.col("_v").cast("string")]
    upto = prefix_sums(counts, order, {"_r": "_c"}).join(F.broadcast(total))
    labels = upto.select("_v", F.concat(F.lit("Level_"), frequency_level(F.col("_r"), F.col("_n"), levels).cast("string")).alias("_l"))
    return df.join(labels, F.col(c) == F.col("_v"), "left").withColumn(c, F.col("_l")).drop("_v", "_l")


@transform("local_suppression")
def local_suppression(df: DataFrame, qi: list[str], k: int = 2, max_share: float = 1.0) -> DataFrame:
    """In classes smaller than k, the first QI whose suppression leads to a key of at least k rows is suppressed.

    Keys are counted before any suppression. A QI is left alone if more than
    ``max_share`` of its cells would go.
    """
    df = with_class_size(as_strings(df, qi), qi, "_s")
    for i, c in enumerate(qi):
        rest = [x for x in qi if x != c]
        df = with_class_size(df, rest, f"_m{i}") if rest else df.join(F.broadcast(df.agg(F.count(F.lit(1)).alias(f"_m{i}"))))
    pick = F.when(F.col("_s") >= k, F.lit(-1))
    for i in range(len(qi)):
        pick = pick.when(F.col(f"_m{i}") >= k, F.lit(i))
    df = df.withColumn("_p", pick.otherwise(F.lit(-1)))
    if max_share < 1:
        share = df.agg(*(F.avg((F.col("_p") == i).cast("double")).alias(f"_h{i}") for i in range(len(qi))))
        df = df.join(F.broadcast(share))
    for i, c in enumerate(qi):
        hit = F.col("_p") == i
        df = df.withColumn(c, F.when(hit & (F.col(f"_h{i}") <= max_share) if max_share < 1 else hit, STAR).otherwise(F.col(c)))
    return df.drop("_s", "_p", *(f"_m{i}" for i in range(len(qi))), *(f"_h{i}" for i in range(len(qi))))


@transform("suppression")
def suppress_small(df: DataFrame, qi: list[str], threshold: int = 5) -> DataFrame:
    """A10: all QIs of classes with fewer than ``threshold`` rows become '*'."""
    df = with_class_size(as_strings(df, qi), qi, "_s")
    return df.withColumns({c: F.when(F.col("_s") < threshold, STAR).otherwise(F.col(c)) for c in qi}).drop("_s")


def _star_classes(df: DataFrame, qi: list[str], bad: DataFrame) -> DataFrame:
    """'*' in all QIs of the classes in ``bad`` (columns named as the QIs)."""
    marked = bad.select(*(F.col(c).alias(f"_b_{c}") for c in qi), F.lit(True).alias("_bad"))
    out = df.join(marked, null_safe(df, marked, [(c, f"_b_{c}") for c in qi]), "left").drop(*(f"_b_{c}" for c in qi))
    return out.withColumns({c: F.when(F.col("_bad"), STAR).otherwise(F.col(c)) for c in qi}).drop("_bad")


def residual_small(df: DataFrame, qi: list[str], k: int) -> DataFrame:
    """Rows in the all-suppressed class if that is smaller than k itself, else 0."""
    cond = F.lit(True)
    for c in qi:
        cond = cond & (F.col(c).cast("string") == STAR)
    n = F.count_if(cond)
    return df.agg(F.when(n < k, n).otherwise(F.lit(0)).alias("residual_small"))


@transform("k_anonymity")
def k_anonymity(df: DataFrame, qi: list[str], k: int = 5, levels: tuple[float, ...] = (0.25, 0.5, 0.75), numeric: list[str] | None = None) -> DataFrame:
    """The first of a few levels at which all classes have k rows; else local, then record suppression after the last."""
    numeric = [c for c in qi if is_numeric(df, c)] if numeric is None else numeric
    now = df
    for g in levels:
        if not _violates(now, qi, k):
            return as_strings(now, qi)
        now = materialise(generalize_level(df, qi, g, numeric), "generalized")
    if not _violates(now, qi, k):
        return now
    return suppress_small(materialise(local_suppression(now, qi, k), "local"), qi, k)


def _violates(df: DataFrame, qi: list[str], k: int) -> bool:
    return not equivalence_classes(df, qi).filter(F.col("class_size") < k).limit(1).isEmpty()


@transform("l_diversity")
def l_diversity(df: DataFrame, qi: list[str], sensitive: str, l: int = 2, levels: tuple[float, ...] = (0.3, 0.5, 0.7)) -> DataFrame:  # noqa: E741
    """As k-anonymity by distinct sensitive values; in classes that still fail, the first QI is suppressed whose suppression gives l values, else all."""
    numeric = [c for c in qi if is_numeric(df, c)]
    now = as_strings(df, qi)

    def few(x: DataFrame) -> DataFrame:
        return equivalence_classes(x, qi, sensitive=sensitive).filter(F.col("n_distinct") < l)

    for g in levels:
        if few(now).limit(1).isEmpty():
            return now
        now = materialise(generalize_level(df, qi, g, numeric), "generalized")
    if few(now).limit(1).isEmpty():
        return now
    out = with_class_size(now, qi, "_s", {"_d": F.count_distinct(sensitive)})
    for i, c in enumerate(qi):
        rest = [x for x in qi if x != c]
        sub = with_class_size(out, rest, f"_z{i}", {f"_m{i}": F.count_distinct(sensitive)}) if rest else out.join(F.broadcast(out.agg(F.count(F.lit(1)).alias(f"_z{i}"), F.count_distinct(sensitive).alias(f"_m{i}"))))
        out = sub
    pick = F.when(F.col("_d") >= l, F.lit(-1))
    for i in range(len(qi)):
        pick = pick.when(F.col(f"_m{i}") >= l, F.lit(i))
    out = out.withColumn("_p", pick.otherwise(F.lit(len(qi))))
    out = out.withColumns({c: F.when((F.col("_p") == i) | (F.col("_p") == len(qi)), STAR).otherwise(F.col(c)) for i, c in enumerate(qi)})
    out = materialise(out.drop("_s", "_d", "_p", *(f"_m{i}" for i in range(len(qi))), *(f"_z{i}" for i in range(len(qi)))), "diverse")
    # A class that the suppressed cells joined may be short of values itself: its rows go to the all-suppressed class.
    return _star_classes(out, qi, few(out))


@transform("t_closeness")
def t_closeness(df: DataFrame, qi: list[str], sensitive: str, t: float = 0.3, distance: str = "tvd", levels: tuple[float, ...] = (0.3, 0.5, 0.7)) -> DataFrame:
    """As above by distance to the distribution of all rows; all QIs of classes that still fail are suppressed."""
    from .risk import class_distances

    numeric = [c for c in qi if is_numeric(df, c)]
    now = as_strings(df, qi)

    def far(x: DataFrame) -> DataFrame:
        return class_distances(x, qi, sensitive, distance).filter(F.col("distance") > t + 1e-12)

    for g in levels:
        if far(now).limit(1).isEmpty():
            return now
        now = materialise(generalize_level(df, qi, g, numeric), "generalized")
    return _star_classes(now, qi, far(now))


@transform("microaggregation")
def microaggregate(df: DataFrame, cols: list[str], group: int = 5, key: str | None = None) -> DataFrame:
    """Runs of ``group`` (2 at least) values in order are replaced by their mean; the rest is a group of its own; ties by ``key``."""
    group = max(2, group)
    for c in cols:
        if not is_numeric(df, c):
            continue
        tie = F.col(key) if key else F.xxhash64(*df.columns)
        ranked = global_rank(df.withColumn("_null", F.col(c).isNull()), [F.col("_null"), F.col(c), tie], "_r").drop("_null")
        ranked = ranked.withColumn("_g", F.when(F.col(c).isNotNull(), F.floor((F.col("_r") - 1) / group)))
        df = _group_means(ranked, c)
    return df


def _group_means(ranked: DataFrame, c: str) -> DataFrame:
    means = ranked.filter(F.col("_g").isNotNull()).groupBy(F.col("_g").alias("_h")).agg(F.avg(F.col(c).cast("double")).alias("_mean"))
    return ranked.join(means, F.col("_g") == F.col("_h"), "left").withColumn(c, F.col("_mean")).drop("_r", "_g", "_h", "_mean")


@transform("pram")
def pram(df: DataFrame, cols: list[str], key: str, rate: float = 0.1, seed: int = 42) -> DataFrame:
    """A value stays with 1 - rate (rate within .01 and .5), else any other category, alike; nulls and single categories stay."""
    rate = min(0.5, max(0.01, rate))
    for c in cols:
        values = df.filter(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("_v")).distinct()
        ranked = materialise(global_rank(values, [F.col("_v")], "_own").select("_v", (F.col("_own") - 1).alias("_own")), "categories")
        m = ranked.count()
        if m < 2:
            continue
        # Rows that change look up the number of their category, and the category of the new number.
        u, w = uniform(seed, f"pram-keep-{c}", F.col(key)), uniform(seed, f"pram-pick-{c}", F.col(key))
        moved = df.withColumn("_from", F.when(u >= 1 - rate, F.col(c).cast("string"))).join(ranked, F.col("_from") == F.col("_v"), "left")
        moved = moved.withColumn("_at", (F.col("_own") + F.floor(w * (m - 1)) + 1) % m).drop("_v", "_own")
        moved = moved.join(ranked.select(F.col("_v").alias("_to"), F.col("_own").alias("_n")), F.col("_at") == F.col("_n"), "left")
        df = moved.withColumn(c, F.coalesce("_to", F.col(c).cast("string"))).drop("_from", "_at", "_to", "_n")
    return df


def pram_matrix(df: DataFrame, c: str, key: str, matrix: dict[str, dict[str, float]], seed: int = 42) -> DataFrame:
    """Transition by a row-stochastic matrix; categories without a row stay."""
    u = uniform(seed, f"pram-matrix-{c}", F.col(key))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for v in sorted(matrix):
        total = sum(matrix[v].values())
        if abs(total - 1) > 1e-6:
            raise ValueError(f"the row of {v} sums to {total}")
        upto, targets = 0.0, sorted(matrix[v])
        inner = F.when(F.lit(False), F.lit(None).cast("string"))
        for w in targets[:-1]:
            upto += matrix[v][w]
            inner = inner.when(u < upto, w)
        out = out.when(F.col(c).cast("string") == v, inner.otherwise(targets[-1]))
    return df.withColumn(c, out.otherwise(F.col(c).cast("string")))


@transform("hybrid")
def hybrid(df: DataFrame, qi: list[str], sensitive: list[str], k: int = 5, l: int = 2, t: float = 0.3, level: float = 0.5) -> DataFrame:  # noqa: E741
    """Generalisation, k-anonymity, then l-diversity and t-closeness for each sensitive column."""
    out = materialise(k_anonymity(generalize_level(df, qi, level), qi, k), "hybrid-k")
    for s in sensitive:
        out = materialise(l_diversity(out, qi, s, l), "hybrid-l")
    for s in sensitive:
        out = materialise(t_closeness(out, qi, s, t), "hybrid-t")
    return out


@transform("psu_aggregation")
def psu(df: DataFrame, psu_col: str, method: str = "aggregate", region: str | None = None, least: int = 5, seed: int = 42) -> DataFrame:
    """Primary sampling units to their region, to numbered regions of at least ``least`` rows, or to random groups of units."""
    if method == "aggregate" and region:
        return df.withColumn(psu_col, F.col(region).cast("string"))
    counts = df.groupBy(F.col(psu_col).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    if method == "aggregate":
        ranked = global_rank(counts.filter(F.col("_c") >= least), [F.col("_v")], "_n")
        big = ranked.select("_v", F.concat(F.lit("REGION_"), (F.col("_n") - 1).cast("string")).alias("_l"))
        label, other = big, "REGION_OTHER"
    elif method == "random_recode":
        n = df.count()
        groups = max(1, n // max(1, least))
        dealt = counts.withColumn("_g", F.floor(uniform(seed, f"psu-{psu_col}", F.col("_v")) * groups).cast("int") + 1)
        sizes = dealt.groupBy(F.col("_g").alias("_h")).agg(F.sum("_c").alias("_t"))
        label = dealt.join(sizes, F.col("_g") == F.col("_h")).filter(F.col("_t") >= least).select("_v", F.concat(F.lit("PSU_RECODED_"), F.col("_g").cast("string")).alias("_l"))
        other = "PSU_RECODED_OTHER"
    else:
        raise ValueError(f"no method {method}")
    out = df.join(label, F.col(psu_col) == F.col("_v"), "left")
    return out.withColumn(psu_col, F.when(F.col(psu_col).isNotNull(), F.coalesce("_l", F.lit(other)))).drop("_v", "_l")


def sensitive_transform(df: DataFrame, c: str, key: str | None = None) -> DataFrame:
    """Numbers are microaggregated in groups of max(3, n // 100); of others rare values become '[SUPPRESSED]'; if none is rare, a single value becomes '[REDACTED]', and of more all but the most frequent five (one less than all) '[OTHER]'."""
    facts = df.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col(c).isNotNull(), F.col(c).cast("string").try_cast("double").isNotNull().cast("double"))).alias("num"), F.count_distinct(c).alias("u")).first()
    if (facts["num"] or 0) > 0.5:
        return microaggregate(df.withColumn(c, F.col(c).cast("string").try_cast("double")), [c], max(3, facts["n"] // 100), key)
    df = as_strings(df, [c])
    counts = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    if not counts.filter(F.col("_c") < 0.05 * facts["n"]).isEmpty():
        return generalize_rare(df, [c], 0.05, "[SUPPRESSED]")
    if facts["u"] <= 1:
        return df.withColumn(c, F.when(F.col(c).isNotNull(), "[REDACTED]"))
    top = counts.orderBy(F.desc("_c"), "_v").limit(min(facts["u"] - 1, 5)).select("_v")
    return df.join(F.broadcast(top), F.col(c) == F.col("_v"), "left").withColumn(c, F.when(F.col(c).isNull() | F.col("_v").isNotNull(), F.col(c)).otherwise("[OTHER]")).drop("_v")


def hide_identifiers(df: DataFrame, identifiers: list[str]) -> DataFrame:
    """Direct identifiers: strings become '[SUPPRESSED]', numbers null."""
    return df.withColumns({c: F.lit(None).cast(dict(df.dtypes)[c]) if is_numeric(df, c) else F.lit("[SUPPRESSED]") for c in identifiers})


def comprehensive(df: DataFrame, anonymized: DataFrame, key: str, identifiers: list[str], qi: list[str], sensitive: list[str]) -> tuple[DataFrame, DataFrame]:
    """(data, change log). On top of anonymised QIs, identifiers are hidden and sensitive columns transformed; the log has a row per column."""
    from .risk import compare

    out = hide_identifiers(anonymized, identifiers)
    for s in sensitive:
        out = sensitive_transform(out, s, key)
    out = materialise(out, "comprehensive")
    return out, compare(df, out, key, [*identifiers, *qi, *sensitive])


def scaled_parameters(n: int, k: int, l: int, t: float) -> dict[str, float]:  # noqa: E741
    """K <= clamp(n // 100, 2, 20); l <= clamp(sqrt(k), 2, 5); t within .15 and .5."""
    k = max(2, min(k, max(2, min(20, n // 100))))
    l = max(2, min(l, max(2, min(5, int(k**0.5)))))  # noqa: E741
    return {"k": k, "l": l, "t": min(0.5, max(0.15, t))}


def mask(c: Column) -> Column:
    """The first letter and '***'."""
    return F.concat(F.substring(c.cast("string"), 1, 1), F.lit("***"))


def rounded_to(c: Column, step: int = 1000) -> Column:
    """To the nearest multiple of ``step``, halves away from zero."""
    # Adding 0 makes one of the two zeros.
    return F.round(c.cast("double") / step) * step + 0.0


# Methods of the catalogue.


@transform("top_bottom_coding")
def top_bottom(df: DataFrame, cols: list[str], low: float = 5, high: float = 95) -> DataFrame:
    """Values beyond the percentiles become the percentiles."""
    cut = exact_quantiles(column_values(df, cols), [low / 100, high / 100])
    edges = cut.agg(*(F.max(F.when(F.col("key") == c, F.col(q))).alias(f"_{n}_{c}") for c in cols for n, q in (("lo", "q0"), ("hi", "q1"))))
    out = df.join(F.broadcast(edges))
    out = out.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c).cast("double"), F.col(f"_lo_{c}")), F.col(f"_hi_{c}"))) for c in cols})
    return out.drop(*edges.columns)


@transform("perturbation")
def perturb(df: DataFrame, cols: list[str], key: str, scale: float = 0.1, seed: int = 42) -> DataFrame:
    """Laplace noise of ``scale`` standard deviations."""
    std = df.agg(*(F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"_sd_{c}") for c in cols))
    out = df.join(F.broadcast(std))
    return out.withColumns({c: F.col(c) + laplace(seed, f"noise-{c}", F.col(key), F.col(f"_sd_{c}") * scale) for c in cols}).drop(*std.columns)


@transform("data_swapping")
def swap(df: DataFrame, cols: list[str], key: str, seed: int = 42) -> DataFrame:
    """The values of ``cols`` are dealt anew among all rows: the row at each position of one random order gets those at the same position of another."""
    a = global_rank(df.drop(*cols), [uniform(seed, "swap-to", F.col(key)), F.col(key)], "_r")
    b = global_rank(df.select(key, *cols), [uniform(seed, "swap-from", F.col(key)), F.col(key)], "_r").drop(key)
    return a.join(b, "_r").select(*df.columns)


@transform("hashing")
def hash_columns(df: DataFrame, cols: list[str], salt: str = "") -> DataFrame:
    return df.withColumns({c: F.sha2(F.concat(F.lit(salt), F.col(c).cast("string")), 256) for c in cols})


@transform("attribute_suppression")
def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*cols)


@transform("temporal_generalization")
def generalize_time(df: DataFrame, cols: list[str], unit: str = "month") -> DataFrame:
    return df.withColumns({c: F.date_trunc(unit, F.col(c)) for c in cols})


@transform("spatial_cloaking")
def cloak(df: DataFrame, cols: list[str], cell: float = 0.1) -> DataFrame:
    """Coordinates become the corner of their grid cell."""
    return df.withColumns({c: F.floor(F.col(c) / cell) * cell for c in cols})


@transform("household_aggregation")
def household(df: DataFrame, household_col: str, cols: list[str]) -> DataFrame:
    """One row a household: its size, and the means of ``cols``."""
    return df.groupBy(household_col).agg(F.count(F.lit(1)).alias("household_size"), *(F.avg(c).alias(c) for c in cols))


@transform("sampling")
def sample(df: DataFrame, key: str, fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """The rows whose number is below ``fraction``."""
    return df.filter(uniform(seed, "sample", F.col(key)) < fraction)


@transform("feature_selection")
def select_features(df: DataFrame, cols: list[str], limit: float = 0.95) -> DataFrame:
    """Of two columns with a correlation above ``limit`` the later goes; all pairs in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    row = df.agg(*(correlation(F.col(a), F.col(b)).alias(f"{i}") for i, (a, b) in enumerate(pairs))).first() if pairs else {}
    gone: set[str] = set()
    for i, (a, b) in enumerate(pairs):
        if a not in gone and row[str(i)] is not None and abs(row[str(i)]) > limit:
            gone.add(b)
    return df.drop(*gone)


@transform("dimensionality_reduction")
def reduce_dimensions(df: DataFrame, cols: list[str], k: int = 2) -> DataFrame:
    """Principal components pc1..pck in place of ``cols``."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    x = VectorAssembler(inputCols=cols, outputCol="_x", handleInvalid="skip").transform(df)
    x = StandardScaler(inputCol="_x", outputCol="_z", withMean=True).fit(x).transform(x)
    x = PCA(k=k, inputCol="_z", outputCol="_pc").fit(x).transform(x)
    return x.withColumns({f"pc{i + 1}": vector_to_array("_pc")[i] for i in range(k)}).drop(*cols, "_x", "_z", "_pc")
