"""Profiling: one row per column, from as few passes as the statistics allow.

Counts, extremes, moments and quantiles of all columns come from one wide
aggregate. Value counts come from one unpivoted group-by over all columns, which
is combined before the shuffle.
"""

from __future__ import annotations

import difflib
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durable import materialise
from ..functions.expressions import correlation
from ..functions.ranks import column_values, exact_quantiles
from .anonymize import NUMERIC, is_numeric

# Patterns of personal data by category.
PII_PATTERNS = {
    "ssn": r"^\d{3}-\d{2}-\d{4}$",
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$",
    "phone": r"^\+?\d[\d\s().-]{7,}\d$",
    "ip": r"^\d{1,3}(\.\d{1,3}){3}$",
    "uuid": r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
}
PII_WITHIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\+?\d[\d\s().-]{7,}\d",
    "nic": r"\b\d{9}[vVxX]\b|\b\d{12}\b",
    "passport": r"\b[A-Z]\d{7}\b",
}


def normalize_column_name(name: str) -> str:
    """Lower case, spaces and underscores to one underscore, no other signs."""
    s = re.sub(r"[_\s]+", "_", name.strip().lower())
    s = re.sub(r"_+", "_", re.sub(r"[^\w\s]", "", s)).strip("_")
    return s or "unnamed_column"


def normalize_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """All columns renamed, and the original of each name; repeated names get _2, _3."""
    seen: dict[str, int] = {}
    out, back = [], {}
    for c in df.columns:
        n = normalize_column_name(c)
        seen[n] = seen.get(n, 0) + 1
        name = n if seen[n] == 1 else f"{n}_{seen[n]}"
        out.append(name)
        back[name] = c
    return df.toDF(*out), back


def dtype_group(kind: str) -> str:
    if kind == "boolean":
        return "boolean"
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return "datetime"
    return "numeric" if kind in NUMERIC or kind.startswith("decimal") else "categorical"


def _stack(row: DataFrame, cols: list[str], fields: dict[str, str]) -> DataFrame:
    """A one-row aggregate with columns field_i as a row per column."""
    items = [F.struct(F.lit(c).alias("column"), *(F.col(f"{f}_{i}").cast(kind).alias(f) for f, kind in fields.items())) for i, c in enumerate(cols)]
    return row.select(F.explode(F.array(*items)).alias("x")).select("x.*")


def infer_types(df: DataFrame) -> DataFrame:
    """(column, logical_type): all_null, integer, float, datetime, boolean or string, by the share of values that can be read as such."""
    cols = df.columns

    def share(ok: Column, c: str) -> Column:
        return F.avg(F.when(F.col(c).isNotNull(), ok.cast("double")))

    aggs = []
    for i, c in enumerate(cols):
        s = F.trim(F.col(c).cast("string"))
        x = s.try_cast("double")
        aggs += [
            F.count(c).alias(f"n_{i}"),
            share(x.isNotNull(), c).alias(f"num_{i}"),
            share(x.isNotNull() & (x == F.floor(x)), c).alias(f"int_{i}"),
            share(F.try_to_timestamp(s).isNotNull(), c).alias(f"date_{i}"),
            share(F.lower(s).isin("true", "false", "yes", "no", "0", "1"), c).alias(f"bool_{i}"),
        ]
    x = _stack(df.agg(*aggs), cols, {"n": "long", "num": "double", "int": "double", "date": "double", "bool": "double"})
    kind = F.when(F.col("n") == 0, "all_null").when(F.col("int") == 1, "integer").when(F.col("num") == 1, "float").when(F.col("date") >= 0.9, "datetime").when(F.col("bool") >= 0.95, "boolean").otherwise("string")
    return x.select("column", kind.alias("logical_type"))


def coerce_types(df: DataFrame) -> DataFrame:
    """Text columns read as numbers or times where 90 % of the values are such, and as booleans from 95 %; other values become null."""
    out = df
    aggs = {}
    for c, kind in df.dtypes:
        if kind == "string":
            s = F.trim(F.col(c))
            aggs |= {f"num_{c}": s.try_cast("double"), f"date_{c}": F.try_to_timestamp(s), f"bool_{c}": F.when(F.lower(s).isin("true", "false", "yes", "no", "0", "1"), True)}
    if not aggs:
        return df
    names = list(aggs)
    row = df.agg(*(F.avg(F.when(F.col(n.split("_", 1)[1]).isNotNull(), aggs[n].isNotNull().cast("double"))).alias(n) for n in names)).first().asDict()
    for c, kind in df.dtypes:
        if kind == "string":
            s = F.trim(F.col(c))
            if (row[f"num_{c}"] or 0) >= 0.9:
                out = out.withColumn(c, s.try_cast("double"))
            elif (row[f"date_{c}"] or 0) >= 0.9:
                out = out.withColumn(c, F.try_to_timestamp(s))
            elif (row[f"bool_{c}"] or 0) >= 0.95:
                out = out.withColumn(c, F.when(F.lower(s).isin("true", "yes", "1"), True).when(F.lower(s).isin("false", "no", "0"), False))
    return out


def profiling_stats(df: DataFrame) -> DataFrame:
    """(column, total_rows, missing, missing_pct, n_unique)."""
    cols = df.columns
    aggs = [a for i, c in enumerate(cols) for a in (F.count(F.lit(1)).alias(f"total_rows_{i}"), F.count_if(F.col(c).isNull()).alias(f"missing_{i}"))]
    counts = _stack(df.agg(*aggs), cols, {"total_rows": "long", "missing": "long"})
    uniq = value_counts(df, cols).groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))
    pct = F.round(100 * F.try_divide(F.col("missing"), F.col("total_rows")), 2)
    return counts.join(uniq, "column", "left").select("column", "total_rows", "missing", F.coalesce(pct, F.lit(0.0)).alias("missing_pct"), F.coalesce("n_unique", F.lit(0)).alias("n_unique"))


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, count) of the non-null values of all ``cols``, as strings."""
    long = df.select(*(F.col(c).cast("string").alias(c) for c in cols)).unpivot([], cols, "column", "value")
    return long.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def missing_report(df: DataFrame) -> DataFrame:
    """(column, missing, missing_pct) of each column, and of all cells under a null name; one aggregate."""
    cols = df.columns
    row = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)))
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing"), F.col("n").alias("of")) for i, c in enumerate(cols)))
    total = F.struct(F.lit(None).cast("string").alias("column"), sum((F.col(f"m{i}") for i in range(len(cols))), F.lit(0).cast("long")).alias("missing"), (F.col("n") * len(cols)).alias("of"))
    out = row.select(F.explode(F.concat(each, F.array(total)) if cols else F.array(total)).alias("x")).select("x.*")
    return out.select("column", "missing", F.coalesce(F.round(100 * F.try_divide(F.col("missing"), F.col("of")), 2), F.lit(0.0)).alias("missing_pct"))


#: Bytes of a value of fixed width.
WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "date": 4, "timestamp": 8, "timestamp_ntz": 8}


def memory_and_types(df: DataFrame) -> DataFrame:
    """(dtype, n_columns, bytes): columns and bytes of values by type; text and binary by its bytes, fixed widths by their non-null rows, others by their text."""
    def size(c: str, kind: str) -> Column:
        x = F.col(c)
        width = WIDTHS.get(kind.split("(")[0], 16 if kind.startswith("decimal") else None)
        return F.count(x) * width if width else F.coalesce(F.sum(F.octet_length(x if kind in ("string", "binary") else F.to_json(F.struct(x)))), F.lit(0))

    row = df.agg(*(size(c, k).alias(f"b{i}") for i, (c, k) in enumerate(df.dtypes)))
    each = F.array(*(F.struct(F.lit(k.split("(")[0] if k.startswith("decimal") else k).alias("dtype"), F.col(f"b{i}").cast("long").alias("b")) for i, (_, k) in enumerate(df.dtypes)))
    return row.select(F.explode(each).alias("x")).groupBy("x.dtype").agg(F.count(F.lit(1)).alias("n_columns"), F.sum("x.b").alias("bytes"))


def sample_values(df: DataFrame, n: int = 5, chars: int | None = 50) -> DataFrame:
    """(column, samples): up to ``n`` distinct non-null values of each column, those of least md5, cut to ``chars``; in that order.

    The same on any partitioning. Each task sends its ``n`` least of a column, and
    the least of these are taken, so that a column of very many values is never
    sorted in one task.
    """
    key = F.md5(F.col("value").cast("binary"))
    values = value_counts(df, df.columns).select("column", "value", key.alias("_h"))
    best = values.withColumn("_r", F.row_number().over(Window.partitionBy("column").orderBy("_h", "value"))).filter(F.col("_r") <= n)
    text = F.col("value") if chars is None else F.substring("value", 1, chars)
    found = best.groupBy("column").agg(F.sort_array(F.collect_list(F.struct("_r", text.alias("v")))).alias("_s")).select("column", F.col("_s.v").alias("samples"))
    every = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")
    return every.join(found, "column", "left").select("column", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def column_summaries(df: DataFrame) -> DataFrame:
    """P3 with 5 samples as one text, and P4's: (column, logical_type, total_rows, missing, missing_pct, n_unique, samples, values, min, max, mean, std); the last four of numbers only."""
    cols = df.columns
    kinds = infer_types(df)
    aggs = []
    for i, c in enumerate(cols):
        x = F.trim(F.col(c).cast("string")).try_cast("double")
        aggs += [F.min(x).alias(f"min_{i}"), F.max(x).alias(f"max_{i}"), F.avg(x).alias(f"mean_{i}"), F.stddev_samp(x).alias(f"std_{i}")]
    figures = _stack(df.agg(*aggs), cols, {n: "double" for n in ("min", "max", "mean", "std")})
    out = profiling_stats(df).join(kinds, "column").join(figures, "column")
    # A row a column.
    out = out.join(F.broadcast(sample_values(df, 5, 50).select("column", F.array_join("samples", ", ").alias("samples"))), "column")
    out = out.join(F.broadcast(sample_values(df, 10, None).select("column", F.col("samples").alias("values"))), "column")
    number = F.col("logical_type").isin("integer", "float")
    return out.select("column", "logical_type", "total_rows", "missing", "missing_pct", "n_unique", "samples", "values", *(F.when(number, F.col(n)).alias(n) for n in ("min", "max", "mean", "std")))


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if is_numeric(df, c)]


def numeric_summary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per numeric column null share, extremes, moments, quartiles, outliers beyond 1.5 and 3 interquartile ranges.

    Quartiles are exact; no column is sorted (``ranks.exact_quantiles``).
    """
    cols = cols or numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(F.lit(1)).alias(f"n_{i}"), F.count(x).alias(f"present_{i}"), F.min(x).alias(f"min_{i}"), F.max(x).alias(f"max_{i}"), F.avg(x).alias(f"mean_{i}"), F.stddev_samp(x).alias(f"std_{i}")]
    fields = {"n": "long", "present": "long", "min": "double", "max": "double", "mean": "double", "std": "double"}
    a = _stack(df.agg(*aggs), cols, fields)
    values = column_values(df, cols).filter("x IS NOT NULL")
    q = materialise(exact_quantiles(values, [0.25, 0.5, 0.75]).select(F.col("key").alias("column"), F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3")), "quartiles")
    x, iqr = F.col("x"), F.col("q3") - F.col("q1")
    outs = [F.count_if((x < F.col("q1") - w * iqr) | (x > F.col("q3") + w * iqr)).alias(name) for name, w in (("outliers", 1.5), ("extreme", 3.0))]
    # One row a column on the other side.
    b = values.join(F.broadcast(q), F.col("key") == F.col("column")).groupBy("column", "q1", "median", "q3").agg(*outs)
    none = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("outliers", "extreme")]
    a = a.join(b, "column", "left").select("column", *fields, "q1", "median", "q3", *none)
    pct = F.coalesce(F.try_divide(100.0 * F.col("outliers"), F.col("present")), F.lit(0.0))
    return a.select("*", (F.col("q3") - F.col("q1")).alias("iqr"), (F.col("max") - F.col("min")).alias("range"), F.round(100 - F.coalesce(F.try_divide(100.0 * F.col("present"), F.col("n")), F.lit(0.0)), 4).alias("null_pct"), F.round(pct, 4).alias("outlier_pct"))


def anomalies(df: DataFrame, identifiers: tuple[str, ...] = ()) -> DataFrame:
    """(column, kind, n): extreme values of numbers, near-unique and rare categories; columns without any are left out."""
    num = [c for c in numeric_columns(df) if c not in identifiers]
    cat = [c for c, k in df.dtypes if k == "string" and c not in identifiers]
    parts = []
    if num:
        x = numeric_summary(df, num)
        parts.append(x.filter((F.col("iqr") > 0) & (F.col("extreme") > 0)).select("column", F.lit("extreme_values").alias("kind"), F.col("extreme").alias("n")))
    if cat:
        v = value_counts(df, cat)
        total = v.groupBy("column").agg(F.sum("count").alias("present"), F.count(F.lit(1)).alias("u"))
        v = v.join(F.broadcast(total), "column")
        parts.append(total.filter(F.col("u") > 0.95 * F.col("present")).select("column", F.lit("high_cardinality").alias("kind"), F.col("u").alias("n")))
        parts.append(v.filter(F.col("count") < 0.01 * F.col("present")).groupBy("column").agg(F.count(F.lit(1)).alias("n")).select("column", F.lit("rare_categories").alias("kind"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fallback_inspection(df: DataFrame) -> DataFrame:
    """(column, kind, n): 1.5 interquartile ranges from 8 values on, near-unique from 30 rows on, half null."""
    x = numeric_summary(df)
    a = x.filter((F.col("present") >= 8) & (F.col("outliers") > 0)).select("column", F.lit("outliers").alias("kind"), F.col("outliers").alias("n"))
    s = profiling_stats(df)
    present = F.col("total_rows") - F.col("missing")
    b = s.filter((present >= 30) & (F.col("n_unique") > 0.95 * present)).select("column", F.lit("high_cardinality").alias("kind"), F.col("n_unique").alias("n"))
    c = s.filter((F.col("total_rows") > 0) & (F.col("missing") >= 0.5 * F.col("total_rows"))).select("column", F.lit("mostly_null").alias("kind"), F.col("missing").alias("n"))
    return a.unionByName(b).unionByName(c)


def top_values(df: DataFrame, cols: list[str], k: int = 10) -> DataFrame:
    """The k most frequent values per column, ties by value."""
    order = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    return value_counts(df, cols).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def categorical_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """Most frequent value, distinct values, values of less than 1 %, whether it looks like an identifier (more than 95 % distinct)."""
    v = value_counts(df, cols)
    total = v.groupBy("column").agg(F.sum("count").alias("present"), F.count(F.lit(1)).alias("n_unique"), F.max(F.struct("count", F.col("value"))).alias("m"))
    first = v.join(F.broadcast(total.select("column", F.col("m.count").alias("top"))), "column").filter(F.col("count") == F.col("top")).groupBy("column").agg(F.min("value").alias("most_frequent"))
    rare = v.join(F.broadcast(total.select("column", "present")), "column").groupBy("column").agg(F.count_if(F.col("count") < 0.01 * F.col("present")).alias("rare_values"))
    out = total.join(first, "column").join(rare, "column")
    return out.select("column", "present", "n_unique", "most_frequent", F.col("m.count").alias("most_frequent_count"), "rare_values", (F.col("n_unique") > 0.95 * F.col("present")).alias("identifier_like"))


def string_lengths(df: DataFrame, cols: list[str]) -> DataFrame:
    """Average, least and greatest length."""
    aggs = [f(F.length(c)).alias(f"{n}_{i}") for i, c in enumerate(cols) for n, f in (("avg_length", F.avg), ("min_length", F.min), ("max_length", F.max))]
    return _stack(df.agg(*aggs), cols, {"avg_length": "double", "min_length": "long", "max_length": "long"})


def datetime_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """First and last day, and days between."""
    aggs = [f(F.col(c).cast("date")).alias(f"{n}_{i}") for i, c in enumerate(cols) for n, f in (("first", F.min), ("last", F.max))]
    x = _stack(df.agg(*aggs), cols, {"first": "date", "last": "date"})
    return x.select("column", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"), F.datediff("last", "first").cast("long").alias("range_days"))


def overview(df: DataFrame) -> DataFrame:
    """Rows, columns, cells, repeated rows and their share, missing cells, completeness, columns by kind of trouble."""
    cols = df.columns
    rows = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).agg(F.sum("_n").alias("rows"), F.sum(F.col("_n") - 1).alias("duplicate_rows"))
    s = profiling_stats(df)
    cells = s.agg(
        F.count(F.lit(1)).alias("columns"),
        F.sum("missing").alias("missing_cells"),
        F.count_if(F.col("missing") > 0).alias("columns_with_missing"),
        F.count_if(F.col("missing") == F.col("total_rows")).alias("empty_columns"),
        F.count_if(F.col("n_unique") <= 1).alias("constant_columns"),
        F.count_if(F.col("missing") > 0.9 * F.col("total_rows")).alias("mostly_null_columns"),
    )
    out = F.broadcast(rows).join(F.broadcast(cells))
    total = F.col("rows") * F.col("columns")
    return out.select(
        F.coalesce("rows", F.lit(0)).alias("rows"), "columns", F.coalesce(total, F.lit(0)).alias("cells"), F.coalesce("duplicate_rows", F.lit(0)).alias("duplicate_rows"),
        F.round(F.coalesce(F.try_divide(100.0 * F.col("duplicate_rows"), F.col("rows")), F.lit(0.0)), 4).alias("duplicate_pct"),
        "missing_cells", F.round(F.coalesce(100 - F.try_divide(100.0 * F.col("missing_cells"), total), F.lit(100.0)), 4).alias("completeness_pct"),
        "columns_with_missing", "empty_columns", "constant_columns",
        ((F.col("empty_columns") == 0) & (F.col("constant_columns") == 0) & (F.col("mostly_null_columns") == 0)).alias("validation_passed"),
    )


def entropy(df: DataFrame, cols: list[str]) -> DataFrame:
    """P20: Shannon entropy in bits of each column."""
    v = value_counts(df, cols)
    total = v.groupBy("column").agg(F.sum("count").alias("n"))
    p = F.col("count") / F.col("n")
    return v.join(F.broadcast(total), "column").groupBy("column").agg((-F.sum(p * F.log2(p + 1e-10))).alias("entropy"))


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every pair, in one aggregate; undefined ones are null."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    row = df.agg(*(correlation(F.col(a), F.col(b)).alias(str(i)) for i, (a, b) in enumerate(pairs)))
    items = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(str(i)).alias("corr")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.explode(F.array(*items)).alias("x")).select("x.*")


def z_outliers(df: DataFrame, cols: list[str]) -> DataFrame:
    """Share of values more than 3 sample deviations from the mean, and whether it is over 5 %."""
    stats = df.agg(*(f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    both = df.select(*cols).join(F.broadcast(stats))
    row = both.agg(*(F.avg((F.abs(F.col(c).cast("double") - F.col(f"m_{c}")) > 3 * F.col(f"s_{c}")).cast("double")).alias(f"share_{i}") for i, c in enumerate(cols)))
    x = _stack(row, cols, {"share": "double"})
    return x.select("column", F.col("share").alias("outlier_share"), (F.col("share") > 0.05).alias("outliers_detected"))


def pattern_rates(df: DataFrame, cols: list[str], patterns: dict[str, str] | None = None) -> DataFrame:
    """Share of non-null values that match each pattern, and the confidence that follows from it."""
    patterns = patterns or PII_PATTERNS
    items = [(c, k, p) for c in cols for k, p in patterns.items()]
    row = df.agg(*(F.avg(F.when(F.col(c).isNotNull(), F.col(c).cast("string").rlike(p).cast("double"))).alias(f"rate_{i}") for i, (c, _, p) in enumerate(items)))
    named = [F.struct(F.lit(c).alias("column"), F.lit(k).alias("category"), F.coalesce(F.col(f"rate_{i}"), F.lit(0.0)).alias("rate")) for i, (c, k, _) in enumerate(items)]
    x = row.select(F.explode(F.array(*named)).alias("x")).select("x.*")
    return x.withColumn("confidence", F.when(F.col("rate") > 0.8, 0.9).when(F.col("rate") > 0.5, 0.7).when(F.col("rate") > 0.2, 0.5).otherwise(0.0))


def pattern_presence(df: DataFrame, cols: list[str]) -> DataFrame:
    """Whether any value contains each kind of personal data, or is longer than 60 characters; over all rows."""
    items = [(c, k, p) for c in cols for k, p in PII_WITHIN.items()]
    aggs = [F.coalesce(F.bool_or(F.col(c).cast("string").rlike(p)), F.lit(False)).alias(f"has_{i}") for i, (c, _, p) in enumerate(items)]
    aggs += [F.coalesce(F.bool_or(F.length(F.col(c).cast("string")) > 60), F.lit(False)).alias(f"long_{j}") for j, c in enumerate(cols)]
    row = df.agg(*aggs)
    named = [F.struct(F.lit(c).alias("column"), F.lit(k).alias("category"), F.col(f"has_{i}").alias("present")) for i, (c, k, _) in enumerate(items)]
    named += [F.struct(F.lit(c).alias("column"), F.lit("address_like").alias("category"), F.col(f"long_{j}").alias("present")) for j, c in enumerate(cols)]
    return row.select(F.explode(F.array(*named)).alias("x")).select("x.*")


def value_overlap(a: DataFrame, ca: str, b: DataFrame, cb: str) -> DataFrame:
    """Common distinct values over the smaller number of distinct values, without case and outer spaces."""
    from ..functions.expressions import clean_string

    x = a.select(clean_string(F.col(ca)).alias("v"), F.lit(1).alias("s")).filter("v IS NOT NULL").distinct()
    y = b.select(clean_string(F.col(cb)).alias("v"), F.lit(2).alias("s")).filter("v IS NOT NULL").distinct()
    sides = x.unionByName(y).groupBy("v").agg(F.sum("s").alias("s"))
    out = sides.agg(F.count_if(F.col("s") == 3).alias("common"), F.count_if(F.col("s") != 2).alias("n_left"), F.count_if(F.col("s") != 1).alias("n_right"))
    return out.withColumn("overlap", F.coalesce(F.try_divide(F.col("common"), F.least("n_left", "n_right")), F.lit(0.0)))


def suggest_columns(wanted: str, columns: list[str]) -> list[str]:
    """P25."""
    return difflib.get_close_matches(wanted, columns, n=3, cutoff=0.6)


def key_candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Common columns as join keys: 40 for an identifying name, 40 times the mean uniqueness, 20 times the overlap; from 35 on a key."""
    common = [c for c in a.columns if c in b.columns]
    ua, ub = (profiling_stats(x.select(*common)).select("column", (F.col("n_unique") / F.greatest(F.lit(1), F.col("total_rows") - F.col("missing"))).alias(n)) for x, n in ((a, "ua"), (b, "ub")))
    va, vb = (value_counts(x, common).select("column", F.lower(F.trim("value")).alias("v"), F.lit(s).alias("s")).distinct() for x, s in ((a, 1), (b, 2)))
    sides = va.unionByName(vb).groupBy("column", "v").agg(F.sum("s").alias("s")).groupBy("column")
    over = sides.agg(F.coalesce(F.try_divide(F.count_if(F.col("s") == 3), F.least(F.count_if(F.col("s") != 2), F.count_if(F.col("s") != 1))), F.lit(0.0)).alias("overlap"))
    named = F.lower("column").rlike(r"(^|_)(id|key|code|no|number|uuid)$|key$|id$")
    score = 40 * named.cast("int") + 40 * (F.col("ua") + F.col("ub")) / 2 + 20 * F.col("overlap")
    x = ua.join(ub, "column").join(over, "column").withColumn("score", score)
    kind = F.when((F.col("ua") > 0.95) & (F.col("ub") > 0.95), "same_level").when(F.col("ua") > 0.95, "parent_child").when(F.col("ub") > 0.95, "event_to_entity").otherwise("related")
    return x.select("column", "ua", "ub", "overlap", "score", (F.col("score") >= 35).alias("is_key"), kind.alias("relation"))
