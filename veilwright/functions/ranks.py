"""Row numbers over a whole table, without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import materialise


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with the 1-based position of each row in ``order``.

    The table is dealt into ranges of the order and numbered range by range; the
    ranges' sizes, one row a range, are summed up to give each its offset. Ties
    that ``order`` leaves open are numbered in any order.
    """
    keys = {f"_vw_o{i}": c for i, c in enumerate(order)}
    dealt = df.withColumns(keys).repartitionByRange(*(F.col(k).asc_nulls_first() for k in keys)).withColumn("_vw_part", F.spark_partition_id())
    dealt = materialise(dealt, "ranges")
    local = Window.partitionBy("_vw_part").orderBy(*(F.col(k).asc_nulls_first() for k in keys))
    sizes = dealt.groupBy("_vw_part").agg(F.count(F.lit(1)).alias("_vw_n"))
    # One row per range partition: a bounded number.
    before = sizes.withColumn("_vw_off", F.coalesce(F.sum("_vw_n").over(Window.orderBy("_vw_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_vw_n")
    out = dealt.withColumn("_vw_rn", F.row_number().over(local)).join(before, "_vw_part")
    return out.withColumn(name, F.col("_vw_rn") + F.col("_vw_off")).drop("_vw_part", "_vw_rn", "_vw_off", *keys)


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with running sums {new: column} in ``order``, inclusive; rows of equal order are summed one by one in any order.

    As ``global_rank``: sums within ranges, plus the totals of the ranges before.
    """
    keys = {f"_vw_o{i}": c for i, c in enumerate(order)}
    asc = [F.col(k).asc_nulls_first() for k in keys]
    dealt = materialise(df.withColumns(keys).repartitionByRange(*asc).withColumn("_vw_part", F.spark_partition_id()), "ranges")
    local = Window.partitionBy("_vw_part").orderBy(*asc).rowsBetween(Window.unboundedPreceding, 0)
    totals = dealt.groupBy("_vw_part").agg(*(F.sum(c).alias(f"_vw_t{i}") for i, c in enumerate(sums.values())))
    # One row per range partition.
    before = Window.orderBy("_vw_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_vw_part", *(F.coalesce(F.sum(f"_vw_t{i}").over(before), F.lit(0)).alias(f"_vw_b{i}") for i in range(len(sums))))
    out = dealt.join(totals, "_vw_part")
    out = out.withColumns({n: F.sum(c).over(local) + F.col(f"_vw_b{i}") for i, (n, c) in enumerate(sums.items())})
    return out.drop("_vw_part", *keys, *(f"_vw_b{i}" for i in range(len(sums))))


def value_ranks(rows: DataFrame) -> DataFrame:
    """(key, x, n, upto) of ``rows`` (key, x): how often each value of a key occurs, and the rows of the key up to it; nulls are left out.

    Equal values are counted before the shuffle; what is sorted are the distinct
    values, by ranges of key and value.
    """
    counts = rows.filter("key IS NOT NULL AND x IS NOT NULL").groupBy("key", "x").agg(F.count(F.lit(1)).alias("n"))
    run = materialise(prefix_sums(counts, [F.col("key"), F.col("x")], {"_to": "n"}), "value-ranks")
    start = run.groupBy("key").agg(F.min(F.col("_to") - F.col("n")).alias("_start"))
    return run.join(start, "key").select("key", "x", "n", (F.col("_to") - F.col("_start")).alias("upto"))


def quantiles(ranks: DataFrame, shares: list[float]) -> DataFrame:
    """(key, q0, q1, ...): exact quantiles of each key, linear between neighbours, from ``value_ranks``."""
    total = ranks.groupBy("key").agg(F.max("upto").alias("_all"))
    x = ranks.join(total, "key")
    aggs = []
    for i, p in enumerate(shares):
        at = F.lit(float(p)) * (F.col("_all") - 1)
        for side, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            aggs.append(F.max(F.when((F.col("upto") - F.col("n") <= pos) & (pos < F.col("upto")), F.col("x"))).alias(f"{side}{i}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"part{i}"))
    got = x.groupBy("key").agg(*aggs)
    return got.select("key", *((F.col(f"lo{i}") * (1 - F.col(f"part{i}")) + F.col(f"hi{i}") * F.col(f"part{i}")).alias(f"q{i}") for i in range(len(shares))))


def _at(shares: list[float], n: Column) -> list[tuple[int, str, Column]]:
    """(share's number, side, 0-based place) of the two neighbours of each quantile among n rows."""
    return [(i, side, f(F.lit(float(p)) * (n - 1)).cast("long")) for i, p in enumerate(shares) for side, f in (("lo", F.floor), ("hi", F.ceil))]


def exact_quantiles(rows: DataFrame, shares: list[float], bins: int = 4096, few: int = 100_000) -> DataFrame:
    """(key, q0, q1, ...): as ``quantiles(value_ranks(rows), shares)``, without sorting all values.

    Rows (key, x) are counted in ``bins`` equal ranges of each key, which says in
    which range a quantile lies and how many rows are below; only rows of those
    ranges are looked at again, each range sorted on its own. A range of more than
    ``few`` rows, where most values crowd, is ranked by ``value_ranks``. ``rows`` is
    read three times. NaN counts as the largest value; nulls are left out.
    """
    rows = rows.filter("key IS NOT NULL AND x IS NOT NULL").select("key", "x", F.isnan(F.col("x").cast("double")).alias("_nan"))
    ends = rows.groupBy(F.col("key").alias("_k")).agg(F.min(F.when(~F.col("_nan"), F.col("x"))).alias("_lo"), F.max(F.when(~F.col("_nan"), F.col("x"))).alias("_hi"))
    ends = materialise(ends, "value-ends")
    place = F.nanvl((F.col("x").cast("double") - F.col("_lo")) / F.nullif(F.col("_hi").cast("double") - F.col("_lo"), F.lit(0.0)) * bins, F.lit(0.0))
    bin_ = F.when(F.col("_nan"), bins).otherwise(F.least(F.lit(bins - 1), F.coalesce(F.floor(place), F.lit(0)))).cast("int")
    placed = rows.join(ends, F.col("key") == F.col("_k")).select("key", "x", bin_.alias("bin"))
    counts = materialise(placed.groupBy("key", "bin").agg(F.count(F.lit(1)).alias("c")), "value-bins")
    # At most ``bins`` + 1 rows a key.
    run = counts.withColumn("below", F.sum("c").over(Window.partitionBy("key").orderBy("bin")) - F.col("c")).withColumn("n", F.sum("c").over(Window.partitionBy("key")))
    hit = F.array_distinct(F.array(*(F.when((at >= F.col("below")) & (at < F.col("below") + F.col("c")), F.lit(1)).otherwise(0) for _, _, at in _at(shares, F.col("n")))))
    wanted = materialise(run.filter(F.array_contains(hit, 1)).select(F.col("key").alias("_k"), F.col("bin").alias("_b"), "c", "below", "n"), "value-targets")
    inside = placed.join(wanted, (F.col("key") == F.col("_k")) & (F.col("bin") == F.col("_b")))
    values = inside.groupBy("key", "bin", "x", "below", "n", "c").agg(F.count(F.lit(1)).alias("m"))
    light = values.filter(F.col("c") <= few).withColumn("upto", F.sum("m").over(Window.partitionBy("key", "bin").orderBy("x")))
    ranked = light.select("key", "x", "m", "n", (F.col("below") + F.col("upto")).alias("upto"))
    if not wanted.filter(F.col("c") > few).isEmpty():
        heavy = value_ranks(inside.filter(F.col("c") > few).select(F.struct("key", "bin").alias("key"), "x")).withColumnRenamed("n", "m")
        heavy = heavy.join(wanted, (F.col("key.key") == F.col("_k")) & (F.col("key.bin") == F.col("_b")))
        ranked = ranked.unionByName(heavy.select(F.col("key.key").alias("key"), "x", "m", "n", (F.col("below") + F.col("upto")).alias("upto")))
    got = ranked.groupBy("key").agg(F.max("n").alias("_n"), *(F.max(F.when((F.col("upto") - F.col("m") <= at) & (at < F.col("upto")), F.col("x"))).alias(f"{side}{i}") for i, side, at in _at(shares, F.col("n"))))
    part = [F.lit(float(p)) * (F.col("_n") - 1) for p in shares]
    return got.select("key", *((F.col(f"lo{i}") * (1 - (x - F.floor(x))) + F.col(f"hi{i}") * (x - F.floor(x))).alias(f"q{i}") for i, x in enumerate(part)))


def column_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """(key, x): the values of numeric columns under the columns' names."""
    return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("x")) for c in cols))).alias("_r")).select("_r.*")
