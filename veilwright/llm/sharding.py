"""Rendezvous hashing of record keys over weighted shards.

A key meets every shard in a race: a number in (0, 1) drawn by md5 of shard and
key gives the time -ln(u) / weight, and the shard of least time takes the record.
Times of other shards don't change when one is added, given more weight or taken
away, so records move only into the shard that grew or out of the one that
shrank, and the share of a shard is its weight's share.

A row's shard is a function of its key alone: one map, no shuffle, the same for
every reader. Rows that repeat a key therefore share a shard, however many they
are; their places within it are dealt over ranges, so a hot key fills no task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import global_rank
from .common import materialise

#: Bits of md5 that make the number: as many as a double holds beside the half that keeps it from 0.
HEX = 13


def _race(key: Column, weights: list[float]) -> Column:
    """array<struct<time, shard, bits>>, an entry a shard."""
    table = F.array(*(F.lit(float(w)) for w in weights))
    text = F.coalesce(key.cast("string"), F.lit(""))

    def one(j: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat_ws("|", j.cast("string"), text).cast("binary")), 1, HEX), 16, 10).cast("long")
        time = -F.ln((bits + 0.5) / F.lit(float(16**HEX))) / F.element_at(table, j + 1)
        return F.struct(time.alias("time"), j.alias("shard"), bits.alias("bits"))

    return F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), one)


def _checked(weights: list[float]) -> list[float]:
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("every shard needs a weight above 0")
    return weights


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard of ``key``, from 0; a null key counts as ''."""
    return F.array_min(_race(key, _checked(weights)))["shard"]


def assign(df: DataFrame, key: str, weights: list[float], grown: list[float] | None = None, text: str | None = "text") -> DataFrame:
    """``df`` with shard (int), grown_shard (int: the shard if there were those of ``grown`` too), order (long), and of ``text`` size and text_crc32 (long).

    Size is the text's UTF-8 bytes plus 1; a null text has size 1 and the sum of
    ''. Columns of these names are replaced. An empty table gives an empty one.
    """
    n, all_weights = len(_checked(weights)), _checked([*weights, *(grown or [])])
    won, new = F.array_min(F.slice("_race", 1, n)), F.array_min("_race")["shard"]
    sums = {"size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1, "text_crc32": F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))} if text else {}
    out = df.withColumns(sums | {"_race": _race(F.col(key), all_weights)})
    # Made once for the three columns that read it.
    return out.withColumns({"shard": won["shard"], "order": won["bits"], "grown_shard": new if grown else F.lit(None).cast("int")}).drop("_race")


def place(assigned: DataFrame, key: str, also: list[str] | None = None) -> DataFrame:
    """``assigned`` with slot (long): gapless from 0 within each shard.

    Slots are in the order of the key's number, which mixes sources and
    neighbours, then of the key and the columns ``also``; rows equal in all of
    them are numbered in any order. Ranges of (shard, order) are numbered one by
    one; neither a large shard nor a hot key is a task of its own.
    """
    rows = materialise(assigned.withColumn("_at", F.monotonically_increasing_id()), "shard-rows")
    by = ["shard", "order", key, *(also or []), "_at"]
    ranked = global_rank(rows, [F.col(c) for c in by], "slot")
    # A row a shard, and ranks follow the shards.
    first = materialise(rows.groupBy("shard").agg(F.count(F.lit(1)).alias("_n")), "shard-counts")
    more = first.select(F.col("shard").alias("_s"), F.col("_n").alias("_before"))
    offset = first.join(F.broadcast(more), F.col("_s") < F.col("shard"), "left").groupBy("shard").agg(F.coalesce(F.sum("_before"), F.lit(0)).alias("_off"))
    return ranked.join(F.broadcast(offset), "shard").withColumn("slot", F.col("slot") - 1 - F.col("_off")).drop("_off", "_at")


def moves(df: DataFrame, key: str, before: list[float], after: list[float]) -> DataFrame:
    """(key, from_shard, to_shard) of the distinct keys that change their shard when weights change from ``before`` to ``after``."""
    keys = df.select(key).distinct().select(key, shard_of(F.col(key), before).alias("from_shard"), shard_of(F.col(key), after).alias("to_shard"))
    return keys.filter("from_shard <> to_shard")


def write_shards(df: DataFrame, key: str, weights: list[float], path: str, text: str = "text", rows_per_file: int = 100_000) -> DataFrame:
    """Write ``df`` with its slots to a folder a shard, files of at most ``rows_per_file`` rows in the order of slots; returns (shard, rows, bytes) as read back."""
    placed = place(assign(df, key, weights, None, text), key, ["size", "text_crc32"]).drop("order", "grown_shard")
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(path)
    back = df.sparkSession.read.parquet(path)
    return back.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
