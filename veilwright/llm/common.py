"""Shared pieces of the training-data operators: table access, durable cuts, names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durable import drop_cut, materialise, shared_dir

__all__ = ["SPACES", "drop_cut", "fresh_name", "materialise", "shared_dir", "shared_path", "shuffled", "table", "without_spaces"]

#: The six characters of [\x20\x09-\x0D].
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def shuffled(side: DataFrame) -> DataFrame:
    """``side`` for a join of which neither side is broadcast.

    Spark sizes an exploded table as if it weren't, and a written one by its
    compressed columns, so a side that grows with the input may look small.
    """
    return side.hint("merge")


def without_spaces(text: Column) -> Column:
    """Delete every character of [\\x20\\x09-\\x0D], with JVM string replacement."""
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def fresh_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores in front if the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted
