"""An extension: equivalence classes of a stream, watched per window of event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_counts(stream: DataFrame, qi: list[str], ts: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, qi..., class_size) per tumbling window, final once the watermark has passed it; batch tables work too."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), *qi).agg(F.count(F.lit(1)).alias("class_size")).select(F.col("w.start").alias("start"), *qi, "class_size")


def k_per_window(counts: DataFrame, k: int = 5) -> DataFrame:
    """Least class, classes and classes below k of each window."""
    return counts.groupBy("start").agg(F.min("class_size").alias("k_min"), F.count(F.lit(1)).alias("classes"), F.count_if(F.col("class_size") < k).alias("violations"))


def enforce(counts: DataFrame, sink: Callable[[DataFrame, int], None], k: int = 5, checkpoint: str | None = None):
    """Start a query that hands each batch of finished classes of at least k rows to ``sink``."""
    writer = counts.writeStream.outputMode("append").foreachBatch(lambda df, n: sink(df.filter(F.col("class_size") >= k), n))
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
