"""The window monitor over events, as a batch."""

from __future__ import annotations

from ..registry import query, table
from ..streaming import monitor


@query("k_monitor_windows", "WITH c AS (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS s FROM events GROUP BY ALL) SELECT CAST(epoch(start) AS BIGINT) AS start_s, min(s) AS k_min, count(*) AS classes, count(*) FILTER (s < 5) AS violations FROM c GROUP BY start")
def k_monitor(spark, d):
    from pyspark.sql import functions as F

    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return monitor.k_per_window(monitor.class_counts(e, ["event_type"], "ts")).select(F.unix_timestamp("start").alias("start_s"), "k_min", "classes", "violations")
