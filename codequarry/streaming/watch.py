"""File events, debounced by silence and applied batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Extensions whose changes count (fixed values; more than extraction reads).
WATCHED = ("py java cpp cc cxx c h hpp hxx rs ts tsx js jsx go cs rb php swift kt kts scala ex exs erl hs").split()


def is_source(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*WATCHED)


def paths_of(events: DataFrame) -> DataFrame:
    """Events (ts, event, path, dest) as one row per path of source; a move touches both its paths."""
    both = F.when(F.col("event") == "moved", F.array("path", "dest")).otherwise(F.array("path"))
    return events.withColumn("path", F.explode(both)).filter(F.col("path").isNotNull() & is_source(F.col("path"))).drop("dest")


def debounce(events: DataFrame, gap: str = "2 seconds", keys: tuple[str, ...] = ()) -> DataFrame:
    """Bursts of events (ts, path): a burst ends after ``gap`` of silence and has its different paths.

    Works on a stream (give it a watermark first) and on a table alike.
    """
    return events.groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.array_sort(F.collect_set("path")).alias("paths"), F.count(F.lit(1)).alias("n_events")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "paths", "n_events")


def watch(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, gap: str = "2 seconds", lateness: str = "10 seconds", available_now: bool = False) -> StreamingQuery:
    """Start a query that calls ``apply`` with each micro-batch of finished bursts; batch ids let it skip a repeat."""
    # A stream's session windows need one more grouping key: the watched root, so each root's bursts are a task's of their own.
    timed = paths_of(events)
    timed = timed.withColumn("watch", F.col("root") if "root" in timed.columns else F.expr("left(path, 0)")).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    writer = debounce(timed, gap, ("watch",)).drop("watch").writeStream.outputMode("append").foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
