"""Event streams: windows with watermarks, sessions, duplicates, alerts, and state by key. Each takes a stream or a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shared import shared_path

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """The events of a folder as a stream of files."""
    return timed(spark.readStream.schema(SCHEMA).option("pathGlobFilter", pattern).parquet(folder))


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events by kind and window: start, event_type, n, cents. Later than the watermark is dropped in a stream."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "cents")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Each user's sessions: stretches of events less than gap apart."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def without_duplicates(events: DataFrame, late: str = "1 day") -> DataFrame:
    """The first of the events of one id: in a stream within the watermark, in a table the earliest."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    rest = [c for c in events.columns if c != "event_id"]
    first = F.min(F.struct("ts", *(c for c in rest if c != "ts"))).alias("e")
    return events.groupBy("event_id").agg(first).select("event_id", *(F.col(f"e.{c}").alias(c) for c in rest))


def alerts(events: DataFrame, size: str = "5 minutes", error_share: float = 0.01, slow: float = 300.0, late: str = "1 hour") -> DataFrame:
    """Windows in which errors or the 95th percentile of the values are too high."""
    w = F.window("ts", size)
    n = F.count(F.lit(1))
    out = events.withWatermark("ts", late).groupBy(w.alias("w")).agg(n.alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.percentile_approx("value", 0.95, 10_000).alias("p95"))
    rules = F.array_compact(F.array(F.when(F.col("errors") > F.col("n") * error_share, "error_rate"), F.when(F.col("p95") > slow, "latency")))
    return out.select(F.col("w.start").alias("start"), "n", "errors", F.array_join(rules, ",").alias("alerts")).where("alerts <> ''")


def measured(events: DataFrame, size: str) -> DataFrame:
    """start, n, error_share and p95 (exact: counts by value are merged) of each window that has events."""
    p95 = F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)")
    out = events.groupBy(F.window("ts", size).alias("w")).agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("event_type") == "error") / F.count(F.lit(1))).alias("error_share"), p95.alias("p95"))
    return out.select(F.col("w.start").alias("start"), "n", "error_share", "p95")


def held_alerts(windows: DataFrame, limits: dict[str, tuple[str, float]], step: float, hold: float) -> DataFrame:
    """rule, began, fired, ended, windows: stretches of successive windows of step seconds in which a measure stays over its limit for hold seconds.

    limits: measure and limit by rule. A window without events, or at the limit, ends a stretch; an alert fires when it has
    held for so long. There is a row for each window and rule, so a rule's windows are put in order as a whole.
    """
    rules = F.array_compact(F.array(*(F.when(F.col(c) > most, rule) for rule, (c, most) in limits.items())))
    bad = windows.select(F.unix_micros("start").alias("at"), F.explode(rules).alias("rule"))
    width = int(step * 1_000_000)
    bad = bad.withColumn("stretch", F.col("at") - F.row_number().over(Window.partitionBy("rule").orderBy("at")) * width)
    out = bad.groupBy("rule", "stretch").agg(F.min("at").alias("began"), F.max("at").alias("last"), F.count(F.lit(1)).alias("windows")).where(F.col("windows") * width >= hold * 1_000_000)
    time = lambda c: F.timestamp_micros(c.cast("long"))
    return out.select("rule", time(F.col("began")).alias("began"), time(F.col("began") + F.lit(int(hold * 1_000_000))).alias("fired"), time(F.col("last") + F.lit(width)).alias("ended"), "windows")


def token_bucket(events: DataFrame, per_minute: float, burst: float) -> DataFrame:
    """user_id, event_id, allowed of a stream: the state of a user is the tokens left and the time of the last event."""
    rate = per_minute / 60.0

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (burst, None)
        for f in frames:
            rows = f.sort_values(["seconds", "event_id"])
            allowed = []
            for now in rows["seconds"]:
                tokens = min(burst, tokens + max(0.0, now - last) * rate) if last is not None else tokens
                last = now
                allowed.append(tokens >= 1.0)
                tokens -= 1.0 if tokens >= 1.0 else 0.0
            yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "allowed": allowed})
        state.update((tokens, last))

    rows = events.select("user_id", "event_id", (F.unix_micros("ts") / 1e6).alias("seconds"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream has now, run to its end and read back."""
    spark = stream.sparkSession
    out = shared_path(spark, "stream")
    if mode == "append":
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    else:
        write: Callable[[DataFrame, int], None] = lambda df, _: df.write.mode("overwrite").parquet(out)
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", shared_path(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def running_total(events: DataFrame, key: Column) -> DataFrame:
    """Totals by key, for update or complete mode."""
    return events.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
