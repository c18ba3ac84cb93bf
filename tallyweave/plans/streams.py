"""Queries on events: each runs as a table; some as a stream to its end too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..streaming import events as S
from ..streaming import state as T
from .inputs import table


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.timed(table(spark, sf_dir, "events"))


def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.windowed(events(spark, sf_dir), "6 hours")


def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.windowed(events(spark, sf_dir), "6 hours", "2 hours")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sessions(events(spark, sf_dir))


def dedupe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return S.without_duplicates(e.unionByName(e.withColumn("ts", F.timestamp_seconds(F.unix_timestamp("ts") + 60))))


def alert_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.alerts(events(spark, sf_dir), "1 hour", 0.25, 1e9)


def held_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours in which a quarter of the events are errors, or the 95th percentile is over 100, for three hours and more."""
    return S.held_alerts(S.measured(events(spark, sf_dir), "1 hour"), {"error_rate": ("error_share", 0.25), "latency": ("p95", 100.0)}, 3600.0, 10_800.0)


def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream of events drained; totals by kind."""
    return S.drained(S.running_total(S.event_stream(spark, sf_dir), F.col("event_type")), "complete")


def stream_token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drained(S.token_bucket(S.event_stream(spark, sf_dir), 0.01, 3.0))


#: Seconds that an answer is held, and that a command may be idle.
TTL, IDLE, LATE = 86_400.0, 21_600.0, "1 hour"


def watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, by user."""
    return S.event_stream(spark, sf_dir).withWatermark("ts", LATE).withColumnsRenamed({"user_id": "key", "event_id": "id"})


def stream_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as lookups of an answer that is held for a day."""
    return S.drained(T.cached(watched(spark, sf_dir), TTL)).select("id", "hit")


def stream_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as stages of commands that end with a purchase, or after six idle hours."""
    rows = T.stage_stream(watched(spark, sf_dir).withColumnRenamed("event_type", "stage"), "purchase", IDLE)
    return S.drained(rows).select("key", F.round("began").cast("long").alias("began"), "place", "id", "stage", "ended")


def stream_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is an entry whose first attempts fail, none to all of them."""
    rows = S.event_stream(spark, sf_dir).withWatermark("ts", LATE).select(F.col("event_id").alias("key"), F.col("event_id").alias("id"), "ts", (F.col("event_id") % 5).alias("payload"))
    out = S.drained(T.deliveries(rows, lambda payload, attempt: attempt > int(payload)))
    return out.select("key", "attempt", F.round("at").cast("long").alias("at"), "outcome")


def log_entries(events: DataFrame) -> DataFrame:
    """Events as entries of four transparency logs."""
    k, ts = F.col("event_id"), F.col("ts")
    kind = F.element_at(F.array(*map(F.lit, T.ENTRY_TYPES)), (k % 3 + 1).cast("int"))
    return events.select((F.col("user_id") % 4).alias("key"), k.alias("id"), "ts", T.leaf(kind, F.concat(F.lit("e-"), k.cast("string")), F.sha2(F.coalesce("props", F.lit("")), 256), E.utc_text(ts), F.md5(k.cast("string"))).alias("leaf"))


def transparency_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roots that four logs publish: every 128 entries, or after ten days."""
    out = S.drained(T.published_roots(log_entries(S.event_stream(spark, sf_dir).withWatermark("ts", LATE)), 128, 864_000.0))
    return out.select("key", "tree_size", "root_hash")


LIST = (tumbling_windows, sliding_windows, sessions, dedupe_events, alert_windows, held_alerts, stream_totals, stream_token_bucket, stream_cache, stream_stages, stream_deliveries, transparency_roots)
QUERIES = {f.__name__: f for f in LIST}
_WALK = "ticks AS MATERIALIZED (SELECT *, epoch_us(ts) / 1e6::DOUBLE AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"
_RULE = "(CASE event_id % 3 WHEN 0 THEN 'receipt' WHEN 1 THEN 'assertion' ELSE 'tombstone' END)"
_LEAF = f"""'{{"entry_id":"e-' || event_id || '","entry_type":"' || {_RULE} || '","nonce":"' || md5(event_id::VARCHAR) || '","root_hash":"' || sha256(coalesce(props, '')) || '","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || '","version":"1.0"}}'"""
_AGG = "event_type, count(*)::BIGINT AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents"
ORACLE = {
    "tumbling_windows": f"SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start, {_AGG} FROM events GROUP BY 1, 2",
    "sliding_windows": f"SELECT time_bucket(INTERVAL '2 hours', ts, TIMESTAMP '1970-01-01') - to_hours(h) AS start, {_AGG} FROM events, (SELECT unnest([0, 2, 4]) AS h) GROUP BY 1, 2",
    "sessions": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*)::BIGINT AS n FROM s GROUP BY user_id, s""",
    "dedupe_events": "SELECT event_id, ts, user_id, event_type, value, props FROM events",
    "alert_windows": "SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS start, count(*)::BIGINT AS n, count_if(event_type = 'error')::BIGINT AS errors, 'error_rate' AS alerts FROM events GROUP BY 1 HAVING count_if(event_type = 'error') > count(*) * 0.25",
    "held_alerts": """WITH w AS (SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS start, count_if(event_type = 'error') / count(*)::DOUBLE AS share, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1),
bad AS (SELECT start, 'error_rate' AS rule FROM w WHERE share > 0.25 UNION ALL SELECT start, 'latency' FROM w WHERE p95 > 100),
run AS (SELECT *, start - to_hours(row_number() OVER (PARTITION BY rule ORDER BY start)::INT) AS stretch FROM bad)
SELECT rule, min(start) AS began, min(start) + INTERVAL '3 hours' AS fired, max(start) + INTERVAL '1 hour' AS ended, count(*)::BIGINT AS windows FROM run GROUP BY rule, stretch HAVING count(*) >= 3""",
    "stream_cache": f"""WITH RECURSIVE {_WALK}, walk AS (SELECT user_id, event_id, k, s AS kept, false AS hit FROM ticks WHERE k = 1
  UNION ALL SELECT t.user_id, t.event_id, t.k, CASE WHEN t.s < w.kept + {TTL} THEN w.kept ELSE t.s END, t.s < w.kept + {TTL} FROM walk w JOIN ticks t ON t.user_id = w.user_id AND t.k = w.k + 1) SELECT event_id AS id, hit FROM walk""",
    "stream_stages": f"""WITH {_WALK}, cut AS (SELECT *, CASE WHEN k = 1 OR s - lag(s) OVER u >= {IDLE} OR lag(event_type) OVER u = 'purchase' THEN 1 ELSE 0 END AS fresh FROM ticks WINDOW u AS (PARTITION BY user_id ORDER BY k)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY k) AS run FROM cut),
placed AS (SELECT *, min(s) OVER r AS began, row_number() OVER (PARTITION BY user_id, run ORDER BY k) AS place, last_value(event_type) OVER r AS final, max(s) OVER r AS ends, count(*) OVER r AS n FROM runs WINDOW r AS (PARTITION BY user_id, run ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT user_id AS key, round(began)::BIGINT AS began, place, event_id AS id, event_type AS stage, CASE WHEN event_type = 'purchase' THEN 'done' END AS ended FROM placed
UNION ALL SELECT user_id, round(began)::BIGINT, n + 1, NULL, NULL, 'timeout' FROM placed WHERE place = 1 AND final <> 'purchase' AND (ends + {IDLE} <= (SELECT max(s) - 3600 FROM ticks) OR run < (SELECT max(run) FROM runs q WHERE q.user_id = placed.user_id))""",
    "stream_deliveries": """WITH e AS (SELECT event_id, epoch_us(ts) / 1e6::DOUBLE AS s, event_id % 5 AS fails FROM events), a AS (SELECT *, unnest([1, 2, 3]) AS attempt, unnest([0, 2, 6]) AS wait FROM e)
SELECT event_id AS key, attempt::BIGINT AS attempt, round(s + wait)::BIGINT AS at, CASE WHEN attempt > fails THEN 'done' WHEN attempt = 3 THEN 'dead' ELSE 'failed' END AS outcome
FROM a WHERE attempt <= fails + 1 AND (attempt = 1 OR s + wait <= (SELECT max(s) - 3600 FROM e))""",
    "transparency_roots": f"""WITH RECURSIVE e AS MATERIALIZED (
  SELECT user_id % 4 AS key, epoch_us(ts) / 1e6::DOUBLE AS s, sha256('\\x00'::BLOB || unhex(sha256({_LEAF}))) AS hash, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS k FROM events),
walk AS (SELECT key, k, k AS published, s AS at FROM e WHERE k = 1
  UNION ALL SELECT e.key, e.k, CASE WHEN e.k - w.published >= 128 OR e.s - w.at >= 864000 THEN e.k ELSE w.published END, CASE WHEN e.k - w.published >= 128 OR e.s - w.at >= 864000 THEN e.s ELSE w.at END FROM walk w JOIN e ON e.key = w.key AND e.k = w.k + 1),
sizes AS (SELECT key, k AS size FROM walk WHERE published = k),
t AS (SELECT s.key, s.size, 0 AS level, e.k - 1 AS idx, e.hash, s.size AS n FROM sizes s JOIN e ON e.key = s.key AND e.k <= s.size
  UNION ALL SELECT key, size, max(level) + 1, idx // 2, CASE WHEN count(*) = 2 THEN sha256('\\x01'::BLOB || unhex(arg_min(hash, idx)) || unhex(arg_max(hash, idx))) ELSE min(hash) END, (max(n) + 1) // 2 FROM t WHERE n > 1 GROUP BY key, size, idx // 2)
SELECT key, size AS tree_size, hash AS root_hash FROM t WHERE n = 1""",
    "stream_totals": "SELECT event_type AS key, count(*)::BIGINT AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1",
}
