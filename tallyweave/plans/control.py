"""Queries on the rules around the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import control as C
from .access import BATCHES, batches
from .evidence import _TICKS, ticks
from .inputs import table

COMMANDS = ["go to Review", "goto nowhere", "HOME", "resolve --file=a.pdf", "resolve  b.txt ", "set mode=x", "toggle  y", "hello", " show settings ", "open"]


def _cycled(values: list[str], k: str) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(k) % len(values) + 1).cast("int"))


def commands_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", C.command(_cycled(COMMANDS, "c_custkey")).alias("c"))
    return rows.select("c_custkey", "c.intent", "c.nav_target", "c.argument", "c.error", F.array_join(C.plan_steps(F.col("c.intent")), ",").alias("plan"))


def batch_ids_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", C.safe_batch_id(F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("BATCH-"), F.col("p_partkey").cast("string"))).otherwise(F.repeat(F.lit("x"), 129))).alias("batch_id"))


def trace_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    header = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("00/"), k)).otherwise(C.trace_header(F.concat(F.lit("t"), k), F.concat(F.lit("s"), k)))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.trace_context(header).alias("c")).select("o_orderkey", "c.trace_id", "c.parent_span_id")


REPLIES = ['{"resolution": "Acme", "confidence": 0.9}', 'Sure: ```json\n{"resolution": "Beta", "confidence": 1.5}\n```', "no json here", "", '{"resolution": "Gamma", "confidence": -0.25} end', "{broken", '{"confidence": 0.5}']


def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", C.model_reply(_cycled(REPLIES, "c_custkey")).alias("r")).select("c_custkey", "r.*")


def _event_json(k: str, text: str) -> str:
    s = f"CAST({k} AS {text})"
    head = f"""'"version":"1.0","event_id":"e' || {s} || '","timestamp":"2024-01-01T00:00:00Z","tenant_id":"t","correlation_id":"c"'"""
    done = f"""'{{"event_type":"resolution.completed",' || {head} || ',"data":{{"resolution_id":"r' || {s} || '","document_id":"d","status":"resolved","layer_used":' || CAST({k} % 6 AS {text}) || ',"confidence":0.5,"evidence_chain_id":"x"}}}}'"""
    made = f"""'{{"event_type":"review.decision_made",' || {head} || ',"data":{{"case_id":"c","resolution_id":"r' || {s} || '","decision":"approve","evidence_chain_id":"x"' || CASE WHEN {k} % 2 = 0 THEN ',"decided_by":"ana"' ELSE '' END || '}}}}'"""
    return f"CASE {k} % 5 WHEN 0 THEN {done} WHEN 1 THEN {made} WHEN 2 THEN '{{\"event_type\":\"other.kind\",' || {head} || ',\"data\":{{}}}}' WHEN 3 THEN 'not json' ELSE '{{\"version\":\"1.0\"}}' END"


def event_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", f"{_event_json('o_orderkey', 'STRING')} AS value")
    return C.events(raw).select("k", "event_type", "event_id", F.coalesce("resolution.resolution_id", "review.resolution_id").alias("resolution_id"), "resolution.layer_used", "review.decision", "problem")


def eastern_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as they are shown in New York, for a place where that is five hours behind: winter."""
    k = F.col("o_orderkey")
    value = F.when(k % 9 == 0, F.lit(None).cast("string")).when(k % 9 == 1, "soon").otherwise(F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("T"), F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":05:00"), F.when(k % 2 == 0, "Z").otherwise("")))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.eastern(value).alias("shown"))


KEYS = ["keys/prod-1", "keys/demo-1", "keys/test", "keys/prod-demo", "keys/other"]


def environment_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, live = F.col("c_custkey"), F.col("c_custkey") % 2 == 0
    mode = _cycled(["PRODUCTION_REAL", "DEMO_SIMULATED", "OTHER"], "c_custkey")
    print_ = F.when(k % 7 == 0, "demo-ab").otherwise("ab")
    return table(spark, sf_dir, "customer").select("c_custkey", C.mode_error(mode, live).alias("mode_error"), C.key_error(_cycled(KEYS, "c_custkey"), print_, live).alias("key_error"))


def purge_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = batches(spark, sf_dir)
    return b.select("trace_id", C.purge(F.when(F.col("k") % 10 != 0, F.col("k") * 30), F.col("hold") == "ACTIVE", 2555).alias("state"))


def purge_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that stay after a purge of those that are not held."""
    b = batches(spark, sf_dir).where("hold IS NULL OR hold <> 'ACTIVE'").select("trace_id", (F.col("k") * 30).alias("age"), (F.col("hold") == "ACTIVE").alias("held"))
    return C.purged(b, "age", "held", 2555).select("trace_id", "age")


def kill_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "orders").select(_cycled(["llm", "export"], "o_orderkey").alias("switch"), F.when(F.col("o_orderkey") % 50 != 0, F.concat(F.lit("t"), (F.col("o_custkey") % 5).cast("string"))).alias("tenant"), F.when(F.col("o_orderkey") % 3 == 0, "activate").otherwise("deactivate").alias("action"), F.col("o_orderkey").alias("at"))
    rows = C.with_switch(batches(spark, sf_dir), C.latest_switches(log), "export")
    return rows.select("trace_id", "tenant_id", "killed")


def bill_of_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashes = F.collect_list(F.when(F.col("p_partkey") % 4 != 0, F.sha2("p_name", 256)))
    return table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 100).alias("app")).agg(C.combined_hash(hashes).alias("sbom_hash"))


def config_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.current_config(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey", "o_orderkey")


def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "customer")
    return b.select("c_custkey", C.cache_key(F.concat(F.lit("t"), F.col("c_nationkey").cast("string")), F.concat(F.lit("  "), F.col("c_name"), F.lit("  Inc ")), F.lit("abc")).alias("cache_key"))


def idempotent_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir).select("user_id", "event_id", "seconds")
    return C.fresh_requests(rows, "user_id", ["seconds", "event_id"], "seconds", 86_400.0).select("event_id", "fresh")


def finalize_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks(spark, sf_dir).select("user_id", "event_id", "seconds", ((F.col("event_type") == "purchase") & (F.col("event_id") % 10 == 0)).alias("completes"))
    return C.finalize_lock(rows, "user_id", ["seconds", "event_id"], "seconds", "completes", 36_000.0).select("event_id", "outcome")


def slots_granted(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", -1).otherwise(0)
    rows = ticks(spark, sf_dir).select("user_id", "event_id", "seconds", change.alias("change"))
    return C.slots(rows, "user_id", ["seconds", "event_id"], "change", 3).select("event_id", "taken", "granted")


LIST = (commands_parsed, batch_ids_checked, trace_headers, model_replies, event_envelopes, eastern_times, environment_rules, purge_states, purge_kept, kill_switches, bill_of_materials, config_versions, cache_keys, idempotent_requests, finalize_locks, slots_granted)
QUERIES = {f.__name__: f for f in LIST}


def _rows(values: list[str], rows: list[str]) -> str:
    """A table that gives each of some values its expected row."""
    return "(VALUES " + ", ".join(f"({k}, {r})" for k, r in enumerate(rows)) + ")"


_R, _NONE = "pii_scan,pii_mask,llm_resolve,pii_unmask,evidence_chain,persist", "NULL, NULL"
_PARSED = [
    "'NAVIGATE', '/review', 'review', NULL, 'navigate'", "'UNKNOWN', NULL, NULL, 'Unknown destination: nowhere', ''", "'NAVIGATE', '/', 'home', NULL, 'navigate'", f"'RESOLVE', '/resolutions', 'a.pdf', NULL, '{_R}'", f"'RESOLVE', '/resolutions', 'b.txt', NULL, '{_R}'", "'CONFIG', '/admin', 'mode=x', NULL, 'load_config,apply_change,audit_log'",
    "'CONFIG', '/admin', 'y', NULL, 'load_config,apply_change,audit_log'", "'UNKNOWN', NULL, 'hello', 'Try: goto resolutions, resolve --file=report.pdf', ''", "'NAVIGATE', '/admin', 'settings', NULL, 'navigate'", "'UNKNOWN', NULL, 'open', 'Try: goto resolutions, resolve --file=report.pdf', ''",
]
_REPLIED = ["'Acme', 0.9, true, NULL", "'Beta', 1.0, false, 'Confidence 1.5 out of range [0.0, 1.0]'", "'no json here', 0.0, true, NULL", "'', 0.0, false, 'Empty response'", "'Gamma', 0.0, false, 'Confidence -0.25 out of range [0.0, 1.0]'", "'{broken', 0.0, true, NULL", "'', 0.0, false, 'Empty response'"]
ORACLE = {
    "commands_parsed": f"SELECT c_custkey, intent, nav_target, argument, error, plan FROM customer JOIN {_rows(COMMANDS, _PARSED)} v(k, intent, nav_target, argument, error, plan) ON c_custkey % {len(COMMANDS)} = k",
    "batch_ids_checked": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CASE WHEN regexp_full_match(p_name, '[A-Za-z0-9-]+') THEN p_name END WHEN 1 THEN 'BATCH-' || p_partkey END AS batch_id FROM part",
    "trace_headers": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN 't' || o_orderkey END AS trace_id, CASE WHEN o_orderkey % 5 <> 0 THEN 's' || o_orderkey END AS parent_span_id FROM orders",
    "model_replies": f"SELECT c_custkey, resolution, confidence::DOUBLE AS confidence, valid, error FROM customer JOIN {_rows(REPLIES, _REPLIED)} v(k, resolution, confidence, valid, error) ON c_custkey % {len(REPLIES)} = k",
    "event_envelopes": """SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'resolution.completed' WHEN 1 THEN 'review.decision_made' WHEN 2 THEN 'other.kind' END AS event_type, CASE WHEN o_orderkey % 5 < 3 THEN 'e' || o_orderkey END AS event_id, CASE WHEN o_orderkey % 5 < 2 THEN 'r' || o_orderkey END AS resolution_id,
  CASE WHEN o_orderkey % 5 = 0 THEN (o_orderkey % 6)::INT END AS layer_used, CASE WHEN o_orderkey % 5 = 1 THEN 'approve' END AS decision,
  CASE o_orderkey % 5 WHEN 0 THEN CASE WHEN o_orderkey % 6 NOT BETWEEN 1 AND 4 THEN 'layer_used out of bounds' END WHEN 1 THEN CASE WHEN o_orderkey % 2 = 1 THEN 'missing data.decided_by' END WHEN 2 THEN 'unknown event_type: other.kind' ELSE 'missing event_type' END AS problem FROM orders""",
    "eastern_times": "WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 > 1 THEN make_timestamp(2024, 1, (o_orderkey % 28 + 1)::INT, (o_orderkey % 24)::INT, 5, 0) - to_hours(5) END AS t FROM orders) SELECT o_orderkey, coalesce(strftime(t, '%b %-d, %Y, %-I:%M %p') || ' ET', '—') AS shown FROM t",
    "environment_rules": """WITH c AS (SELECT c_custkey, c_custkey % 2 = 0 AS live, ['PRODUCTION_REAL', 'DEMO_SIMULATED', 'OTHER'][(c_custkey % 3 + 1)::INT] AS mode, ['keys/prod-1', 'keys/demo-1', 'keys/test', 'keys/prod-demo', 'keys/other'][(c_custkey % 5 + 1)::INT] AS key, c_custkey % 7 = 0 AS demo_print FROM customer)
SELECT c_custkey, CASE WHEN live AND mode <> 'PRODUCTION_REAL' THEN 'Production environment requires artifact_mode=PRODUCTION_REAL, got: ' || mode WHEN NOT live AND mode <> 'DEMO_SIMULATED' THEN 'Demo environment requires artifact_mode=DEMO_SIMULATED, got: ' || mode END AS mode_error,
  CASE WHEN live THEN CASE key WHEN 'keys/prod-1' THEN CASE WHEN demo_print THEN 'demo fingerprint in production' END WHEN 'keys/other' THEN 'production key without prod' ELSE 'demo key in production' END WHEN key = 'keys/prod-1' THEN 'production key in demo' END AS key_error FROM c""",
    "purge_states": f"WITH {BATCHES} SELECT trace_id, CASE WHEN hold = 'ACTIVE' THEN 'blocked' WHEN k % 10 = 0 OR k * 30 < 2555 THEN 'kept' ELSE 'purged' END AS state FROM batches",
    "purge_kept": f"WITH {BATCHES} SELECT trace_id, k * 30 AS age FROM batches WHERE coalesce(hold, '') <> 'ACTIVE' AND k * 30 < 2555",
    "kill_switches": f"""WITH {BATCHES}, log AS (SELECT CASE WHEN o_orderkey % 50 <> 0 THEN 't' || (o_custkey % 5) END AS tenant, arg_max(o_orderkey % 3 = 0, o_orderkey) AS killed FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT trace_id, tenant_id, coalesce((SELECT killed FROM log WHERE tenant IS NULL), false) OR coalesce(killed, false) AS killed FROM batches LEFT JOIN log ON tenant_id = tenant""",
    "bill_of_materials": "SELECT p_partkey % 100 AS app, CASE WHEN count(*) FILTER (p_partkey % 4 <> 0) > 0 THEN sha256(string_agg(sha256(p_name), ':' ORDER BY sha256(p_name)) FILTER (p_partkey % 4 <> 0)) END AS sbom_hash FROM part GROUP BY 1",
    "config_versions": "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority, (count(*) - 1)::BIGINT AS history FROM orders GROUP BY 1",
    "cache_keys": "SELECT c_custkey, sha256('t' || c_nationkey || ':' || lower(c_name) || ' inc:abc') AS cache_key FROM customer",
    "idempotent_requests": f"""WITH RECURSIVE {_TICKS}, walk AS (SELECT user_id, event_id, k, s AS kept, true AS fresh FROM ticks WHERE k = 1
  UNION ALL SELECT t.user_id, t.event_id, t.k, CASE WHEN t.s < w.kept + 86400.0 THEN w.kept ELSE t.s END, t.s >= w.kept + 86400.0 FROM walk w JOIN ticks t ON t.user_id = w.user_id AND t.k = w.k + 1) SELECT event_id, fresh FROM walk""",
    "finalize_locks": f"""WITH RECURSIVE {_TICKS}, calls AS MATERIALIZED (SELECT t.*, e.event_type = 'purchase' AND t.event_id % 10 = 0 AS completes FROM ticks t JOIN events e ON t.event_id = e.event_id),
walk AS (SELECT user_id, event_id, k, CASE WHEN completes THEN 'none' ELSE 'finalizing' END AS state, s + 36000.0 AS till, CASE WHEN completes THEN 'no_lock' ELSE 'acquired' END AS outcome FROM calls WHERE k = 1
  UNION ALL SELECT t.user_id, t.event_id, t.k, CASE WHEN w.state = 'completed' OR (t.completes AND w.state <> 'none') THEN 'completed' WHEN t.completes THEN 'none' ELSE 'finalizing' END,
    CASE WHEN w.state <> 'completed' AND NOT t.completes AND NOT (w.state = 'finalizing' AND t.s < w.till) THEN t.s + 36000.0 ELSE w.till END,
    CASE WHEN w.state = 'completed' THEN 'already_terminal' WHEN t.completes THEN CASE WHEN w.state = 'none' THEN 'no_lock' ELSE 'completed' END WHEN w.state = 'none' THEN 'acquired' WHEN t.s < w.till THEN 'refused' ELSE 'taken_over' END
  FROM walk w JOIN calls t ON t.user_id = w.user_id AND t.k = w.k + 1) SELECT event_id, outcome FROM walk""",
    "slots_granted": f"""WITH RECURSIVE {_TICKS}, asks AS MATERIALIZED (SELECT t.*, CASE e.event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END AS d FROM ticks t JOIN events e ON t.event_id = e.event_id),
walk AS (SELECT user_id, event_id, k, greatest(d, 0)::BIGINT AS taken, true AS granted FROM asks WHERE k = 1
  UNION ALL SELECT t.user_id, t.event_id, t.k, greatest(0, least(3, w.taken + t.d))::BIGINT, NOT (t.d = 1 AND w.taken >= 3) FROM walk w JOIN asks t ON t.user_id = w.user_id AND t.k = w.k + 1) SELECT event_id, taken, granted FROM walk""",
}
