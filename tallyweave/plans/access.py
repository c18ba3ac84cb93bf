"""Queries on who sees what: batches, results, cases and samples by role, tenant and page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access as A
from .evidence import CASES, cases
from .inputs import RESULTS, results, table

#: A batch for each customer; what evidence it has goes by its number.
_BATCH = {
    "trace_id": "'T' || CAST({k} AS {text})", "tenant_id": "'t' || CAST({k} % 5 AS {text})", "status": "CASE {k} % 4 WHEN 1 THEN 'running' WHEN 2 THEN 'failed' ELSE 'completed' END", "total": "{k} * 3", "cost_usd": "{k} * 0.25", "timestamp": "CASE WHEN {k} % 7 <> 0 THEN '2024-' || lpad(CAST({k} % 12 + 1 AS {text}), 2, '0') || '-' || lpad(CAST({k} % 28 + 1 AS {text}), 2, '0') END",
    "signature": "CASE {k} % 3 WHEN 0 THEN '' WHEN 1 THEN 'sig' END", "signature_b64": "CASE WHEN {k} % 6 = 0 THEN 'c2ln' END", "root_hash": "CASE WHEN {k} % 2 = 0 THEN 'abc' END", "anchored": "CASE WHEN {k} % 5 <> 4 THEN {k} % 5 = 1 END", "hold": "CASE {k} % 8 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'RELEASED' END",
    "is_legacy": "{k} % 11 = 0", "verify_status": "CASE {k} % 9 WHEN 0 THEN 'NOT_AVAILABLE' WHEN 1 THEN 'PASS' WHEN 2 THEN 'FAIL' END", "verified": "{k} % 9 = 1", "loading": "{k} % 13 = 0", "duration_ms": "CASE WHEN {k} % 3 = 0 THEN {k} % 997 * 100 + 7 ELSE 0 END", "duration_seconds": "CASE WHEN {k} % 3 = 1 THEN {k} % 50 + 0.2 END", "minutes": "CASE WHEN {k} % 4 = 2 THEN {k} % 3 END",
    "l1": "{k} % 4", "l1_long": "CASE WHEN {k} % 2 = 1 THEN {k} % 3 END", "exact": "{k} % 10",
}


def _columns(text: str) -> str:
    return ", ".join(f"{v.format(k='c_custkey', text=text)} AS {c}" for c, v in _BATCH.items())


BATCHES = f"batches AS (SELECT c_custkey AS k, c_custkey % 3 AS shard_id, {_columns('VARCHAR')} FROM customer)"


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "c_custkey % 3 AS shard_id", *(v.format(k="c_custkey", text="STRING") + f" AS {c}" for c, v in _BATCH.items()))


def batch_list_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.newest_batches(batches(spark, sf_dir).drop("duration_ms", "duration_seconds"), "t3", "analyst", 500)


def batch_list_admin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.newest_batches(batches(spark, sf_dir).drop("duration_ms", "duration_seconds"), "t3", "platform_admin", 50).withColumn("cost_usd", F.col("cost_usd").cast("double"))


def batch_forensic(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = batches(spark, sf_dir)
    summary = A.forensic_summary(*(F.col(c) for c in ("signature", "signature_b64", "root_hash", "anchored", "hold")))
    return A.shown(b, A.FORENSIC_FIELDS + ["s"], s=summary).select("*", "s.*").drop("s")


def legacy_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    forensic = A.some(F.col("root_hash")) | A.some(F.col("signature")) | A.some(F.col("signature_b64"))
    legacy = A.is_legacy(F.col("is_legacy"), forensic, F.col("verify_status"), F.col("verified"), F.lit(None).cast("boolean"), F.col("loading"))
    return batches(spark, sf_dir).select("trace_id", legacy.alias("legacy"))


def duration_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    begun = F.lit("2024-01-01 00:00:00").cast("timestamp")
    text = A.duration_text(F.col("duration_ms"), F.col("duration_seconds"), begun, F.timestamp_seconds(F.unix_timestamp(begun) + F.col("minutes") * 60), F.col("status"))
    return batches(spark, sf_dir).select("trace_id", text.alias("duration"))


def layer_count_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches(spark, sf_dir).select("trace_id", A.first_nonzero(F.col("l1_long"), F.col("l1"), F.col("exact")).cast("long").alias("l1"))


def shards_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of one status by their number: how many batches each has."""
    shards = A.equal_to(batches(spark, sf_dir), status="completed").groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"))
    return A.page(shards, [F.col("shard_id")], 100, 100)


def wide_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("row_index")
    return results(spark, sf_dir).withColumns({"sanitized_name": F.when(k % 5 == 0, F.concat(F.lit("San "), "original")), "canonical_name": F.when(k % 50 == 7, F.lit("")), "reason": F.when(k % 3 == 0, F.lit("Low score")), "match_reason": F.lit("alias Hit"), "internal_note": F.lit("x"), "company_raw": F.lit("")})


WIDE = f"{RESULTS}, wide AS (SELECT *, CASE WHEN row_index % 5 = 0 THEN 'San ' || original END AS sanitized_name, CASE WHEN row_index % 50 = 7 THEN '' END AS canonical_name, CASE WHEN row_index % 3 = 0 THEN 'Low score' END AS reason, 'alias Hit' AS match_reason FROM results)"


def result_rows_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.shown(wide_results(spark, sf_dir), A.RESULT_FIELDS)


def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.shown(A.page(wide_results(spark, sf_dir).where("trace_id = 'B2'"), [F.col("row_index")], 50_000, A.AUDIT_PAGE), A.AUDIT_FIELDS)


def results_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_results(spark, sf_dir).select("row_index", *(A.anomaly(k).alias(k) for k in ("garbage", "review", "unresolved", "any")))


def results_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wide_results(spark, sf_dir)
    return rows.select("row_index", *(A.found_in(q).alias(n) for n, q in (("low", " low SCORE "), ("hit", "alias hit"), ("layer", "l2_v"), ("seven", "777"), ("all", " "))))


def results_page_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of more rows than are allowed, from within; a page past the end adds none."""
    rows = results(spark, sf_dir).where("trace_id = 'B1'").select("row_index", "original")
    order = [F.col("row_index")]
    return A.page(rows, order, 5000, A.RESULT_PAGE, 10).unionByName(A.page(rows, order, 10, A.RESULT_PAGE, 10_000_000))


def results_page_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page behind a row seen last, the most confident first."""
    rows = results(spark, sf_dir).select("confidence", "row_index", "original")
    return A.page_after(rows, {"confidence": True, "row_index": False}, 5000, A.RESULT_PAGE, {"confidence": 0.5, "row_index": 700})


def review_queue_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.equal_to(cases(spark, sf_dir), status="assigned", priority="high", reviewer="bo")
    return A.page(rows.select("case_id", "status", "priority", "reviewer"), [F.col("case_id")], 50, 100)


def cases_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.equal_to(cases(spark, sf_dir), status="escalated", priority=None).select("case_id", "priority")


def first_order_of_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup by key that takes the first of several rows."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return A.first_by_key(o, "o_custkey", "o_orderkey")


def input_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*map(F.lit, [*A.DOCUMENT_TYPES, "poem"])), (F.col("doc_id") % 5 + 1).cast("int"))
    d = d.select("doc_id", F.when(F.col("doc_id") % 17 != 0, kind).alias("kind"), F.col("text"), F.substring("text", 1, 700).alias("name"))
    return d.select("doc_id", A.input_error(F.col("doc_id").cast("string"), F.col("kind"), F.col("text")).alias("error"), A.name_in_bounds(F.col("name")).alias("name_ok"))


def export_preconditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cases(spark, sf_dir)
    k = F.col("case_id")
    node = lambda kind, decision: F.struct(F.lit(kind).alias("node_type"), decision.alias("decision"))
    nodes = F.array(node("source_artifact", F.lit(None).cast("string")), node("human_decision", F.when(k % 3 == 0, "approve").otherwise("reject")))
    status = F.when(k % 4 != 1, "complete").when(k % 8 == 1, "open")
    return c.select("case_id", A.export_refusal(status, nodes, k % 2 == 0).alias("refusal"))


def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that a row's manifest lacks."""
    have = F.array_compact(F.array(F.lit("batch_id"), F.when(F.col("root_hash").isNotNull(), "root_hash"), F.when(F.col("signature").isNotNull(), "signature")))
    return batches(spark, sf_dir).select("trace_id", F.array_join(A.missing_fields(have, ["root_hash", "batch_id", "signature", "issued_at"]), ",").alias("missing"))


LIST = (
    batch_list_tenant, batch_list_admin, batch_forensic, legacy_batches, duration_display, layer_count_fallback, shards_in_order, result_rows_shown, audit_rows, results_anomalies, results_search, results_page_clamped, results_page_after, review_queue_page, cases_by_status, first_order_of_customer, input_validation, export_preconditions, required_fields,
)
QUERIES = {f.__name__: f for f in LIST}
_SHOWN = "trace_id, status, total, timestamp, tenant_id"
_ORDER = "ORDER BY coalesce(timestamp, '') DESC, trace_id"
_FORENSIC = "(coalesce(signature, '') <> '' OR coalesce(signature_b64, '') <> '')"
_NONE = "coalesce(resolved, '') = '' AND coalesce(sanitized_name, '') = '' AND coalesce(canonical_name, '') = ''"
_BEST = "coalesce(nullif(resolved, ''), nullif(sanitized_name, ''), nullif(canonical_name, ''), '')"


def _holds(q: str) -> str:
    return f"(contains(lower(original), '{q}') OR contains(lower({_BEST}), '{q}') OR contains(lower(layer), '{q}') OR contains(lower(coalesce(reason, match_reason)), '{q}'))"


ORACLE = {
    "batch_list_tenant": f"WITH {BATCHES} SELECT {_SHOWN} FROM batches WHERE tenant_id = 't3' {_ORDER} LIMIT 200",
    "batch_list_admin": f"WITH {BATCHES} SELECT {_SHOWN}, cost_usd::DOUBLE AS cost_usd FROM batches {_ORDER} LIMIT 50",
    "batch_forensic": f"WITH {BATCHES} SELECT trace_id, status, signature, {_FORENSIC} AS signature_present, root_hash IS NOT NULL AS hash_chain_present, coalesce(anchored, false) AS anchor_present, coalesce(hold = 'ACTIVE', false) AS legal_hold_active FROM batches",
    "legacy_batches": f"WITH {BATCHES}, f AS (SELECT *, NOT ({_FORENSIC} OR root_hash IS NOT NULL) AS bare FROM batches) SELECT trace_id, is_legacy OR (bare AND coalesce(verify_status = 'NOT_AVAILABLE', false)) OR (bare AND NOT loading AND verify_status IS NOT NULL AND NOT verified) AS legacy FROM f",
    "duration_display": f"WITH {BATCHES}, d AS (SELECT trace_id, status, CASE WHEN duration_ms > 0 THEN duration_ms / 1000.0 WHEN duration_seconds > 0 THEN duration_seconds WHEN minutes > 0 THEN minutes * 60 END::DOUBLE AS s FROM batches) SELECT trace_id, CASE WHEN s IS NOT NULL THEN printf('%.1fs', s) WHEN status = 'completed' THEN '—' ELSE '0.0s' END AS duration FROM d",
    "layer_count_fallback": f"WITH {BATCHES} SELECT trace_id, coalesce(nullif(l1_long, 0), nullif(l1, 0), nullif(exact, 0), 0)::BIGINT AS l1 FROM batches",
    "shards_in_order": f"WITH {BATCHES} SELECT shard_id, count(*)::BIGINT AS n, row_number() OVER (ORDER BY shard_id) AS place FROM batches WHERE status = 'completed' GROUP BY shard_id",
    "result_rows_shown": f"WITH {WIDE} SELECT original, resolved, canonical_name, sanitized_name, layer, confidence, reason, match_reason, row_index FROM wide",
    "audit_rows": f"WITH {WIDE} SELECT row_index, original, resolved, canonical_name, layer, confidence, reason, match_reason, decision_path FROM wide WHERE trace_id = 'B2' ORDER BY row_index LIMIT 10000",
    "results_anomalies": f"WITH {WIDE} SELECT row_index, starts_with(layer, 'L0') AS garbage, starts_with(layer, 'L4') AS review, {_NONE} AS unresolved, true AS any FROM wide",
    "results_search": f"WITH {WIDE} SELECT row_index, {_holds('low score')} AS low, {_holds('alias hit')} AS hit, {_holds('l2_v')} AS layer, {_holds('777')} AS seven, true AS all FROM wide".replace("AS all", 'AS "all"'),
    "results_page_after": f"WITH {RESULTS} SELECT confidence, row_index, original FROM results WHERE confidence < 0.5 OR confidence = 0.5 AND row_index > 700 ORDER BY confidence DESC, row_index LIMIT 1000",
    "results_page_clamped": f"WITH {RESULTS}, r AS (SELECT row_index, original, row_number() OVER (ORDER BY row_index) AS place FROM results WHERE trace_id = 'B1') SELECT * FROM r WHERE place BETWEEN 11 AND 1010",
    "review_queue_page": f"WITH {CASES} SELECT case_id, status, priority, reviewer, row_number() OVER (ORDER BY case_id) AS place FROM cases WHERE status = 'assigned' AND priority = 'high' AND reviewer = 'bo' ORDER BY case_id LIMIT 50",
    "cases_by_status": f"WITH {CASES} SELECT case_id, priority FROM cases WHERE status = 'escalated'",
    "first_order_of_customer": "SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1",
    "input_validation": """WITH d AS (SELECT *, CASE WHEN doc_id % 17 <> 0 THEN ['regulatory', 'compliance', 'financial', 'medical', 'poem'][(doc_id % 5 + 1)::INT] END AS kind FROM documents)
SELECT doc_id, CASE WHEN kind IS NULL THEN 'Missing required field: document_type' WHEN text IS NULL THEN 'Missing required field: content' WHEN kind = 'poem' THEN 'Invalid document_type: poem' WHEN octet_length(encode(text)) > 51200 THEN 'Document content exceeds 50KB limit' END AS error, coalesce(length(text) BETWEEN 1 AND 500, false) AS name_ok FROM d""",
    "export_preconditions": f"WITH {CASES} SELECT case_id, CASE WHEN case_id % 4 = 1 THEN 'Evidence chain is not complete' WHEN case_id % 2 = 0 AND case_id % 3 <> 0 THEN 'High-impact resolution requires human approval before export (INV-004)' END AS refusal FROM cases",
    "required_fields": f"WITH {BATCHES} SELECT trace_id, 'issued_at' || CASE WHEN root_hash IS NULL THEN ',root_hash' ELSE '' END || CASE WHEN signature IS NULL THEN ',signature' ELSE '' END AS missing FROM batches",
}
