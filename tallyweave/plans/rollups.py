"""Queries on decisions and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import rollups as R
from .inputs import RESULTS, results, table

AS_OF = "2002-01-01 12:00:00"
L1_SQL = "(layer IN ('L1_EXACT', 'L1_NORM', 'L1_KNOWN_PARENT', 'L1_CANONICAL', 'L1_PERSON', 'L1_ORG', 'L1_VESSEL') OR starts_with(layer, 'L1_PERSON_') OR starts_with(layer, 'L1_MIXED_'))"
COUNTS = f"""counts AS (SELECT trace_id, count(*)::BIGINT AS total, count_if(starts_with(layer, 'L0'))::BIGINT AS l0, count_if({L1_SQL})::BIGINT AS l1, count_if(layer = 'L2_VECTOR')::BIGINT AS l2,
  count_if(starts_with(layer, 'L3_'))::BIGINT AS l3, count_if(starts_with(layer, 'L4'))::BIGINT AS l4 FROM results GROUP BY 1)"""


def layer_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.layer_counts(results(spark, sf_dir), "trace_id")


def decision_path_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = R.layer_counts(results(spark, sf_dir))
    return c.select(F.col("l1").alias("deterministic"), F.col("l2").alias("similarity"), F.col("l3").alias("model"), (F.col("l0") + F.col("l4")).alias("other"), "total")


def confidence_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).groupBy("trace_id", R.confidence_bucket(F.col("confidence")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def company_match_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).groupBy("layer", R.match_type(F.col("layer"), F.col("confidence")).alias("match_type")).agg(F.count(F.lit(1)).alias("n"))


def drift_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = R.layer_counts(results(spark, sf_dir), "trace_id").withColumn("valid", F.col("total") - F.col("l0"))
    pct = F.when(F.col("valid") > 0, F.col("l3") / F.col("valid") * 100.0).otherwise(0.0)
    spent = F.col("l3") * 0.005
    return c.select("trace_id", F.round(pct, 3).alias("l3_pct"), R.drift_zone(pct, spent, F.lit(10.0)).alias("zone"))


def margin_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = R.layer_counts(results(spark, sf_dir), "trace_id").withColumn("valid", F.col("total") - F.col("l0"))
    cost = (F.col("l4") * 500 + F.col("l3") * 5) / 1000.0
    l4_pct, each = F.col("l4") / F.col("valid") * 100.0, cost / F.col("valid")
    return c.select("trace_id", F.round(l4_pct, 3).alias("l4_pct"), F.round(each, 5).alias("cost_per_record"), R.margin_zone(l4_pct, each).alias("zone"))


def batch_economics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = R.layer_counts(results(spark, sf_dir), "trace_id")
    cost = F.col("l3") * 5
    pct = {f"{k}_pct": F.round(F.col(k) / F.col("total") * 100.0, 4) for k in ("l0", "l1", "l2", "l3", "l4")}
    return c.select("trace_id", F.round(cost / F.col("total") / 1000.0, 8).alias("cost_per_record"), F.try_divide(cost / 1000.0, F.col("l3").cast("double")).alias("cost_per_call"), *(v.alias(k) for k, v in pct.items()))


def finalize_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per batch: what mixed and company mode count as resolved, and what is flagged."""
    r = results(spark, sf_dir)
    auto = ~F.col("layer").startswith("L0") & (F.col("confidence") >= 0.70)
    c = r.groupBy("trace_id").agg(F.count(F.lit(1)).alias("total"), R.tally(auto).alias("auto_resolved"), R.tally(R.is_l1(F.col("layer")) | (F.col("layer") == "L2_VECTOR") | F.col("layer").startswith("L3_")).alias("company_resolved"))
    return c.withColumn("flagged", F.col("total") - F.col("auto_resolved"))


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels against a prediction by length, as a pivot."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") >= 400, "pred_1").otherwise("pred_0").alias("pred"))
    x = table(spark, sf_dir, "labels").join(d, "doc_id")
    out = x.groupBy("quality").pivot("pred", ["pred_0", "pred_1"]).agg(F.count(F.lit(1)))
    return out.select("quality", F.coalesce("pred_0", F.lit(0)).alias("pred_0"), F.coalesce("pred_1", F.lit(0)).alias("pred_1"))


def p95_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.nearest_rank(table(spark, sf_dir, "events"), ["event_type"], "value", 0.95)


def percentile_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.floor_index(table(spark, sf_dir, "events"), ["event_type"], "value", 90)


def vitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.count_if(kind == "error") / F.count(F.lit(1)) * 100.0, 4).alias("error_pct"), F.round(F.count_if(kind == "view") / F.count(F.lit(1)) * 100.0, 4).alias("view_pct"), F.count_distinct("user_id").alias("users"))


def ring_buffer_last100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest 100 samples of each metric."""
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("k", F.row_number().over(w)).where("k <= 100").select("event_type", "event_id", "value", F.col("k").cast("long").alias("k"))


def labelled_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters, histogram bounds and the latest gauge by label."""
    e = table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return e.groupBy("event_type").agg(F.sum("cents").alias("total_cents"), F.min("cents").alias("low"), F.max("cents").alias("high"), F.max_by("cents", F.struct("ts", "event_id")).alias("gauge"))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trace_id"), F.col("o_orderdate").alias("finished_at"), (F.col("o_orderkey") % 17 == 0).alias("held"))


def retention_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.retention(batches(spark, sf_dir), F.lit(AS_OF).cast("timestamp"))
    return out.select("trace_id", "age_days", "status", "action", "days_until_cold", "days_until_purge")


def retention_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.retention(batches(spark, sf_dir), F.lit(AS_OF).cast("timestamp")).groupBy("status", "action").agg(F.count(F.lit(1)).alias("n"), F.min("age_days").alias("youngest"), F.max("age_days").alias("oldest"))


def upcoming_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.retention(batches(spark, sf_dir), F.lit("2002-01-01 12:00:00").cast("timestamp"))
    return out.where("status <> 'HELD' AND age_days >= 2000").select("trace_id", "age_days", "days_until_purge").orderBy("days_until_purge", "trace_id")


def energy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy by return flag; sums in thousandths of a milliwatt-hour, so that their order doesn't matter."""
    li = table(spark, sf_dir, "lineitem").withColumn("llm", F.col("l_linenumber") % 3 == 0).withColumn("tokens", F.when(F.col("l_linenumber") != 6, F.col("l_quantity")))
    wh, co2 = R.energy(F.col("llm"), F.col("tokens"), 0.5, 0.125, 400.0)
    whole = lambda c: F.sum(F.round(c * 1_000_000).cast("long"))
    return li.withColumn("wh", wh).withColumn("co2", co2).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("records"), F.count("wh").alias("estimated"), whole(F.col("wh")).alias("micro_wh"), whole(F.col("co2")).alias("micro_g"), F.round(F.count("wh") / F.count(F.lit(1)) * 100.0, 2).alias("coverage_pct"))


def energy_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = R.layer_counts(results(spark, sf_dir), "trace_id")
    share = (F.col("total") - F.col("l3")) / F.col("total")
    return c.select("trace_id", F.round(share, 6).alias("share"), R.energy_rating(share).alias("rating"))


def batch_compare_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each month's orders against the month before."""
    m = table(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))
    return R.with_previous(m, "month", ["orders", "finished"])


def batch_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir).withColumn("trace_id", F.concat("trace_id", F.lit("-"), F.date_format("source_timestamp", "yyyy-MM-dd")))
    c = R.layer_counts(r, "trace_id")
    return c.select("trace_id", F.array_join(R.anomalies(F.col("total"), F.col("l1") + F.col("l2") + F.col("l3"), F.col("l0"), F.col("l4"), F.col("total") * 40), ",").alias("anomalies"))


def weighted_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = R.layer_counts(results(spark, sf_dir), "trace_id")
    return c.agg(F.sum("total").alias("records"), F.sum("l4").alias("flagged"), F.round(F.sum(F.col("l1") + F.col("l2") + F.col("l3")) / F.sum("total") * 100.0, 4).alias("resolved_pct"))


def shard_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.shard_ranges(table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("trace_id")).agg(F.count(F.lit(1)).alias("total")))


def shard_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of layers summed first by shard, then by batch."""
    r = results(spark, sf_dir).withColumn("shard_id", F.floor(F.col("row_index") / 1000))
    shards = r.groupBy("trace_id", "shard_id", "layer").agg(F.count(F.lit(1)).alias("n"))
    return shards.groupBy("trace_id", "layer").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("shards"))


def shard_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir).groupBy("trace_id", F.floor(F.col("row_index") / 1000).alias("shard_id")).agg(F.count(F.lit(1)).alias("n"))
    return r.groupBy("trace_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("shard_id", "n"))), lambda s: F.concat_ws(":", s["shard_id"].cast("string"), s["n"].cast("string"))), ",").alias("receipts"))


def batch_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    s = table(spark, sf_dir, "orders").select((k % 400).alias("trace_id"), F.when(k % 391 == 0, "running").when(k % 97 == 0, "failed").otherwise("completed").alias("status"))
    return R.completion(s)


def index_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as rows of a batch: line numbers that repeat or lack show up."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trace_id"), F.col("l_linenumber").cast("long").alias("row_index"))
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trace_id"), F.lit(4).cast("long").alias("expected"))
    return R.index_integrity(li, expected).select("trace_id", "expected", "observed", "lowest", "highest", "reason")


def list_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(200).select("o_orderkey", "o_orderdate", "o_orderstatus")


def results_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir).where("trace_id = 'B2'")
    return r.orderBy("row_index").offset(500).limit(1000).select("row_index", "original", "resolved", "layer", "confidence")


def results_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result browser's filters together: layer prefix, confidence bucket, search text."""
    r = results(spark, sf_dir)
    return r.where(F.upper("layer").startswith("L1") & (R.confidence_bucket(F.col("confidence")) == "high") & F.contains(F.lower(F.coalesce("original", F.lit(""))), F.lit("00012"))).select("trace_id", "row_index", "original", "layer")


def audit_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of several kinds in one list, latest first within a batch."""
    r = results(spark, sf_dir)
    a = r.where("layer LIKE 'L4%'").select("trace_id", "row_index", F.lit("review").alias("kind"), F.col("source_timestamp").alias("at"))
    b = r.where("layer LIKE 'L3%'").select("trace_id", "row_index", F.lit("model_call").alias("kind"), F.col("source_timestamp").alias("at"))
    w = Window.partitionBy("trace_id").orderBy(F.desc("at"), "row_index", "kind")
    return a.unionByName(b).withColumn("k", F.row_number().over(w).cast("long"))


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains without resolution and resolutions without chain, of customers that have one, the other, or both."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    chains, resolutions = c.where("id % 5 <> 0"), c.where("id % 7 <> 0")
    return chains.join(resolutions, "id", "left_anti").select(F.lit("chain").alias("kind"), "id").unionByName(resolutions.join(chains, "id", "left_anti").select(F.lit("resolution").alias("kind"), "id"))


def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key")), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    return o.exceptAll(li.distinct()).select("key", F.lit("without_lines").alias("kind")).unionByName(li.distinct().join(o, "key", "left_anti").select("key", F.lit("without_order").alias("kind")))


def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios of numbers, letters, nulls and different values of each text column, in one pass."""
    s = table(spark, sf_dir, "customer").selectExpr("stack(2, 'c_name', c_name, 'c_mktsegment', c_mktsegment) AS (name, v)")
    n = F.count(F.lit(1))
    ratio = lambda c: F.round(c / n, 6)
    return s.groupBy("name").agg(n.alias("n"), ratio(F.count_if(F.col("v").rlike(r"^-?[0-9.,]+$"))).alias("numeric_ratio"), ratio(F.count_if(F.col("v").rlike("[A-Za-z]"))).alias("alpha_ratio"), ratio(F.count_if(F.col("v").isNull())).alias("null_ratio"), ratio(F.count_distinct("v")).alias("unique_ratio"))


NAMES = (
    layer_rollup, decision_path_summary, confidence_buckets, company_match_types, drift_zone, margin_zone, batch_economics, finalize_summary, confusion_matrix, p95_nearest_rank, percentile_floor, vitals, ring_buffer_last100, labelled_metrics,
    retention_status, retention_summary, upcoming_purge, energy_rollup, energy_rating, batch_compare_prev, batch_anomalies, weighted_overview, shard_ranges, shard_rollup, shard_receipts, batch_completion, index_integrity, list_batches, results_page,
    results_filtered, audit_timeline, orphans, set_difference, column_profile,
)
QUERIES = {f.__name__: f for f in NAMES}

BUCKET_SQL = "CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' WHEN confidence > 0 THEN 'low' ELSE 'none' END"
RETENTION_SQL = f"""aged AS (SELECT o_orderkey AS trace_id, o_orderkey % 17 = 0 AS held, floor((epoch(TIMESTAMP '{AS_OF}') - epoch(o_orderdate)) / 86400)::BIGINT AS age_days FROM orders),
kept AS (SELECT *, CASE WHEN held THEN 'HELD' WHEN age_days >= 2555 THEN 'PURGE_ELIGIBLE' WHEN age_days >= 2190 THEN 'ARCHIVE' WHEN age_days >= 90 THEN 'COLD' ELSE 'HOT' END AS status,
  CASE WHEN NOT held AND age_days <> 0 THEN greatest(0, 90 - age_days) END AS days_until_cold, CASE WHEN NOT held AND age_days <> 0 THEN greatest(0, 2555 - age_days) END AS days_until_purge FROM aged),
acted AS (SELECT *, CASE status WHEN 'HELD' THEN 'BLOCKED_BY_HOLD' WHEN 'PURGE_ELIGIBLE' THEN 'PURGE' WHEN 'ARCHIVE' THEN 'TRANSITION_TO_ARCHIVE' WHEN 'COLD' THEN 'TRANSITION_TO_COLD' ELSE 'NONE' END AS action FROM kept)"""
ORACLE = {
    "layer_rollup": f"WITH {RESULTS}, {COUNTS} SELECT * FROM counts",
    "decision_path_summary": f"WITH {RESULTS}, {COUNTS} SELECT sum(l1)::BIGINT AS deterministic, sum(l2)::BIGINT AS similarity, sum(l3)::BIGINT AS model, sum(l0 + l4)::BIGINT AS other, sum(total)::BIGINT AS total FROM counts",
    "confidence_buckets": f"WITH {RESULTS} SELECT trace_id, {BUCKET_SQL} AS bucket, count(*)::BIGINT AS n FROM results GROUP BY ALL",
    "company_match_types": f"""WITH {RESULTS} SELECT layer, CASE WHEN layer = 'L1_EXACT' THEN 'EXACT_MATCH' WHEN layer = 'L2_VECTOR' AND confidence >= 0.85 THEN 'FUZZY_MATCH' WHEN layer = 'L2_VECTOR' OR starts_with(layer, 'L3_') THEN 'POSSIBLE_MATCH' ELSE 'NO_MATCH' END AS match_type, count(*)::BIGINT AS n FROM results GROUP BY ALL""",
    "drift_zone": f"""WITH {RESULTS}, {COUNTS}, p AS (SELECT trace_id, CASE WHEN total > l0 THEN l3::DOUBLE / (total - l0) * 100.0::DOUBLE ELSE 0.0::DOUBLE END AS pct, l3 * 0.005::DOUBLE AS spent FROM counts)
SELECT trace_id, round(pct, 3) AS l3_pct, CASE WHEN spent >= 10 OR pct >= 4.5 THEN 'RED' WHEN pct >= 3.0 THEN 'WARNING' ELSE 'SAFE' END AS zone FROM p""",
    "margin_zone": f"""WITH {RESULTS}, {COUNTS}, p AS (SELECT trace_id, l4::DOUBLE / (total - l0) * 100.0::DOUBLE AS pct, (l4 * 500 + l3 * 5)::DOUBLE / 1000.0::DOUBLE / (total - l0) AS each FROM counts)
SELECT trace_id, round(pct, 3) AS l4_pct, round(each, 5) AS cost_per_record, CASE WHEN each >= 0.05 OR pct >= 8 THEN 'RED' WHEN pct >= 6 OR each >= 0.05::DOUBLE * 0.8::DOUBLE THEN 'WARNING' ELSE 'SAFE' END AS zone FROM p""",
    "batch_economics": f"""WITH {RESULTS}, {COUNTS} SELECT trace_id, round((l3 * 5)::DOUBLE / total / 1000.0::DOUBLE, 8) AS cost_per_record, CASE WHEN l3 <> 0 THEN (l3 * 5)::DOUBLE / 1000.0::DOUBLE / l3 END AS cost_per_call,
  round(l0::DOUBLE / total * 100.0::DOUBLE, 4) AS l0_pct, round(l1::DOUBLE / total * 100.0::DOUBLE, 4) AS l1_pct, round(l2::DOUBLE / total * 100.0::DOUBLE, 4) AS l2_pct, round(l3::DOUBLE / total * 100.0::DOUBLE, 4) AS l3_pct, round(l4::DOUBLE / total * 100.0::DOUBLE, 4) AS l4_pct FROM counts""",
    "finalize_summary": f"""WITH {RESULTS} SELECT trace_id, count(*)::BIGINT AS total, count_if(NOT starts_with(layer, 'L0') AND confidence >= 0.70)::BIGINT AS auto_resolved,
  count_if({L1_SQL} OR layer = 'L2_VECTOR' OR starts_with(layer, 'L3_'))::BIGINT AS company_resolved, (count(*) - count_if(NOT starts_with(layer, 'L0') AND confidence >= 0.70))::BIGINT AS flagged FROM results GROUP BY 1""",
    "confusion_matrix": "SELECT quality, count_if(n_chars < 400)::BIGINT AS pred_0, count_if(n_chars >= 400)::BIGINT AS pred_1 FROM labels JOIN documents USING (doc_id) GROUP BY 1",
    "p95_nearest_rank": "SELECT event_type, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1",
    "percentile_floor": "SELECT event_type, list_sort(list(value))[least(count(*) * 90 // 100, count(*) - 1) + 1] AS p90 FROM events GROUP BY 1",
    "vitals": "SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*)::BIGINT AS n, round(count_if(event_type = 'error')::DOUBLE / count(*) * 100.0::DOUBLE, 4) AS error_pct, round(count_if(event_type = 'view')::DOUBLE / count(*) * 100.0::DOUBLE, 4) AS view_pct, count(DISTINCT user_id)::BIGINT AS users FROM events GROUP BY 1",
    "ring_buffer_last100": "SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC)::BIGINT AS k FROM events QUALIFY k <= 100",
    "labelled_metrics": "SELECT event_type, sum(c)::BIGINT AS total_cents, min(c) AS low, max(c) AS high, arg_max(c, (ts, event_id)) AS gauge FROM (SELECT *, round(value * 100)::BIGINT AS c FROM events) GROUP BY 1",
    "retention_status": f"WITH {RETENTION_SQL} SELECT trace_id, age_days, status, action, days_until_cold, days_until_purge FROM acted",
    "retention_summary": f"WITH {RETENTION_SQL} SELECT status, action, count(*)::BIGINT AS n, min(age_days) AS youngest, max(age_days) AS oldest FROM acted GROUP BY ALL",
    "upcoming_purge": f"WITH {RETENTION_SQL} SELECT trace_id, age_days, days_until_purge FROM acted WHERE status <> 'HELD' AND age_days >= 2000",
    "energy_rollup": """WITH e AS (SELECT l_returnflag, CASE WHEN l_linenumber % 3 = 0 THEN 0.125::DOUBLE + CASE WHEN l_linenumber <> 6 THEN l_quantity END / 1000.0::DOUBLE * 0.5::DOUBLE ELSE 0.125::DOUBLE END AS wh FROM lineitem)
SELECT l_returnflag, count(*)::BIGINT AS records, count(wh)::BIGINT AS estimated, sum(round(wh * 1000000)::BIGINT)::BIGINT AS micro_wh, sum(round(wh / 1000.0::DOUBLE * 400.0::DOUBLE * 1000000)::BIGINT)::BIGINT AS micro_g, round(count(wh)::DOUBLE / count(*) * 100.0::DOUBLE, 2) AS coverage_pct FROM e GROUP BY 1""",
    "energy_rating": f"WITH {RESULTS}, {COUNTS} SELECT trace_id, round((total - l3)::DOUBLE / total, 6) AS share, CASE WHEN (total - l3)::DOUBLE / total >= 0.95 THEN 'A' WHEN (total - l3)::DOUBLE / total >= 0.8 THEN 'B' ELSE 'C' END AS rating FROM counts",
    "batch_compare_prev": """WITH m AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, count(*)::BIGINT AS orders, count_if(o_orderstatus = 'F')::BIGINT AS finished FROM orders GROUP BY 1),
l AS (SELECT *, lag(orders) OVER (ORDER BY month) AS orders_before, lag(finished) OVER (ORDER BY month) AS finished_before FROM m) SELECT *, orders - orders_before AS orders_delta, finished - finished_before AS finished_delta FROM l""",
    "batch_anomalies": f"""WITH {RESULTS.replace("'B' || substr(o_orderpriority, 1, 1) AS trace_id", "'B' || substr(o_orderpriority, 1, 1) || '-' || strftime(o_orderdate, '%Y-%m-%d') AS trace_id")}, {COUNTS}
SELECT trace_id, concat_ws(',', CASE WHEN l1 + l2 + l3 = 0 THEN 'zero_resolved' WHEN (l1 + l2 + l3)::DOUBLE / total < 0.2 THEN 'low_resolution' END, CASE WHEN l0::DOUBLE / total >= 0.9 THEN 'mostly_garbage' END, CASE WHEN total * 40 > 300 THEN 'slow_batch' END, CASE WHEN l4::DOUBLE / total > 0.3 THEN 'high_review' END) AS anomalies FROM counts""",
    "weighted_overview": f"WITH {RESULTS}, {COUNTS} SELECT sum(total)::BIGINT AS records, sum(l4)::BIGINT AS flagged, round(sum(l1 + l2 + l3)::DOUBLE / sum(total)::DOUBLE * 100.0::DOUBLE, 4) AS resolved_pct FROM counts",
    "shard_ranges": "SELECT trace_id, s // 1000 AS shard_id, s AS start_index, least(s + 1000, total) AS end_index FROM (SELECT l_returnflag AS trace_id, count(*)::BIGINT AS total, unnest(range(0, count(*)::BIGINT, 1000)) AS s FROM lineitem GROUP BY 1)",
    "shard_rollup": f"WITH {RESULTS} SELECT trace_id, layer, count(*)::BIGINT AS n, count(DISTINCT row_index // 1000)::BIGINT AS shards FROM results GROUP BY ALL",
    "shard_receipts": f"WITH {RESULTS}, s AS (SELECT trace_id, row_index // 1000 AS shard_id, count(*) AS n FROM results GROUP BY ALL) SELECT trace_id, string_agg(shard_id || ':' || n, ',' ORDER BY shard_id) AS receipts FROM s GROUP BY 1",
    "batch_completion": """WITH s AS (SELECT o_orderkey % 400 AS trace_id, count(*)::BIGINT AS shards, count_if(o_orderkey % 391 = 0)::BIGINT AS running, count_if(o_orderkey % 391 <> 0 AND o_orderkey % 97 = 0)::BIGINT AS failed FROM orders GROUP BY 1)
SELECT *, CASE WHEN running > 0 THEN 'wait' WHEN failed > 0 THEN 'fail' ELSE 'finalize' END AS gate FROM s""",
    "index_integrity": """WITH s AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS d, min(l_linenumber)::BIGINT AS lowest, max(l_linenumber)::BIGINT AS highest FROM lineitem GROUP BY 1)
SELECT o_orderkey AS trace_id, 4::BIGINT AS expected, coalesce(n, 0)::BIGINT AS observed, lowest, highest, CASE WHEN d < n THEN 'DUPLICATE_INDEX' WHEN coalesce(n, 0) <> 4 THEN 'COUNT_MISMATCH' ELSE 'OK' END AS reason FROM orders LEFT JOIN s ON o_orderkey = l_orderkey""",
    "list_batches": "SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200",
    "results_page": f"WITH {RESULTS} SELECT row_index, original, resolved, layer, confidence FROM results WHERE trace_id = 'B2' ORDER BY row_index LIMIT 1000 OFFSET 500",
    "results_filtered": f"WITH {RESULTS} SELECT trace_id, row_index, original, layer FROM results WHERE starts_with(upper(layer), 'L1') AND confidence >= 0.8 AND contains(lower(original), '00012')",
    "audit_timeline": f"""WITH {RESULTS}, a AS (SELECT trace_id, row_index, CASE WHEN layer LIKE 'L4%' THEN 'review' ELSE 'model_call' END AS kind, source_timestamp AS at_ FROM results WHERE layer LIKE 'L4%' OR layer LIKE 'L3%')
SELECT trace_id, row_index, kind, at_ AS "at", row_number() OVER (PARTITION BY trace_id ORDER BY at_ DESC, row_index, kind)::BIGINT AS k FROM a""",
    "orphans": "SELECT 'chain' AS kind, c_custkey AS id FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 = 0 UNION ALL SELECT 'resolution', c_custkey FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 5 = 0",
    "set_difference": "SELECT o_orderkey AS key, 'without_lines' AS kind FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT l_orderkey, 'without_order' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)",
    "column_profile": """WITH s AS (SELECT 'c_name' AS name, c_name AS v FROM customer UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer)
SELECT name, count(*)::BIGINT AS n, round(count_if(regexp_full_match(v, '-?[0-9.,]+'))::DOUBLE / count(*), 6) AS numeric_ratio, round(count_if(regexp_matches(v, '[A-Za-z]'))::DOUBLE / count(*), 6) AS alpha_ratio, round(count_if(v IS NULL)::DOUBLE / count(*), 6) AS null_ratio, round(count(DISTINCT v)::DOUBLE / count(*), 6) AS unique_ratio FROM s GROUP BY 1""",
}
