"""Queries on review cases, exports, counters, routing figures and trust."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pii
from ..operators import persons as P
from ..operators import review as V
from ..operators import routing
from ..shared import shared_path
from ..sources import sinks
from . import documents as docs_plan
from . import manifests
from .inputs import RESULTS, results, table
from .uploads import _routed

CREATED = "2024-06-01 00:00:00"


def review_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case for each document that goes to review."""
    return V.opened(docs_plan.resolved(spark, sf_dir), F.lit(CREATED).cast("timestamp")).select(F.col("key").alias("doc_id"), "reason", "priority", "status", "due")


def reason_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.element_at(F.array(*map(F.lit, ["high_impact", "force_review", "low_confidence", "llm_unavailable", "other"])), (F.col("c_custkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", V.priority_of(reason).alias("priority"))


def model_call_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred possible matches by row, which may ask the model."""
    kind = F.when(F.col("confidence") > 0.9, "POSSIBLE_MATCH").otherwise("NO_MATCH")
    return P.model_calls(results(spark, sf_dir).select("row_index", kind.alias("match_type")), 100)


def evidence_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of evidence chains as text reports."""
    return sinks.exported(docs_plan.chains(spark, sf_dir), "text").select(F.sha2("value", 256).alias("digest"))


def evidence_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.exported(docs_plan.chains(spark, sf_dir), "csv")


def html_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.sha2(sinks.escape_html(F.col("html")), 256).alias("escaped"), F.sha2(sinks.strip_html(F.col("html")), 256).alias("stripped"))


def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(sinks.csv_cell(F.col("text")), 256).alias("cell"))


def shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shard's rows by their range; the filter reaches the scan."""
    return results(spark, sf_dir).where("row_index >= 1000 AND row_index < 1500").select("row_index", "original")


def audit_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to an audit table, read back."""
    path = shared_path(spark, "audit")
    rows = results(spark, sf_dir).select("trace_id", "row_index", "layer")
    sinks.append_audit(rows.where("trace_id = 'B1'"), path)
    sinks.append_audit(rows.where("trace_id <> 'B1'"), path)
    return spark.read.parquet(path).groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"), F.min("row_index").alias("first"))


def cumulative_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events so far of each kind, by day."""
    days = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.select("event_type", "day", F.sum("n").over(Window.partitionBy("event_type").orderBy("day")).alias("total"))


def routing_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected routes against those taken; a table that is missing is an error."""
    want = [("supplier", "mixed"), ("customer", "company"), ("vendors", "company"), ("people", "mixed"), ("numbers", "reject"), ("nothing", "reject"), ("lost", "company")]
    got = [(n, routing.inspect(df).effective_mode) for n, df in _routed(spark, sf_dir).items()]
    both = spark.createDataFrame(want, "name string, expected string").join(spark.createDataFrame(got, "name string, actual string"), "name", "left")
    both = both.withColumn("actual", F.coalesce("actual", F.lit("error")))
    return both.groupBy("expected", "actual").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))


def routing_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes by decision, with their share of company words."""
    got = [(r.decision, float(r.company_ratio)) for r in (routing.inspect(df) for df in _routed(spark, sf_dir).values())]
    rows = spark.createDataFrame(got, "decision string, ratio double")
    return rows.groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ratio"), 6).alias("mean"), F.count_if(F.col("ratio") < 0.2).alias("low"), F.count_if(F.col("ratio") >= 0.8).alias("high"))


def trust_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts that may be trusted: verified, all checks passed, and not a day old."""
    c = manifests.checked(spark, sf_dir)
    need = F.array(*map(F.lit, ["schema_jcs", "signature", "anchor_binding"]))
    age = (F.col("k") % 40).cast("long") * 3600
    why = F.when(~F.col("success"), "verification_failed").when(F.size(F.array_except(need, "checks_passed")) > 0, "missing_checks").when(age >= 86_400, "receipt_too_old")
    return c.select("k", F.when(why.isNull(), "allow").otherwise("deny").alias("decision"), why.alias("reason"))


def pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds of each category and their length."""
    s = pii.found_spans(table(spark, sf_dir, "documents"), "doc_id")
    return s.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("length"))


def log_fields_scrubbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.create_map(F.lit("note"), F.concat(F.lit("call 555-123-4567 by "), F.col("c_name")), F.lit("Password"), F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", pii.scrub_fields(fields).alias("f")).select("c_custkey", F.col("f")["note"].alias("note"), F.col("f")["Password"].alias("password"))


def log_records_scrubbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested log records: texts in lists, objects and maps."""
    call = F.concat(F.lit("call 555-123-4567 by "), F.col("c_name"))
    people = F.array(F.struct(call.alias("note"), F.col("c_name").alias("Token")), F.struct(F.lit("mail a@b.org").alias("note"), F.lit(None).cast("string").alias("Token")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.struct(people.alias("people"), F.create_map(F.lit("a"), F.array(call), F.lit("API_KEY"), F.array(call)).alias("by_key"), F.struct(F.col("c_acctbal").alias("diagnosis"), F.col("c_nationkey").alias("n")).alias("inner")).alias("r"))
    out = rows.select("c_custkey", pii.scrub_value(F.col("r"), rows.schema["r"].dataType).alias("r"))
    return out.select("c_custkey", F.to_json("r", {"ignoreNullFields": "false"}).alias("record"))


LIST = (review_cases, reason_priorities, model_call_cap, evidence_report, evidence_csv, html_escaped, csv_cells, shard_rows, audit_appended, cumulative_counters, routing_benchmark, routing_metrics, trust_assertions, pii_spans, log_fields_scrubbed, log_records_scrubbed)
QUERIES = {f.__name__: f for f in LIST}

_ESCAPED = "replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;')"
_SPANS = " UNION ALL ".join(f"SELECT '{k}' AS category, unnest(regexp_extract_all(text, '{p}')) AS v FROM documents" for k, p in pii.PATTERNS.items())
ORACLE = {
    "review_cases": f"WITH {docs_plan.RESOLVED_SQL} SELECT doc_id, reason, 'standard' AS priority, 'pending' AS status, TIMESTAMP '2024-06-02 00:00:00' AS due FROM routed WHERE reason IS NOT NULL",
    "reason_priorities": "SELECT c_custkey, CASE WHEN c_custkey % 5 IN (0, 3) THEN 'high' ELSE 'standard' END AS priority FROM customer",
    "model_call_cap": f"WITH {RESULTS} SELECT row_index FROM results WHERE confidence > 0.9 ORDER BY row_index LIMIT 100",
    "evidence_report": f"""WITH {docs_plan.CHAIN_SQL} SELECT sha256('Evidence for ' || doc_id || chr(10) || '  1. source_artifact ' || h1 || CASE WHEN layer_used IS NOT NULL THEN chr(10) || '  2. ' || CASE layer_used WHEN 1 THEN 'transformation' ELSE 'retrieval_result' END || ' ' || h2 ELSE '' END || chr(10) || '  ' || n_nodes || '. transformation ' || h3) AS digest FROM chained""",
    "evidence_csv": f"""WITH {docs_plan.CHAIN_SQL} SELECT doc_id || ',source_artifact,1,' || h1 AS value FROM chained UNION ALL SELECT doc_id || CASE layer_used WHEN 1 THEN ',transformation,2,' ELSE ',retrieval_result,2,' END || h2 FROM chained WHERE layer_used IS NOT NULL UNION ALL SELECT doc_id || ',transformation,' || n_nodes || ',' || h3 FROM chained""",
    "html_escaped": f"SELECT page_id, sha256({_ESCAPED}) AS escaped, sha256(regexp_replace(html, '<[^>]*>', '', 'g')) AS stripped FROM pages",
    "csv_cells": r"""SELECT doc_id, sha256(CASE WHEN regexp_matches(text, '[,"\n\r]') THEN '"' || replace(text, '"', '""') || '"' ELSE coalesce(text, '') END) AS cell FROM documents""",
    "shard_rows": f"WITH {RESULTS} SELECT row_index, original FROM results WHERE row_index >= 1000 AND row_index < 1500",
    "audit_appended": f"WITH {RESULTS} SELECT trace_id, count(*)::BIGINT AS n, min(row_index) AS first FROM results GROUP BY 1",
    "cumulative_counters": "WITH d AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, day, (sum(n) OVER (PARTITION BY event_type ORDER BY day))::BIGINT AS total FROM d",
    "routing_benchmark": "SELECT * FROM (VALUES ('mixed', 'mixed', 2::BIGINT, 'people,supplier'), ('company', 'mixed', 1, 'customer'), ('company', 'company', 1, 'vendors'), ('reject', 'reject', 2, 'nothing,numbers'), ('company', 'error', 1, 'lost')) v(expected, actual, n, names)",
    "routing_metrics": """WITH f AS (SELECT avg((s_suppkey % 2 = 0)::INT) AS r FROM (SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 100))
SELECT 'mixed_dataset' AS decision, 2::BIGINT AS n, 0.0::DOUBLE AS mean, 2::BIGINT AS low, 0::BIGINT AS high UNION ALL SELECT 'person_dataset', 1, 0.0, 1, 0 UNION ALL SELECT 'invalid_dataset', 1, 0.0, 1, 0 UNION ALL SELECT 'empty_dataset', 1, 0.0, 1, 0 UNION ALL SELECT 'company_dataset', 2, round(r / 2, 6), 1, 0 FROM f""",
    "trust_assertions": f"""WITH {manifests.CHECKED} SELECT k, CASE WHEN success AND k % 40 < 24 THEN 'allow' ELSE 'deny' END AS decision, CASE WHEN NOT success THEN 'verification_failed' WHEN k % 40 >= 24 THEN 'receipt_too_old' END AS reason FROM checked""",
    "pii_spans": f"SELECT category, count(*)::BIGINT AS n, sum(length(v))::BIGINT AS length FROM ({_SPANS}) GROUP BY 1",
    "log_records_scrubbed": """WITH c AS (SELECT *, 'call [PHONE_US_REDACTED] by ' || c_name AS call FROM customer)
SELECT c_custkey, '{"people":[{"note":"' || call || '","Token":"[RESTRICTED_REDACTED]"},{"note":"mail [EMAIL_REDACTED]","Token":"[RESTRICTED_REDACTED]"}],"by_key":{"a":["' || call || '"],"API_KEY":null},"inner":{"diagnosis":null,"n":' || c_nationkey || '}}' AS record FROM c""",
    "log_fields_scrubbed": "SELECT c_custkey, 'call [PHONE_US_REDACTED] by ' || c_name AS note, '[RESTRICTED_REDACTED]' AS password FROM customer",
}
