"""Queries on public samples: anchors, policy decisions, samples, redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import redaction as R
from ..operators import access as A
from ..operators import publish as P
from .inputs import table

POLICY = P.Policy(blocked_tenants=("t2",), anchors=("INV-002", "INV-006"))
_K = "o_orderkey"
_SOURCE = {
    "resolution_id": "CASE WHEN {k} % 19 <> 0 THEN 'R' || {id} END", "tenant_id": "'t' || {mod4}", "status": "CASE {k} % 5 WHEN 0 THEN 'resolved' WHEN 1 THEN 'routed_to_review' WHEN 2 THEN 'pending' ELSE 'open' END", "document_type": "CASE {k} % 6 WHEN 0 THEN 'regulatory' WHEN 1 THEN 'financial' WHEN 2 THEN 'medical' WHEN 3 THEN 'compliance' END",
    "step": "CASE {k} % 3 WHEN 0 THEN 'l1_rule_match' WHEN 1 THEN 'routing_decision' ELSE 'PII_mask' END", "spec_id": "CASE WHEN {k} % 4 = 1 THEN 'INV-999' END", "route": "{k} % 2 = 0",
}


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = [v.format(k=_K, id=f"string({_K})", mod4=f"string({_K} % 4)") + f" AS {c}" for c, v in _SOURCE.items()]
    rows = table(spark, sf_dir, "orders").selectExpr(f"{_K} AS k", *cols, "0.5D AS confidence", "1 AS layer_used", "'low_confidence' AS review_reason")
    steps = F.array(F.struct("step", "spec_id", F.col("route").alias("route_to_review")), F.struct(F.lit("source").alias("step"), F.lit(None).cast("string").alias("spec_id"), F.lit(None).cast("boolean").alias("route_to_review")))
    return rows.withColumn("anchors", P.anchors_of(steps)).drop("step", "spec_id", "route")


def sample_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.decided(_sources(spark, sf_dir), POLICY)
    return out.select("k", F.array_join("anchors", ",").alias("anchors"), "decision", "reasons", F.array_join("unknown_anchors", ",").alias("unknown"), "integrity_hash")


def public_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.samples(P.decided(_sources(spark, sf_dir), POLICY), POLICY, F.substring("resolution_id", -1, 1) < "5")
    return out.withColumn("anchors", F.array_join("anchors", ","))


def sample_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of published samples, the newest first, without what is internal."""
    rows = P.decided(_sources(spark, sf_dir), P.Policy(manual_approval=False, sanitized_samples=True)).withColumn("emitted_at", F.concat(F.lit("2024-"), F.lpad((F.col("k") % 360).cast("string"), 3, "0"))).withColumn("public_sample_id", F.concat(F.lit("pub_"), F.col("k").cast("string")))
    page = A.page(rows.where("decision = 'allow_with_redaction_profile'"), [F.desc("emitted_at"), F.col("public_sample_id")], 500, A.SAMPLE_PAGE, 20)
    return A.shown(page.select("k", "decision", "public_sample_id", "status", "emitted_at"), A.SAMPLE_FIELDS)


def field_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every field that is known, and of others."""
    names = [*R.ALWAYS_DROPPED, *R.STANDS_FOR, *R.PUBLIC, "Status", "NAME", "n_name", "secret"]
    return table(spark, sf_dir, "region").where("r_regionkey = 0").select(F.explode(F.array(*map(F.lit, names))).alias("field")).select("field", R.field_class(F.col("field")).alias("action"))


def redacted_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("layer_used"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("status"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("tenant_id"))
    return R.redacted(c)


def scrubbed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    more = F.concat("text", F.lit(" John  Smith, 12 Main St, tenants/a-b, "), F.lit("12345678-1234-1234-1234-123456789abc"))
    return d.select("doc_id", F.sha2(R.scrubbed(more), 256).alias("scrubbed_sha256"))


QUERIES = {f.__name__: f for f in (sample_decisions, public_samples, sample_feed, field_classes, redacted_customers, scrubbed_texts)}

_COLS = ", ".join(v.format(k=_K, id=f"{_K}::VARCHAR", mod4=f"({_K} % 4)::VARCHAR") + f" AS {c}" for c, v in _SOURCE.items())
SOURCES = f"""sources AS (SELECT {_K} AS k, {_COLS} FROM orders),
anchored AS (SELECT *, list_sort(list_distinct(list_filter([spec_id, CASE WHEN step = 'l1_rule_match' THEN 'INV-002' END, CASE WHEN step = 'routing_decision' AND route THEN 'INV-005' END, CASE WHEN step = 'PII_mask' THEN 'INV-006' END], lambda x: x IS NOT NULL))) AS anchors FROM sources),
denied AS (SELECT *, list_filter(anchors, lambda x: x NOT IN ('INV-002', 'INV-006')) AS unknown, CASE WHEN tenant_id = 't2' THEN 'blocked_tenant' WHEN resolution_id IS NULL THEN 'missing_source' END AS deny FROM anchored)"""
_DATA = """'{"decision":"requires_manual_approval","dropped_fields":["resolution_id"],"generalized_fields":["document_type","review_reason"],"policy_version":"1","source_resolution_id":"' || resolution_id || '","tenant_id":"' || tenant_id || '"}'"""
_SCRUB = "text || ' John  Smith, 12 Main St, tenants/a-b, 12345678-1234-1234-1234-123456789abc'"
for _pattern, _instead in R.SCRUBS:
    _SCRUB = f"regexp_replace({_SCRUB}, '{_pattern}', '{_instead}', 'g')"
_LIST = lambda xs: ", ".join(f"'{x}'" for x in xs)
_CASE = lambda d: " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in d.items())
ORACLE = {
    "sample_decisions": f"""WITH {SOURCES} SELECT k, array_to_string(anchors, ',') AS anchors, CASE WHEN deny IS NULL THEN 'requires_manual_approval' ELSE 'deny' END AS decision,
  CASE deny WHEN 'blocked_tenant' THEN 'Tenant ''t2'' is blocked by policy' WHEN 'missing_source' THEN 'Missing or empty source resolution data' ELSE CASE WHEN len(unknown) > 0 THEN 'Unknown anchors dropped: [''' || array_to_string(unknown, ''', ''') || ''']; ' ELSE '' END || 'Manual approval required by policy (PMC-INV-007)' END AS reasons,
  array_to_string(unknown, ',') AS unknown, sha256(CASE WHEN deny IS NOT NULL THEN '{{"deny":"' || deny || '"}}' ELSE {_DATA} END) AS integrity_hash FROM denied""",
    "public_samples": f"""WITH {SOURCES}, o AS (SELECT resolution_id, list_filter(anchors, lambda x: x IN ('INV-002', 'INV-006')) AS a, CASE WHEN status = 'resolved' THEN 'resolved' WHEN status IN ('routed_to_review', 'pending') THEN 'human_review_required' WHEN document_type IN ('regulatory', 'compliance') THEN 'compliance_flag' WHEN document_type = 'financial' THEN 'risk_assessment' ELSE 'resolved' END AS outcome_class
  FROM denied WHERE deny IS NULL AND right(resolution_id, 1) < '5'),
s AS (SELECT resolution_id, outcome_class, array_to_string(a, ',') AS anchors, CASE outcome_class {_CASE(P.HEADLINES)} END AS headline, CASE outcome_class {_CASE(P.SUMMARIES)} ELSE '{P.OTHER_SUMMARY}' END AS summary,
  CASE WHEN len(a) = 0 THEN '{P.NO_PROOF}' ELSE 'Resolution verified through: ' || array_to_string(list_transform(a, lambda x: CASE x {_CASE(P.PROOFS)} END), ', ') || '.' END AS proof_summary, CASE WHEN len(a) = 0 THEN '' ELSE '"' || array_to_string(a, '","') || '"' END AS quoted FROM o)
SELECT * EXCLUDE quoted, sha256('{{"anchors":[' || quoted || '],"headline":"' || headline || '","outcome_class":"' || outcome_class || '","proof_summary":"' || proof_summary || '","summary":"' || summary || '"}}') AS integrity_hash FROM s""",
    "sample_feed": f"""WITH {SOURCES} SELECT 'pub_' || k::VARCHAR AS public_sample_id, status, '2024-' || lpad((k % 360)::VARCHAR, 3, '0') AS emitted_at FROM denied WHERE resolution_id IS NOT NULL ORDER BY emitted_at DESC, public_sample_id LIMIT 100 OFFSET 20""",
    "field_classes": f"""SELECT field, CASE WHEN lower(field) IN ({_LIST(R.STANDS_FOR)}) THEN 'generalize' WHEN lower(field) IN ({_LIST(R.PUBLIC)}) THEN 'public' ELSE 'drop' END AS action FROM (SELECT unnest([{_LIST([*R.ALWAYS_DROPPED, *R.STANDS_FOR, *R.PUBLIC, 'Status', 'NAME', 'n_name', 'secret'])}]) AS field)""",
    "redacted_customers": "SELECT c_custkey AS layer_used, 'an individual' AS name, c_mktsegment AS status FROM customer",
    "scrubbed_texts": f"SELECT doc_id, sha256({_SCRUB}) AS scrubbed_sha256 FROM documents",
}
