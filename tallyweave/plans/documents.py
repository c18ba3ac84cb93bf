"""Queries on documents: rules, precedents, routing, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical as J
from ..operators import documents as D
from ..shared import spread, written
from .inputs import table

RULES = [
    {"id": "R-001", "condition": {"all_of": [{"document_type_equals": "en"}, {"content_contains": "apache license"}]}, "resolution": "open source notice"},
    {"id": "R-002", "condition": {"all_of": [{"document_type_equals": "en"}, {"any_of": [{"content_pattern": r"all\s+rights\s+reserved"}, {"content_contains": "mit license"}]}]}, "resolution": "rights notice"},
    {"id": "R-003", "condition": {"content_pattern": r"\b\d{3}-\d{2}-\d{4}\b"}, "resolution": "identity number present"},
    {"id": "R-004", "condition": {"unknown_test": "x"}, "resolution": "never"},
]
AS_OF = "2024-06-01T00:00:00.000000Z"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text", F.col("lang").alias("document_type")))


def precedents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("precedent"), F.col("item_id").alias("ordinal"), F.col("text").alias("content"))


def doc_rules_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).withColumn("rule", D.first_rule(RULES, F.col("text"), F.col("document_type")))
    return d.select(F.col("key").alias("doc_id"), "rule.rule_id", "rule.resolution")


RULE_SQL = r"""CASE WHEN lang = 'en' AND contains(lower(text), 'apache license') THEN 'R-001'
  WHEN lang = 'en' AND (regexp_matches(text, '(?i)all\s+rights\s+reserved') OR contains(lower(text), 'mit license')) THEN 'R-002'
  WHEN regexp_matches(text, '\b\d{3}-\d{2}-\d{4}\b') THEN 'R-003' END"""
RESOLUTION_SQL = "CASE rule_id WHEN 'R-001' THEN 'open source notice' WHEN 'R-002' THEN 'rights notice' WHEN 'R-003' THEN 'identity number present' END"
NORMAL_SQL = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_\p{{M}}]+', ' ', 'g'))"


def doc_precedent_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items, and documents, against the items as precedents."""
    own = table(spark, sf_dir, "benchmark").select((-F.col("item_id") - 1).alias("key"), F.concat(F.lit("  "), F.col("text"), F.lit(" !")).alias("text"))
    rows = docs(spark, sf_dir).select("key", "text").unionByName(own)
    return D.exact_precedents(rows, precedents(spark, sf_dir)).select("key", "precedent")


def doc_precedent_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.similar_precedents(docs(spark, sf_dir), precedents(spark, sf_dir), 0.6).select(F.col("key").alias("doc_id"), "precedent", F.round("similarity", 6).alias("similarity"))


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.resolve_documents(docs(spark, sf_dir), RULES, precedents(spark, sf_dir))


def doc_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir).select(F.col("key").alias("doc_id"), "rule_id", "precedent", "match_type", "resolution", "confidence", "layer_used", "reason", "status")


def layer_rollup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: documents resolved by rules and precedents, counted by language, layer and status."""
    out = resolved(spark, sf_dir)
    return out.groupBy(F.col("document_type").alias("lang"), F.coalesce(F.concat(F.lit("L"), F.col("layer_used").cast("string")), F.lit("L4")).alias("layer"), "status").agg(F.count(F.lit(1)).alias("n"), F.count("precedent").alias("n_precedent"))


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.evidence_chain(written(resolved(spark, sf_dir), "resolved"), AS_OF)


def doc_evidence_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains(spark, sf_dir).select(F.col("key").alias("doc_id"), F.size("nodes").cast("long").alias("n_nodes"), "chain_hash", "closed")


def planted(own: DataFrame) -> DataFrame:
    """Chains of which some are spoiled: a node's data, a gap in the sequence, or the hash of the chain."""
    changed = F.transform("nodes", lambda n: n.withField("data", F.when((F.col("key") % 7 == 3) & (n["sequence"] == 1), "{}").otherwise(n["data"])))
    spoiled = own.withColumn("nodes", F.when(F.col("key") % 11 == 5, F.filter(changed, lambda n: n["sequence"] != 2)).otherwise(changed))
    return spoiled.withColumn("chain_hash", F.when(F.col("key") % 13 == 1, "0").otherwise(F.col("chain_hash")))


def chain_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.checked_chains(planted(chains(spark, sf_dir)))
    return out.select(F.col("key").alias("doc_id"), F.size("node_errors").cast("long").alias("node_errors"), "gap", "chain_ok", "valid")


def chain_integrity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.integrity_report(D.checked_chains(planted(chains(spark, sf_dir))))


def chains_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open chains get a reviewer's decision, and those approved a record of their export."""
    own = chains(spark, sf_dir).where("NOT closed")
    yes, size, c = F.col("key") % 2 == 0, lambda n: F.size("nodes") + n, J.text
    decision = {"decision": c(F.when(yes, "approve").otherwise("reject")), "reviewer_id": c(F.lit("ana")), "notes": J.ascii_text(F.lit("geprüft ✓")), "evidence_reviewed": J.items(F.transform("nodes", lambda n: c(n["node_type"])))}
    own = D.appended(own, D.node("human_decision", size(1), F.lit(AS_OF), decision))
    export = {"artifact_ref": c(F.concat(F.lit("doc-"), F.col("key").cast("string"))), "format": c(F.lit("json")), "hash": c(F.col("chain_hash"))}
    own = D.appended(own, F.when(yes, D.node("export_artifact", size(1), F.lit(AS_OF), export)))
    return own.select(F.col("key").alias("doc_id"), F.size("nodes").cast("long").alias("n_nodes"), "chain_hash")


DICE_SQL = f"""sa AS (SELECT doc_id, list_distinct(list_transform(range(1, len(c)), lambda i: c[i] || c[i+1])) AS s FROM (SELECT doc_id, string_split({NORMAL_SQL.format("text")}, '') AS c FROM documents)),
sb AS (SELECT item_id, list_distinct(list_transform(range(1, len(c)), lambda i: c[i] || c[i+1])) AS s FROM (SELECT item_id, string_split({NORMAL_SQL.format("text")}, '') AS c FROM benchmark)),
near AS (SELECT doc_id, item_id AS precedent, 2.0::DOUBLE * len(list_intersect(sa.s, sb.s)) / (len(sa.s) + len(sb.s)) AS similarity FROM sa, sb WHERE len(sa.s) > 0 AND similarity >= 0.6 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, item_id) = 1)"""
RESOLVED_SQL = f"""
prec AS (SELECT {NORMAL_SQL.format("text")} AS norm, min(item_id) AS precedent FROM benchmark GROUP BY 1),
{DICE_SQL},
ruled AS (SELECT doc_id, lang, text, {RULE_SQL} AS rule_id FROM documents),
matched AS (
  SELECT r.doc_id, lang, length(text) AS content_length, rule_id, CASE WHEN rule_id IS NULL THEN coalesce(prec.precedent, near.precedent) END AS precedent,
    CASE WHEN rule_id IS NULL THEN CASE WHEN prec.precedent IS NOT NULL THEN 'exact' WHEN near.precedent IS NOT NULL THEN 'fuzzy' END END AS match_type, CASE match_type WHEN 'exact' THEN 1.0::DOUBLE WHEN 'fuzzy' THEN near.similarity END AS similarity
  FROM ruled r LEFT JOIN prec ON {NORMAL_SQL.format("r.text")} = norm LEFT JOIN near ON r.doc_id = near.doc_id),
resolved AS (
  SELECT *, coalesce({RESOLUTION_SQL}, 'precedent ' || precedent::VARCHAR) AS resolution, CASE WHEN rule_id IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(similarity, 0.0::DOUBLE) END AS confidence,
    CASE WHEN rule_id IS NOT NULL THEN 1 WHEN precedent IS NOT NULL THEN 2 END AS layer_used
  FROM matched),
routed AS (SELECT *, CASE WHEN confidence < 0.85 THEN 'low_confidence' END AS reason, CASE WHEN confidence < 0.85 THEN 'routed_to_review' ELSE 'resolved' END AS status FROM resolved)"""


def _node_sql(kind: str, sequence: str, data: str) -> str:
    return f"""sha256('{{"data":' || {data} || ',"node_type":"{kind}","sequence":' || {sequence} || ',"timestamp":"{AS_OF}"}}')"""


_KIND = """coalesce('"' || lang || '"', 'null')"""
_SOURCE = _node_sql("source_artifact", "1", f"""('{{"content_length":' || coalesce(content_length::VARCHAR, 'null') || ',"document_type":' || {_KIND} || ',"has_force_review":false}}')""")
_BY_RULE = _node_sql("transformation", "2", f"""('{{"document_type":' || {_KIND} || ',"matched":true,"rule_id":"' || rule_id || '","rule_set_version":"1","step":"l1_rule_match"}}')""")
_MATCH = _node_sql("retrieval_result", "2", """('{"match_type":"' || match_type || '","precedent_id":"' || precedent || '","similarity":' || similarity || ',"step":"l2_' || match_type || '_match"' || CASE match_type WHEN 'fuzzy' THEN ',"threshold":0.6' ELSE '' END || '}')""")
_ROUTING = _node_sql("transformation", "n_nodes", """('{"confidence":' || confidence || ',"force_review":false,"llm_available":true,"reason":' || coalesce('"' || reason || '"', 'null') || ',"review_threshold":0.85,"route_to_review":' || (reason IS NOT NULL)::VARCHAR || ',"step":"routing_decision"}')""")
CHAIN_SQL = f"""{RESOLVED_SQL}, sized AS (SELECT *, (2 + (layer_used IS NOT NULL)::INT)::BIGINT AS n_nodes FROM routed),
hashes AS (SELECT *, {_SOURCE} AS h1, CASE layer_used WHEN 1 THEN {_BY_RULE} WHEN 2 THEN {_MATCH} END AS h2, {_ROUTING} AS h3 FROM sized),
chained AS (SELECT *, sha256(h1 || coalesce(h2, '') || h3) AS chain_hash, status = 'resolved' AS closed FROM hashes)"""
_PLANTED = f"""{CHAIN_SQL}, planted AS (SELECT doc_id, (doc_id % 7 = 3)::BIGINT AS node_errors, doc_id % 11 = 5 AND n_nodes > 2 AS gap, doc_id % 13 <> 1 AND doc_id % 11 <> 5 AS chain_ok FROM chained)"""
_NODES = """'[' || '"source_artifact"' || CASE layer_used WHEN 1 THEN ',"transformation"' WHEN 2 THEN ',"retrieval_result"' ELSE '' END || ',"transformation"]'"""
_DECISION = _node_sql("human_decision", "(n_nodes + 1)", f"""('{{"decision":"' || CASE WHEN doc_id % 2 = 0 THEN 'approve' ELSE 'reject' END || '","evidence_reviewed":' || {_NODES} || ',"notes":"gepr\\u00fcft \\u2713","reviewer_id":"ana"}}')""")
_EXPORT = _node_sql("export_artifact", "(n_nodes + 2)", """('{"artifact_ref":"doc-' || doc_id || '","format":"json","hash":"' || decided || '"}')""")

QUERIES = {f.__name__: f for f in (doc_rules_l1, doc_precedent_exact, doc_precedent_dice, doc_resolve, layer_rollup_documents, doc_evidence_chain, chain_validation, chain_integrity_report, chains_extended)}
ORACLE = {
    "doc_rules_l1": f"SELECT doc_id, rule_id, {RESOLUTION_SQL} AS resolution FROM (SELECT doc_id, {RULE_SQL} AS rule_id FROM documents)",
    "doc_precedent_exact": f"""WITH prec AS (SELECT {NORMAL_SQL.format("text")} AS norm, min(item_id) AS precedent FROM benchmark GROUP BY 1),
rows AS (SELECT doc_id AS key, text FROM documents UNION ALL SELECT -item_id - 1, '  ' || text || ' !' FROM benchmark)
SELECT key, precedent FROM rows LEFT JOIN prec ON {NORMAL_SQL.format("rows.text")} = norm""",
    "doc_precedent_dice": f"""WITH a AS (SELECT doc_id, {NORMAL_SQL.format("text")} AS t FROM documents), b AS (SELECT item_id, {NORMAL_SQL.format("text")} AS t FROM benchmark),
ca AS (SELECT doc_id, string_split(t, '') AS c FROM a WHERE len(t) > 1), cb AS (SELECT item_id, string_split(t, '') AS c FROM b WHERE len(t) > 1),
sa AS (SELECT doc_id, list_distinct(list_transform(range(1, len(c)), lambda i: c[i] || c[i+1])) AS s FROM ca), sb AS (SELECT item_id, list_distinct(list_transform(range(1, len(c)), lambda i: c[i] || c[i+1])) AS s FROM cb),
scored AS (SELECT doc_id, item_id AS precedent, 2.0::DOUBLE * len(list_intersect(sa.s, sb.s)) / (len(sa.s) + len(sb.s)) AS similarity FROM sa, sb)
SELECT doc_id, precedent, round(similarity, 6) AS similarity FROM scored WHERE similarity >= 0.6 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, precedent) = 1""",
    "doc_resolve": f"WITH {RESOLVED_SQL} SELECT doc_id, rule_id, precedent, match_type, resolution, confidence, layer_used, reason, status FROM routed",
    "layer_rollup_documents": f"WITH {RESOLVED_SQL} SELECT lang, coalesce('L' || layer_used, 'L4') AS layer, status, count(*)::BIGINT AS n, count(precedent)::BIGINT AS n_precedent FROM routed GROUP BY ALL",
    "doc_evidence_chain": f"WITH {CHAIN_SQL} SELECT doc_id, n_nodes, chain_hash, closed FROM chained",
    "chain_validation": f"WITH {_PLANTED} SELECT *, node_errors = 0 AND NOT gap AND chain_ok AS valid FROM planted",
    "chain_integrity_report": f"WITH {_PLANTED} SELECT count(*)::BIGINT AS chains, count_if(node_errors = 0 AND NOT gap AND chain_ok)::BIGINT AS valid, count_if(node_errors > 0)::BIGINT AS node_errors, count_if(gap)::BIGINT AS gaps, count_if(NOT chain_ok)::BIGINT AS chain_errors FROM planted",
    "chains_extended": f"""WITH {CHAIN_SQL}, d AS (SELECT *, h1 || coalesce(h2, '') || h3 || {_DECISION} AS four, sha256(four) AS decided FROM chained WHERE NOT closed)
SELECT doc_id, n_nodes + 1 + (doc_id % 2 = 0)::BIGINT AS n_nodes, CASE WHEN doc_id % 2 = 0 THEN sha256(four || {_EXPORT}) ELSE decided END AS chain_hash FROM d""",
}
