"""Queries on attestation manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical as J
from ..operators import manifest as M
from ..operators import verification as V
from ..shared import spread
from .inputs import table

NOW = "2024-06-01 00:00:00"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of a manifest for each customer as a batch; a few can't be built."""
    k, s = F.col("c_custkey"), F.col("c_custkey").cast("string")
    h = lambda x: F.sha2(F.concat(F.lit(x), s), 256)
    return spread(table(spark, sf_dir, "customer").select("c_custkey")).select(
        k.alias("k"), F.concat(F.lit("B"), s).alias("batch_id"), F.when(k % 29 != 0, h("root")).alias("root_hash"), F.when(k % 31 == 0, "OTHER").otherwise("PRODUCTION_REAL").alias("artifact_mode"), F.lit("1.0").alias("engine_version"), F.lit("prod").alias("environment"), h("config").alias("config_hash"), h("data").alias("dataset_hash"), h("reg").alias("registry_hash"),
        F.concat(F.lit("keys/prod-"), (k % 3).cast("string")).alias("key_id"), F.substring(h("scope"), 1, 16).alias("tenant_scope"), F.lit(None).cast("string").alias("source_blob_hash"), F.concat(F.lit("r-"), s).alias("receipt_id"), F.when(k % 17 == 3, "2024-06-01T00:02:00Z").otherwise("2024-05-31T00:00:00Z").alias("timestamp"),
    )


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, manifest (null where it can't be built) and problem."""
    k = F.col("k")
    anchor = {"anchor_hash": J.text(F.when(k % 17 == 4, "short").otherwise(F.col("dataset_hash"))), "anchor_timestamp": J.text(F.lit("t")), "bucket": J.text(F.lit("b")), "object_path": J.text(F.lit("p"))}
    metrics = {m: F.lit('"ledger"') if m == "replay_method" else F.lit("3") for m in M.METRICS}
    artifacts = J.items(F.array(J.record({"artifact_type": J.text(F.lit("report")), "hash": J.text(F.col("config_hash")), "size_bytes": F.when(k % 17 == 5, "-1").otherwise("10")})))
    r = rows(spark, sf_dir).withColumn("problem", M.input_problem())
    return r.select("k", "batch_id", "receipt_id", "problem", F.when(F.col("problem").isNull(), M.manifest_json(anchor, metrics, artifacts)).alias("manifest"))


def attestation_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).select("k", "problem", F.sha2("manifest", 256).alias("manifest_hash"))


def public_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).where("problem IS NULL").select("k", F.sha2(M.public_projection(F.col("manifest")), 256).alias("public_hash"))


def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests with signatures (a keyed hash stands for one) and metadata, each seventeenth spoiled in another way."""
    b = built(spark, sf_dir).where("problem IS NULL")
    k, m = F.col("k") % 17, F.col("manifest")
    spoiled = F.when(k == 0, F.concat(m, F.lit("x"))).when(k == 1, F.regexp_replace(m, '"root_hash":"[0-9a-f]+",', "")).when(k == 2, F.regexp_replace(m, '"engine_version":"1.0"', '"engine_version": "1.0"')).when(k == 8, F.regexp_replace(m, M.PROTOCOL, "other/v9")).otherwise(m)
    sign = F.when(k == 6, "").when(k == 7, "forged").otherwise(F.sha2(F.concat(F.lit("pub"), F.regexp_extract(spoiled, '"key_id":"([^"]+)"', 1), spoiled), 256))
    meta = J.record({"receipt_id": J.text(F.when(k == 9, "r-0").otherwise(F.col("receipt_id"))), "batch_id": J.text(F.when(k == 10, "B0").otherwise(F.col("batch_id"))), "protocol_version": J.text(F.lit(M.PROTOCOL)), "manifest_hash": J.text(F.when(k == 11, "0").otherwise(F.sha2(spoiled, 256)))})
    return b.select("k", spoiled.alias("manifest"), sign.alias("signature"), F.when(k == 12, "{").when(k != 13, meta).alias("metadata"))


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "region").where("r_regionkey < 2").select(F.concat(F.lit("keys/prod-"), F.col("r_regionkey").cast("string")).alias("key_id")).withColumn("public_key", F.concat(F.lit("pub"), F.col("key_id")))
    signed = lambda manifest, signature, key: signature == F.sha2(F.concat(key, manifest), 256)
    return M.verified(bundles(spark, sf_dir), F.lit(NOW).cast("timestamp"), keys, signed)


def manifest_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, sf_dir).select("k", "success", "failure_reason", "detail", F.array_join("checks_passed", ",").alias("checks_passed"))


def verification_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.verdicts(checked(spark, sf_dir))


def public_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer as a batch that is asked for, and as many ids again as there are fiftieths that no batch has."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    own = lambda x: F.sha2(F.concat(F.lit(x), k.cast("string")), 256)
    pick = lambda n, values: F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (F.floor(k / n) % len(values) + 1).cast("int"))
    batch, root, mode = F.concat(F.lit("B"), k.cast("string")), F.when(k % 9 != 4, own("root")), F.when(k % 8 != 3, "PRODUCTION_REAL")
    metrics = F.struct(F.round(F.col("c_acctbal"), 2).alias("saved"), (k % 7).alias("replays"))
    digest = F.sha2(F.concat(F.lit('{"replays":'), (k % 7).cast("string"), F.lit(',"saved":'), J.double(F.round("c_acctbal", 2), J.JCS), F.lit("}")), 256)
    payload = F.struct(F.when(k % 23 == 1, "other").otherwise(own("root")).alias("root_hash"), F.when(k % 23 == 2, "SIMULATION").otherwise("PRODUCTION_REAL").alias("artifact_mode"), F.when(k % 23 == 3, None).otherwise(batch).alias("batch_id"), F.when(k % 23 == 4, "0").when(k % 23 != 5, digest).alias("metrics_hash"))
    batches = c.select(
        k.alias("k"), batch.alias("batch_id"), pick(1, ["completed", "completed", "completed", "queued", "completed", "aborted", "completed", "completed", None, "completed", "completed"]).alias("status"), root.alias("root_hash"), mode.alias("artifact_mode"), F.when(k % 6 != 5, metrics).alias("metrics"), payload.alias("payload"),
        F.when(k % 5 != 2, "s").alias("signature"), F.when(k % 4 != 1, "a").otherwise("").alias("attestation"), F.when(k % 5 != 2, F.lit("2024-05-31T10:00:00Z")).alias("signed_at"), pick(1, ["ACTIVE", "RELEASED", None]).alias("hold"),
    )
    asked = batches.select("batch_id").unionByName(c.where(k % 50 == 0).select(F.concat(F.lit("X"), k.cast("string")).alias("batch_id")))
    return V.looked_up(asked, batches, "payload", "metrics", F.col("k") % 13 != 7)


QUERIES = {f.__name__: f for f in (attestation_manifests, public_manifests, manifest_verification, verification_counts, public_verification)}

_H = "sha256('{}' || c_custkey)"
_ANCHOR = f"""'"anchor_hash":"' || CASE WHEN c_custkey % 17 = 4 THEN 'short' ELSE {_H.format("data")} END || '","anchor_timestamp":"t\"'"""
_MIDDLE = f"""',"artifact_hashes":[{{"artifact_type":"report","hash":"' || {_H.format("config")} || '","size_bytes":' || CASE WHEN c_custkey % 17 = 5 THEN '-1' ELSE '10' END || '}}],"artifact_mode":"PRODUCTION_REAL","batch_id":"B' || c_custkey || '","config_hash":"' || {_H.format("config")} || '","dataset_hash":"' || {_H.format("data")} || '","engine_version":"1.0","environment":"prod",'"""
_TAIL = f"""'"metrics":{{"l1_pct":3,"l2_pct":3,"l3_pct":3,"l4_pct":3,"record_count":3,"replay_method":"ledger","replay_runs":3,"replay_variance":3}},"protocol_version":"{M.PROTOCOL}","receipt_id":"r-' || c_custkey || '","registry_hash":"' || {_H.format("reg")} || '","root_hash":"' || {_H.format("root")} || '","signature_algorithm":"{M.ALGORITHM}","source_blob_hash":null,"tenant_scope":"' || substr({_H.format("scope")}, 1, 16) || '","timestamp":"' || CASE WHEN c_custkey % 17 = 3 THEN '2024-06-01T00:02:00Z' ELSE '2024-05-31T00:00:00Z' END || '"}}'"""
BUILT = f"""built AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 29 = 0 THEN 'root_hash must be a 64-char hex string' WHEN c_custkey % 31 = 0 THEN 'artifact_mode must be PRODUCTION_REAL or DEMO_SIMULATED' END AS problem,
  '{{"anchor_ref":{{' || {_ANCHOR} || ',"bucket":"b","object_path":"p"}}' || {_MIDDLE} || '"key_id":"keys/prod-' || c_custkey % 3 || '",' || {_TAIL} AS manifest,
  '{{"anchor_ref":{{' || {_ANCHOR} || '}}' || {_MIDDLE} || {_TAIL} AS public FROM customer)"""
_CHECKS = "schema_jcs,signature,metadata_consistency,anchor_binding,artifact_integrity,timestamp_skew".split(",")
CHECKED = f"""{BUILT}, faults AS (SELECT k, CASE
  WHEN k % 17 = 0 THEN 'MANIFEST_MALFORMED|invalid_json|0' WHEN k % 17 = 1 THEN 'MANIFEST_MALFORMED|missing_fields: root_hash|0' WHEN k % 17 = 8 THEN 'MANIFEST_MALFORMED|wrong_protocol_version|0' WHEN k % 17 = 2 THEN 'MANIFEST_MALFORMED|jcs_round_trip_mismatch|0'
  WHEN k % 17 = 6 THEN 'SIGNATURE_INVALID|empty_signature|1' WHEN k % 3 = 2 THEN 'KEY_VERSION_MISMATCH|key_not_found|1' WHEN k % 17 = 7 THEN 'SIGNATURE_INVALID|verification_failed|1' WHEN k % 17 = 12 THEN 'METADATA_INCONSISTENT|invalid_metadata_json|2' WHEN k % 17 = 9 THEN 'METADATA_INCONSISTENT|receipt_id_mismatch|2'
  WHEN k % 17 = 10 THEN 'METADATA_INCONSISTENT|batch_id_mismatch|2' WHEN k % 17 = 11 THEN 'METADATA_INCONSISTENT|manifest_hash_mismatch|2' WHEN k % 17 = 4 THEN 'ANCHOR_HASH_MISMATCH|anchor_hash_wrong_length|3' WHEN k % 17 = 5 THEN 'ARTIFACT_SIZE_MISMATCH|invalid_size_bytes|4' WHEN k % 17 = 3 THEN 'TIMESTAMP_SKEW_EXCEEDED|timestamp_in_future|5' END AS f FROM built WHERE problem IS NULL),
checked AS (SELECT k, f IS NULL AS success, split_part(f, '|', 1) AS failure_reason, split_part(f, '|', 2) AS detail, array_to_string({_CHECKS}[1 : coalesce(split_part(f, '|', 3)::INT, 6)], ',') AS checks_passed FROM faults)"""
ORACLE = {
    "attestation_manifests": f"WITH {BUILT} SELECT k, problem, CASE WHEN problem IS NULL THEN sha256(manifest) END AS manifest_hash FROM built",
    "public_manifests": f"WITH {BUILT} SELECT k, sha256(public) AS public_hash FROM built WHERE problem IS NULL",
    "manifest_verification": f"WITH {CHECKED} SELECT * FROM checked",
    "verification_counts": f"WITH {CHECKED} SELECT coalesce(failure_reason, 'success') AS reason, count(*)::BIGINT AS n FROM checked GROUP BY 1",
}
_SAVED = "round(c_acctbal, 2)"
ORACLE["public_verification"] = f"""WITH b AS (
  SELECT c_custkey AS k, 'B' || c_custkey AS batch_id, ['completed', 'completed', 'completed', 'queued', 'completed', 'aborted', 'completed', 'completed', NULL, 'completed', 'completed'][c_custkey % 11 + 1] AS status, CASE WHEN c_custkey % 9 <> 4 THEN {_H.format("root")} END AS root,
    c_custkey % 5 <> 2 AS plain, c_custkey % 4 <> 1 AS attested, {_H.format("root")} AS own, sha256('{{"replays":' || c_custkey % 7 || ',"saved":' || CASE WHEN {_SAVED} = 0 THEN '0' ELSE regexp_replace({_SAVED}::VARCHAR, '\\.0$', '') END || '}}') AS digest FROM customer),
f AS (SELECT *, CASE WHEN attested AND k % 13 <> 7 THEN CASE
    WHEN root IS NOT NULL AND k % 23 = 1 THEN 'root_hash mismatch: payload=other, stored=' || root WHEN k % 8 <> 3 AND k % 23 = 2 THEN 'artifact_mode mismatch: payload=SIMULATION, manifest=PRODUCTION_REAL'
    WHEN k % 23 = 3 THEN 'batch_id mismatch: payload=None, stored=' || batch_id WHEN k % 6 <> 5 AND k % 23 = 4 THEN 'metrics_hash mismatch: payload=0, recomputed=' || digest END END AS fault FROM b)
SELECT batch_id, CASE WHEN status = 'queued' THEN 'PENDING' WHEN status = 'aborted' THEN 'ERROR' WHEN (plain OR attested) AND k % 13 <> 7 AND fault IS NULL AND root IS NOT NULL THEN 'VERIFIED' WHEN NOT plain AND NOT attested AND root IS NULL THEN 'UNKNOWN' ELSE 'UNVERIFIED' END AS public_status,
  fault, plain AND root IS NOT NULL AS sealed, CASE WHEN plain THEN '2024-05-31' END AS signed_on, k % 3 = 0 AS held FROM f
UNION ALL SELECT 'X' || k, 'NOT_FOUND', NULL, false, NULL, false FROM b WHERE k % 50 = 0"""
