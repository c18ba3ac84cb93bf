"""Attestation manifests of batches: built as canonical JSON, shown in public, and verified in six ordered checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canonical as J

#: The fields that a manifest must have, its forms, and how far its time may lie ahead.
REQUIRED = "anchor_ref artifact_hashes artifact_mode batch_id config_hash dataset_hash engine_version environment key_id metrics protocol_version receipt_id registry_hash root_hash signature_algorithm tenant_scope timestamp".split()
METRICS = "l1_pct l2_pct l3_pct l4_pct record_count replay_method replay_runs replay_variance".split()
ANCHOR = "anchor_hash anchor_timestamp bucket object_path".split()
MODES, ENVIRONMENTS, AHEAD_SECONDS = ("PRODUCTION_REAL", "DEMO_SIMULATED"), ("prod", "test"), 60
PROTOCOL, ALGORITHM = "attestation/v1", "ECDSA_P256_SHA256"
#: A manifest's parts as text; nested ones as their own JSON.
_FLAT = ", ".join(f"{c} string" for c in [*REQUIRED, "source_blob_hash"])
_ARTIFACTS = "array<struct<artifact_type:string,hash:string,size_bytes:double>>"


def input_problem() -> Column:
    """Why a manifest can't be built from a row's columns, or null: the first thing that is missing or malformed."""
    empty = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    sized = lambda c, n: F.coalesce(F.length(c) != n, F.lit(True))
    tests = [(empty("batch_id"), "batch_id is required"), (sized("root_hash", 64), "root_hash must be a 64-char hex string"), (~F.coalesce(F.col("artifact_mode").isin(*MODES), F.lit(False)), "artifact_mode must be PRODUCTION_REAL or DEMO_SIMULATED"), (~F.coalesce(F.col("environment").isin(*ENVIRONMENTS), F.lit(False)), "environment must be prod or test")]
    tests += [(sized(c, 64), f"{c} must be a 64-char hex string") for c in ("config_hash", "dataset_hash", "registry_hash")]
    tests += [(empty("key_id"), "key_id is required"), (sized("tenant_scope", 16), "tenant_scope must be a 16-char hex string"), (empty("engine_version"), "engine_version is required")]
    return F.coalesce(*(F.when(bad, F.lit(why)) for bad, why in tests))


def manifest_json(anchor: dict[str, Column], metrics: dict[str, Column], artifacts: Column) -> Column:
    """The canonical JSON of a manifest from columns by the names of its fields; artifacts is JSON already. The anchor's and metrics' values are JSON."""
    if sorted(anchor) != ANCHOR or sorted(metrics) != METRICS:
        raise ValueError("an anchor or metrics lack fields")
    nested = {"anchor_ref": J.record(anchor), "metrics": J.record(metrics), "artifact_hashes": artifacts, "protocol_version": J.text(F.lit(PROTOCOL)), "signature_algorithm": J.text(F.lit(ALGORITHM))}
    return J.record({c: J.text(F.col(c)) for c in [*REQUIRED, "source_blob_hash"] if c not in nested} | nested)


def public_projection(manifest: Column) -> Column:
    """A manifest's JSON without its key and where its anchor lies."""
    m = F.from_json(manifest, _FLAT)
    anchor = F.map_filter(F.from_json(m["anchor_ref"], "map<string,string>"), lambda k, _: ~k.isin("bucket", "object_path"))
    kept = [c for c in sorted([*REQUIRED, "source_blob_hash"]) if c != "key_id"]
    nested = ("artifact_hashes", "metrics")
    return J.record({c: F.to_json(anchor) if c == "anchor_ref" else m[c] if c in nested else J.text(m[c]) for c in kept})


def _canonical(manifest: Column, m: Column) -> Column:
    """The manifest's text as it is written when it is canonical: keys in order at both levels, no spaces."""
    nested = lambda c: J.record_of(F.from_json(m[c], "map<string,string>"), F.json_object_keys(m[c]), m[c])
    parts = [F.when(F.array_contains(F.json_object_keys(manifest), c), F.concat(F.lit(f'"{c}":'), nested(c) if c in ("anchor_ref", "metrics") else m[c] if c == "artifact_hashes" else J.text(m[c]))) for c in sorted([*REQUIRED, "source_blob_hash"])]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def verified(bundles: DataFrame, now: Column, keys: DataFrame | None = None, signed: Callable[[Column, Column, Column], Column] | None = None, fail_closed: bool = False) -> DataFrame:
    """bundles (manifest, signature, metadata; text, the last may be null) with success, failure_reason, detail and checks_passed.

    The first check that fails decides: form, signature, metadata, anchor, artifacts, time. keys: key_id and public_key, a
    table that is joined by key; signed(manifest, signature, public_key) is the caller's test of a signature.
    """
    keys = keys if keys is not None else bundles.sparkSession.createDataFrame([], "key_id string, public_key string")
    rows = bundles.withColumn("__m", F.from_json("manifest", _FLAT)).withColumn("__key", F.col("__m.key_id"))
    rows = rows.join(keys.select(F.col("key_id").alias("__key"), F.col("public_key").alias("__public")), "__key", "left")
    m, text = F.col("__m"), F.col("manifest")
    present = F.json_object_keys(text)
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, REQUIRED)), present))
    fail = lambda test, reason, detail: F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(reason).alias("reason"), detail.alias("detail") if isinstance(detail, Column) else F.lit(detail).alias("detail")))
    bad = "MANIFEST_MALFORMED"
    form = F.coalesce(fail(present.isNull() | ~text.rlike(r"(?s)^\s*\{.*\}\s*$"), bad, "invalid_json"), fail(F.size(missing) > 0, bad, F.concat(F.lit("missing_fields: "), F.array_join(missing, ","))), fail(m["protocol_version"] != PROTOCOL, bad, "wrong_protocol_version"), fail(m["signature_algorithm"] != ALGORITHM, bad, "wrong_signature_algorithm"), fail(~_canonical(text, m).eqNullSafe(text), bad, "jcs_round_trip_mismatch"))
    signature = fail(F.coalesce(F.col("signature") == "", F.lit(True)), "SIGNATURE_INVALID", "empty_signature")
    if signed is not None:
        signature = F.coalesce(signature, fail(F.col("__public").isNull(), "KEY_VERSION_MISMATCH", "key_not_found"), fail(~signed(text, F.col("signature"), F.col("__public")), "SIGNATURE_INVALID", "verification_failed"))
    elif fail_closed:
        signature = F.coalesce(signature, fail(F.lit(True), "SIGNATURE_INVALID", "no_public_key_resolver_and_fail_closed"))
    d = F.from_json("metadata", "receipt_id string, batch_id string, protocol_version string, manifest_hash string")
    odd = "METADATA_INCONSISTENT"
    differs = lambda c: ~d[c].eqNullSafe(m[c])
    metadata = F.when(F.col("metadata").isNotNull(), F.coalesce(fail(F.json_object_keys("metadata").isNull(), odd, "invalid_metadata_json"), *(fail(differs(c), odd, f"{c}_mismatch") for c in ("receipt_id", "batch_id", "protocol_version")), fail(F.coalesce(d["manifest_hash"] != "", F.lit(False)) & (d["manifest_hash"] != F.sha2(text, 256)), odd, "manifest_hash_mismatch")))
    a, loose = F.from_json(m["anchor_ref"], "anchor_hash string, anchor_timestamp string"), "ANCHOR_HASH_MISMATCH"
    gone = lambda c: F.coalesce(c == "", F.lit(True))
    anchor = F.coalesce(fail(F.json_object_keys(m["anchor_ref"]).isNull(), loose, "anchor_ref_not_a_dict"), fail(gone(a["anchor_hash"]), loose, "anchor_hash_missing"), fail(F.length(a["anchor_hash"]) != 64, loose, "anchor_hash_wrong_length"), fail(~a["anchor_hash"].rlike("^[0-9a-fA-F]+$"), loose, "anchor_hash_not_hex"), fail(gone(a["anchor_timestamp"]), loose, "anchor_timestamp_missing"))
    files = F.from_json(m["artifact_hashes"], _ARTIFACTS)
    entry = lambda e: F.when(gone(e["artifact_type"]), "ARTIFACT_HASH_MISMATCH: missing_artifact_type").when(gone(e["hash"]) | (F.length(e["hash"]) != 64), "ARTIFACT_HASH_MISMATCH: invalid_hash").when(F.coalesce(e["size_bytes"] < 0, F.lit(True)), "ARTIFACT_SIZE_MISMATCH: invalid_size_bytes")
    first = F.get(F.array_compact(F.transform(files, entry)), 0)
    artifacts = F.coalesce(fail(~m["artifact_hashes"].startswith("["), "ARTIFACT_HASH_MISMATCH", "artifact_hashes_not_a_list"), fail(F.size(files) == 0, "ARTIFACT_HASH_MISMATCH", "artifact_hashes_empty"), F.when(first.isNotNull(), F.struct(F.split(first, ": ")[0].alias("reason"), F.split(first, ": ")[1].alias("detail"))))
    t, late = F.try_to_timestamp(m["timestamp"]), "TIMESTAMP_SKEW_EXCEEDED"
    time = F.coalesce(fail(gone(m["timestamp"]), late, "timestamp_missing"), fail(t.isNull(), late, "timestamp_parse_error"), fail(F.unix_micros(t) - F.unix_micros(now) > AHEAD_SECONDS * 1_000_000, late, "timestamp_in_future"))
    checks = {"schema_jcs": form, "signature": signature, "metadata_consistency": metadata, "anchor_binding": anchor, "artifact_integrity": artifacts, "timestamp_skew": time}
    rows = rows.withColumns({f"__{k}": v for k, v in checks.items()})
    failed = F.coalesce(*(F.col(f"__{k}") for k in checks))
    passed = F.array(*map(F.lit, checks))
    upto = F.coalesce(*(F.when(F.col(f"__{k}").isNotNull(), F.lit(i)) for i, k in enumerate(checks)), F.lit(len(checks)))
    return rows.select(*bundles.columns, failed.isNull().alias("success"), failed["reason"].alias("failure_reason"), failed["detail"].alias("detail"), F.slice(passed, F.lit(1), upto).alias("checks_passed"))


def verdicts(checked: DataFrame) -> DataFrame:
    """How many manifests passed, and how many failed by reason."""
    return checked.groupBy(F.coalesce("failure_reason", F.lit("success")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
