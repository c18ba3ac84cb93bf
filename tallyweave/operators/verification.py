"""What the public may learn of a batch: whether its signed payload is that of the batch, its status and its seal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canonical as J

#: A batch's states before its end and after a failure.
RUNNING, FAILED = ("queued", "processing"), ("failed", "failed_integrity", "aborted")


def _filled(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def payload_fault(batches: DataFrame, payload: str, metrics: str) -> Column:
    """The first field in which a signed payload (a column of structs) is not its batch's, or null.

    batches: batch_id, root_hash, artifact_mode and metrics (a struct). What a batch doesn't have is not compared, but
    its root, mode and id must be signed where it has them; a metrics hash that was not signed is not asked for.
    """
    p = F.col(payload)
    own = F.when(F.col(metrics).isNotNull(), F.sha2(J.value(F.col(metrics), batches.schema[metrics].dataType, J.JCS), 256))
    told = lambda name, signed, kept, word: F.concat(F.lit(f"{name} mismatch: payload="), F.coalesce(signed, F.lit("None")), F.lit(f", {word}="), kept)

    def other(name: str, signed: Column, kept: Column, word: str) -> Column:
        return F.when(_filled(kept) & ~signed.eqNullSafe(kept), told(name, signed, kept, word))

    digest = F.when(_filled(p["metrics_hash"]) & (p["metrics_hash"] != own), told("metrics_hash", p["metrics_hash"], own, "recomputed"))
    return F.coalesce(other("root_hash", p["root_hash"], F.col("root_hash"), "stored"), other("artifact_mode", p["artifact_mode"], F.col("artifact_mode"), "manifest"), other("batch_id", p["batch_id"], F.col("batch_id"), "stored"), digest)


def public_status(found: Column, status: Column, signed: Column, valid: Column, root_hash: Column) -> Column:
    """NOT_FOUND, PENDING, ERROR, VERIFIED (a valid signature and a chain), UNKNOWN (neither of them) or UNVERIFIED."""
    chained, none = _filled(root_hash), F.lit(False)
    state = F.when(F.coalesce(valid, none) & chained, "VERIFIED").when(~F.coalesce(signed, none) & ~chained, "UNKNOWN").otherwise("UNVERIFIED")
    return F.when(~F.coalesce(found, none), "NOT_FOUND").when(status.isin(*RUNNING), "PENDING").when(status.isin(*FAILED), "ERROR").otherwise(state)


def looked_up(asked: DataFrame, batches: DataFrame, payload: str, metrics: str, good: Column) -> DataFrame:
    """asked (batch_id) with public_status, fault, sealed, signed_on and held of each batch; one that isn't there is NOT_FOUND.

    batches: what payload_fault needs, and status, signature, attestation, signed_at, hold. good: whether a signature is
    valid, by the caller's keys. An attested batch is valid if its payload is its own, too.
    """
    attested = _filled(F.col("attestation"))
    fault = F.when(attested & good, payload_fault(batches, payload, metrics))
    signed = attested | _filled(F.col("signature"))
    rows = batches.select(
        "batch_id", F.lit(True).alias("found"), "status", signed.alias("signed"), (signed & good & fault.isNull()).alias("valid"), fault.alias("fault"), "root_hash", (_filled(F.col("signature")) & _filled(F.col("root_hash"))).alias("sealed"),
        F.when(_filled(F.col("signed_at")), F.substring_index("signed_at", "T", 1)).alias("signed_on"), F.coalesce(F.col("hold") == "ACTIVE", F.lit(False)).alias("held"),
    )
    out = asked.select("batch_id").join(rows, "batch_id", "left")
    state = public_status(F.col("found"), F.coalesce("status", F.lit("unknown")), F.col("signed"), F.col("valid"), F.col("root_hash"))
    return out.select("batch_id", state.alias("public_status"), "fault", F.coalesce("sealed", F.lit(False)).alias("sealed"), "signed_on", F.coalesce("held", F.lit(False)).alias("held"))
