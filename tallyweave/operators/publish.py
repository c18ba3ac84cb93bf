"""Public samples of resolutions: what their evidence anchors, whether policy lets them out, and what they say."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canonical as J
from ..functions.redaction import dropped_and_generalized
from .review import looked_up

#: Fields of a resolution that are known, labels, and the texts that samples are put together from.
SOURCE_FIELDS = "resolution_id status confidence layer_used review_reason document_type evidence_chain_id".split()
LAYER_LABELS = {1: "Deterministic rule match", 2: "Precedent-based matching", 3: "LLM-assisted analysis", 4: "LLM with extended context"}
REASON_TEXTS = {"low_confidence": "Confidence below threshold — preserved escalation", "high_impact": "High-impact classification — human review required", "force_review": "Manual review requested by submitter", "llm_unavailable": "LLM provider unavailable — fail-safe escalation"}
HEADLINES = {"resolved": "Automated resolution completed with verified confidence", "human_review_required": "System preserved escalation for expert assessment", "compliance_flag": "Compliance assessment completed per regulatory requirements", "risk_assessment": "Risk evaluation completed through multi-layer analysis"}
SUMMARIES = {"resolved": "The system completed automated resolution with verified confidence.", "human_review_required": "A policy discrepancy was correctly routed for human review."}
OTHER_SUMMARY = "The system completed analysis through its multi-layer resolution pipeline."
PROOFS = {"INV-002": "hash-protected evidence lineage", "INV-005": "tenant-isolated data scope", "INV-006": "PII-masked external processing"}
NO_PROOF = "Resolution verified through deterministic pipeline."


@dataclass(frozen=True)
class Policy:
    version: str = "1"
    deny_all: bool = False
    blocked_tenants: tuple[str, ...] = ()
    anchors: tuple[str, ...] = tuple(PROOFS)
    manual_approval: bool = True
    sanitized_samples: bool = False


def anchors_of(steps: Column) -> Column:
    """The anchors of evidence steps (structs of step, spec_id and route_to_review), each once, in order."""
    named = F.transform(F.filter(steps, lambda s: s["spec_id"].isNotNull()), lambda s: s["spec_id"])
    implied = lambda anchor, test: F.when(F.exists(steps, lambda s: F.coalesce(test(s), F.lit(False))), anchor)
    masks = lambda s: F.contains(F.lower(s["step"]), F.lit("pii")) | F.contains(F.lower(s["step"]), F.lit("mask"))
    more = F.array(implied("INV-002", lambda s: s["step"] == "l1_rule_match"), implied("INV-005", lambda s: (s["step"] == "routing_decision") & s["route_to_review"]), implied("INV-006", masks))
    return F.array_sort(F.array_distinct(F.concat(named, F.array_compact(more))))


def decided(sources: DataFrame, policy: Policy | None) -> DataFrame:
    """sources (resolution_id, tenant_id, anchors) with decision, reasons, unknown anchors and integrity_hash. Whatever is not certain is denied.

    Which fields are dropped or generalized depends on the columns, so it is the same for all rows.
    """
    missing = F.coalesce(F.col("resolution_id") == "", F.lit(True))
    blocked = F.lit(False) if policy is None or not policy.blocked_tenants else F.coalesce(F.col("tenant_id").isin(*policy.blocked_tenants), F.lit(False))
    source = F.coalesce("resolution_id", F.lit("unknown"))
    p = policy or Policy()
    unknown = F.array_except("anchors", F.array(*map(F.lit, p.anchors)).cast("array<string>"))
    after = ("requires_manual_approval", "Manual approval required by policy (PMC-INV-007)") if p.manual_approval else ("allow_with_redaction_profile", "Auto-sanitized sample allowed by policy") if p.sanitized_samples else ("deny", "Policy does not allow real sanitized samples and manual approval not enabled")
    dropped, general = dropped_and_generalized([c for c in sources.columns if c in SOURCE_FIELDS])
    texts = lambda xs: J.items(F.array(*(J.text(F.lit(x)) for x in xs)).cast("array<string>"))
    data = J.record({"decision": J.text(F.lit(after[0])), "source_resolution_id": J.ascii_text(source), "tenant_id": J.ascii_text(F.col("tenant_id")), "policy_version": J.text(F.lit(p.version)), "dropped_fields": texts(dropped), "generalized_fields": texts(general)})
    early = [(F.lit(policy is None), "no_policy", F.lit("No PublicMetadataPolicy provided (PMC-INV-002)")), (F.lit(p.deny_all), "deny_all", F.lit("Policy mode is deny_all")), (blocked, "blocked_tenant", F.concat(F.lit("Tenant '"), F.col("tenant_id"), F.lit("' is blocked by policy"))), (missing, "missing_source", F.lit("Missing or empty source resolution data"))]
    choose = lambda k, last: F.coalesce(*(F.when(e[0], e[k] if isinstance(e[k], Column) else F.lit(e[k])) for e in early), last)
    told = F.when(F.size(unknown) > 0, F.concat(F.lit("Unknown anchors dropped: ['"), F.array_join(unknown, "', '"), F.lit("']; "))).otherwise("")
    deny = choose(1, F.lit(None).cast("string"))
    return sources.withColumns({
        "decision": F.when(deny.isNotNull(), "deny").otherwise(after[0]), "reasons": choose(2, F.concat(told, F.lit(after[1]))), "unknown_anchors": unknown,
        "integrity_hash": F.sha2(F.when(deny.isNotNull(), F.concat(F.lit('{"deny":"'), deny, F.lit('"}'))).otherwise(data), 256),
    })


def outcome_class(status: Column, document_type: Column) -> Column:
    return F.when(status == "resolved", "resolved").when(status.isin("routed_to_review", "pending"), "human_review_required").when(document_type.isin("regulatory", "compliance"), "compliance_flag").when(document_type == "financial", "risk_assessment").otherwise("resolved")


def samples(decisions: DataFrame, policy: Policy, approved: Column) -> DataFrame:
    """resolution_id, outcome_class, headline, summary, anchors, proof_summary and integrity_hash of what may go out: allowed, or approved by hand."""
    out = decisions.where((F.col("decision") == "allow_with_redaction_profile") | ((F.col("decision") == "requires_manual_approval") & approved))
    kind = outcome_class(F.coalesce("status", F.lit("")), F.coalesce("document_type", F.lit("")))
    out = out.select("resolution_id", kind.alias("outcome_class"), F.array_intersect("anchors", F.array(*map(F.lit, policy.anchors)).cast("array<string>")).alias("anchors"))
    proofs = F.array_compact(F.array(*(F.when(F.array_contains("anchors", a), text) for a, text in PROOFS.items())))
    proof = F.when(F.size("anchors") == 0, NO_PROOF).otherwise(F.concat(F.lit("Resolution verified through: "), F.array_join(proofs, ", "), F.lit(".")))
    out = out.withColumns({"headline": looked_up(HEADLINES, F.col("outcome_class"), F.lit(HEADLINES["resolved"])), "summary": looked_up(SUMMARIES, F.col("outcome_class"), F.lit(OTHER_SUMMARY)), "proof_summary": proof})
    data = {k: J.ascii_text(F.col(k)) for k in ("headline", "summary", "outcome_class", "proof_summary")} | {"anchors": J.items(F.transform(F.array_sort("anchors"), J.text))}
    return out.withColumn("integrity_hash", F.sha2(J.record(data), 256))
