"""What may be published of a resolution: fields by their class, and free text without what names someone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields by what happens to them, and what stands for those that are generalized.
ALWAYS_DROPPED = (
    "tenant_id user_id reviewer_id analyst_id assigned_to decided_by requested_by email phone address ssn credit_card mrn drivers_license document_content content raw_content masked_content raw_response raw_prompt prompt_text trace_id correlation_id evidence_chain_id resolution_id "
    "document_id case_id export_id batch_id chain_hash node_hash artifact_ref bucket_path gcs_path storage_path db_path created_at updated_at decided_at emitted_at_source filename uploaded_filename"
).split()
STANDS_FOR = {
    "name": "an individual", "applicant_name": "the applicant", "reviewer_name": "a reviewer", "analyst_name": "an analyst", "tenant_name": "the organization", "organization": "the organization", "review_reason": "policy-driven review criteria", "notes": "review commentary (redacted)",
    "decision_notes": "decision rationale (redacted)", "source": "submitted documentation", "document_type": "compliance document",
}
PUBLIC = "status confidence layer_used outcome_class workflow_stage spec_id".split()
#: Patterns of free text and what stands for their finds, in this order.
SCRUBS = [
    (r"(?i)\b(?:James\s+Benson|Maria\s+Garcia|John\s+Smith|Jane\s+Doe)\b", "the individual"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED]"),
    (r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "[REDACTED]"),
    (r"(?:\(\d{3}\)\s?|\b\d{3}[-.])\d{3}[-.]?\d{4}\b", "[REDACTED]"),
    (r"\b\d+\s+[A-Z][a-zA-Z]+\s+(?:St|Ave|Blvd|Rd|Dr|Ln|Ct|Way)\b", "[a property address]"),
    (r"\btenant[s]?/[a-zA-Z0-9_-]+\b", "[REDACTED]"),
    (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "[REDACTED]"),
]


def field_class(name: Column) -> Column:
    """drop, generalize or public; fields that are not known are dropped."""
    low = F.lower(name)
    return F.when(low.isin(*ALWAYS_DROPPED), "drop").when(low.isin(*STANDS_FOR), "generalize").when(low.isin(*PUBLIC), "public").otherwise("drop")


def redacted(df: DataFrame) -> DataFrame:
    """df with its public columns as they are, the generalized ones replaced, and no others."""
    keep = [F.lit(STANDS_FOR[c.lower()]).alias(c) if c.lower() in STANDS_FOR and c.lower() not in ALWAYS_DROPPED else F.col(c) for c in df.columns if c.lower() not in ALWAYS_DROPPED and (c.lower() in STANDS_FOR or c.lower() in PUBLIC)]
    return df.select(*keep)


def dropped_and_generalized(columns: list[str]) -> tuple[list[str], list[str]]:
    """The columns that redacted() drops and those that it replaces, in order of name."""
    general = sorted(c for c in columns if c.lower() in STANDS_FOR and c.lower() not in ALWAYS_DROPPED)
    return sorted(c for c in columns if c not in general and (c.lower() in ALWAYS_DROPPED or c.lower() not in PUBLIC)), general


def scrubbed(text: Column) -> Column:
    """Text without names, numbers and addresses that identify someone."""
    for pattern, instead in SCRUBS:
        text = F.regexp_replace(text, pattern, instead)
    return text
