"""Who may see which rows and fields, and pages of them: projections, predicates, lookups and page bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The fields that each kind of row may show.
BATCH_FIELDS = "trace_id status filename total total_records timestamp finished_at duration_seconds duration_ms dataset_type config_version protocol_version auto_resolved_pct sharded shard_count counts stats classification_meta column_selection tenant_id".split()
ADMIN_FIELDS = "llm_budget_summary credits_reserved_usd credits_spent_usd cost_usd".split()
FORENSIC_FIELDS = "trace_id status signature hash_chain anchor attestation legal_hold iavp_manifest receipt".split()
RESULT_FIELDS = "original resolved canonical_name sanitized_name layer confidence sanitization_confidence reason match_reason garbage_reason row_index match_type match_id decision".split()
AUDIT_FIELDS = "row_index original resolved canonical_name layer confidence reason match_reason garbage_reason decision decision_path match_type event_type timestamp".split()
SAMPLE_FIELDS = "public_sample_id sample_type status headline summary outcome_class workflow_stages public_spec_anchors proof_summary redaction_profile_version source_kind integrity_hash emitted_at".split()
ADMIN_ROLES = ("tenant_admin", "platform_admin")
#: Bounds of input and of pages.
DOCUMENT_TYPES, DOCUMENT_BYTES, NAME_LENGTH = ("regulatory", "compliance", "financial", "medical"), 50 * 1024, (1, 500)
BATCH_PAGE, RESULT_PAGE, AUDIT_PAGE, SAMPLE_PAGE = 200, 1000, 10_000, 100


def shown(df: DataFrame, fields: list[str], **more: Column) -> DataFrame:
    """The allowed fields that df has, in the order of the list; more: fields that are worked out from all of df's."""
    df = df.withColumns(more) if more else df
    return df.select(*(c for c in fields if c in df.columns))


def batch_view(batches: DataFrame, role: str) -> DataFrame:
    """The fields of batches that a role may see."""
    return shown(batches, BATCH_FIELDS + ADMIN_FIELDS if role in ADMIN_ROLES else BATCH_FIELDS)


def own_rows(df: DataFrame, tenant: str, role: str) -> DataFrame:
    """Administrators see all rows, others those of their tenant; the filter reaches the scan."""
    return df if role in ADMIN_ROLES else df.where(F.col("tenant_id") == tenant)


def some(c: Column) -> Column:
    """Whether a text is there and not empty."""
    return F.coalesce(c != "", F.lit(False))


def forensic_summary(signature: Column, signature_b64: Column, root_hash: Column, anchored: Column, hold: Column) -> Column:
    """What a batch's evidence holds, as four booleans."""
    return F.struct((some(signature) | some(signature_b64)).alias("signature_present"), some(root_hash).alias("hash_chain_present"), F.coalesce(anchored, F.lit(False)).alias("anchor_present"), F.coalesce(hold == "ACTIVE", F.lit(False)).alias("legal_hold_active"))


def equal_to(df: DataFrame, **values: str | int | None) -> DataFrame:
    """Rows that are equal to every value that is given."""
    for name, value in values.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def first_by_key(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One row for each key: the first by ordinal."""
    return df.groupBy(key).agg(F.min_by(F.struct(*(c for c in df.columns if c != key)), ordinal).alias("first")).select(key, "first.*")


def page(df: DataFrame, order: list[Column], limit: int, most: int, offset: int = 0) -> DataFrame:
    """Rows offset to offset + limit in order, most at a time, with their place; past the end there are none.

    Only the first offset + limit rows of each task travel, so nothing is sorted as a whole.
    """
    limit, offset = max(1, min(limit, most)), max(0, offset)
    top = df.orderBy(*order).limit(offset + limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")).where(F.col("place") > offset)


def page_after(df: DataFrame, order: dict[str, bool], limit: int, most: int, after: dict | None = None) -> DataFrame:
    """The first rows beyond the last one seen, most at a time: however deep a page lies, no more than its own rows are sorted.

    order: columns without nulls that tell rows apart, and whether each goes down; after: that row's values of them.
    """
    beyond, same = F.lit(False), F.lit(True)
    for name, down in order.items() if after else ():
        seen = F.lit(after[name])
        beyond |= same & (F.col(name) < seen if down else F.col(name) > seen)
        same &= F.col(name) == seen
    rows = df.where(beyond) if after else df
    return rows.orderBy(*(F.desc(c) if down else F.asc(c) for c, down in order.items())).limit(max(1, min(limit, most)))


def newest_batches(batches: DataFrame, tenant: str, role: str, limit: int = BATCH_PAGE) -> DataFrame:
    """The newest batches that a caller may see; those without time come last."""
    order = [F.desc(F.coalesce("timestamp", F.lit(""))), F.col("trace_id")]
    return batch_view(page(own_rows(batches, tenant, role), order, limit, BATCH_PAGE), role)


def anomaly(kind: str) -> Column:
    """Whether a result is of a kind: garbage, review or unresolved; any other kind takes all."""
    layer = F.upper(F.coalesce("layer", F.lit("")))
    tests = {"garbage": layer.startswith("L0"), "review": layer.startswith("L4"), "unresolved": ~(some(F.col("resolved")) | some(F.col("sanitized_name")) | some(F.col("canonical_name")))}
    return tests.get(kind, F.lit(True))


def _first_text(*names: str) -> Column:
    return F.lower(F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names), F.lit("")))


def found_in(query: str) -> Column:
    """Whether a result holds the query in its original, its resolution, its layer or its reason."""
    q = F.lit(query.strip().lower())
    fields = [("original", "company_raw"), ("resolved", "sanitized_name", "canonical_name"), ("layer",), ("reason", "match_reason")]
    out = F.lit(not query.strip())
    for names in fields:
        out = out | F.contains(_first_text(*names), q)
    return out


def is_legacy(flag: Column, forensic: Column, verify_status: Column, verified: Column, verify_has_fields: Column, loading: Column) -> Column:
    """Whether a batch is from before evidence was kept. verify_status is null where no verification is known."""
    bare = ~F.coalesce(forensic, F.lit(False))
    nothing = ~loading & verify_status.isNotNull() & bare & ~F.coalesce(verified, F.lit(False)) & ~F.coalesce(verify_has_fields, F.lit(False))
    return F.coalesce(flag, F.lit(False)) | (F.coalesce(verify_status == "NOT_AVAILABLE", F.lit(False)) & bare) | nothing


def input_error(document_id: Column, document_type: Column, content: Column) -> Column:
    """Why a document is refused, or null: a missing field, an unknown type, or too many bytes."""
    missing = [F.when(c.isNull(), F.lit(f"Missing required field: {n}")) for n, c in (("document_id", document_id), ("document_type", document_type), ("content", content))]
    return F.coalesce(*missing, F.when(~document_type.isin(*DOCUMENT_TYPES), F.concat(F.lit("Invalid document_type: "), document_type)), F.when(F.octet_length(content) > DOCUMENT_BYTES, "Document content exceeds 50KB limit"))


def name_in_bounds(name: Column) -> Column:
    return F.coalesce(F.length(name).between(*NAME_LENGTH), F.lit(False))


def export_refusal(status: Column, nodes: Column, high_impact: Column) -> Column:
    """Why an export is refused, or null. nodes: array of structs with node_type and decision."""
    approved = F.coalesce(F.exists(nodes, lambda n: (n["node_type"] == "human_decision") & (n["decision"] == "approve")), F.lit(False))
    open_ = F.coalesce(status != "complete", F.lit(True))
    return F.when(open_, "Evidence chain is not complete").when(high_impact & ~approved, "High-impact resolution requires human approval before export (INV-004)")


def duration_text(ms: Column, seconds: Column, begun: Column, finished: Column, status: Column) -> Column:
    """How long a batch took, from the first of its figures that is above zero."""
    own = F.coalesce(F.nullif(ms.cast("double"), F.lit(0.0)), seconds.cast("double") * 1000, F.lit(0.0)) / 1000
    between = (F.unix_micros(finished) - F.unix_micros(begun)) / 1e6
    known = F.when(own > 0, own).when(between > 0, between)
    return F.when(known.isNotNull(), F.format_string("%.1fs", known)).when(status == "completed", "—").otherwise("0.0s")


def first_nonzero(*counts: Column) -> Column:
    """The first count that is not zero, else 0."""
    return F.coalesce(*(F.nullif(c, F.lit(0)) for c in counts), F.lit(0))


def missing_fields(fields: Column, required: list[str]) -> Column:
    """The required fields that are not among a row's."""
    return F.array_sort(F.array_except(F.array(*map(F.lit, required)), fields))
