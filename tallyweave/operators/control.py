"""Rules around the engine: commands, traces, replies, events, modes and keys, purges, switches, locks and repeated requests."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import unused
from . import ordered as O
from .review import looked_up

#: Where commands lead, and the forms that they take.
ROUTES = {"dashboard": "/", "home": "/", "resolutions": "/resolutions", "resolution": "/resolutions", "resolve": "/resolutions", "review": "/review", "queue": "/review", "admin": "/admin", "config": "/admin", "settings": "/admin"}
GO_TO, RESOLVE, CONFIG = r"(?i)^(?:go(?:\s+to)?|goto|navigate|open|show)\s+(.+)$", r"(?i)^resolve\s+(?:--file=)?(.+)$", r"(?i)^(?:config|set|toggle)\s+(.+)$"
#: The actions of a command's plan.
PLANS = {"RESOLVE": ["pii_scan", "pii_mask", "llm_resolve", "pii_unmask", "evidence_chain", "persist"], "NAVIGATE": ["navigate"], "CONFIG": ["load_config", "apply_change", "audit_log"]}


def command(raw: Column) -> Column:
    """intent, nav_target, argument and error of a command line."""
    text = F.trim(raw)
    target, file, param = (F.trim(F.regexp_extract(text, p, 1)) for p in (GO_TO, RESOLVE, CONFIG))
    none = F.lit(None).cast("string")
    place = lambda c: looked_up(ROUTES, F.lower(c), none)
    out = lambda intent, nav, arg, error=none: F.struct(F.lit(intent).alias("intent"), nav.alias("nav_target"), arg.alias("argument"), error.alias("error"))
    gone = F.when(place(target).isNotNull(), out("NAVIGATE", place(target), F.lower(target))).otherwise(out("UNKNOWN", none, none, F.concat(F.lit("Unknown destination: "), F.lower(target))))
    unknown = out("UNKNOWN", none, text, F.lit("Try: goto resolutions, resolve --file=report.pdf"))
    return F.when(text.rlike(GO_TO), gone).when(place(text).isNotNull(), out("NAVIGATE", place(text), F.lower(text))).when(text.rlike(RESOLVE), out("RESOLVE", F.lit("/resolutions"), file)).when(text.rlike(CONFIG), out("CONFIG", F.lit("/admin"), param)).otherwise(unknown)


def plan_steps(intent: Column) -> Column:
    """The actions that a command's intent takes, in order; none if it is unknown."""
    return F.coalesce(*(F.when(intent == k, F.array(*map(F.lit, v))) for k, v in PLANS.items()), F.array().cast("array<string>"))


def safe_batch_id(batch: Column) -> Column:
    """The id, or null unless it is letters, digits and hyphens, 128 at most."""
    return F.when((F.length(batch) <= 128) & batch.rlike(r"^[A-Za-z0-9\-]+$"), batch)


def trace_context(header: Column) -> Column:
    """trace_id and parent_span_id of a trace header (00/trace/span/01), null where it is too short."""
    parts = F.split(header, "/")
    return F.when(F.size(parts) >= 3, F.struct(parts[1].alias("trace_id"), parts[2].alias("parent_span_id")))


def trace_header(trace: Column, span: Column) -> Column:
    return F.concat_ws("/", F.lit("00"), trace, span, F.lit("01"))


def model_reply(raw: Column) -> Column:
    """resolution, confidence (clamped), valid and error of a model's reply: the JSON from its first brace to its last, else its text with confidence 0."""
    json = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    parsed = F.from_json(json, "resolution string, confidence double")
    good = F.coalesce(F.is_valid_json(json) if hasattr(F, "is_valid_json") else F.try_parse_json(json).isNotNull(), F.lit(False)) & (json != "")
    text = F.when(good, F.coalesce(parsed["resolution"], F.lit(""))).otherwise(F.coalesce(raw, F.lit("")))
    confidence = F.when(good, F.coalesce(parsed["confidence"], F.lit(0.0))).otherwise(0.0)
    empty, out = F.trim(text) == "", (confidence < 0.0) | (confidence > 1.0)
    error = F.when(empty, "Empty response").when(out, F.concat(F.lit("Confidence "), confidence.cast("string"), F.lit(" out of range [0.0, 1.0]")))
    return F.struct(F.when(out & ~empty, text).otherwise(F.trim(text)).alias("resolution"), F.when(empty, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))).alias("confidence"), error.isNull().alias("valid"), error.alias("error"))


#: The fields of events' data by kind.
EVENT_DATA = {
    "resolution.completed": "resolution_id string, document_id string, status string, layer_used int, confidence double, evidence_chain_id string, review_reason string",
    "review.decision_made": "case_id string, resolution_id string, decision string, decided_by string, evidence_chain_id string",
    "export.requested": "export_id string, resolution_id string, evidence_chain_id string, format string, include_evidence boolean, include_source_document boolean, requested_by string",
}
ENVELOPE = "event_type string, version string, event_id string, timestamp string, tenant_id string, correlation_id string, data string"


def events(raw: DataFrame) -> DataFrame:
    """value (JSON) of events as their envelope, a struct for each kind of data, and problem: why an event can't be used, or null.

    Kinds that are not known are kept with a problem, so that subscribers may pass over them.
    """
    e = raw.select("*", F.from_json("value", ENVELOPE).alias("e"))
    short = lambda kind: kind.split(".")[0]
    data = {short(k): F.when(F.col("e.event_type") == k, F.from_json("e.data", v)) for k, v in EVENT_DATA.items()}
    out = e.withColumns(data)
    need = [c.split()[0] for c in ENVELOPE.split(", ") if not c.startswith(("version", "data"))]
    lacks = [F.when(F.col(f"e.{n}").isNull(), F.lit(f"missing {n}")) for n in need]
    for k, v in EVENT_DATA.items():
        lacks += [F.when((F.col("e.event_type") == k) & F.col(f"{short(k)}.{n}").isNull(), F.lit(f"missing data.{n}")) for n in (c.split()[0] for c in v.split(", ")) if n != "review_reason"]
    r = F.col("resolution")
    bounds = [F.when(~r["layer_used"].between(1, 4), "layer_used out of bounds"), F.when(~r["confidence"].between(0, 1), "confidence out of bounds")]
    unknown = F.when(~F.col("e.event_type").isin(*EVENT_DATA), F.concat(F.lit("unknown event_type: "), F.col("e.event_type")))
    problem = F.coalesce(F.when(F.col("e").isNull(), "not JSON"), *lacks[:1], unknown, *lacks[1:], *bounds)
    return out.select(*raw.columns, "e.event_type", F.coalesce("e.version", F.lit("1.0")).alias("version"), "e.event_id", "e.tenant_id", "e.correlation_id", *(short(k) for k in EVENT_DATA), problem.alias("problem"))


def eastern(value: Column, form: str = "MMM d, yyyy, h:mm a") -> Column:
    """A UTC time's text as it is shown in New York; a time without a zone is UTC, and what is no time is a dash."""
    zoned = F.when(value.rlike(r"(Z|[+-]\d{2}:\d{2})$"), value).otherwise(F.concat(value, F.lit("Z")))
    t = F.from_utc_timestamp(F.try_to_timestamp(zoned), "America/New_York")
    return F.coalesce(F.concat(F.date_format(t, form), F.lit(" ET")), F.lit("—"))


def mode_error(mode: Column, production: Column) -> Column:
    """Why an artifact's mode doesn't fit its environment, or null."""
    want = F.when(production, "PRODUCTION_REAL").otherwise("DEMO_SIMULATED")
    return F.when(~mode.eqNullSafe(want), F.concat(F.when(production, "Production").otherwise("Demo"), F.lit(" environment requires artifact_mode="), want, F.lit(", got: "), F.coalesce(mode, F.lit("None"))))


def key_error(key: Column, fingerprint: Column, production: Column) -> Column:
    """Why a key may not be used in its environment, or null."""
    low = F.lower(key)
    has = lambda w: F.contains(low, F.lit(w))
    live = F.when(has("demo") | has("test"), "demo key in production").when(~has("prod"), "production key without prod").when(fingerprint.startswith("demo-"), "demo fingerprint in production")
    return F.when(production, live).when(has("prod") & ~has("demo"), "production key in demo")


def purge(age_days: Column, held: Column, threshold: int) -> Column:
    """What becomes of a batch that is to be purged: kept, purged, or blocked as it is held."""
    return F.when(F.coalesce(held, F.lit(False)), "blocked").when(age_days.isNull() | (age_days < threshold), "kept").otherwise("purged")


def purged(batches: DataFrame, age_days: str, held: str, threshold: int) -> DataFrame:
    """The batches that stay. A held batch among those to be purged raises."""
    state = purge(F.col(age_days), F.col(held), threshold)
    return batches.where(F.when(state == "blocked", F.raise_error(F.lit("attempted purge of a held batch")).cast("boolean")).otherwise(state == "kept"))


def latest_switches(log: DataFrame) -> DataFrame:
    """switch, tenant (null: platform) and killed by the last entry of a log (switch, tenant, action, at)."""
    last = log.groupBy("switch", "tenant").agg(F.max_by("action", "at").alias("action"))
    return last.select("switch", "tenant", (F.col("action") == "activate").alias("killed"))


def with_switch(rows: DataFrame, switches: DataFrame, switch: str, tenant: str = "tenant_id") -> DataFrame:
    """rows with killed: by the platform's switch, else by that of their tenant."""
    own = switches.where(F.col("switch") == switch)
    platform = own.where("tenant IS NULL").agg(F.coalesce(F.bool_or("killed"), F.lit(False)).alias("off")).scalar()
    whose, off = unused(rows, "whose", "off")
    by_tenant = own.where("tenant IS NOT NULL").select(F.col("tenant").alias(whose), F.col("killed").alias(off))
    out = rows.join(by_tenant, F.col(tenant) == F.col(whose), "left")
    return out.withColumn("killed", platform | F.coalesce(off, F.lit(False))).drop(whose, off)


def combined_hash(hashes: Column) -> Column:
    """SHA-256 over the hashes of files in order, null without any."""
    known = F.array_compact(hashes)
    return F.when(F.size(known) > 0, F.sha2(F.array_join(F.array_sort(known), ":"), 256))


def current_config(changes: DataFrame, key: str, version: str) -> DataFrame:
    """The last version of each key's configuration, with how many came before it."""
    rest = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("last"), (F.count(F.lit(1)) - 1).alias("history")).select(key, "last.*", "history")


def cache_key(tenant: Column, name: Column, list_hash: Column) -> Column:
    """The key of a tenant's cached reply; a tenant that is not known raises."""
    bad = F.coalesce(F.trim(tenant).isin("", "unknown"), F.lit(True))
    return F.when(bad, F.raise_error(F.lit("a cache needs a tenant")).cast("string")).otherwise(F.sha2(F.concat_ws(":", tenant, F.lower(F.trim(F.regexp_replace(name, r"\s+", " "))), list_hash), 256))


def fresh_requests(df: DataFrame, key: str, order: list[str], seconds: str, ttl: float) -> DataFrame:
    """fresh: whether a request is carried out; one of a key that was carried out less than ttl seconds ago is answered from memory."""

    def start() -> O.Step:
        kept: float | None = None

        def step(row: dict[str, Any]) -> tuple[bool]:
            nonlocal kept
            if kept is not None and row[seconds] < kept + ttl:
                return (False,)
            kept = row[seconds]
            return (True,)

        return step

    return O.fold(df, key, order, start, "fresh boolean")


def finalize_lock(df: DataFrame, key: str, order: list[str], seconds: str, completes: str, ttl: float) -> DataFrame:
    """outcome of each call for a batch: acquired, taken_over (the lock had expired), refused, completed, no_lock or already_terminal."""

    def start() -> O.Step:
        state, until = "none", 0.0

        def step(row: dict[str, Any]) -> tuple[str]:
            nonlocal state, until
            if state == "completed":
                return ("already_terminal",)
            if row[completes]:
                if state == "none":
                    return ("no_lock",)
                state = "completed"
                return ("completed",)
            if state == "finalizing" and row[seconds] < until:
                return ("refused",)
            before, state, until = state, "finalizing", row[seconds] + ttl
            return ("acquired" if before == "none" else "taken_over",)

        return step

    return O.fold(df, key, order, start, "outcome string")


def slots(df: DataFrame, key: str, order: list[str], change: str, most: int) -> DataFrame:
    """taken and granted of each request for a slot (change 1) or return of one (-1): at most so many are out at once; returns never go below none."""

    def start() -> O.Step:
        taken = 0

        def step(row: dict[str, Any]) -> tuple[int, bool]:
            nonlocal taken
            if row[change] > 0:
                if taken >= most:
                    return taken, False
                taken += 1
            elif row[change] < 0:
                taken = max(0, taken - 1)
            return taken, True

        return step

    return O.fold(df, key, order, start, "taken long, granted boolean")
