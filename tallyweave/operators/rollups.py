"""Roll-ups of decisions: layers, zones of drift and margin, retention, energy, percentiles, comparison of batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered as O

from ..config import DEFAULT, Thresholds

L1_LAYERS = ["L1_EXACT", "L1_NORM", "L1_KNOWN_PARENT", "L1_CANONICAL", "L1_PERSON", "L1_ORG", "L1_VESSEL"]


def tally(when: Column) -> Column:
    return F.count_if(F.coalesce(when, F.lit(False)))


def is_l1(layer: Column) -> Column:
    return layer.isin(L1_LAYERS) | layer.startswith("L1_PERSON_") | layer.startswith("L1_MIXED_")


def layer_counts(results: DataFrame, *keys: str) -> DataFrame:
    """Decisions by layer: l0 to l4 and all."""
    layer = F.col("layer")
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), tally(layer.startswith("L0")).alias("l0"), tally(is_l1(layer)).alias("l1"), tally(layer == "L2_VECTOR").alias("l2"), tally(layer.startswith("L3_")).alias("l3"), tally(layer.startswith("L4")).alias("l4"),
    )


def confidence_bucket(confidence: Column) -> Column:
    """high from .8, medium from .5, low above 0, else none."""
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").when(confidence > 0, "low").otherwise("none")


def drift_zone(l3_pct: Column, spent: Column, budget: Column, t: Thresholds = DEFAULT) -> Column:
    return F.when((budget > 0) & (spent >= budget), "RED").when(l3_pct >= t.drift_red_pct, "RED").when(l3_pct >= t.drift_warn_pct, "WARNING").otherwise("SAFE")


def margin_zone(l4_pct: Column, cost_per_record: Column, t: Thresholds = DEFAULT) -> Column:
    red = (cost_per_record >= t.cost_red_usd) | (l4_pct >= t.l4_red_pct)
    warn = (l4_pct >= t.l4_warn_pct) | (cost_per_record >= t.cost_red_usd * t.cost_near)
    return F.when(red, "RED").when(warn, "WARNING").otherwise("SAFE")


def match_type(layer: Column, confidence: Column) -> Column:
    """How sure a company match is, by its layer."""
    return (
        F.when(layer.startswith("L0_GARBAGE"), "NO_MATCH").when(layer.isin("L1_KNOWN_PARENT", "L1_EXACT"), "EXACT_MATCH").when((layer == "L2_VECTOR") & (confidence >= DEFAULT.vector_fuzzy), "FUZZY_MATCH")
        .when(layer == "L2_VECTOR", "POSSIBLE_MATCH").when(layer.startswith("L3_"), "POSSIBLE_MATCH").otherwise("NO_MATCH")
    )


def age_days(at: Column, as_of: Column) -> Column:
    return F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(at)) / 86_400)


def retention(batches: DataFrame, as_of: Column, t: Thresholds = DEFAULT) -> DataFrame:
    """batches (finished_at, held) with age_days, status, action, days_until_cold, days_until_purge; a hold overrides age, and the counters are null at age 0."""
    age = F.col("age_days")
    rows = batches.withColumn("age_days", age_days(F.col("finished_at"), as_of))
    status = F.when(F.col("held"), "HELD").when(age >= t.purge_days, "PURGE_ELIGIBLE").when(age >= t.archive_days, "ARCHIVE").when(age >= t.cold_days, "COLD").otherwise("HOT")
    actions = {"HELD": "BLOCKED_BY_HOLD", "PURGE_ELIGIBLE": "PURGE", "ARCHIVE": "TRANSITION_TO_ARCHIVE", "COLD": "TRANSITION_TO_COLD", "HOT": "NONE"}
    left = lambda days: F.when(~F.col("held") & (age != 0), F.greatest(F.lit(0), days - age))
    rows = rows.withColumn("status", status)
    action = F.create_map(*(F.lit(x) for kv in actions.items() for x in kv))[F.col("status")]
    return rows.withColumn("action", action).withColumn("days_until_cold", left(t.cold_days)).withColumn("days_until_purge", left(t.purge_days))


def energy(llm_used: Column, tokens: Column, per_1k: float | None, base: float, co2e_g_per_kwh: float | None) -> tuple[Column, Column]:
    """Watt-hours and grams of CO2e of a record; null wherever an input is missing."""
    llm = F.when(llm_used, F.lit(base) + tokens / 1000.0 * F.lit(per_1k).cast("double"))
    wh = F.coalesce(llm, F.when(~llm_used & F.lit(base > 0), F.lit(base)))
    return wh, wh / 1000.0 * F.lit(co2e_g_per_kwh).cast("double")


def energy_rating(shares: Column) -> Column:
    """A to C by the share of decisions that needed no model."""
    return F.when(shares >= 0.95, "A").when(shares >= 0.80, "B").otherwise("C")


def nearest_rank(df: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    """The value of rank ceil(p*n) for each group."""
    return df.groupBy(*keys).agg(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(100 * p)}"))


def floor_index(df: DataFrame, keys: list[str], value: str, pct: int) -> DataFrame:
    """The value at index int(n*pct/100), the last at most. Ranks come from ranges of equal size, whatever the keys' sizes."""
    rows = df.where(F.col(value).isNotNull()).select(F.struct(*keys, F.lit(0).alias("0")).alias("key"), F.col(value).alias("value"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select(F.col("key").alias("of"), (F.least(F.floor(F.col("n") * pct / 100), F.col("n") - 1) + 1).alias("at"))
    ranked = O.placed(rows, "key", ["value"], "place").join(sizes, F.col("key").eqNullSafe(F.col("of")) & (F.col("place") == F.col("at")))
    return ranked.select(*(F.col("key")[k].alias(k) for k in keys), F.col("value").alias(f"p{pct}"))


def with_previous(batches: DataFrame, order: str, metrics: list[str], *keys: str) -> DataFrame:
    """Each batch's metrics, those of the batch before, and their differences."""
    w = Window.partitionBy(*keys).orderBy(order) if keys else Window.orderBy(order)
    before = {f"{m}_before": F.lag(m).over(w) for m in metrics}
    return batches.withColumns(before).withColumns({f"{m}_delta": F.col(m) - F.col(f"{m}_before") for m in metrics})


def anomalies(total: Column, resolved: Column, garbage: Column, l4: Column, seconds: Column) -> Column:
    """Names of the rules that a batch breaks, in order."""
    share = lambda c: F.coalesce(F.try_divide(c.cast("double"), total.cast("double")), F.lit(0.0))
    return F.array_compact(
        F.array(
            F.when(total.isNull() | (total == 0), "missing_metrics"), F.when((total > 0) & (resolved == 0), "zero_resolved").when((total > 0) & (share(resolved) < 0.2), "low_resolution"),
            F.when(share(garbage) >= 0.9, "mostly_garbage"), F.when(seconds > 300, "slow_batch"), F.when(share(l4) > 0.3, "high_review"),
        )
    )


def shard_ranges(batches: DataFrame, rows: int = DEFAULT.shard_rows) -> DataFrame:
    """trace_id, shard_id, start_index, end_index of the shards of batches (trace_id, total)."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(rows).cast("long")))
    out = batches.where("total > 0").select("trace_id", "total", starts.alias("start_index"))
    return out.select("trace_id", F.floor(F.col("start_index") / rows).alias("shard_id"), "start_index", F.least(F.col("start_index") + rows, F.col("total")).alias("end_index"))


def completion(shards: DataFrame) -> DataFrame:
    """Whether each batch of shards (trace_id, status) waits, fails or is finalized."""
    out = shards.groupBy("trace_id").agg(F.count(F.lit(1)).alias("shards"), F.count_if(F.col("status") == "running").alias("running"), F.count_if(F.col("status") == "failed").alias("failed"))
    return out.withColumn("gate", F.when(F.col("running") > 0, "wait").when(F.col("failed") > 0, "fail").otherwise("finalize"))


def index_integrity(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected against observed rows of each batch, with the first reason that holds."""
    seen = results.groupBy("trace_id").agg(F.count(F.lit(1)).alias("observed"), F.count_distinct("row_index").alias("different"), F.min("row_index").alias("lowest"), F.max("row_index").alias("highest"), F.count_if(F.col("row_index").isNull()).alias("missing"))
    out = expected.join(seen, "trace_id", "left").withColumn("observed", F.coalesce("observed", F.lit(0).cast("long")))
    reason = F.when(F.col("missing") > 0, "MISSING_INDEX").when(F.col("different") < F.col("observed"), "DUPLICATE_INDEX").when(F.col("observed") != F.col("expected"), "COUNT_MISMATCH").otherwise("OK")
    return out.withColumn("reason", reason)
