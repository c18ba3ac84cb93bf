"""Review cases: priorities, deadlines, breaches, assignment, decisions."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Step, fold, numbered

#: Hours by priority, priority by reason, status by decision, reassignments before a case goes up.
HOURS = {"urgent": 1, "high": 4, "standard": 24}
PRIORITY = {"high_impact": "high", "force_review": "standard", "low_confidence": "standard", "llm_unavailable": "high"}
AFTER = {"approve": "decided", "reject": "decided", "escalate": "escalated", "request_more_evidence": "pending", "reopen": "pending"}
MOST_MOVES = 2


def looked_up(values: dict, key: Column, default: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key], default)


def priority_of(reason: Column) -> Column:
    """A case's priority by the reason of its review."""
    return looked_up(PRIORITY, reason, F.lit("standard"))


def opened(resolved: DataFrame, created: Column) -> DataFrame:
    """A pending case with priority and deadline for each resolution (key, reason, status) that goes to review."""
    rows = resolved.where("status = 'routed_to_review'").select("key", "reason", priority_of(F.col("reason")).alias("priority"), F.lit("pending").alias("status"), created.alias("created_at"))
    return rows.withColumn("due", deadline(F.col("priority"), F.col("created_at")))


def deadline(priority: Column, created: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(created) + looked_up(HOURS, priority, F.lit(HOURS["standard"])) * 3600)


def breached(status: Column, due: Column, as_of: Column) -> Column:
    return status.isin("pending", "assigned") & (due < as_of)


def stale_action(assigned: Column, moves: Column, reviewers: list[str]) -> Column:
    """What happens to a breached case: action and new_reviewer (the first who isn't the present one)."""
    other = F.try_element_at(F.filter(F.array(*map(F.lit, reviewers)), lambda r: ~r.eqNullSafe(assigned)), F.lit(1))
    up = (moves >= MOST_MOVES) | other.isNull()
    return F.struct(F.when(up, "escalate").otherwise("reassign").alias("action"), F.when(~up, other).alias("new_reviewer"))


def round_robin(cases: DataFrame, key: str, reviewers: list[str]) -> DataFrame:
    """cases with the reviewer whose turn it is, in order of a whole-number key."""
    return numbered(cases, key).withColumn("assigned_to", F.element_at(F.array(*map(F.lit, reviewers)), (F.col("n") % len(reviewers) + 1).cast("int"))).drop("n")


def with_capacity(changes: DataFrame, key: str, order: list[str], opens: str, reviewer: str, reviewers: list[str], most: int) -> DataFrame:
    """changes with assigned_to and active (that reviewer's open cases then): a case that opens goes to the next reviewer in turn who has fewer than most.

    changes: by key (a team) and order, cases that open (opens true) or that are closed by a reviewer. Where all reviewers are
    full, a case goes to none and the turn stays. A team's changes depend on each other; teams run side by side.
    """

    def start() -> Step:
        turn, active = 0, dict.fromkeys(reviewers, 0)

        def step(row: dict[str, Any]) -> tuple[str | None, int | None]:
            nonlocal turn
            if not row[opens]:
                who = row[reviewer]
                if who not in active:
                    return None, None
                active[who] = max(0, active[who] - 1)
                return None, active[who]
            who = next((r for r in [*reviewers[turn:], *reviewers[:turn]] if active[r] < most), None)
            if who is None:
                return None, None
            turn, active[who] = (reviewers.index(who) + 1) % len(reviewers), active[who] + 1
            return who, active[who]

        return step

    return fold(changes, key, order, start, "assigned_to string, active long")


def decided(status: Column, decision: Column) -> Column:
    """The status after a decision; null where it is unknown or the case is decided already."""
    return F.when(status != "decided", looked_up(AFTER, decision, F.lit(None).cast("string")))
