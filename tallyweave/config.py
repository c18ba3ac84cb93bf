"""Thresholds of the operators, handed to them as one frozen value."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    """Fixed values by which results are compared."""

    review: float = 0.85
    precedent_match: float = 0.6
    max_layer: int = 4
    person_accept: float = 0.92
    person_possible: float = 0.90
    person_least: float = 0.70
    weight_full: float = 0.50
    weight_last: float = 0.40
    weight_phonetic: float = 0.10
    initial_last_length: int = 6
    initial_first_chars: int = 3
    auto_resolve: float = 0.70
    vector_resolve: float = 0.55
    vector_fuzzy: float = 0.85
    drift_warn_pct: float = 3.0
    drift_red_pct: float = 4.5
    l4_warn_pct: float = 6.0
    l4_red_pct: float = 8.0
    cost_red_usd: float = 0.05
    cost_near: float = 0.80
    human_cost_usd: float = 0.50
    cold_days: int = 90
    archive_days: int = 2190
    purge_days: int = 2555
    purge_warning_days: int = 2520
    shard_rows: int = 1000
    chunk_rows: int = 500


DEFAULT = Thresholds()
