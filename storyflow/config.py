"""Tunable thresholds, gathered in one immutable object that operators accept."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    # Defaults that results depend on.
    min_trust: float = 40.0
    min_final: float = 30.0
    brief_quality: float = 42.0
    brief_soft_max: int = 18
    brief_hard_max: int = 20
    brief_tag_share: float = 0.35
    brief_serendipity: int = 2
    major_trend: float = 85.0
    half_life_days: float = 14.0
    telemetry_days: int = 180
    semantic_duplicate: float = 0.92
    semantic_search: float = 0.78
    semantic_window_hours: int = 48
    title_jaccard: float = 0.35
    event_window_hours: int = 72
    event_vector: float = 0.88
    max_age_hours: float = 168.0
    future_tolerance_hours: float = 0.25
    interrupt_priority: float = 85.0
    alert_cap: int = 20
    retention_days: int = 30
    mentor_min: float = 55.0

    # Token matches one clustering step may enumerate, per core of the session, before the rank
    # range is split (see operators/cluster.py). As every step reads all that is left, the budget also grows with the tokens.
    pair_budget_per_core: int = 8_000_000
    pair_budget_per_token: int = 128
    # Largest day's pool that tasks hold as an index (see operators/briefs.py).
    pool_mb: int = 256
    # Articles that tasks hold at once where all pairs with readers are made (see operators/pairs.py).
    pair_block_mb: int = 64
    # Vector joins (see operators/vectors.py): rows per side of one comparison block, largest right side that is sent to tasks
    # whole, bound on an index's pivots, "exact" or "bands", and the share of pairs at the threshold that bands of signs find.
    vector_block: int = 4096
    vector_broadcast_mb: int = 16
    vector_pivot_mb: int = 64
    vector_mode: str = "exact"
    vector_recall: float = 0.99


DEFAULT = EngineConfig()
