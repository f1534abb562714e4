"""Thresholds and sizes; every operator takes them as parameters, these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 1000
    chunk_overlap: int = 150
    min_score: float = 0.80
    seed_distance: float = 0.18
    extract_threshold: float = 0.5
    graph_boost: float = 0.05
    keyword_boost: float = 0.04
    near_duplicate: float | None = 0.95  # None: passages that are near copies all stay
    same_question: float = 0.9
    max_neighbours: int = 30
    k1: float = 1.2
    b: float = 0.75
    k: int = 8
    max_k: int = 50
    session_hours: int = 4
    max_sessions: int = 500
    result_cache: int = 256
    score_cache: int = 20_000
    log_records: int = 20_000
    read_window: int = 3
    budget_floor: int = 100


DEFAULTS = Settings()
