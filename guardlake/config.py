"""Thresholds and versions. All are data: pass another instance to change them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ContentConfig:
    max_bytes: int = 2 * 1024 * 1024
    repetition_rule: float = 0.9
    repetition_bonus_at: float = 0.85
    gate: int = 50
    schema_version: int = 1
    ruleset_version: int = 3
    scoring_version: int = 2
    max_json_depth: int = 64
    salt: bytes = b"guardlake"
    key: bytes = b"guardlake-test-key"


@dataclass(frozen=True)
class MemoryConfig:
    promotion_sessions: int = 3
    archive_days: int = 90
    stale_days: int = 180


@dataclass(frozen=True)
class FatigueConfig:
    threshold: int = 10
    window_seconds: int = 300
    cooldown_seconds: int = 120


@dataclass(frozen=True)
class RateConfig:
    per_minute: int = 30
    per_hour: int = 200
