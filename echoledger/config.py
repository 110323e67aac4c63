"""Tunables of reuse resolution, passed as plain values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ReuseConfig:
    # Fixed values (defaults that results depend on).
    similarity_threshold: float = 0.90
    # Bounds on candidates and latencies are off unless a caller asks for them.
    max_store_rows: int | None = None
    top_k: int | None = None
    embedding_dims: int = 384
    contradiction_threshold: float = 0.5
    failure_threshold: int = 3
    failure_window_s: int = 30
    latency_window_rows: int | None = None
    flush_interval_s: int = 30

    # Physical sizing of the similarity join.
    block_rows: int = 3072
    block_bytes: int = 48 * 1024 * 1024
    max_pivots: int = 1024
    broadcast_rows: int = 20_000
    broadcast_bytes: int = 256 * 1024 * 1024


DEFAULTS = ReuseConfig()

_FALSY = ("false", "0", "no", "off", "")


def is_truthy(value: str | None, default: bool) -> bool:
    """Flag parsing: unset keeps the default, anything but the falsy words is on."""
    return default if value is None else value.strip().lower() not in _FALSY


def parse_fraction(value: str | None, default: float) -> float:
    """Fraction setting; text that is not a number keeps the default."""
    try:
        return default if value is None else float(value)
    except ValueError:
        return default
