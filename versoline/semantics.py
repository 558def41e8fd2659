"""Shared meaning of offsets, confidences and rounding, and the parameter records.

Offsets are code points, 0-based, end-exclusive.  Durations are BIGINT milliseconds.
Half-even rounding is ``bround``; truncation toward zero is a cast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds that decide results.
BOUNDARY_CONFIDENCE = 0.2
STRONG_CONFIDENCE = 0.5
TYPICAL_CHARS_PER_MS = 0.015
SHORTEST_PACE_MS = 5_000
SLOWEST_PACE = 0.005
FASTEST_PACE = 0.05
CHAPTER_TAIL_MS = 30_000
TRUST_RECENT_ANCHOR_MS = 120_000
FRAME_MS = 20
MAP_VERSION = 2


@dataclass(frozen=True)
class AlignSettings:
    """Parameters of the sampled alignment; passed into plans as literals."""

    probe_ms: int = 10_000
    interval_ms: int = 60_000
    run_in_probes: int = 12
    run_in_ms: int = 10_000
    min_confidence: float = 0.45
    radius_tokens: int = 400
    phrase_radius_tokens: int = 60
    max_radius_tokens: int = 12_000
    min_words_anywhere: int = 10
    anywhere_confidence: float = 0.6
    rate_smoothing: float = 0.5


REFINEMENT = AlignSettings(probe_ms=15_000, interval_ms=15_000, radius_tokens=120)


def heard(confidence: Column | str, threshold: float = BOUNDARY_CONFIDENCE) -> Column:
    """A measurement, as opposed to a boundary guess (strictly above the threshold).

    Compared as floats: a confidence of exactly the threshold must not count, whatever its column type.
    """
    c = F.col(confidence) if isinstance(confidence, str) else confidence
    return c.cast("float") > F.lit(threshold).cast("float")


def half_even(c: Column) -> Column:
    return F.bround(c, 0)


def blank(c: Column) -> Column:
    """Null, empty or only white space."""
    return F.coalesce(F.trim(c) == "", F.lit(True))
