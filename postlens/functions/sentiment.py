"""Polarity → label / sign maps and the reproducible jitter draw.

Polarity follows the labelled corpus: 0 negative, 2 neutral, 4 positive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEGATIVE, NEUTRAL, POSITIVE = "Negative", "Neutral", "Positive"

# --- fixed values: jitter thresholds on a draw r in 0..9 -------------------
# polarity 0: r <= 6 Negative, r == 7 Positive, r >= 8 Neutral
# polarity 4: r >= 8 Neutral, otherwise Positive
# any other polarity: Positive
JITTER_NEGATIVE_MAX = 6
JITTER_NEUTRAL_MIN = 8
DRAW_MODULUS = 10
# ---------------------------------------------------------------------------


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def polarity_label(polarity: str | Column) -> Column:
    """0 → Negative, 2 → Neutral, 4 → Positive, anything else → Neutral."""
    p = _col(polarity)
    return (
        F.when(p == 0, F.lit(NEGATIVE))
        .when(p == 2, F.lit(NEUTRAL))
        .when(p == 4, F.lit(POSITIVE))
        .otherwise(F.lit(NEUTRAL))
    )


def polarity_sign(polarity: str | Column) -> Column:
    """0 → -1, 2 → 0, 4 → 1, anything else → 0 (int)."""
    p = _col(polarity)
    return F.when(p == 0, F.lit(-1)).when(p == 4, F.lit(1)).otherwise(F.lit(0))


def default_draw(key: str | Column = "id", seed: int = 0) -> Column:
    """A per-row draw in 0..9 that is a pure function of ``key`` and ``seed``:
    the same under any partitioning, retry or re-execution (``rand`` is not)."""
    return F.pmod(F.xxhash64(_col(key), F.lit(seed)), F.lit(DRAW_MODULUS)).cast("int")


def jittered_label(polarity: str | Column, draw: Column) -> Column:
    """Label with the noise rule above applied to the draw ``r``."""
    p, r = _col(polarity), draw
    return (
        F.when((p == 0) & (r <= JITTER_NEGATIVE_MAX), F.lit(NEGATIVE))
        .when((p == 0) & (r >= JITTER_NEUTRAL_MIN), F.lit(NEUTRAL))
        .when((p == 4) & (r >= JITTER_NEUTRAL_MIN), F.lit(NEUTRAL))
        .otherwise(F.lit(POSITIVE))
    )
