"""Labels and levels of scores. Signed bias runs from -1 to 1, unit bias from 0 to 1; they never mix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colours of signed bias at -1, just below 0, 0, 0.5 and 1; the lowest runs towards the neutral one as it moves away from 0.
BELOW, NEUTRAL, HALF, FULL = (245, 197, 66), (150, 140, 131), (117, 170, 219), (26, 58, 107)


def bias_label(score: Column) -> Column:
    return F.when(score.isNull(), "no data").when(score > 0.5, "strong official").when(score > 0.1, "mild official").when(score >= -0.1, "neutral").when(score >= -0.5, "mild opposition").otherwise("strong opposition")


def bias_band(score: Column, edge: float = 0.1) -> Column:
    """official, opposition or neutral; null is neutral."""
    return F.when(score > edge, "official").when(score < -edge, "opposition").otherwise("neutral")


def bias_colour(score: Column) -> Column:
    s = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score))

    def channel(i: int) -> Column:
        run = lambda a, b, t: F.floor(F.lit(float(a[i])) + (b[i] - a[i]) * t + 0.5).cast("int")
        return F.when(s < 0, run(BELOW, NEUTRAL, -s)).when(s <= 0.5, run(NEUTRAL, HALF, s / 0.5)).otherwise(run(HALF, FULL, (s - 0.5) / 0.5))

    return F.when(score.isNull(), "#94a3b8").otherwise(F.format_string("rgb(%d,%d,%d)", channel(0), channel(1), channel(2)))


def signal_level(n_sources: Column, quality: Column, is_press: Column) -> Column:
    """1 to 10 from the number of sources, raised or lowered by quality, lowered for press releases."""
    base = F.when(n_sources >= 20, 10).when(n_sources >= 10, 8).when(n_sources >= 5, 6).when(n_sources >= 3, 4).when(n_sources >= 2, 3).otherwise(1)
    by_quality = F.when(quality >= 0.7, 1).when(quality < 0.4, -1).otherwise(0)
    return F.greatest(F.lit(1), F.least(F.lit(10), base + by_quality - F.when(is_press, 2).otherwise(0)))


def quality_tier(quality: Column) -> Column:
    return F.when(quality.isNull(), "unscored").when(quality >= 0.7, "high").when(quality >= 0.4, "medium").when(quality >= 0.2, "low").otherwise("very low")
