"""Rounding half up, as the published numbers use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, places: int = 0) -> Column:
    """``floor(value * 10**places + 0.5) / 10**places`` as a double; null stays null."""
    scale = 10.0**places
    return F.floor(value * scale + 0.5).cast("double") / scale


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))
