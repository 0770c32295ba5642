"""Rounding and clamping as the image domain uses them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Nearest integer, halves towards plus infinity, for negatives too."""
    return F.floor(x + F.lit(0.5))


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
