"""Aggregates that round the same way on every run and every engine.

Sums run over integers or decimals, so they do not depend on task order; one
division and one rounding follow.  ``steady_round`` pushes a value that sits on
a rounding tie (up to binary noise) away from zero before rounding.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIE = 1e-9
SCORE = "decimal(8,4)"  # sums stay in decimal(18,4), the fast long-backed form


def steady_round(value: Column, digits: int) -> Column:
    value = value.cast("double")
    return F.round(value + F.signum(value) * F.lit(TIE), digits)


def ratio(top: Column, bottom: Column, digits: int | None = None) -> Column:
    """``top / bottom`` as double, NULL where the bottom is zero."""
    out = top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))
    return out if digits is None else steady_round(out, digits)


def mean_of(value: Column, digits: int | None = None) -> Column:
    return ratio(F.sum(value), F.count(value), digits)


def share_of(condition: Column, digits: int) -> Column:
    """Share of all rows of the group that meet the condition (0..1)."""
    return ratio(F.count_if(condition), F.count(F.lit(1)), digits)


def percent_of(condition: Column, digits: int) -> Column:
    return ratio(F.count_if(condition) * 100, F.count(F.lit(1)), digits)
