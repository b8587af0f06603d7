"""The measures, as expressions.  Missing is null throughout; NaN never stands for it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.schema import EPS, IMPUTED, ZERO_TOL


def similarity(n1: Column, t1: Column, n2: Column, t2: Column, rounding: int | None = None) -> Column:
    """Static similarity of two counts: 1 - |p1 - p2| / (p1 + p2); null if a total or both shares are 0."""
    p1, p2 = n1 / F.when(t1 > 0, t1), n2 / F.when(t2 > 0, t2)
    score = F.when(p1 + p2 > 0, 1 - F.abs(p1 - p2) / (p1 + p2))
    return score if rounding is None else F.bround(score, rounding)


def responsiveness(leader: Column, responder: Column, eps: float = EPS, zero_tol: float = ZERO_TOL) -> Column:
    """Directional score of one exchange from rates in percent; null where the leader's rate is about 0."""
    a, b = F.coalesce(leader, F.lit(0.0)), F.coalesce(responder, F.lit(0.0))
    return F.when(F.abs(a) > zero_tol, 1 - F.abs(a - b) / (a + b + eps))


def rate(n: Column, total: Column) -> Column:
    """Percent of the words; 0 without words."""
    return F.when(total > 0, n / total * 100).otherwise(0.0)


def present(columns: list[Column]) -> Column:
    """How many values aren't missing."""
    return reduce(lambda a, b: a + b, [c.isNotNull().cast("long") for c in columns])


def mean(columns: list[Column]) -> Column:
    """Mean of the values that aren't missing."""
    n = present(columns)
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in columns]) / F.when(n > 0, n)


def deviation(columns: list[Column]) -> Column:
    """Population standard deviation of the values that aren't missing; 0 for one."""
    m, n = mean(columns), present(columns)
    return F.sqrt(reduce(lambda a, b: a + b, [F.coalesce((c - m) * (c - m), F.lit(0.0)) for c in columns]) / F.when(n > 0, n))


def talk_ratio(first: Column, total: Column) -> Column:
    return F.when(total > 0, first / total)


def imputed(value: Column, need: Column) -> tuple[Column, Column]:
    """(value or the neutral one, whether it was filled in)."""
    return F.when(need, F.lit(IMPUTED)).otherwise(value), need.cast("int")


def window_index(start: Column, seconds: float) -> Column:
    """The half-open window [k W, (k + 1) W) of a time; missing times are in window 0."""
    return F.coalesce(F.floor(start / F.lit(float(seconds))), F.lit(0)).cast("long")
