"""Two-sided p-values of Student's t as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Simpson steps, and how far they reach in asinh(t): the tail beyond holds less than 1e-12 from one degree of freedom on.
STEPS, REACH = 4000, 30.0


def _area(freedom: Column, start: Column) -> Column:
    """Integral of (1 + t^2 / v)^(-(v + 1) / 2) from start on, over y = asinh(t), by Simpson's rule."""
    step = F.lit(REACH / STEPS)

    def term(i: Column) -> Column:
        y = start + i * step
        t = (F.exp(y) - F.exp(-y)) / 2
        density = F.exp(-(freedom + 1) / 2 * F.log1p(t * t / freedom)) * (F.exp(y) + F.exp(-y)) / 2
        weight = F.when((i == 0) | (i == STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        return weight * density

    return F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), lambda total, i: total + term(i))


def p_value(statistic: str, freedom: str) -> Column:
    """P(|T| >= |statistic|): the tail's share of the density, so its constant is not needed; NULL for missing input."""
    t, v = F.abs(F.col(statistic)), F.col(freedom)
    start = F.log(t + F.sqrt(t * t + 1))
    share = _area(v, start) / _area(v, F.lit(0.0))
    return F.when(t.isNotNull() & ~F.isnan(t) & (v > 0) & ~F.isnan(v), F.least(F.lit(1.0), share))
