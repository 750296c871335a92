"""Levels, quantiles and the names of interval columns."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def levels_of(level: Sequence[float] | None, quantiles: Sequence[float] | None) -> list[float]:
    """Interval levels from either argument; rounding keeps 0.3 in a float grid at level 40."""
    if level is not None and quantiles is not None:
        raise ValueError("give level or quantiles, not both")
    if quantiles is not None:
        if not all(0 < q < 1 for q in quantiles):
            raise ValueError("quantiles must lie between 0 and 1")
        return sorted({float(round(abs(100 - 200 * q))) for q in quantiles} - {0.0})
    if level is not None and not all(0 <= x < 100 for x in level):
        raise ValueError("levels must lie in [0, 100)")
    return sorted({float(x) for x in level or ()})


def z_of(level: float) -> float:
    """Half width, in deviations, of a normal interval."""
    return NormalDist().inv_cdf(0.5 + level / 200)


def bound(name: str, side: str, level: float) -> str:
    return f"{name}-{side}-{level:g}"


def quantile_column(name: str, q: float) -> Column:
    """The column that holds a quantile, under its quantile name."""
    level = float(round(abs(100 - 200 * q)))
    source = name if not level else bound(name, "lo" if q < 0.5 else "hi", level)
    return F.col(f"`{source}`").alias(f"{name}-q-{round(100 * q)}")
