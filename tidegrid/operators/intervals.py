"""Prediction intervals from residuals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.quantiles import bound, quantile_column, z_of
from tidegrid.operators.panel import ROLES, Roles


def conformal_widths(cv: DataFrame, levels: Sequence[float], name: str, roles: Roles = ROLES) -> DataFrame:
    """(id, k, width_L…): percentiles of absolute residuals for each step ahead, from cross-validated rows with k."""
    e = F.abs(F.col(roles.target) - F.col(name))
    return cv.groupBy(roles.id, "k").agg(*[F.percentile(e, F.lit(x / 100)).alias(f"width_{x:g}") for x in levels])


def with_conformal(forecast: DataFrame, widths: DataFrame, levels: Sequence[float], name: str, roles: Roles = ROLES) -> DataFrame:
    """forecast, which has k, with name-lo-L by falling and name-hi-L by rising level. Series without residuals get nulls."""
    met = forecast.join(widths, [roles.id, "k"], "left")
    los = [(F.col(name) - F.col(f"`width_{x:g}`")).alias(bound(name, "lo", x)) for x in sorted(levels, reverse=True)]
    his = [(F.col(name) + F.col(f"`width_{x:g}`")).alias(bound(name, "hi", x)) for x in sorted(levels)]
    return met.select(*forecast.columns, *los, *his)


def with_rolling_conformal(cv: DataFrame, levels: Sequence[float], name: str, lag: int, calibration: int, roles: Roles = ROLES) -> DataFrame:
    """cv, which has cutoff and k, with intervals for each window: percentiles of absolute residuals at the same step of the `calibration` windows that are `lag` windows or more before it.

    With lag = ceil(h / step_size) these windows' rows end at the cutoff or before it, so that nothing is known that wasn't then.
    Null where there is no such window."""
    from pyspark.sql import Window

    before = Window.partitionBy(roles.id, "k").orderBy("cutoff").rowsBetween(-(lag + calibration - 1), -lag)
    e = F.abs(F.col(roles.target) - F.col(f"`{name}`"))
    rows = cv.withColumns({f"__w{i}": F.percentile(e, F.lit(x / 100)).over(before) for i, x in enumerate(sorted(levels))})
    at = {x: F.col(f"__w{i}") for i, x in enumerate(sorted(levels))}
    los = [(F.col(f"`{name}`") - at[x]).alias(bound(name, "lo", x)) for x in sorted(levels, reverse=True)]
    his = [(F.col(f"`{name}`") + at[x]).alias(bound(name, "hi", x)) for x in sorted(levels)]
    return rows.select(*[F.col(f"`{c}`") for c in cv.columns], *los, *his)


def with_normal(forecast: DataFrame, sigma: DataFrame, levels: Sequence[float], name: str, roles: Roles = ROLES) -> DataFrame:
    """The same from one deviation per series (id, sigma)."""
    met = forecast.join(sigma, roles.id, "left")
    los = [(F.col(name) - z_of(x) * F.col("sigma")).alias(bound(name, "lo", x)) for x in sorted(levels, reverse=True)]
    his = [(F.col(name) + z_of(x) * F.col("sigma")).alias(bound(name, "hi", x)) for x in sorted(levels)]
    return met.select(*forecast.columns, *los, *his)


def to_quantiles(df: DataFrame, quantiles: Sequence[float], name: str, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys, name, *[quantile_column(name, q) for q in quantiles])


def interval_map(df: DataFrame, levels: Sequence[float], name: str, keys: Sequence[str]) -> DataFrame:
    """Intervals as one map column: level -> (lo, hi)."""
    entries = [F.struct(F.lit(f"{x:g}").alias("k"), F.struct(F.col(f"`{bound(name, 'lo', x)}`").alias("lo"), F.col(f"`{bound(name, 'hi', x)}`").alias("hi")).alias("v")) for x in levels]
    return df.select(*keys, name, F.map_from_entries(F.array(*entries)).alias("intervals"))


def ensemble_sigma(df: DataFrame, models: Sequence[str], level: float = 68.27) -> DataFrame:
    """df with the models' mean and the deviation of their mean, from each one's interval at about one deviation."""
    mean = sum((F.col(m) for m in models[1:]), F.col(models[0])) / len(models)
    one = [F.col(f"`{bound(m, 'hi', level)}`") - F.col(m) for m in models]
    return df.withColumns({"ensemble": mean, "sigma": F.sqrt(sum((s * s for s in one[1:]), one[0] * one[0])) / len(models)})
