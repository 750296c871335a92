"""Deterministic forecasters: aggregates and short tails of each series, spread over the horizon."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import metrics as M
from tidegrid.functions.freq import Freq, freq
from tidegrid.operators.panel import ROLES, Roles


def _spread(stats: DataFrame, value: Column, h: int, step: Freq, name: str, roles: Roles) -> DataFrame:
    """stats (id, last, …) over k = 1..h."""
    rows = stats.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(h))))
    return rows.select(roles.id, step.add(F.col("last"), F.col("k")).alias(roles.time), value.cast("double").alias(name))


def zero(df: DataFrame, h: int, step: Freq, roles: Roles = ROLES, name: str = "zero") -> DataFrame:
    return _spread(df.groupBy(roles.id).agg(F.max(roles.time).alias("last")), F.lit(0.0), h, step, name, roles)


def naive(df: DataFrame, h: int, step: Freq, roles: Roles = ROLES, name: str = "naive") -> DataFrame:
    """The last value."""
    s = df.groupBy(roles.id).agg(F.max(roles.time).alias("last"), F.max_by(roles.target, roles.time).alias("v"))
    return _spread(s, F.col("v"), h, step, name, roles)


def hist_avg(df: DataFrame, h: int, step: Freq, roles: Roles = ROLES, name: str = "hist_avg", ordered: bool = False) -> DataFrame:
    """The mean; ordered: added up from the last value to the first, to the same bits in every run."""
    mean = M.avg_along(F.col(roles.target), F.col(roles.time), rising=False) if ordered else F.avg(roles.target)
    s = df.groupBy(roles.id).agg(F.max(roles.time).alias("last"), mean.alias("v"))
    return _spread(s, F.col("v"), h, step, name, roles)


def drift(df: DataFrame, h: int, step: Freq, roles: Roles = ROLES, name: str = "drift") -> DataFrame:
    """The line through the first and the last value."""
    s = df.groupBy(roles.id).agg(F.max(roles.time).alias("last"), F.max_by(roles.target, roles.time).alias("b"), F.min_by(roles.target, roles.time).alias("a"), F.count(F.lit(1)).alias("n"))
    gone = F.col("k") * (F.col("b") - F.col("a")).cast("double") / F.nullif((F.col("n") - 1).cast("double"), F.lit(0.0))
    return _spread(s, F.col("b") + gone, h, step, name, roles)


def linear_trend(df: DataFrame, h: int, step: Freq, roles: Roles = ROLES, name: str = "linear_trend") -> DataFrame:
    """Least squares along the position."""
    rows = df.withColumn("rn", F.row_number().over(roles.rising))
    s = rows.groupBy(roles.id).agg(F.max(roles.time).alias("last"), F.regr_slope(roles.target, "rn").alias("b"), F.regr_intercept(roles.target, "rn").alias("a"), F.max("rn").alias("n"))
    return _spread(s, F.col("a") + F.col("b") * (F.col("n") + F.col("k")), h, step, name, roles)


def _last(df: DataFrame, n: int, roles: Roles) -> DataFrame:
    """The last n rows with back (1 = last) and last; ranks are limited before the exchange."""
    from pyspark.sql import Window

    last = F.first(roles.time).over(roles.falling.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.select(roles.id, roles.time, roles.target, F.row_number().over(roles.falling).alias("back"), last.alias("last")).filter(F.col("back") <= n)


def window_avg(df: DataFrame, h: int, step: Freq, roles: Roles = ROLES, name: str = "window_avg", window: int = 7) -> DataFrame:
    """The mean of the last `window` values."""
    s = _last(df, window, roles).groupBy(roles.id).agg(F.max("last").alias("last"), F.avg(roles.target).alias("v"))
    return _spread(s, F.col("v"), h, step, name, roles)


def seasonal_naive(df: DataFrame, h: int, step: Freq, roles: Roles = ROLES, name: str = "seasonal_naive", season: int | None = None) -> DataFrame:
    """The value one season ago, over and over; null where a series is shorter than a season."""
    s = season or step.season
    rows = _last(df, s, roles).filter(F.col("back") >= s - min(h, s) + 1)  # the rest of the season isn't reached
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(s + 1) - F.col("back"), F.lit(h), F.lit(s))))
    known = rows.select(roles.id, step.add(F.col("last"), F.col("k")).alias(roles.time), F.col(roles.target).cast("double").alias(name))
    short = df.groupBy(roles.id).agg(F.max(roles.time).alias("last"), F.count(F.lit(1)).alias("n")).filter(F.col("n") < s)
    nulls = _spread(short, F.lit(None), h, step, name, roles)
    return known.join(short.select(roles.id), roles.id, "left_anti").unionByName(nulls)


STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "zero": zero, "naive": naive, "hist_avg": hist_avg, "drift": drift, "linear_trend": linear_trend, "window_avg": window_avg, "seasonal_naive": seasonal_naive,
}


def forecast_with(df: DataFrame, models: list[str], h: int, step: str | int | Freq, roles: Roles = ROLES, **how) -> DataFrame:
    """One column for each strategy, on (id, time)."""
    step = step if isinstance(step, Freq) else freq(step)
    out = None
    for m in models:
        own = STRATEGIES[m](df, h, step, roles, **how.get(m, {}))
        out = own if out is None else out.join(own, [roles.id, roles.time])
    return out


def fitted_seasonal(df: DataFrame, season: int, roles: Roles = ROLES, name: str = "seasonal_naive") -> DataFrame:
    """df with the in-sample value one season back; null in the first season."""
    return df.withColumn(name, F.lag(roles.target, season).over(roles.rising).cast("double"))


def with_history(df: DataFrame, forecast: DataFrame, season: int, roles: Roles = ROLES, name: str = "seasonal_naive") -> DataFrame:
    """Fitted values of the past, where there are any, and forecasts in one relation."""
    past = fitted_seasonal(df, season, roles, name).select(roles.id, roles.time, name, F.row_number().over(roles.rising).alias("__rn")).filter(F.col("__rn") > season).drop("__rn")
    return past.unionByName(forecast.select(roles.id, roles.time, name))


def bounded(df: DataFrame, fit: Callable[[DataFrame], DataFrame], name: str, roles: Roles = ROLES, low: float = 0.0) -> DataFrame:
    """A forecast made on log(y - low), which exp keeps above low."""
    out = fit(df.withColumn(roles.target, F.log(F.col(roles.target) - low)))
    return out.withColumn(name, F.exp(name) + low)


def fallback(df: DataFrame, name: str, other: str) -> DataFrame:
    return df.withColumn(name, F.coalesce(F.col(name), F.col(other)))


def ensemble(df: DataFrame, models: list[str], name: str = "ensemble") -> DataFrame:
    """The mean of the models that have a value."""
    have = sum((F.col(m).isNotNull().cast("int") for m in models), F.lit(0))
    total = sum((F.coalesce(F.col(m), F.lit(0.0)) for m in models), F.lit(0.0))
    return df.withColumn(name, total / F.nullif(have.cast("double"), F.lit(0.0)))


def exogenous(df: DataFrame, future: DataFrame, x: str, roles: Roles = ROLES, name: str = "exogenous") -> DataFrame:
    """Least squares of each series on one covariate that is known ahead; a series without spread in it gets its mean."""
    s = df.groupBy(roles.id).agg(F.regr_slope(roles.target, x).alias("b"), F.avg(roles.target).alias("ym"), F.avg(x).alias("xm"))
    rows = future.join(s, roles.id)
    return rows.select(roles.id, roles.time, (F.col("ym") + F.coalesce("b", F.lit(0.0)) * (F.col(x) - F.col("xm"))).alias(name), (F.coalesce("b", F.lit(0.0)) * (F.col(x) - F.col("xm"))).alias(x), F.col("ym").alias("base_value"))
