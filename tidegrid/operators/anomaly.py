"""Anomalies: in history, and among the latest rows against rolling residuals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.quantiles import bound, z_of
from tidegrid.operators.forecast import fitted_seasonal
from tidegrid.operators.panel import ROLES, Roles
from tidegrid.operators.validation import seasonal_cv


#: Forecasts of rolling windows: from their number and the rows between them, rows with cutoff, target and the forecast.
Windows = Callable[[int, int], DataFrame]


def historical(df: DataFrame, season: int, level: float = 99, roles: Roles = ROLES, name: str = "seasonal_naive", fitted: DataFrame | None = None) -> DataFrame:
    """(id, time, y, name, anomaly, lo, hi) for rows with a fitted value: outside z deviations of the series' residuals. A null y is no anomaly.

    `fitted` is df with the values of a model; without it they are those of one season before."""
    fit = (fitted_seasonal(df, season, roles, name) if fitted is None else fitted).filter(F.col(name).isNotNull())
    sigma = F.stddev_samp(F.col(roles.target) - F.col(name)).over(roles.whole)
    rows = fit.withColumn("__w", z_of(level) * sigma)
    lo, hi = F.col(name) - F.col("__w"), F.col(name) + F.col("__w")
    y = F.col(roles.target)
    flag = F.coalesce((y < lo) | (y > hi), F.lit(False))
    return rows.select(roles.id, roles.time, roles.target, name, flag.alias("anomaly"), lo.alias(bound(name, "lo", level)), hi.alias(bound(name, "hi", level)))


def rolling_residuals(df: DataFrame, h: int, detection_size: int, season: int, calibration: int, step: int | None = None, roles: Roles = ROLES, name: str = "seasonal_naive", windows: Windows | None = None) -> DataFrame:
    """(id, time, y, name, r, live): one row for each stamp that rolling windows test, over calibration + detection_size rows; where windows overlap, their forecasts' mean. live marks the last detection_size rows."""
    p = step or h
    n_windows = max(1, -(-(calibration + detection_size - h) // p) + 1)
    cv = windows(n_windows, p) if windows else seasonal_cv(df, h, season, n_windows, p, roles, name)
    rows = cv.groupBy(roles.id, roles.time).agg(F.first(roles.target).alias(roles.target), F.avg(name).alias(name))
    rows = rows.withColumn("r", F.col(roles.target) - F.col(name))
    return rows.withColumn("live", F.row_number().over(roles.falling) <= detection_size)


def online(df: DataFrame, h: int, detection_size: int, season: int, level: float = 99, calibration: int | None = None, step: int | None = None, roles: Roles = ROLES, name: str = "seasonal_naive", windows: Windows | None = None) -> DataFrame:
    """The last detection_size rows of each series with anomaly_score, in deviations of the residuals before them, and anomaly, lo and hi."""
    rows = rolling_residuals(df, h, detection_size, season, calibration or 6 * detection_size, step, roles, name, windows)
    past = F.when(~F.col("live"), F.col("r"))
    rows = rows.withColumns({"mu": F.avg(past).over(roles.whole), "sd": F.stddev_samp(past).over(roles.whole)}).filter("live")
    z = z_of(level)
    score = (F.col("r") - F.col("mu")) / F.nullif("sd", F.lit(0.0))
    lo, hi = F.col(name) + F.col("mu") - z * F.col("sd"), F.col(name) + F.col("mu") + z * F.col("sd")
    y = F.col(roles.target)
    return rows.select(roles.id, roles.time, roles.target, name, F.coalesce((y < lo) | (y > hi), F.lit(False)).alias("anomaly"), score.alias("anomaly_score"), lo.alias(bound(name, "lo", level)), hi.alias(bound(name, "hi", level)))


def online_multivariate(df: DataFrame, h: int, detection_size: int, season: int, level: float = 99, calibration: int | None = None, step: int | None = None, roles: Roles = ROLES, name: str = "seasonal_naive", windows: Windows | None = None) -> DataFrame:
    """Scores squared and summed over series at each stamp, against the level's percentile of the stamps before; all series share a stamp's flag, but for null targets. The percentile is over a number for each stamp, in one task: a calendar's length."""
    rows = rolling_residuals(df, h, detection_size, season, calibration or 6 * detection_size, step, roles, name, windows)
    past = F.when(~F.col("live"), F.col("r"))
    rows = rows.withColumns({"mu": F.avg(past).over(roles.whole), "sd": F.stddev_samp(past).over(roles.whole)})
    rows = rows.withColumn("anomaly_score", (F.col("r") - F.col("mu")) / F.nullif("sd", F.lit(0.0)))
    by = rows.groupBy(roles.time).agg(F.sum(F.col("anomaly_score") * F.col("anomaly_score")).alias("accumulated_anomaly_score"), F.bool_or("live").alias("late"))
    limit = F.broadcast(by.filter(~F.col("late")).agg(F.percentile("accumulated_anomaly_score", F.lit(level / 100)).alias("limit")))  # one row
    hot = by.crossJoin(limit)
    met = rows.filter("live").join(hot, roles.time)
    flag = F.coalesce((F.col("accumulated_anomaly_score") > F.col("limit")) & F.col(roles.target).isNotNull(), F.lit(False))
    return met.select(roles.id, roles.time, roles.target, name, flag.alias("anomaly"), "anomaly_score", "accumulated_anomaly_score")
