"""Forecast errors as aggregate expressions over rows (actual y, forecast f). Rows where either is null don't count."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _over(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def avg_along(value: Column, along: Column, rising: bool = True) -> Column:
    """The mean of a group, added up along a column, so that the last bits don't depend on where rows are. A group is held as one array."""
    own = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct(along.alias("at"), value.cast("double").alias("v")))), rising)
    return F.aggregate(own, F.lit(0.0), lambda total, r: total + r["v"]) / F.nullif(F.count(value).cast("double"), F.lit(0.0))


def mae(y: Column, f: Column, avg: Callable[[Column], Column] = F.avg) -> Column:
    return avg(F.abs(y - f))


def mse(y: Column, f: Column) -> Column:
    return F.avg((y - f) * (y - f))


def rmse(y: Column, f: Column) -> Column:
    return F.sqrt(mse(y, f))


def mape(y: Column, f: Column) -> Column:
    """Rows with y = 0 are left out."""
    return F.avg(_over(F.abs(y - f), F.abs(y)))


def smape(y: Column, f: Column) -> Column:
    """Between 0 and 1; rows where both are 0 have no error."""
    own = F.coalesce(_over(F.abs(y - f), F.abs(y) + F.abs(f)), F.lit(0.0))
    return F.avg(F.when(y.isNotNull() & f.isNotNull(), own))


def bias(y: Column, f: Column) -> Column:
    return F.avg(f - y)


METRICS: dict[str, Callable[[Column, Column], Column]] = {"mae": mae, "mse": mse, "rmse": rmse, "mape": mape, "smape": smape, "bias": bias}


def pinball(y: Column, f: Column, q: float) -> Column:
    """Loss of f as the q-quantile of y."""
    e = y - f
    return F.avg(F.greatest(e * q, e * (q - 1)))


def score(y: Column, f: Column) -> Column:
    """Absolute error and absolute bias, both in sum, over the sum of actuals."""
    return _over(F.sum(F.abs(f - y)) + F.abs(F.sum(f - y)), F.sum(y))


def mase(error: Column, scale: Column, least: float = 1e-2) -> Column:
    """An error over its in-sample scale; 0 where there is no scale to speak of."""
    return F.coalesce(error / F.when(scale >= least, scale), F.lit(0.0))
