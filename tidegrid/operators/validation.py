"""Rolling-origin cross-validation by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.models import regression
from tidegrid.operators.panel import ROLES, Roles, with_positions


def windows(df: DataFrame, h: int, n_windows: int = 1, step: int | None = None, roles: Roles = ROLES) -> DataFrame:
    """Test rows of each window: the columns of df, window w, k = 1..h and cutoff, the last stamp of the training rows.

    Window w ends its training at position n - h - step * (n_windows - 1 - w); windows that would train on nothing are
    left out. A row finds its windows by arithmetic, so that nothing is joined and only rows that are tested multiply."""
    p = step or h
    rows = with_positions(df, roles)
    back = F.col("n") - F.col("rn")  # rows behind this one
    w = F.explode(F.sequence(F.lit(0), F.lit(n_windows - 1)))
    # the cutoff's stamp is a fixed number of rows before: lag by k for each k
    stamps = F.array(*[F.lag(roles.time, k).over(roles.rising) for k in range(1, h + 1)])
    rows = rows.withColumn("__stamps", stamps).filter(back < h + p * (n_windows - 1))
    rows = rows.withColumn("w", w).withColumn("c", F.col("n") - h - p * (n_windows - 1 - F.col("w"))).withColumn("k", (F.col("rn") - F.col("c")).cast("int"))
    rows = rows.filter((F.col("c") >= 1) & F.col("k").between(1, h))
    return rows.withColumn("cutoff", F.element_at("__stamps", F.col("k"))).drop("__stamps", "c")


def cutoffs(df: DataFrame, h: int, n_windows: int = 1, step: int | None = None, roles: Roles = ROLES) -> DataFrame:
    """(id, w, cutoff, n_train) of each series' windows."""
    p = step or h
    rows = with_positions(df, roles).filter(F.col("n") - F.col("rn") >= h)
    ahead = F.col("n") - h - F.col("rn")
    rows = rows.filter((ahead % p == 0) & (ahead <= p * (n_windows - 1)))
    return rows.select(roles.id, (n_windows - 1 - ahead / p).cast("int").alias("w"), F.col(roles.time).alias("cutoff"), F.col("rn").cast("long").alias("n_train"))


def seasonal_cv(df: DataFrame, h: int, season: int, n_windows: int = 1, step: int | None = None, roles: Roles = ROLES, name: str = "seasonal_naive") -> DataFrame:
    """(id, time, cutoff, y, name): each window's seasonal-naive forecasts, read at fixed lags from the tested row."""
    reach = sorted({((k - 1) // season + 1) * season for k in range(1, h + 1)})
    rows = df.withColumn("__lags", F.array(*[F.lag(roles.target, r).over(roles.rising) for r in reach]))
    tested = windows(rows, h, n_windows, step, roles)
    value = F.element_at("__lags", (F.floor((F.col("k") - 1) / season) + 1).cast("int"))
    # a lag beyond the training rows' start is null already
    return tested.select(roles.id, roles.time, "cutoff", roles.target, value.cast("double").alias(name), "k")


def train_test_cv(df: DataFrame, fit, h: int, n_windows: int = 1, step: int | None = None, roles: Roles = ROLES) -> DataFrame:
    """Cross-validation of any forecaster fit(train): one pass over all windows at once, with the window as part of the series' id.

    Training rows multiply by the number of windows, as they must for a forecaster that sees only rows."""
    cuts = cutoffs(df, h, n_windows, step, roles)
    key = F.struct(F.col(roles.id).alias("id"), "cutoff")
    train = df.join(cuts.select(roles.id, "cutoff"), roles.id).filter(F.col(roles.time) <= F.col("cutoff"))
    out = fit(train.withColumn(roles.id, key).drop("cutoff"))
    values = [c for c in out.columns if c not in (roles.id, roles.time)]
    out = out.select(F.col(f"{roles.id}.id").alias(roles.id), roles.time, F.col(f"{roles.id}.cutoff").alias("cutoff"), *values)
    return out.join(df.select(roles.id, roles.time, roles.target), [roles.id, roles.time])


def last_windows(cv: DataFrame, n_windows: int, roles: Roles = ROLES) -> DataFrame:
    """The rows of each series' last n_windows windows, from rows with cutoff and k."""
    from pyspark.sql import Window

    newest = Window.partitionBy(roles.id, "k").orderBy(F.col("cutoff").desc())
    return cv.withColumn("__w", F.row_number().over(newest)).filter(F.col("__w") <= n_windows).drop("__w")


def regression_cv(df: DataFrame, xs: Sequence[str], h: int, n_windows: int = 1, step: int | None = None, roles: Roles = ROLES, name: str = "regression") -> DataFrame:
    """(id, time, cutoff, y, name, k): each window's least squares on covariates that are known ahead, learned from what precedes its cutoff."""
    key = F.struct(F.col(roles.id).alias("id"), "cutoff")
    cuts = cutoffs(df, h, n_windows, step, roles).select(roles.id, "cutoff")
    train = df.join(cuts, roles.id).filter(F.col(roles.time) <= F.col("cutoff")).withColumn(roles.id, key)
    tested = windows(df, h, n_windows, step, roles)
    ahead = regression(train, tested.withColumn(roles.id, key), xs, roles, name)
    ahead = ahead.select(F.col(f"{roles.id}.id").alias(roles.id), F.col(f"{roles.id}.cutoff").alias("cutoff"), roles.time, name)
    return tested.select(roles.id, roles.time, "cutoff", roles.target, "k").join(ahead, [roles.id, roles.time, "cutoff"]).select(roles.id, roles.time, "cutoff", roles.target, name, "k")
