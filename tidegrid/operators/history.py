"""What models say about the past: in-sample values one step ahead, and the season that the data have."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.panel import ROLES, Roles
from tidegrid.operators.recursive import series_arrays


def fitted(df: DataFrame, model: str, season: int = 1, roles: Roles = ROLES, name: str | None = None, alpha: float | str = 0.1) -> DataFrame:
    """df with the model's forecast of each row from the rows before it; null where they don't suffice.

    One window pass for models of lags, means and lines; simple smoothing folds a series' values, held by one task, with one
    weight or a column of them. Other models have no values of the past."""
    y, name = F.col(roles.target), name or model
    before = roles.rising.rowsBetween(Window.unboundedPreceding, -1)
    at = F.row_number().over(roles.rising)
    if model == "ses":
        return _smoothed(df, alpha, roles, name)
    if model == "linear_trend":
        rows = df.withColumn("__rn", at)
        line = F.regr_intercept(y, F.col("__rn")).over(before) + F.regr_slope(y, F.col("__rn")).over(before) * F.col("__rn")
        return rows.withColumn(name, line.cast("double")).drop("__rn")
    last = F.lag(y, 1).over(roles.rising)
    ways = {
        "seasonal_naive": lambda: F.lag(y, season).over(roles.rising), "naive": lambda: last, "zero": lambda: F.lit(0.0), "hist_avg": lambda: F.avg(y).over(before),
        "window_avg": lambda: F.avg(y).over(roles.rising.rowsBetween(-7, -1)), "drift": lambda: last + (last - F.first(y).over(before)) / F.nullif((at - 2).cast("double"), F.lit(0.0)),
    }
    if model not in ways:
        raise ValueError(f"{model} has no values of the past; {sorted([*ways, 'linear_trend', 'ses'])} do")
    return df.withColumn(name, ways[model]().cast("double"))


def _smoothed(df: DataFrame, alpha: float | str, roles: Roles, name: str) -> DataFrame:
    kinds = dict(df.dtypes)
    pairs = F.array_sort(F.collect_list(F.struct(F.col(roles.time).alias("t"), F.col(roles.target).cast("double").alias("y"))))
    rows = df.filter(F.col(roles.target).isNotNull()).groupBy(F.col(roles.id).alias("i")).agg(pairs.alias("p"), (F.first(alpha) if isinstance(alpha, str) else F.lit(alpha)).alias("a"))
    alpha = F.col("a")
    level = lambda s, x: F.struct(F.coalesce(alpha * x["y"] + (1 - alpha) * s["l"], x["y"]).alias("l"), F.array_append(s["out"], F.struct(x["t"].alias("t"), s["l"].alias("f"))).alias("out"))
    start = F.struct(F.lit(None).cast("double").alias("l"), F.array().cast(f"array<struct<t:{kinds[roles.time]},f:double>>").alias("out"))
    ahead = rows.select("i", F.explode(F.aggregate("p", start, level, lambda s: s["out"])).alias("o")).select(F.col("i").alias(roles.id), F.col("o.t").alias(roles.time), F.col("o.f").alias(name))
    return df.join(ahead, [roles.id, roles.time], "left")


def find_season(df: DataFrame, roles: Roles = ROLES, most: int = 366, least: float = 0.5) -> int:
    """The lag at which series are most like themselves, behind the first one at which they aren't: one number for the panel, 1 without any.

    Each series gives its correlations at all lags that leave a third of its values; their means over series decide. A
    series is held by one task; what comes to the driver is a number for each lag."""

    def correlations(batches):
        for b in batches:
            total, n = np.zeros(most + 1), np.zeros(most + 1)
            for ys in b.column("ys").to_pylist():
                y = np.asarray(ys, float)
                for k in range(1, min(most, 2 * len(y) // 3) + 1):
                    u, v = y[k:] - y[k:].mean(), y[:-k] - y[:-k].mean()
                    d = np.sqrt((u @ u) * (v @ v))
                    if len(u) > 3 and d > 1e-12:
                        total[k] += (u @ v) / d
                        n[k] += 1
            own = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own]), pa.array(n[own])], names=["k", "total", "n"])

    rows = series_arrays(df, roles).select("ys").mapInArrow(correlations, "k long, total double, n double")
    got = {r["k"]: r["total"] / r["n"] for r in rows.groupBy("k").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()}
    first = next((k for k in sorted(got) if got[k] < least / 2), None)
    later = {k: v for k, v in got.items() if first is not None and k > first}
    best = max(later, key=lambda k: (later[k], -k), default=None)
    return best if best is not None and later[best] >= least else 1
