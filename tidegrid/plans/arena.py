"""Models against each other: hold-outs of several datasets, forecasts of all models, errors in one table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import metrics as M
from tidegrid.functions.freq import freq
from tidegrid.operators import panel
from tidegrid.operators.panel import ROLES, Roles
from tidegrid.plans.api import MODELS


def forecasts(df: DataFrame, models: Sequence[str], h: int, step: str | int, roles: Roles = ROLES) -> DataFrame:
    """(id, time, forecaster, value): all models' forecasts below one another, so that one join meets them all."""
    out = None
    for m in models:
        own = MODELS[m](df, h, freq(step), roles).select(roles.id, roles.time, F.lit(m).alias("forecaster"), F.col(m).alias("value"))
        out = own if out is None else out.unionByName(own)
    return out


def compete(datasets: Mapping[str, tuple[DataFrame, str | int]], models: Sequence[str], h: int, metrics: Sequence[str] = ("mae", "rmse"), roles: Roles = ROLES) -> DataFrame:
    """(dataset, forecaster, metrics…): errors on the last h rows of each series, over all tested rows of a dataset. datasets: name -> (panel, frequency)."""
    out = None
    for name, (df, step) in datasets.items():
        split = panel.holdout(df.select(roles.id, roles.time, roles.target), h, roles)
        ahead = forecasts(split.filter("part = 'train'").drop("part"), models, h, step, roles)
        met = split.filter("part = 'test'").join(ahead, [roles.id, roles.time])
        y, f = F.col(roles.target), F.col("value")
        own = met.groupBy(F.lit(name).alias("dataset"), "forecaster").agg(*[M.METRICS[m](y, f).alias(m) for m in metrics])
        out = own if out is None else out.unionByName(own)
    return out


def plot_rows(history: DataFrame, ahead: DataFrame, models: Sequence[str], series: int = 8, tail: int | None = None, roles: Roles = ROLES) -> DataFrame:
    """(id, time, what, value) of a few series, the same ones each time: what a chart of history and forecasts needs."""
    own = panel.sample_series(history, series, roles)
    if tail:
        own = panel.tail(own, tail, roles)
    past = own.select(roles.id, roles.time, F.lit(roles.target).alias("what"), F.col(roles.target).alias("value"))
    few = ahead.join(own.select(roles.id).distinct(), roles.id, "left_semi")
    return past.unionByName(few.unpivot([roles.id, roles.time], list(models), "what", "value"))
