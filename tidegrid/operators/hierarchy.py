"""Hierarchies of series: roll-ups along keys and along time, and reconciliation of forecasts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.panel import ROLES, Roles


def aggregate(bottom: DataFrame, spec: Sequence[Sequence[str]], roles: Roles = ROLES) -> DataFrame:
    """(id, time, y, level): sums at each level of spec in one pass of grouping sets; ids join their keys by `/`."""
    keys = list(dict.fromkeys(k for level in spec for k in level))
    sets = [[F.col(k) for k in level] + [F.col(roles.time)] for level in spec]
    on = lambda k: F.grouping(k) == 0
    rows = bottom.groupingSets(sets, *keys, roles.time).agg(F.sum(roles.target).alias(roles.target), *[F.grouping(k).alias(f"__{k}") for k in keys])
    on = lambda k: F.col(f"__{k}") == 0
    name = F.concat_ws("/", *[F.when(on(k), F.col(k)) for k in keys])
    level = F.concat_ws("/", *[F.when(on(k), F.lit(k)) for k in keys])
    return rows.select(name.alias(roles.id), roles.time, roles.target, level.alias("level"))


def summing_edges(bottom: DataFrame, spec: Sequence[Sequence[str]]) -> DataFrame:
    """(agg_id, bottom_id): the summing matrix as its ones."""
    keys = list(spec[-1])
    ids = bottom.select(*keys).distinct().withColumn("bottom_id", F.concat_ws("/", *keys))
    levels = F.array(*[F.concat_ws("/", *level) for level in spec])
    return ids.select(F.explode(levels).alias("agg_id"), "bottom_id")


def bottom_up(forecast: DataFrame, edges: DataFrame, name: str, roles: Roles = ROLES) -> DataFrame:
    """Forecasts of all levels as sums of the bottom ones."""
    own = forecast.withColumnRenamed(roles.id, "bottom_id").join(edges, "bottom_id")
    return own.groupBy(F.col("agg_id").alias(roles.id), roles.time).agg(F.sum(name).alias(name))


def top_down(history: DataFrame, total: DataFrame, name: str, roles: Roles = ROLES, most: int = 10_000) -> DataFrame:
    """Bottom forecasts from one total by each series' share of the history's sum. The total's horizon, of `most` stamps at most, goes to every series as one array."""
    ahead = F.array_sort(F.collect_list(F.struct(F.col(roles.time).alias("t"), F.col(name).alias("v"))))
    whole = history.agg(F.sum(roles.target).alias("__all"))
    one = F.broadcast(total.limit(most + 1).agg(ahead.alias("__ahead")).crossJoin(F.broadcast(whole)))  # one row of `most` stamps
    rows = history.groupBy(roles.id).agg(F.sum(roles.target).alias("__own")).crossJoin(one)
    rows = rows.withColumn("__ahead", F.when(F.size("__ahead") <= most, F.col("__ahead")).otherwise(F.raise_error(F.lit(f"a total of more than {most} stamps"))))
    rows = rows.select(roles.id, (F.col("__own") / F.nullif("__all", F.lit(0.0))).alias("__share"), F.explode("__ahead").alias("__a"))
    return rows.select(roles.id, F.col("__a.t").alias(roles.time), (F.col("__share") * F.col("__a.v")).alias(name))


def shrunk_covariance(residuals: np.ndarray) -> np.ndarray:
    """Covariance of residuals (rows, series), its correlations drawn to zero as far as their own variance says (Schaefer and Strimmer, 2005)."""
    n = len(residuals)
    x = residuals - residuals.mean(0)
    cov = x.T @ x / max(1, n - 1)
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    z = x / scale
    corr = z.T @ z / max(1, n - 1)
    spread = ((z**2).T @ (z**2) - (z.T @ z) ** 2 / n) * n / max(1, n - 1) ** 3
    off = ~np.eye(len(corr), dtype=bool)
    part = float(np.clip(spread[off].sum() / max((corr[off] ** 2).sum(), 1e-12), 0, 1))
    return np.where(off, (1 - part) * corr, corr) * np.outer(scale, scale)


def min_trace(forecast: DataFrame, edges: pd.DataFrame | DataFrame, name: str, roles: Roles = ROLES, weights: str = "ols", residuals: DataFrame | None = None, most: int = 4_000_000) -> DataFrame:
    """Coherent forecasts by linear projection, one stamp at a time; weights: ols, wls_struct by the bottom series below each, or mint_shrink from residuals (id, time, r).

    The hierarchy's matrix is held by every task, so this is for hierarchies of thousands of series: more than `most` edges,
    or residuals, are an error before anything is collected."""

    def small(df: DataFrame) -> pd.DataFrame:
        rows = df.limit(most + 1).toPandas()
        if len(rows) > most:
            raise ValueError(f"more than {most} rows; reconcile parts of the hierarchy")
        return rows

    edges = small(edges) if isinstance(edges, DataFrame) else edges
    bottom = {b: i for i, b in enumerate(sorted(edges["bottom_id"].unique()))}
    ids = sorted(edges["agg_id"].unique())
    places = {a: i for i, a in enumerate(ids)}
    s = np.zeros((len(ids), len(bottom)))
    s[[places[a] for a in edges["agg_id"]], [bottom[b] for b in edges["bottom_id"]]] = 1
    if weights == "mint_shrink":
        if residuals is None:
            raise ValueError("mint_shrink needs residuals")
        wide = small(residuals.select(roles.id, roles.time, "r").filter("r is not null")).pivot(index=roles.time, columns=roles.id, values="r").reindex(columns=ids).dropna()
        inverse = np.linalg.pinv(shrunk_covariance(wide.to_numpy(float)), hermitian=True)
    else:
        inverse = np.diag(np.ones(len(ids)) if weights == "ols" else 1 / s.sum(1))
    project = s @ np.linalg.pinv(s.T @ inverse @ s) @ s.T @ inverse
    kinds = dict(forecast.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.set_index(roles.id)[name].reindex(ids).to_numpy(float)
        return pd.DataFrame({roles.id: ids, roles.time: pdf[roles.time].iloc[0], name: project @ own})

    return forecast.select(roles.id, roles.time, name).groupBy(roles.time).applyInPandas(one, f"{roles.id} {kinds[roles.id]}, {roles.time} {kinds[roles.time]}, {name} double")


def temporal(df: DataFrame, size: int, label: str, roles: Roles = ROLES) -> DataFrame:
    """Sums of `size` neighbours, named label-1, label-2, …, at their last stamp; an incomplete last bucket is left out."""
    b = F.floor((F.row_number().over(roles.rising) - 1) / size)
    rows = df.withColumn("b", b).groupBy(roles.id, "b").agg(F.max(roles.time).alias(roles.time), F.sum(roles.target).alias(roles.target), F.count(F.lit(1)).alias("m"))
    return rows.filter(F.col("m") == size).select(roles.id, F.concat(F.lit(f"{label}-"), (F.col("b") + 1).cast("string")).alias("temporal_id"), roles.time, roles.target)


def resample_max(df: DataFrame, unit: str, flags: Sequence[str], time: str = "ds") -> DataFrame:
    return df.groupBy(F.date_trunc(unit, time).cast("timestamp_ntz").alias(time)).agg(*[F.max(c).alias(c) for c in flags])
