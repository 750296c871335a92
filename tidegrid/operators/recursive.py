"""Smoothing models: a recursion along each series' sorted values, as a fold inside one expression."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.freq import Freq
from tidegrid.operators.panel import ROLES, Roles


def series_arrays(df: DataFrame, roles: Roles = ROLES) -> DataFrame:
    """(id, last, ys): a series' values that aren't null, in order."""
    pairs = F.array_sort(F.collect_list(F.struct(roles.time, F.col(roles.target).cast("double").alias("y"))))
    rows = df.filter(F.col(roles.target).isNotNull()).groupBy(roles.id).agg(F.max(roles.time).alias("last"), pairs.alias("p"))
    return rows.select(roles.id, "last", F.col("p.y").alias("ys"))


def ses_level(ys: Column, alpha: float | Column) -> Column:
    """l <- alpha y + (1 - alpha) l from the first value on."""
    return F.aggregate(F.slice(ys, 2, F.greatest(F.size(ys) - 1, F.lit(0))), F.get(ys, F.lit(0)), lambda level, y: alpha * y + (1 - alpha) * level)


def _fold(kind: str, alpha: float) -> str:
    """SQL of a fold over ys. State: z demand, x interval or probability, gap since the last demand."""
    start = "named_struct('z', cast(null as double), 'x', cast(null as double), 'gap', 0)"
    if kind == "croston":
        hit = f"named_struct('z', coalesce({alpha}D * y + {1 - alpha}D * s.z, y), 'x', coalesce({alpha}D * (s.gap + 1) + {1 - alpha}D * s.x, cast(s.gap + 1 as double)), 'gap', 0)"
        miss = "named_struct('z', s.z, 'x', s.x, 'gap', s.gap + 1)"
        end = "s.z / s.x"
    else:
        hit = f"named_struct('z', coalesce({alpha}D * y + {1 - alpha}D * s.z, y), 'x', coalesce({alpha}D + {1 - alpha}D * s.x, 1D), 'gap', 0)"
        miss = f"named_struct('z', s.z, 'x', coalesce({1 - alpha}D * s.x, 0D), 'gap', 0)"
        end = "s.z * s.x"
    return f"coalesce(aggregate(ys, {start}, (s, y) -> case when y <> 0 then {hit} else {miss} end, s -> {end}), 0D)"


def smoothing(df: DataFrame, h: int, step: Freq, model: str = "ses", alpha: float = 0.1, roles: Roles = ROLES, name: str | None = None) -> DataFrame:
    """Flat forecasts of ses, croston (demand over interval) or tsb (demand times its probability)."""
    rows = series_arrays(df, roles)
    value = ses_level(F.col("ys"), alpha) if model == "ses" else F.expr(_fold(model, alpha))
    rows = rows.select(roles.id, "last", value.alias("v")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(h))))
    return rows.select(roles.id, step.add(F.col("last"), F.col("k")).alias(roles.time), F.col("v").alias(name or model))


def best_weights(df: DataFrame, steps: int = 19, roles: Roles = ROLES) -> DataFrame:
    """(id, alpha): of `steps` weights from 0.05 to 0.95 the one whose simple smoothing has the least squared errors one step ahead."""
    grid = np.linspace(0.05, 0.95, max(1, steps))
    rows = series_arrays(df, roles)

    def run(batches):
        for b in batches:
            out = []
            for ys in b.column("ys").to_pylist():
                y, level, loss = np.asarray(ys, float), np.full(len(grid), ys[0]), np.zeros(len(grid))
                for v in y[1:]:
                    loss += (v - level) ** 2
                    level += grid * (v - level)
                out.append(float(grid[loss.argmin()]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=["i", "alpha"])

    found = rows.select(roles.id, "ys").mapInArrow(run, f"i {dict(rows.dtypes)[roles.id]}, alpha double")
    return found.withColumnRenamed("i", roles.id)


def tuned(df: DataFrame, h: int, step: Freq, weights: DataFrame, roles: Roles = ROLES, name: str = "ses", usual: float = 0.1) -> DataFrame:
    """Simple smoothing with each series' own weight (id, alpha); `usual` for series without one. Ids may be structs of a series and a cutoff, as in validation."""
    rows = series_arrays(df, roles)
    nested = dict(rows.dtypes)[roles.id].startswith("struct<")
    own = weights.select(F.col(roles.id).alias("__i"), F.col("alpha").alias("__a"))
    rows = rows.join(own, (F.col(f"{roles.id}.id") if nested else F.col(roles.id)) == F.col("__i"), "left")
    value = ses_level(F.col("ys"), F.coalesce("__a", F.lit(usual)))
    rows = rows.select(roles.id, "last", value.alias("v")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(h))))
    return rows.select(roles.id, step.add(F.col("last"), F.col("k")).alias(roles.time), F.col("v").alias(name))


def adida(df: DataFrame, h: int, step: Freq, alpha: float = 0.1, roles: Roles = ROLES, name: str = "adida") -> DataFrame:
    """Smoothing of sums over buckets as long as the mean interval between demands, spread evenly."""
    rows = series_arrays(df, roles)
    hits = F.size(F.filter("ys", lambda y: y != 0))
    rows = rows.withColumn("size", F.greatest(F.lit(1), F.round(F.size("ys") / F.nullif(hits, F.lit(0))).cast("int"))).withColumn("size", F.coalesce("size", F.lit(1)))
    skip = F.size("ys") % F.col("size")
    buckets = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size("ys") / F.col("size")).cast("int") - 1, F.lit(0))), lambda b: F.aggregate(F.slice("ys", skip + b * F.col("size") + 1, F.col("size")), F.lit(0.0), lambda s, y: s + y))
    rows = rows.select(roles.id, "last", (ses_level(buckets, alpha) / F.col("size")).alias("v")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(h))))
    return rows.select(roles.id, step.add(F.col("last"), F.col("k")).alias(roles.time), F.col("v").alias(name))


def theta(df: DataFrame, h: int, step: Freq, roles: Roles = ROLES, name: str = "theta", grid: int = 19) -> DataFrame:
    """The classical theta method: half the drift of the trend line on top of smoothing, whose weight is the best of a grid. A series is held by one task."""
    rows = series_arrays(df, roles)
    kinds = dict(rows.dtypes)

    def one(batches):
        for pdf in batches:
            out = []
            for i, last, ys in zip(pdf[roles.id], pdf["last"], pdf["ys"], strict=True):
                y = np.asarray(ys, float)
                t = np.arange(len(y))
                slope = float(((t - t.mean()) * (y - y.mean())).sum() / max(((t - t.mean()) ** 2).sum(), 1e-12))
                alphas = np.linspace(0.05, 0.95, grid)
                level, loss = np.full(grid, y[0]), np.zeros(grid)
                for v in y[1:]:
                    loss += (v - level) ** 2
                    level = alphas * v + (1 - alphas) * level
                b = int(loss.argmin())
                a = alphas[b]
                base = level[b] + 0.5 * slope * ((1 - (1 - a) ** len(y)) / a - 1)
                out += [(i, last, k, base + 0.5 * slope * k) for k in range(1, h + 1)]
            yield pd.DataFrame(out, columns=[roles.id, "last", "k", name])

    spread = rows.mapInPandas(one, f"{roles.id} {kinds[roles.id]}, last {kinds['last']}, k int, {name} double")
    return spread.select(roles.id, step.add(F.col("last"), F.col("k")).alias(roles.time), name)
