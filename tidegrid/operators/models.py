"""Models that are fitted to each series: smoothing, autoregression, intermittent demand, and regression on covariates.

The first kinds take a series' values as one array and run on Arrow batches of many series; a series is held by one task.
Regression aggregates moments, so that only they are shuffled, and forecasts are expressions over the coefficients.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.freq import Freq
from tidegrid.operators.panel import ROLES, Roles
from tidegrid.operators.recursive import series_arrays

_WEIGHTS = np.linspace(0.05, 0.95, 19)


def per_series(df: DataFrame, h: int, step: Freq, name: str, fit: Callable[[np.ndarray, int], np.ndarray], roles: Roles = ROLES) -> DataFrame:
    """(id, time, name): fit(values, h) of each series behind its last known value; ids may be of any type."""
    rows = series_arrays(df, roles)
    kinds = dict(rows.dtypes)

    def run(batches):
        for b in batches:
            ahead = [np.asarray(fit(np.asarray(ys, float), h), float) for ys in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ahead, pa.list_(pa.float64()))], names=["i", "last", "v"])

    out = rows.mapInArrow(run, f"i {kinds[roles.id]}, last {kinds['last']}, v array<double>")
    out = out.select(F.col("i").alias(roles.id), "last", F.posexplode("v").alias("k", "value"))
    return out.select(roles.id, step.add(F.col("last"), F.col("k") + 1).alias(roles.time), F.col("value").alias(name))


def best_ses(y: np.ndarray) -> float:
    """The last level of simple smoothing by the weight that makes the least squared errors one step ahead."""
    level, loss = np.full(len(_WEIGHTS), y[0]), np.zeros(len(_WEIGHTS))
    for v in y[1:]:
        loss += (v - level) ** 2
        level += _WEIGHTS * (v - level)
    return float(level[loss.argmin()])


def fit_croston_optimized(y: np.ndarray, h: int) -> np.ndarray:
    """Demand over interval, each smoothed by its own best weight; zero without demand."""
    at = np.flatnonzero(y)
    if not len(at):
        return np.zeros(h)
    return np.full(h, best_ses(y[at]) / best_ses(np.diff(at, prepend=-1).astype(float)))


def fit_imapa(y: np.ndarray, h: int) -> np.ndarray:
    """The mean of smoothed sums over buckets of 1, 2, … up to the mean interval between demands, spread evenly."""
    at = np.flatnonzero(y)
    if not len(at):
        return np.zeros(h)
    most = max(1, round(len(y) / len(at)))
    parts = [best_ses(y[len(y) % k :].reshape(-1, k).sum(1)) / k for k in range(1, most + 1)]
    return np.full(h, float(np.mean(parts)))


def _corrected(sse: float, n: int, k: int) -> float:
    """Akaike's criterion for small samples."""
    return n * np.log(max(sse / n, 1e-12)) + 2 * k + 2 * k * (k + 1) / (n - k - 1)


def _smooth(y: np.ndarray, season: int, trend: bool, seasonal: bool) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Least squared error over a grid of weights of additive smoothing in error correction form; and its level, slope and season at the end."""
    s = season if seasonal else 1
    grids = np.meshgrid(np.linspace(0.1, 0.9, 9), [0.01, 0.05, 0.15] if trend else [0.0], [0.05, 0.15, 0.3] if seasonal else [0.0])
    a, b, g = (x.ravel() for x in grids)
    start = y[:s].mean()
    slope = (y[s : 2 * s].mean() - start) / s if trend and len(y) >= 2 * s else 0.0
    level, slope = np.full(len(a), start - (slope if not seasonal else slope * (s + 1) / 2)), np.full(len(a), slope)
    cycle = np.tile(y[:s] - start if seasonal else 0.0, (len(a), 1))
    loss = np.zeros(len(a))
    for t, v in enumerate(y):
        e = v - (level + slope + cycle[:, t % s])
        loss += e * e
        level = level + slope + a * e
        slope = slope + b * e
        cycle[:, t % s] += g * e
    i = int(loss.argmin())
    return float(loss[i]), level[i], slope[i], cycle[i]


def fit_ets(y: np.ndarray, h: int, season: int = 1) -> np.ndarray:
    """Additive exponential smoothing with or without trend and season, chosen by the corrected criterion of Akaike."""
    n, best = len(y), None
    for trend in (False, True):
        for seasonal in (False, True)[: 1 + (season > 1 and n >= 2 * season)]:
            k = 3 + 2 * trend + seasonal * season
            if n <= k + 1:
                continue
            loss, *state = _smooth(y, season, trend, seasonal)
            score = _corrected(loss, n, k)
            if best is None or score < best[0]:
                best = score, *state
    if best is None:
        return np.full(h, best_ses(y))
    _, level, slope, cycle = best
    k = np.arange(1, h + 1)
    return level + slope * k + cycle[(n + k - 1) % len(cycle)]


def fit_ar(y: np.ndarray, h: int, most: int = 8) -> np.ndarray:
    """Autoregression of the values, or of their differences where those vary less, by least squares; its order by the corrected criterion of Akaike."""
    moved = len(y) > 3 and np.diff(y).std() < y.std()
    v = np.diff(y) if moved else y
    top = min(most, max(0, len(v) // 4 - 1))
    goal, best = v[top:], None
    for p in range(top + 1):
        if len(goal) <= p + 3:
            continue
        x = np.stack([np.ones(len(goal)), *(v[top - j : len(v) - j] for j in range(1, p + 1))], axis=1)
        w = np.linalg.lstsq(x, goal, rcond=None)[0]
        score = _corrected(float(((goal - x @ w) ** 2).sum()), len(goal), p + 2)
        if best is None or score < best[0]:
            best = score, w
    w = best[1] if best else np.array([v.mean()])
    past = list(v[::-1][: len(w) - 1])
    out = []
    for _ in range(h):
        out.append(float(w[0] + np.dot(w[1:], past)))
        past = [out[-1], *past][: len(w) - 1]
    return y[-1] + np.cumsum(out) if moved else np.array(out)


def croston_optimized(df: DataFrame, h: int, step: Freq, roles: Roles = ROLES, name: str = "croston_optimized") -> DataFrame:
    return per_series(df, h, step, name, fit_croston_optimized, roles)


def imapa(df: DataFrame, h: int, step: Freq, roles: Roles = ROLES, name: str = "imapa") -> DataFrame:
    return per_series(df, h, step, name, fit_imapa, roles)


def auto_ets(df: DataFrame, h: int, step: Freq, roles: Roles = ROLES, name: str = "auto_ets", season: int | None = None) -> DataFrame:
    s = season or step.season
    return per_series(df, h, step, name, lambda y, k: fit_ets(y, k, s), roles)


def auto_ar(df: DataFrame, h: int, step: Freq, roles: Roles = ROLES, name: str = "auto_ar", most: int = 8) -> DataFrame:
    return per_series(df, h, step, name, lambda y, k: fit_ar(y, k, most), roles)


def regression(df: DataFrame, future: DataFrame, xs: Sequence[str], roles: Roles = ROLES, name: str = "regression", ridge: float = 0.0) -> DataFrame:
    """(id, time, name, a column for each covariate's contribution, base_value): least squares of each series on covariates that are known ahead.

    Contributions and base_value sum to the forecast. Rows with a null target or covariate aren't learned from;
    covariates without spread, or that others determine, contribute what the solution of least norm gives them.
    ridge is a penalty on the covariates' standardised weights."""
    p = len(xs)
    known = df.select(roles.id, F.col(roles.target).cast("double").alias("__y"), *[F.col(f"`{x}`").cast("double").alias(f"__{i}") for i, x in enumerate(xs)]).dropna()
    pairs = {(i, j): F.covar_pop(f"__{i}", f"__{j}") for i in range(p) for j in range(i, p)}
    sums = known.groupBy(roles.id).agg(
        F.avg("__y").alias("ym"), F.array(*[F.avg(f"__{i}") for i in range(p)]).alias("xm"),
        F.array(*[pairs[min(i, j), max(i, j)] for i in range(p) for j in range(p)]).alias("xx"), F.array(*[F.covar_pop(f"__{i}", "__y") for i in range(p)]).alias("xy"),
    )
    kind = dict(sums.dtypes)[roles.id]

    def solve(batches):
        for t in batches:
            read = lambda c, *shape: np.array(t.column(c).to_pylist(), float).reshape(t.num_rows, *shape)
            xx, xy = read("xx", p, p), read("xy", p)
            scale = np.sqrt(np.einsum("nii->ni", xx))
            scale[scale == 0] = 1
            unit = xx / (scale[:, :, None] * scale[:, None, :]) + ridge * np.eye(p)
            b = np.einsum("nij,nj->ni", np.linalg.pinv(unit, rcond=1e-10, hermitian=True), xy / scale) / scale
            yield pa.RecordBatch.from_arrays([t.column(0), t.column("ym"), t.column("xm"), pa.array(list(b), pa.list_(pa.float64()))], names=["i", "ym", "xm", "b"])

    fitted = sums.mapInArrow(solve, f"i {kind}, ym double, xm array<double>, b array<double>")
    parts = [F.get("b", F.lit(i)) * (F.col(f"`{x}`") - F.get("xm", F.lit(i))) for i, x in enumerate(xs)]
    rows = future.join(fitted.withColumnRenamed("i", roles.id), roles.id)
    return rows.select(roles.id, roles.time, sum(parts, F.col("ym")).alias(name), *[v.alias(x) for x, v in zip(xs, parts, strict=True)], F.col("ym").alias("base_value"))


def encode_categories(df: DataFrame, future: DataFrame, columns: Sequence[str], most: int = 200) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both frames with a 0/1 column for each category of either, and those columns' names; more than `most` categories of a column are an error."""
    names: list[str] = []
    for c in columns:
        both = df.select(F.col(c).cast("string").alias("v")).unionByName(future.select(F.col(c).cast("string").alias("v")))
        values = sorted(r[0] for r in both.filter("v is not null").distinct().limit(most + 1).collect())
        if len(values) > most:
            raise ValueError(f"{c} has more than {most} categories")
        own = {f"{c}_{v}": F.coalesce(F.col(c).cast("string") == v, F.lit(False)).cast("double") for v in values}
        df, future = df.withColumns(own).drop(c), future.withColumns(own).drop(c)
        names += own
    return df, future, names


def ensemble_normal(df: DataFrame, sigmas: dict[str, str], level: Sequence[float] = (), name: str = "ensemble") -> DataFrame:
    """The mean of models with normal intervals, from the models' columns and those of their deviations: errors of different models count as independent."""
    from tidegrid.functions.quantiles import bound, z_of

    k = len(sigmas)
    mean = sum((F.col(f"`{m}`") for m in sigmas), F.lit(0.0)) / k
    sigma = F.sqrt(sum((F.col(f"`{s}`") ** 2 for s in sigmas.values()), F.lit(0.0))) / k
    sides = {bound(name, "lo", x): mean - z_of(x) * sigma for x in sorted(level, reverse=True)} | {bound(name, "hi", x): mean + z_of(x) * sigma for x in sorted(level)}
    return df.withColumns({name: mean} | sides)


MODELS = {"croston_optimized": croston_optimized, "imapa": imapa, "auto_ets": auto_ets, "auto_ar": auto_ar}
