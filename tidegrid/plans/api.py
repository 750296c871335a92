"""The product's entry points: forecasting, cross-validation, anomaly detection, auditing, evaluation, model registry, SQL."""

from __future__ import annotations

import time
import uuid
import warnings
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions import calendar
from tidegrid.functions.freq import Freq, freq
from tidegrid.functions.quantiles import levels_of
from tidegrid.operators import anomaly, audit, evaluate, explain, forecast, grid, history, intervals, models, validation
from tidegrid.operators.panel import ROLES, Roles, check_schema, infer_frequency, single_series
from tidegrid.operators.recursive import adida, best_weights, smoothing, theta, tuned

_RECURSIVE: dict[str, Callable[..., DataFrame]] = {
    "ses": lambda d, h, s, r, **k: smoothing(d, h, s, "ses", roles=r, **k), "croston": lambda d, h, s, r, **k: smoothing(d, h, s, "croston", roles=r, **k),
    "tsb": lambda d, h, s, r, **k: smoothing(d, h, s, "tsb", roles=r, **k), "adida": lambda d, h, s, r, **k: adida(d, h, s, roles=r, **k), "theta": lambda d, h, s, r, **k: theta(d, h, s, r, **k),
}
MODELS = {**forecast.STRATEGIES, **_RECURSIVE, **models.MODELS}


def check_parameters(parameters: Mapping | None) -> dict:
    """Model parameters: primitives, flat lists of them, and one nested level of primitives."""
    plain = (str, int, float, bool, type(None))
    if parameters is None:
        return {}
    if not isinstance(parameters, Mapping):
        raise ValueError("model parameters must be a mapping")
    for key, value in parameters.items():
        inner: Iterable = value.values() if isinstance(value, Mapping) else value if isinstance(value, (list, tuple, set)) else [value]
        if not all(isinstance(x, plain) for x in inner):
            raise TypeError(f"model parameter {key!r} nests too deep or holds something that isn't a primitive")
    return dict(parameters)


def _ready(df: DataFrame, step: str | int | None, roles: Roles, validate: bool) -> tuple[DataFrame, Freq]:
    df = check_schema(single_series(df, roles), roles)
    if dict(df.dtypes)[roles.target] in ("double", "float"):
        df = df.withColumn(roles.target, F.when(~F.isnan(roles.target), F.col(roles.target)))  # no number is no value
    own = freq(step if step is not None else infer_frequency(df, roles))
    if validate:
        grid.require_contiguous(df, own, roles)
    return df, own


def exogenous_roles(columns: Sequence[str], future: Sequence[str] | None, hist: Sequence[str] | None, roles: Roles = ROLES) -> tuple[list[str], list[str]]:
    """(future, historical) covariates, in order. What a future frame has must be in the panel; what is named as historical is that."""
    hist = list(hist or ())
    ahead = [c for c in future or () if c not in (roles.id, roles.time) and c not in hist]
    if missing := [c for c in (*ahead, *hist) if c not in columns]:
        raise ValueError(f"covariates {missing} are not in the panel")
    return ahead, hist


@dataclass(frozen=True)
class Covariates:
    """What a model may learn from besides the target.

    known: columns that a future frame has too; hist: columns of the past alone, which enter as their values h rows before;
    categorical: those of both that become a 0/1 column for each category; dates: calendar parts, True for those of the
    frequency; one_hot: parts that become columns of their own."""

    known: Sequence[str] = ()
    hist: Sequence[str] = ()
    categorical: Sequence[str] = ()
    dates: Sequence | bool = ()
    one_hot: Sequence[str] = ()

    def __bool__(self) -> bool:
        return bool(self.known or self.hist or self.dates)

    def ready(self, df: DataFrame, future: DataFrame | None, h: int, step: Freq, roles: Roles) -> tuple[DataFrame, DataFrame | None, list[str]]:
        """Both frames with numeric columns only, and the names of these."""
        names = [*self.known]
        if missing := [c for c in (*self.known, *self.hist) if c not in df.columns]:
            raise ValueError(f"covariates {missing} are not in the panel")
        rows = df.select(roles.id, roles.time, roles.target, *dict.fromkeys((*self.known, *self.hist))).withColumn("__ahead", F.lit(False))
        if future is not None:
            rows = rows.unionByName(future.select(roles.id, roles.time, *self.known).withColumn("__ahead", F.lit(True)), allowMissingColumns=True)
        if self.dates and step.unit != "int":
            parts = calendar.default_parts(step.unit, step.step) if self.dates is True else list(self.dates)
            before = set(rows.columns)
            rows = calendar.date_features(rows, parts, roles.time)
            for c in self.one_hot:
                rows = calendar.one_hot(rows, c).drop(c)
            names += [c for c in rows.columns if c not in before]
        lagged = {c: f"{c}_lag{h}" for c in self.hist}
        rows = rows.withColumns({new: F.lag(c, h).over(roles.rising) for c, new in lagged.items()}).drop(*[c for c in self.hist if c not in self.known])
        names += lagged.values()
        coded = [lagged.get(c, c) for c in self.categorical]
        rows, _, more = models.encode_categories(rows, rows.limit(0), [c for c in coded if c in names])
        names = [*(c for c in names if c not in coded), *more]
        past = rows.filter("not __ahead").drop("__ahead")
        return past, None if future is None else rows.filter("__ahead").drop("__ahead", roles.target), names


def _forecast(df: DataFrame, h: int, step: Freq, model: str, season: int | None, how: Mapping, weights: DataFrame | None, roles: Roles) -> DataFrame:
    if weights is not None:
        return tuned(df, h, step, weights, roles, model)
    if model == "seasonal_naive":
        return forecast.seasonal_naive(df, h, step, roles, season=season or step.season)
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; there are {sorted(MODELS)}")
    return MODELS[model](df, h, step, roles, **how)


def _windows(df: DataFrame, h: int, step: Freq, n: int, apart: int | None, model: str, season: int | None, xs: Sequence[str], how: Mapping, weights: DataFrame | None, roles: Roles) -> DataFrame:
    """(id, time, cutoff, y, model, k) of rolling windows of any model."""
    if xs:
        return validation.regression_cv(df, xs, h, n, apart, roles, model)
    if model == "seasonal_naive" and weights is None:
        return validation.seasonal_cv(df, h, season or step.season, n, apart, roles, model)
    out = validation.train_test_cv(df, lambda d: _forecast(d, h, step, model, season, how, weights, roles), h, n, apart, roles)
    return out.withColumn("k", step.steps(F.col("cutoff"), F.col(roles.time)).cast("int"))


def _past(df: DataFrame, step: Freq, model: str, season: int | None, xs: Sequence[str], weights: DataFrame | None, roles: Roles) -> DataFrame:
    """df with the model's values of the past in the column `model`."""
    if xs:
        return df.join(models.regression(df, df, xs, roles, "__fit").select(roles.id, roles.time, F.col("__fit").alias(model)), [roles.id, roles.time], "left")
    if weights is not None:
        rows = df.join(weights.select(roles.id, "alpha"), roles.id, "left").withColumn("alpha", F.coalesce("alpha", F.lit(0.1)))
        return history.fitted(rows, "ses", 1, roles, model, alpha="alpha").drop("alpha")
    return history.fitted(df, model, season or step.season, roles, model)


def forecast_panel(df: DataFrame, h: int, step: str | int | None = None, model: str = "seasonal_naive", future: DataFrame | None = None, level: Sequence[float] | None = None, quantiles: Sequence[float] | None = None, add_history: bool = False, calibration_windows: int = 3, season: int | None = None, parameters: Mapping | None = None, hist: Sequence[str] | None = None, categorical: Sequence[str] = (), dates: Sequence | bool = (), one_hot: Sequence[str] = (), weights: DataFrame | None = None, validate: bool = True, roles: Roles = ROLES) -> DataFrame:
    """(id, time, model, intervals…): h steps behind each series' end.

    Intervals are conformal: percentiles of the errors that the same model, with the same covariates, makes in rolling windows,
    step by step; series too short for a window have null intervals. With covariates (see Covariates) the model is least
    squares on them; columns of the panel that the future frame lacks and `hist` doesn't name take no part, with a warning.
    `weights` are a fine-tuned model's, from finetune(). add_history puts the model's own values of the past in front."""
    levels = levels_of(level, quantiles)
    alone = roles.id not in df.columns
    df, own = _ready(df, step, roles, validate)
    how = check_parameters(parameters)
    xs: list[str] = []
    if future is not None:
        future = single_series(future, roles)
        ahead, past_only = exogenous_roles(df.columns, future.columns, hist, roles)
        if not (ahead or past_only or dates):
            raise ValueError("the future frame has no covariate")
    else:
        ahead, past_only = [], list(hist or ())
    _warn_unused(df, [*ahead, *past_only], roles)
    plan = Covariates(ahead, past_only, categorical, dates, one_hot)
    if plan:
        future = grid.future_grid(df, h, own, roles).drop("k") if future is None else future
        df, future, xs = plan.ready(df, future, h, own, roles)
        out = models.regression(df, future, xs, roles, model, **how).select(roles.id, roles.time, model)
    else:
        out = _forecast(df, h, own, model, season, how, weights, roles)
    if levels:
        cv = _windows(df, h, own, calibration_windows, None, model, season, xs, how, weights, roles)
        widths = intervals.conformal_widths(cv, levels, model, roles)
        places = grid.future_grid(df, h, own, roles)
        out = intervals.with_conformal(out.join(places, [roles.id, roles.time]), widths, levels, model, roles).drop("k")
        if quantiles is not None:
            out = intervals.to_quantiles(out, quantiles, model, [roles.id, roles.time])
    if add_history:
        past = _past(df, own, model, season, xs, weights, roles).filter(F.col(model).isNotNull()).select(roles.id, roles.time, model)
        out = past.unionByName(out, allowMissingColumns=True)
    return out.drop(roles.id) if alone else out


def _warn_unused(df: DataFrame, used: Sequence[str], roles: Roles) -> None:
    if extra := [c for c in df.columns if c not in (roles.id, roles.time, roles.target, *used)]:
        warnings.warn(f"columns {extra} are in the panel alone and take no part; name them in `hist` to use them", stacklevel=3)


def cross_validation(df: DataFrame, h: int, step: str | int | None = None, n_windows: int = 1, step_size: int | None = None, model: str = "seasonal_naive", season: int | None = None, level: Sequence[float] | None = None, exog: Sequence[str] = (), quantiles: Sequence[float] | None = None, hist: Sequence[str] = (), categorical: Sequence[str] = (), dates: Sequence | bool = (), one_hot: Sequence[str] = (), parameters: Mapping | None = None, calibration_windows: int = 3, weights: DataFrame | None = None, validate: bool = True, roles: Roles = ROLES) -> DataFrame:
    """(id, time, y, model, cutoff, intervals…): forecasts of rolling windows beside the actual values; with covariates (see Covariates) by least squares on them.

    A window's intervals come from the errors of `calibration_windows` windows that end at its cutoff or before it; null where there is none."""
    levels = levels_of(level, quantiles)
    df, own = _ready(df, step, roles, validate)
    how = check_parameters(parameters)
    plan, xs = Covariates(exog, hist, categorical, dates, one_hot), []
    if plan:
        df, _, xs = plan.ready(df, None, h, own, roles)
    lag = -(-h // (step_size or h))
    n = n_windows + (lag + calibration_windows - 1 if levels else 0)
    out = _windows(df, h, own, n, step_size, model, season, xs, how, weights, roles)
    first = [roles.id, roles.time, roles.target, model, "cutoff"]
    if levels:
        out = intervals.with_rolling_conformal(out, levels, model, lag, calibration_windows, roles)
        out = validation.last_windows(out, n_windows, roles)
        if quantiles is not None:
            out = intervals.to_quantiles(out, quantiles, model, [roles.id, roles.time, roles.target, "cutoff"])
    return out.select(*[F.col(f"`{c}`") for c in first], *[F.col(f"`{c}`") for c in out.columns if c not in first and c != "k"])


def finetune(df: DataFrame, step: str | int | None = None, steps: int = 19, validate: bool = True, roles: Roles = ROLES) -> DataFrame:
    """(id, alpha): simple smoothing fitted to each series by trying `steps` weights; give it as `weights` to forecasts, validation and detectors, or keep it in a Registry."""
    return best_weights(_ready(df, step, roles, validate)[0], steps, roles)


def _season_of(df: DataFrame, step: Freq, season: int | None, roles: Roles) -> int:
    """The given season, the frequency's, or, where that has none, the one that the data have."""
    return season or (step.season if step.season > 1 else history.find_season(df, roles))


def detect_anomalies(df: DataFrame, step: str | int | None = None, level: float = 99, season: int | None = None, model: str = "seasonal_naive", exog: Sequence[str] = (), hist: Sequence[str] = (), categorical: Sequence[str] = (), dates: Sequence | bool = (), one_hot: Sequence[str] = (), weights: DataFrame | None = None, h: int = 1, validate: bool = True, roles: Roles = ROLES) -> DataFrame:
    """(id, time, y, model, anomaly, lo, hi): rows outside the interval around the model's values of the past; with covariates (see Covariates; hist ones are h rows old) by least squares on them."""
    df, own = _ready(df, step, roles, validate)
    plan, xs = Covariates(exog, hist, categorical, dates, one_hot), []
    if plan:
        df, _, xs = plan.ready(df, None, h, own, roles)
    if not xs and weights is None and model == "seasonal_naive":
        return anomaly.historical(df, _season_of(df, own, season, roles), level, roles)
    return anomaly.historical(df, 1, level, roles, model, _past(df, own, model, season, xs, weights, roles))


def detect_anomalies_online(df: DataFrame, h: int, detection_size: int, step: str | int | None = None, threshold_method: str = "univariate", level: float = 99, step_size: int | None = None, season: int | None = None, model: str = "seasonal_naive", exog: Sequence[str] = (), hist: Sequence[str] = (), categorical: Sequence[str] = (), dates: Sequence | bool = (), one_hot: Sequence[str] = (), weights: DataFrame | None = None, parameters: Mapping | None = None, refit: bool = True, validate: bool = True, roles: Roles = ROLES) -> DataFrame:
    """The last detection_size rows of each series, scored against the errors that the model made in rolling windows before them; with covariates (see Covariates) by least squares on them.

    Every window is fitted anew. With refit=False simple smoothing keeps the weight that the rows before the detection gave it."""
    if threshold_method not in ("univariate", "multivariate"):
        raise ValueError("threshold_method is univariate or multivariate")
    df, own = _ready(df, step, roles, validate)
    how = check_parameters(parameters)
    plan, xs = Covariates(exog, hist, categorical, dates, one_hot), []
    if plan:
        df, _, xs = plan.ready(df, None, h, own, roles)
    if not refit and model == "ses" and weights is None and not xs:
        weights = best_weights(df.withColumn("__at", F.row_number().over(roles.falling)).filter(F.col("__at") > detection_size).drop("__at"), roles=roles)
    period = _season_of(df, own, season, roles) if model == "seasonal_naive" and not xs and weights is None else 1
    rolling = lambda n, apart: _windows(df, h, own, n, apart, model, period, xs, how, weights, roles)
    way = anomaly.online if threshold_method == "univariate" else anomaly.online_multivariate
    return way(df, h, detection_size, period, level, step=step_size, roles=roles, name=model, windows=rolling)


audit_data, clean_data = audit.audit, audit.clean


def date_features(df: DataFrame, step: str | int, features: Sequence | None = None, one_hot: Sequence[str] = (), roles: Roles = ROLES) -> DataFrame:
    """Calendar columns, by default those that vary at the frequency; give history and future together to one-hot."""
    own = freq(step)
    if own.unit == "int":
        return df
    out = calendar.date_features(df, calendar.default_parts(own.unit, own.step) if features is None else features, roles.time)
    for c in one_hot:
        out = calendar.one_hot(out, c).drop(c)
    return out


def evaluate_forecasts(df: DataFrame, metrics: Sequence[str] = ("mae", "rmse"), models: Sequence[str] | None = None, roles: Roles = ROLES) -> DataFrame:
    """(id, metric, forecaster, value); models: all numeric columns besides the panel's own."""
    kinds = dict(df.dtypes)
    own = list(models or [c for c in df.columns if c not in (roles.id, roles.time, roles.target, "cutoff") and kinds[c] in ("double", "float", "int", "bigint")])
    return evaluate.evaluate_long(df, own, list(metrics), [roles.id], roles)


@dataclass
class Job:
    """A query in the background: its tag, where its rows go, and how it stands. As a context it is cancelled when left unfinished."""

    tag: str
    path: str
    spark: SparkSession
    future: Future = field(repr=False)
    cancelled: bool = False

    @property
    def status(self) -> str:
        """queued, running, succeeded, failed or cancelled."""
        if self.cancelled or self.future.cancelled():
            return "cancelled"
        if not self.future.done():
            return "running" if self.future.running() else "queued"
        return "failed" if self.future.exception() else "succeeded"

    def wait(self, timeout: float | None = None) -> DataFrame:
        """The result, once it is there. TimeoutError after so many seconds; the job goes on."""
        return self.spark.read.parquet(self.future.result(timeout))

    def cancel(self) -> bool:
        """Whether there was anything left to cancel."""
        if self.future.done():
            return False
        self.cancelled = True
        if not self.future.cancel():
            self.spark.interruptTag(self.tag)
        return True

    def __enter__(self) -> Job:
        return self

    def __exit__(self, *_) -> None:
        self.cancel()


@dataclass(frozen=True)
class Jobs:
    """Queries in the background, each under a tag by which it can be cancelled."""

    spark: SparkSession
    pool: ThreadPoolExecutor

    def start(self, query: Callable[[], DataFrame], path: str, retries: int = 0, pause: float = 1.0) -> Job:
        """A job whose rows are written to path; a failure is tried again `retries` times, each after twice the pause."""
        tag = f"job-{uuid.uuid4().hex}"
        jobs: list[Job] = []

        def run() -> str:
            self.spark.addTag(tag)
            try:
                for k in range(retries + 1):
                    try:
                        query().write.mode("overwrite").parquet(path)
                        return path
                    except Exception:
                        if k == retries or (jobs and jobs[0].cancelled):
                            raise
                        time.sleep(pause * 2**k)
            finally:
                self.spark.removeTag(tag)
            return path

        jobs.append(Job(tag, path, self.spark, self.pool.submit(run)))
        return jobs[0]

    def submit(self, query: Callable[[], DataFrame], path: str) -> tuple[str, Future]:
        job = self.start(query, path)
        return job.tag, job.future

    def cancel(self, tag: str) -> None:
        self.spark.interruptTag(tag)


@dataclass(frozen=True)
class Registry:
    """Fitted parameters of series as folders of Parquet under one path, one for each model."""

    spark: SparkSession
    path: str

    def save(self, name: str, parameters: DataFrame, base: str, steps: int = 0) -> None:
        meta = {"id": F.lit(name), "base_model": F.lit(base), "steps": F.lit(steps), "created_at": F.current_timestamp()}
        parameters.withColumns({f"model_{k}": v for k, v in meta.items()}).write.mode("overwrite").parquet(f"{self.path}/model={name}")

    def list(self) -> DataFrame:
        return self.spark.read.parquet(self.path).groupBy("model").agg(F.first("model_base_model").alias("base_model"), F.first("model_steps").alias("steps"), F.max("model_created_at").alias("created_at"))

    def load(self, name: str) -> DataFrame:
        """A model's parameters, ready to be given as `weights`."""
        rows = self.spark.read.parquet(f"{self.path}/model={name}")
        return rows.select(*[c for c in rows.columns if not c.startswith("model_")])

    def delete(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/model={name}")
        return bool(at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True))

    def older_than(self, stamp: Column) -> DataFrame:
        return self.list().filter(F.col("created_at") < stamp)


def register_sql(spark: SparkSession, table: str, h: int, step: str, prefix: str = "tide", exog: Sequence[str] = ()) -> list[str]:
    """Temporary views over a table's panel for use from SQL: forecasts, cross-validation and its errors, anomalies, the audit report and, with covariates, what they contribute; and the table function `{prefix}_series(h, model, TABLE(t) PARTITION BY unique_id)`."""
    df = spark.table(table)
    df = df.toDF(*[c.lower() for c in df.columns])
    plain = df.select("unique_id", "ds", "y")
    cv = cross_validation(plain, h, step, 2, validate=False)
    views = {
        "forecast": forecast_panel(plain, h, step, validate=False), "cv": cv, "evaluate": evaluate_forecasts(cv),
        "anomalies": detect_anomalies(plain, step, validate=False), "audit": audit.report(plain, step),
    }
    if exog:
        rows = check_schema(df, ROLES)
        known, ahead = rows.filter("y is not null"), rows.filter("y is null")
        views["explain"] = explain.contributions_of(known, ahead, list(exog))
    for name, own in views.items():
        own.createOrReplaceTempView(f"{prefix}_{name}")
    spark.udtf.register(f"{prefix}_series", series_function())
    return [f"{prefix}_{name}" for name in views]


def series_function():
    """A table function that forecasts one partition's series: (unique_id, ds, y) rows in any order, h and a model of naive, mean or drift; out come k = 1..h and the value."""
    from pyspark.sql.functions import udtf

    class Series:
        def __init__(self) -> None:
            self.rows, self.h, self.model = [], 0, "naive"

        def eval(self, h: int, model: str, row):
            own = {k.lower(): v for k, v in row.asDict().items()}
            self.rows.append((own["ds"], own["unique_id"], own["y"]))
            self.h, self.model = h, model

        def terminate(self):
            known = sorted((r for r in self.rows if r[2] is not None), key=lambda r: r[0])
            ys = [float(r[2]) for r in known]
            for k in range(1, self.h + 1 if ys else 1):
                slope = (ys[-1] - ys[0]) / (len(ys) - 1) if self.model == "drift" and len(ys) > 1 else 0.0
                yield str(known[0][1]), k, sum(ys) / len(ys) if self.model == "mean" else ys[-1] + slope * k

    return udtf(Series, returnType="unique_id string, k int, value double")
