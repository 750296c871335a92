"""The entry points: intervals and history of the model asked for, covariates, detectors, fine-tuning, frames in memory, jobs, SQL."""

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.functions.freq import freq
from tidegrid.operators import evaluate, hierarchy, history, panel, validation
from tidegrid.plans import api
from tidegrid.plans.local import Local
from test_panel import make


def wave(n=70, season=7):
    return [10 + (i % season) * 10.0 for i in range(n)]


# ---- intervals and history ---------------------------------------------------------------------------------------


def test_intervals_are_the_models_own(spark):
    """Around a mean, a weekly wave is wide; the seasonal model, which knows it, has no width."""
    df = make(spark, {"a": wave()})
    got = api.forecast_panel(df, 7, "D", "hist_avg", level=[80]).collect()
    assert len(got) == 7 and sum(r["hist_avg-hi-80"] - r["hist_avg-lo-80"] > 5 for r in got) >= 5
    flat = api.forecast_panel(df, 7, "D", level=[80]).collect()
    assert all(r["seasonal_naive-hi-80"] == r["seasonal_naive-lo-80"] == r["seasonal_naive"] for r in flat)


def test_cv_intervals_use_earlier_windows_only(spark):
    """The last window's surprise doesn't widen its own interval."""
    ys = wave(70)
    ys[-7:] = [y + 1000 for y in ys[-7:]]
    got = api.cross_validation(make(spark, {"a": ys, "short": [1] * 16}), 7, "D", 2, level=[90]).collect()
    last = [r for r in got if r["unique_id"] == "a" and r["y"] > 1000]
    assert len(last) == 7 and all(r["seasonal_naive-hi-90"] == r["seasonal_naive"] for r in last)
    assert any(r["seasonal_naive-lo-90"] is None for r in got if r["unique_id"] == "short")
    overlapping = api.cross_validation(make(spark, {"a": ys}), 7, "D", 3, step_size=2, level=[90]).collect()
    assert len(overlapping) == 21 and all(r["seasonal_naive-hi-90"] == r["seasonal_naive"] for r in overlapping)
    assert [c for c in api.cross_validation(make(spark, {"a": ys}), 7, "D", quantiles=[0.1, 0.9]).columns if "-q-" in c] == ["seasonal_naive-q-10", "seasonal_naive-q-90"]


def test_history_of_models(spark):
    df = make(spark, {"a": [1, 3, 2, 6]})
    past = lambda m, **k: [r["f"] for r in history.fitted(df, m, name="f", **k).orderBy("ds").collect()]
    assert past("naive") == [None, 1, 3, 2] and past("hist_avg") == [None, 1, 2, 2] and past("seasonal_naive", season=2) == [None, None, 1, 3]
    assert past("drift")[2:] == [5, 2.5] and past("zero") == [0] * 4 and past("window_avg") == [None, 1, 2, 2]
    assert past("ses", alpha=0.5) == [None, 1, 2, 2] and past("linear_trend")[2:] == pytest.approx([5, 3])
    with pytest.raises(ValueError, match="past"):
        history.fitted(df, "theta")
    out = api.forecast_panel(df, 1, "D", "hist_avg", add_history=True).orderBy("ds").collect()
    assert [r["hist_avg"] for r in out] == [1, 2, 2, 3]


def test_season_from_data(spark):
    assert history.find_season(make(spark, {"a": wave(90, 9), "b": wave(60, 9)})) == 9
    assert history.find_season(make(spark, {"a": [float(i) for i in range(40)]})) == 1
    assert history.find_season(make(spark, {"a": [1.0]})) == 1


# ---- detectors ---------------------------------------------------------------------------------------------------


def sines(spark, holes=()):
    """Two weekly series of one slow wave, each with one jump among its last five rows."""
    rows = []
    for i in (1, 2):
        for k in range(100):
            y = 30.0 if (i, k) in ((1, 95), (2, 99)) else 10 * np.sin(0.1 * k) + 12
            rows.append((i, dt.datetime(2023, 1, 1) + dt.timedelta(weeks=k), float("nan") if k in holes else float(y)))
    return spark.createDataFrame(rows, "unique_id long, ds timestamp_ntz, y double")


def flags(out):
    return [r["anomaly"] for r in out.orderBy("unique_id", "ds").collect()]


def test_online_at_defaults(spark):
    df = sines(spark)
    one = api.detect_anomalies_online(df, h=20, detection_size=5, step="W-SUN", level=99)
    assert len(one.columns) == 8 and [i for i, x in enumerate(flags(one)) if x] == [0, 9]
    many = api.detect_anomalies_online(df, h=20, detection_size=5, step="W-SUN", level=99, threshold_method="multivariate")
    assert len(many.columns) == 7 and [i for i, x in enumerate(flags(many)) if x] == [0, 4, 5, 9]


@pytest.mark.parametrize("method", ["univariate", "multivariate"])
def test_online_with_missing_values(spark, method):
    got = flags(api.detect_anomalies_online(sines(spark, (97,)), h=20, detection_size=5, step="W-SUN", threshold_method=method))
    assert len(got) == 10 and not got[2] and not got[7] and got[0] and got[9]


def test_detectors_with_models_and_covariates(spark):
    rows = [("a", d, 5.0 + 3 * (d % 4) + (40 if d == 57 else 0) + 0.01 * (d * 7 % 5), float(d % 4), "hot" if d % 4 > 1 else "cold") for d in range(60)]
    df = spark.createDataFrame(rows, "unique_id string, ds long, y double, x double, c string")
    hit = lambda out: [r["ds"] for r in out.filter("anomaly").collect()]
    assert hit(api.detect_anomalies(df, 1, model="lm", exog=["x"])) == [57]
    assert hit(api.detect_anomalies(df, 1, model="lm", exog=["c"], categorical=["c"])) == [57]
    assert hit(api.detect_anomalies(df, 1, model="hist_avg")) == [57]
    for how in (dict(model="lm", exog=["x"]), dict(model="lm", hist=["x"]), dict(model="window_avg"), dict(model="ses"), dict(model="ses", refit=False), dict(model="lm", exog=["x", "c"], categorical=["c"])):
        assert hit(api.detect_anomalies_online(df, 4, 4, 1, **how)) == [57], how


# ---- covariates --------------------------------------------------------------------------------------------------


def test_covariates_of_the_past(spark):
    rows = [("a", d, float(d % 5 == 2), float(d % 5 == 0), "up" if d % 5 == 0 else "down") for d in range(40)]
    df = spark.createDataFrame(rows, "unique_id string, ds long, y double, x double, c string")
    for hist, cat in ((["x"], []), (["c"], ["c"])):
        got = api.forecast_panel(df, 2, 1, "lm", hist=hist, categorical=cat).orderBy("ds").collect()
        assert [r["lm"] for r in got] == pytest.approx([0, 0], abs=1e-9)
        cv = api.cross_validation(df, 2, 1, 4, model="lm", hist=hist, categorical=cat).collect()
        assert len(cv) == 8 and all(r["lm"] == pytest.approx(r["y"], abs=1e-6) for r in cv)
    future = spark.createDataFrame([("a", 40, 1.0), ("a", 41, 0.0)], "unique_id string, ds long, x double")
    assert api.forecast_panel(df, 2, 1, "lm", future=future, hist=["c"], categorical=["c"], level=[80]).count() == 2
    with pytest.warns(UserWarning, match="'c', 'x'|'x', 'c'"):
        api.forecast_panel(df, 2, 1, "naive")
    with pytest.raises(ValueError, match="not in the panel"):
        api.forecast_panel(df, 2, 1, "lm", hist=["z"])


def test_date_features_as_arguments(spark):
    df = make(spark, {"a": wave(28)})
    got = [r["lm"] for r in api.forecast_panel(df, 7, "D", "lm", dates=True, one_hot=["weekday"]).orderBy("ds").collect()]
    assert got == pytest.approx(wave(7), abs=1e-6)
    assert len(api.cross_validation(df, 7, "D", model="lm", dates=["weekday"], one_hot=["weekday"]).collect()) == 7


# ---- fine-tuning, frames, jobs, SQL ------------------------------------------------------------------------------


def test_finetune_then_everything(spark, tmp_path):
    df = make(spark, {"a": [5.0 + (-1) ** i for i in range(40)], "b": [float(i) for i in range(40)]})
    own = api.Registry(spark, str(tmp_path))
    own.save("m", api.finetune(df, "D"), "ses", 19)
    weights = own.load("m")
    by = {r["unique_id"]: r["alpha"] for r in weights.collect()}
    assert by["a"] < 0.2 and by["b"] == pytest.approx(0.95)
    more = df.unionByName(make(spark, {"new": [1, 2, 3, 4, 5, 6]}))
    got = {r["unique_id"]: r["ses"] for r in api.forecast_panel(more, 1, "D", "ses", weights=weights).collect()}
    assert got["b"] > 38.9 and abs(got["a"] - 5) < 0.2 and len(got) == 3
    assert api.cross_validation(df, 2, "D", 3, model="ses", weights=weights, level=[80]).count() == 12
    assert api.forecast_panel(df, 2, "D", "ses", weights=weights, level=[80], add_history=True).count() == 2 * 39 + 4
    assert api.detect_anomalies(df, "D", model="ses", weights=weights).count() == 2 * 39
    assert api.detect_anomalies_online(df, 2, 2, "D", model="ses", weights=weights).count() == 4


def test_frames_in_memory(spark):
    pdf = pd.DataFrame({"unique_id": ["b"] * 20 + ["a"] * 20, "ds": list(pd.date_range("2024-01-01", periods=20)) * 2, "y": np.arange(40.0)})
    pdf["kind"] = pd.Categorical(["u", "v"] * 20)
    local = Local(spark)
    out = local.forecast(pdf.drop(columns="kind"), 3, "D", level=[80])
    assert isinstance(out, pd.DataFrame) and out["unique_id"].tolist() == ["a"] * 3 + ["b"] * 3 and out["ds"].is_monotonic_increasing is False
    cv = local.cross_validation(pdf, 3, "D", 2, model="lm", exog=["kind"], categorical=["kind"])
    assert len(cv) == 12 and len(local.evaluate(cv)) == 4
    import pyarrow as pa

    assert local.forecast(pa.Table.from_pandas(pdf.drop(columns="kind")), 3, "D").num_rows == 6
    assert len(local.detect_anomalies(pdf.drop(columns="kind"), "D")) == 26
    assert local.finetune(pdf.drop(columns="kind"), "D")["alpha"].between(0, 1).all()


def test_jobs(spark, tmp_path):
    with ThreadPoolExecutor(1) as pool:
        jobs = api.Jobs(spark, pool)
        job = jobs.start(lambda: spark.range(3), str(tmp_path / "a"))
        assert job.wait(60).count() == 3 and job.status == "succeeded" and not job.cancel()
        tries = []

        def flaky():
            tries.append(1)
            if len(tries) < 3:
                raise RuntimeError("not yet")
            return spark.range(2)

        assert jobs.start(flaky, str(tmp_path / "b"), retries=2, pause=0.01).wait(60).count() == 2
        bad = jobs.start(lambda: spark.range(1).select(F.raise_error(F.lit("no"))), str(tmp_path / "c"))
        with pytest.raises(Exception, match="no"):
            bad.wait(60)
        assert bad.status == "failed"
        slow = lambda: spark.range(4).select(F.expr("reflect('java.lang.Thread', 'sleep', 20000L)").alias("x"))
        with jobs.start(slow, str(tmp_path / "d")) as job:
            with pytest.raises(TimeoutError):
                job.wait(1)
            queued = jobs.start(lambda: spark.range(1), str(tmp_path / "e"))
            assert queued.status == "queued" and queued.cancel() and queued.status == "cancelled"
        assert job.status == "cancelled"


def test_sql_views_and_function(spark):
    rows = [("a", f"2024-01-{d:02d}", None if d > 28 else float(d), float(d)) for d in range(1, 31)] + [("b", f"2024-01-{d:02d}", 2.0 * d, 1.0) for d in range(1, 29)]
    spark.createDataFrame(rows, "UNIQUE_ID string, DS string, Y double, X double").createOrReplaceTempView("sales")
    spark.table("sales").filter("Y is not null").createOrReplaceTempView("known")
    assert set(api.register_sql(spark, "known", 7, "D")) == {f"tide_{x}" for x in ("forecast", "cv", "evaluate", "anomalies", "audit")}
    assert spark.sql("SELECT count(*) FROM tide_evaluate").first()[0] == 4
    out = spark.sql("SELECT * FROM tide_series(2, 'drift', TABLE(known) PARTITION BY unique_id)").collect()
    assert sorted((r["unique_id"], r["k"], r["value"]) for r in out) == [("a", 1, 29.0), ("a", 2, 30.0), ("b", 1, 58.0), ("b", 2, 60.0)]
    assert "demo_explain" in api.register_sql(spark, "sales", 2, "D", "demo", exog=["x"])
    parts = spark.sql("SELECT feature, contribution FROM demo_explain WHERE day(ds) = 30").collect()
    assert sum(r["contribution"] for r in parts) == pytest.approx(30)


# ---- smaller operators -------------------------------------------------------------------------------------------


def test_checks_of_panels(spark):
    df = make(spark, {"a": [1, 2, 3], "b": [1, None, 3, 4]})
    assert [(r["unique_id"], r["n"], r["needed"], r["reason"]) for r in panel.short_series(df, "days", need=4).collect()] == [("a", 3, 4, "3 rows, 4 needed")]
    assert panel.short_series(df, "days", 7).first()["needed"] == 64 and panel.short_series(df, "months").first()["needed"] == 48
    assert panel.require_complete(df, ["ds"]) is df
    with pytest.raises(ValueError, match="'y': 1"):
        panel.require_complete(df, ["ds", "y"])
    assert panel.same_ids(df, df.filter("y > 2")) and not panel.same_ids(df, df.filter("y > 3"))


def test_mase_by_cutoff(spark):
    df = make(spark, {"a": [1, 2, 4, 8, 16, 32]})
    cv = validation.seasonal_cv(df, 1, 1, 2)
    got = {r["cutoff"].day: r["mase"] for r in evaluate.mase(cv, df, "seasonal_naive", 1).collect()}
    assert got == pytest.approx({4: 8 / (7 / 3), 5: 16 / (15 / 4)})


def test_shrunk_reconciliation(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    r = np.stack([x.sum(1), x[:, 0], x[:, 1]], axis=1) + 0.1 * rng.normal(size=(400, 3))
    cov = hierarchy.shrunk_covariance(r)
    assert np.diag(cov) == pytest.approx(np.diag(np.cov(r.T))) and abs(cov[0, 1]) <= abs(np.cov(r.T)[0, 1])
    edges = pd.DataFrame([("all", "u"), ("all", "v"), ("u", "u"), ("v", "v")], columns=["agg_id", "bottom_id"])
    errors = spark.createDataFrame([(i, t, float(r[t, k])) for t in range(400) for k, i in enumerate(("all", "u", "v"))], "unique_id string, ds long, r double")
    base = spark.createDataFrame([("all", 0, 10.0), ("u", 0, 3.0), ("v", 0, 4.0)], "unique_id string, ds long, f double")
    out = {x["unique_id"]: x["f"] for x in hierarchy.min_trace(base, edges, "f", weights="mint_shrink", residuals=errors).collect()}
    assert out["all"] == pytest.approx(out["u"] + out["v"]) and 7 < out["all"] < 10
    with pytest.raises(ValueError, match="residuals"):
        hierarchy.min_trace(base, edges, "f", weights="mint_shrink")
    with pytest.raises(Exception, match="more than 3"):
        hierarchy.min_trace(base, spark.createDataFrame(edges), "f", most=3)


def test_top_down(spark):
    past = make(spark, {"a": [1, 2], "b": [3, 6]})
    total = make(spark, {"t": [12, 24, 36]}).withColumnRenamed("y", "f")
    out = sorted((r["unique_id"], r["f"]) for r in hierarchy.top_down(past, total, "f").collect())
    assert out == [("a", 3), ("a", 6), ("a", 9), ("b", 9), ("b", 18), ("b", 27)]
    with pytest.raises(Exception, match="more than 2"):
        hierarchy.top_down(past, total, "f", most=2).collect()


def test_frequency_of_data():
    assert freq("W-SUN").season == 1
