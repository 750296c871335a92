"""Small panels with known answers."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions.freq import freq
from tidegrid.functions.quantiles import levels_of, z_of
from tidegrid.operators import anomaly, audit, forecast, grid, hierarchy, models, panel, recursive, validation
from tidegrid.plans import api, arena
from tidegrid.sources import tables


def make(spark, series, start="2023-01-01"):
    """{id: [values]} or {id: {day: value or list}} as a daily panel."""
    rows = []
    for i, ys in series.items():
        for d, y in ys.items() if isinstance(ys, dict) else enumerate(ys, 1):
            for v in y if isinstance(y, list) else [y]:
                rows.append((i, str(dt.date.fromisoformat(start) + dt.timedelta(d - 1)), None if v is None else float(v)))
    return panel.check_schema(spark.createDataFrame(rows, "unique_id string, ds string, y double"))


def days(df):
    return sorted((r["unique_id"], r["ds"].day, r["y"]) for r in df.collect())


def test_duplicates_then_gaps(spark):
    df = make(spark, {"a": {1: [1, 2], 2: 3}, "b": {2: 4, 3: 5}})
    found = api.audit_data(df, "D")
    assert not found.all_pass and set(found.fail) == {"D001", "D002"} and found.fail["D002"] is None
    assert found.fail["D001"].count() == 2
    with pytest.raises(ValueError, match="rule"):
        api.clean_data(df, found, "D")
    once, left = api.clean_data(df, found, "D", rules={"y": "sum"})
    assert once.count() == 4 and left.fail["D002"].count() == 1
    whole, left = api.clean_data(once, left, "D")
    assert whole.count() == 5 and left.all_pass
    assert ("a", 3, None) in days(whole)


def test_missing_dates(spark):
    found = api.audit_data(make(spark, {"a": {1: 1, 3: 2}, "b": {1: 3, 3: 4}}), "D")
    assert found.fail["D002"].count() == 2


def test_clip_makes_leading_zeros(spark):
    df = make(spark, {"a": [-1, 0, 1], "b": [2, -3, -4]})
    found = api.audit_data(df, "D")
    assert set(found.case_specific) == {"V001"} and found.case_specific["V001"].count() == 3
    once, left = api.clean_data(df, found, "D", clean_case_specific=True)
    assert left.case_specific["V002"].count() == 1
    _, left = api.clean_data(once, left, "D", clean_case_specific=True)
    assert left.all_pass


def test_leading_zeros(spark):
    df = make(spark, {"a": [0, 1, 2], "b": [0, 1, 2], "c": [0, 0, 0], "d": [None, 0, 1]})
    assert sorted(r[0] for r in audit.leading_zeros(df).collect()) == ["a", "b"]
    assert audit.trim_leading_zeros(df).count() == 10
    assert audit.trim_leading_zeros(df, drop_all_zero=True).filter("unique_id = 'c'").count() == 0


def test_categorical_columns(spark):
    df = make(spark, {"a": [1, 2]}).withColumn("word", F.lit("x"))
    assert audit.categorical_columns(df) == ["word"]
    assert set(api.audit_data(df, "D").fail) == {"F001"}


def test_frequencies(spark):
    row = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-31' AS a, TIMESTAMP_NTZ '2024-05-31' AS b, 10L AS i")
    m = freq("MS")
    assert [x.day for x in row.select(m.grid(F.col("a"), F.col("b"))).first()[0]] == [31, 29, 31, 30, 31]
    assert row.select(freq("15min").steps(F.col("a"), F.col("b"))).first()[0] == 121 * 96
    assert row.select(freq(5).add(F.col("i"), 3)).first()[0] == 25
    assert freq("h").season == 24 and freq("D").season == 7 and freq("6h").season == 4
    with pytest.raises(ValueError):
        freq("fortnight")


def test_contiguity(spark):
    df = make(spark, {"ok": [1, 2, 3], "gap": {1: 1, 3: 2}, "both": {1: [1, 1], 3: 2}})
    got = {r["unique_id"]: r["ok"] for r in grid.contiguity(df, "D").collect()}
    assert got == {"ok": True, "gap": False, "both": False}
    with pytest.raises(ValueError, match="both"):
        grid.require_contiguous(df, "D")


def test_interpolate(spark):
    df = make(spark, {"a": [None, 1, None, None, 4, None], "b": [None, None]})
    assert [y for _, _, y in days(grid.interpolate(df).filter("unique_id = 'a'"))] == [1, 1, 2, 3, 4, 4]
    assert grid.interpolate(df).filter("unique_id = 'b' AND y IS NULL").count() == 2


def test_seasonal_naive_and_short_series(spark):
    df = make(spark, {"a": [1, 2, 3, 4, 5], "short": [9]})
    got = days(forecast.seasonal_naive(df, 5, freq("D"), season=3).withColumnRenamed("seasonal_naive", "y"))
    assert [y for i, _, y in got if i == "a"] == [3, 4, 5, 3, 4]
    assert [y for i, _, y in got if i == "short"] == [None] * 5
    assert [y for i, _, y in days(forecast.seasonal_naive(df, 2, freq("D"), season=3).withColumnRenamed("seasonal_naive", "y")) if i == "a"] == [3, 4]


def test_empty_panel(spark):
    df = make(spark, {"a": [1]}).filter("false")
    for m in api.MODELS:
        assert api.forecast_panel(df, 3, "D", m).count() == 0
    assert audit.report(df, "D").filter("n_rows > 0").count() == 0


def test_rolling_windows(spark):
    df = make(spark, {"a": list(range(1, 11)), "short": [1, 2]})
    got = validation.seasonal_cv(df, 2, 2, 2).orderBy("ds").collect()
    assert [(r["cutoff"].day, r["ds"].day, r["y"], r["seasonal_naive"]) for r in got] == [(6, 7, 7, 5), (6, 8, 8, 6), (8, 9, 9, 7), (8, 10, 10, 8)]
    assert {r["n_train"] for r in validation.cutoffs(df, 2, 2).collect()} == {6, 8}


def test_smoothing(spark):
    df = make(spark, {"a": [0, 4, 0, 0, 8]})
    one = lambda m: recursive.smoothing(df, 1, freq("D"), m, 0.5).first()[m]
    assert one("ses") == pytest.approx(0.5 * 8 + 0.5 * 0.5 * 0.5 * 0.5 * 4)
    assert one("croston") == pytest.approx(6 / 2.5)
    assert recursive.theta(df, 2, freq("D")).count() == 2


def test_anomaly_flags(spark):
    ys = [10.0 + (i % 7) + 0.1 * (i * 7 % 5) for i in range(70)]
    df = make(spark, {"a": [y + 50 * (i == 66) for i, y in enumerate(ys)], "b": ys})
    hit = [(r["unique_id"], r["ds"].timetuple().tm_yday) for r in anomaly.online(df, 7, 7, 7, 99).filter("anomaly").collect()]
    assert hit == [("a", 67)]
    multi = anomaly.online_multivariate(df, 7, 7, 7, 99).filter("anomaly")
    assert {r["unique_id"] for r in multi.filter(F.dayofyear("ds") == 67).collect()} == {"a", "b"}
    assert anomaly.historical(make(spark, {"a": [1, 2, 1, 2, None]}), 2).filter("y is null and anomaly").count() == 0


def test_hierarchy_is_coherent(spark):
    rows = [("all", r, n, i, float(v)) for r, n, v in (("e", "x", 1), ("e", "y", 2), ("w", "z", 4)) for i in range(2)]
    df = spark.createDataFrame(rows, "total string, region string, nation string, ds int, y double")
    spec = [["total"], ["total", "region"], ["total", "region", "nation"]]
    got = {(r["unique_id"], r["ds"]): r["y"] for r in hierarchy.aggregate(df, spec).collect()}
    assert got[("all", 0)] == 7 and got[("all/e", 1)] == 3 and got[("all/w/z", 0)] == 4
    base = hierarchy.aggregate(df, spec).withColumn("f", F.col("y") + F.length("unique_id"))
    fixed = {r["unique_id"]: r["f"] for r in hierarchy.min_trace(base, hierarchy.summing_edges(df, spec).toPandas(), "f").filter("ds = 0").collect()}
    assert fixed["all"] == pytest.approx(fixed["all/e"] + fixed["all/w"]) and fixed["all/e"] == pytest.approx(fixed["all/e/x"] + fixed["all/e/y"])


def test_levels_and_parameters():
    assert levels_of(None, [0.1, 0.30000000000000004, 0.5, 0.9]) == [40.0, 80.0]
    with pytest.raises(ValueError, match="both"):
        levels_of([80], [0.1])
    assert api.check_parameters({"a": 1, "b": [1, 2], "c": {"d": 2}}) == {"a": 1, "b": [1, 2], "c": {"d": 2}}
    with pytest.raises(TypeError):
        api.check_parameters({"a": {"b": {"c": 1}}})
    with pytest.raises(ValueError):
        api.check_parameters([1])


def test_integer_time(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(10)], "unique_id long, ds long, y double")
    assert [r["ds"] for r in api.forecast_panel(df, 3, 1, "naive").orderBy("ds").collect()] == [10, 11, 12]


def test_partitions_do_not_matter(spark):
    df = make(spark, {f"s{i}": [i + j % 7 for j in range(30)] for i in range(4)})
    a, b = (sorted(map(tuple, api.forecast_panel(df.repartition(n), 12, "D", level=[80], validate=False).collect())) for n in (1, 7))
    assert a == b and len(a) == 48


def test_sources(spark, tmp_path):
    (tmp_path / "w.csv").write_text("a,b,2024-01-01,2024-01-02\nx,y,1,2\n")
    assert days(tables.csv_wide(spark, str(tmp_path / "w.csv"), ["a", "b"])) == [("x-y", 1, 1.0), ("x-y", 2, 2.0)]
    df = spark.range(3).withColumn("one", F.lit(5))
    assert tables.write_once(df, str(tmp_path / "o")) and not tables.write_once(df, str(tmp_path / "o"))
    assert tables.single_value(df, "one") == 5
    with pytest.raises(ValueError):
        tables.single_value(df, "id")


def test_fitted_models():
    y = np.array([0, 0, 4, 0, 0, 4, 0, 0, 4.0])
    assert models.fit_croston_optimized(y, 2) == pytest.approx([4 / 3] * 2) and not models.fit_croston_optimized(y * 0, 2).any()
    assert models.fit_imapa(y, 1) == pytest.approx(np.mean([models.best_ses(y), models.best_ses(y[1:].reshape(-1, 2).sum(1)) / 2, 4 / 3]))
    t = np.arange(84)
    assert models.fit_ets(5 + 2.0 * t + 10 * np.sin(2 * np.pi * t / 7), 7, 7) == pytest.approx(5 + 2.0 * (84 + np.arange(7)) + 10 * np.sin(2 * np.pi * (84 + np.arange(7)) / 7), abs=1.5)
    v = [10.0, 12.0]
    for _ in range(60):
        v.append(3 + 1.2 * v[-1] - 0.5 * v[-2])
    assert models.fit_ar(np.array(v[:40]), 5) == pytest.approx(v[40:45], abs=1e-3)
    for fit in (models.fit_ets, models.fit_ar, models.fit_imapa, models.fit_croston_optimized):
        assert np.isfinite(fit(np.array([3.0]), 4)).all() and np.isfinite(fit(np.array([3.0, 3.0, 3.0]), 4)).all()


def test_regression(spark):
    rows = [("a", d, float(3 + 2 * d + (5 if d % 3 == 0 else 0)), float(d), "red" if d % 3 == 0 else "blue") for d in range(20)] + [("b", d, 1.0, 7.0, "blue") for d in range(20)]
    df = spark.createDataFrame(rows, "unique_id string, ds long, y double, x double, c string")
    future = spark.createDataFrame([("a", 20, 20.0, "blue"), ("a", 21, 21.0, "red"), ("b", 20, 9.0, "red")], "unique_id string, ds long, x double, c string")
    got = {(r["unique_id"], r["ds"]): r["lm"] for r in api.forecast_panel(df, 2, 1, "lm", future=future, categorical=["c"]).collect()}
    assert got == pytest.approx({("a", 20): 43.0, ("a", 21): 50.0, ("b", 20): 1.0})
    parts = models.regression(df, future, ["x"]).collect()
    assert all(r["regression"] == pytest.approx(r["x"] + r["base_value"]) for r in parts)
    cv = api.cross_validation(df.drop("c").withColumn("y", 2 * F.col("x")), 3, 1, n_windows=2, exog=["x"]).collect()
    assert len(cv) == 12 and all(r["seasonal_naive"] == pytest.approx(r["y"]) for r in cv)
    with pytest.raises(ValueError, match="no covariate"):
        api.forecast_panel(df, 2, 1, "lm", future=future.select("unique_id", "ds"))


def test_normal_ensemble_and_plot_rows(spark):
    df = spark.createDataFrame([("a", 1, 2.0, 4.0, 3.0, 4.0)], "unique_id string, ds long, m1 double, m2 double, s1 double, s2 double")
    r = models.ensemble_normal(df, {"m1": "s1", "m2": "s2"}, [80]).first()
    assert r["ensemble"] == 3 and r["ensemble-hi-80"] - 3 == pytest.approx(2.5 * z_of(80)) and r["ensemble-lo-80"] < 3
    past = make(spark, {f"s{i}": [1, 2, 3] for i in range(5)})
    ahead = forecast.naive(past, 2, freq("D"))
    out = arena.plot_rows(past, ahead, ["naive"], series=2, tail=2).collect()
    assert len({x["unique_id"] for x in out}) == 2 and sum(x["what"] == "y" for x in out) == 4 and sum(x["what"] == "naive" for x in out) == 4


def test_registry_and_jobs(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    own = api.Registry(spark, str(tmp_path / "r"))
    own.save("m1", spark.range(2), "ses")
    assert own.list().first()["base_model"] == "ses" and own.load("m1").count() == 2
    assert own.delete("m1")
    with ThreadPoolExecutor(1) as pool:
        _, job = api.Jobs(spark, pool).submit(lambda: spark.range(4), str(tmp_path / "j"))
        assert spark.read.parquet(job.result()).count() == 4


def test_stream(spark, sf, tmp_path):
    from tidegrid.streaming.online import detect_batches, running_scores, windowed_panel

    kind = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(sf)
    q = detect_batches(windowed_panel(events), lambda d: d.filter("y is not null"), str(tmp_path / "o"), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "o")).count() > 50
    flat = events.select(F.col("event_type").alias("unique_id"), F.col("ts").cast("timestamp").alias("ds"), F.col("value").alias("y"))
    q = running_scores(flat).writeStream.format("memory").queryName("scores").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(*) from scores").first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_whole_arrays(spark, sf):
    """The registered query keeps every value of every array."""
    from tidegrid.plans.queries import QUERIES

    n = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("sum(size(embedding))").first()[0]
    assert QUERIES["arrays_to_long_whole"](spark, sf).count() == n
