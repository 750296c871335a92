"""best_model_argmin where models have equal errors, or none."""

import datetime as dt

import duckdb
import pytest

from tidegrid.plans.queries import ORACLE_SQL, QUERIES

# users 406 and 811 at scale 0.1 by day of January: the errors of naive and hist_avg are equal but for the order of addition
TIED = {
    406: "93.86 276.98 3.41 15.85 107.95 208.08 71.21 - 74.65 - 344.68 160.33 85.07 - 121.44 63.82 89.82 274.96 38.45 130.62 0.33 120.02 147.91 65.87 147.95 320.32 - 7.84 104.56 135.93",
    811: "26.01 72.94 145.51 113.46 254.94 66.81 60.78 62.29 66.43 11.97 116.69 66.25 42.06 14.23 26.06 45.29 - 82.88 161.66 142.65 132.97 66.28 20.81 118.7 92.49 - 31.05 91.73 0.11 277.84",
}
# one day of training: no drift
SHORT = {1: "5 1 2 3 4 5 6 7"}


@pytest.fixture
def plain_plans(spark):
    """Neither broadcasts nor merged partitions, as with large tables."""
    own = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in [*own, "spark.sql.shuffle.partitions"]}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("partitions", [1, 4, 29])
@pytest.mark.parametrize("series", [TIED, SHORT], ids=["tied", "short"])
def test_rows_of_sql(spark, plain_plans, tmp_path, series, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    rows = [(u, dt.datetime(2024, 1, day), float(y)) for u, ys in series.items() for day, y in enumerate(ys.split(), 1) if y != "-"]
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect(config={"threads": 1})  # with more, the SQL's own answers to ties vary
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.sql(ORACLE_SQL["best_model_argmin"]).fetchall())
    got = sorted((r["unique_id"], r["best"], r["value"]) for r in QUERIES["best_model_argmin"](spark, str(tmp_path)).collect())
    assert got == [(u, b, pytest.approx(v, abs=2e-6)) for u, b, v in want]
