"""The engine's queries on the driver's tables, each with SQL that gives the same rows.

Sums of floats are rounded in both, since the order of addition differs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions import calendar as C
from tidegrid.functions import metrics as M
from tidegrid.functions.freq import freq
from tidegrid.functions.quantiles import z_of
from tidegrid.operators import anomaly, audit, evaluate, explain, forecast, grid, hierarchy, intervals, models, panel, recursive, validation
from tidegrid.plans import api, arena
from tidegrid.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

D, MS = freq("D"), freq("MS")
H, SEASON, MODELS = 7, 7, ["zero", "naive", "hist_avg", "seasonal_naive", "window_avg", "drift"]

_DAYS = "p AS (SELECT CAST({by} AS VARCHAR) AS unique_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ds, round(sum(value), 6) AS y FROM events GROUP BY 1, 2)"
P1, P2 = _DAYS.format(by="event_type"), _DAYS.format(by="user_id")
P3 = "p AS (SELECT o_orderpriority AS unique_id, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS ds, round(sum(o_totalprice), 2) AS y, CAST(count(*) AS DOUBLE) AS x FROM orders GROUP BY 1, 2)"
POS = "r AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS rn, count(*) OVER (PARTITION BY unique_id) AS n FROM p)"
GRID = "g AS (SELECT unique_id, unnest(generate_series({lo}, {hi}, INTERVAL 1 DAY)) AS ds FROM (SELECT unique_id, min(ds) AS lo, max(ds) AS hi FROM p GROUP BY 1), (SELECT min(ds) AS all_lo, max(ds) AS all_hi FROM p))"
ZEROS = GRID.format(lo="all_lo", hi="all_hi") + ", q AS (SELECT g.unique_id, g.ds, coalesce(p.y, 0) AS y FROM g LEFT JOIN p USING (unique_id, ds))"
CV = """c AS (SELECT unique_id, w, n - {h} - {p} * ({w} - 1 - w) AS c, ds AS cutoff FROM r, (SELECT unnest(range({w})) AS w)
         WHERE rn = n - {h} - {p} * ({w} - 1 - w)),
    cv AS (SELECT t.unique_id, t.ds, c.cutoff, t.y, f.y AS seasonal_naive, CAST(t.rn - c.c AS INTEGER) AS k, c.c
           FROM c JOIN r t ON t.unique_id = c.unique_id AND t.rn BETWEEN c.c + 1 AND c.c + {h}
           LEFT JOIN r f ON f.unique_id = c.unique_id AND f.rn = c.c - {s} + 1 + (t.rn - c.c - 1) % {s})"""
CV3 = CV.format(h=7, p=7, w=3, s=7)


def p1(spark: SparkSession, sf: str) -> DataFrame:
    return tables.events_panel(spark, sf, "day", "event_type")


def p2(spark: SparkSession, sf: str) -> DataFrame:
    return tables.events_panel(spark, sf, "day", "user_id")


def p3(spark: SparkSession, sf: str) -> DataFrame:
    return tables.orders_panel(spark, sf)


def zeros(spark: SparkSession, sf: str) -> DataFrame:
    """Daily values by user over all days, zero where there are none."""
    return grid.fill_gaps(p2(spark, sf), D, "global", "global").fillna(0.0, ["y"])


def rounded(df: DataFrame, columns: Sequence[str], n: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`"), n) for c in columns})


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def note(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return note


# ---- panels, summaries, duplicates -------------------------------------------------------------------------------


@query(f"WITH {P2} SELECT unique_id, count(*) AS n, min(ds) AS first_ds, max(ds) AS last_ds, round(avg(y), 6) AS mean, round(stddev_samp(y), 6) AS std FROM p GROUP BY 1")
def series_stats(spark, sf):
    return rounded(panel.series_stats(p2(spark, sf)), ["mean", "std"])


@query(f"WITH {P2}, s AS (SELECT unique_id, count(*) AS n FROM p GROUP BY 1) SELECT count(*) AS n_series, CAST(sum(n) AS BIGINT) AS n_obs, round(avg(n), 6) AS mean_length, round(stddev_samp(n), 6) AS std_length, min(n) AS min_length, max(n) AS max_length FROM s")
def dataset_summary(spark, sf):
    return rounded(panel.dataset_summary(p2(spark, sf)), ["mean_length", "std_length"])


def _hours(spark, sf):
    own = spark.read.parquet(f"{sf}/events.parquet")
    return own.select("event_id", F.col("user_id").alias("unique_id"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ds"), F.col("value").alias("y"))


_HOURS = "p AS (SELECT event_id, user_id AS unique_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ds, value AS y FROM events)"


@query(f"WITH {_HOURS} SELECT unique_id, ds, round(sum(y), 6) AS y, max(event_id) AS event_id FROM p GROUP BY 1, 2")
def dedupe_agg(spark, sf):
    return rounded(panel.dedupe(_hours(spark, sf), {"y": "sum", "event_id": "max"}), ["y"])


@query(f"WITH {_HOURS} SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY unique_id, ds ORDER BY event_id) = 1")
def first_of_each(spark, sf):
    return panel.first_of_each(_hours(spark, sf), ["event_id"])


@query(f"WITH {_HOURS} SELECT * FROM p QUALIFY count(*) OVER (PARTITION BY unique_id, ds) > 1")
def dup_rows_d001(spark, sf):
    return audit.duplicate_rows(_hours(spark, sf)).select("event_id", "unique_id", "ds", "y")


@query(f"WITH {P2} SELECT * FROM p WHERE unique_id IN (SELECT DISTINCT unique_id FROM p ORDER BY md5(unique_id), unique_id LIMIT 10)")
def sample_series(spark, sf):
    return panel.sample_series(p2(spark, sf), 10)


@query(f"WITH {P2} SELECT * FROM p WHERE unique_id IN (SELECT unique_id FROM p GROUP BY 1 HAVING count(*) >= 27)")
def min_length_filter(spark, sf):
    return panel.at_least(p2(spark, sf), 27)


@query(f"WITH {P2} SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) <= 5")
def tail_n(spark, sf):
    return panel.tail(p2(spark, sf), 5)


@query(f"WITH {P2} SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) BETWEEN 4 AND 9")
def tail_slice(spark, sf):
    return panel.tail(p2(spark, sf), 6, skip=3)


@query(f"WITH {P2} SELECT *, CASE WHEN row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) <= 7 THEN 'test' ELSE 'train' END AS part FROM p")
def holdout_split(spark, sf):
    return panel.holdout(p2(spark, sf), 7)


@query(f"WITH {P2} SELECT CAST('0x' || substr(md5(unique_id), 1, 8) AS BIGINT) % 16 AS batch, count(DISTINCT unique_id) AS n_series FROM p GROUP BY 1")
def hash_batches(spark, sf):
    return panel.hash_batches(p2(spark, sf), 16).groupBy("batch").agg(F.count_distinct("unique_id").alias("n_series"))


@query("SELECT 'D' AS daily, 'MS' AS monthly")
def infer_frequency(spark, sf):
    return spark.range(1).select(F.lit(panel.infer_frequency(p1(spark, sf))).alias("daily"), F.lit(panel.infer_frequency(p3(spark, sf))).alias("monthly"))


# ---- audit and cleaning ------------------------------------------------------------------------------------------


@query(f"WITH {P2}, {GRID.format(lo='lo', hi='all_hi')} SELECT g.* FROM g ANTI JOIN p USING (unique_id, ds)")
def missing_dates_d002(spark, sf):
    return grid.missing_dates(p2(spark, sf), D)


@query("SELECT * FROM (VALUES ('event_type'), ('props')) t(column_name)")
def categorical_cols_f001(spark, sf):
    own = spark.read.parquet(f"{sf}/events.parquet").withColumnsRenamed({"user_id": "unique_id", "ts": "ds", "value": "y"})
    return spark.createDataFrame([(c,) for c in audit.categorical_columns(own)], "column_name string")


@query(f"WITH {P2} SELECT unique_id, ds, round(y - 60, 6) AS y FROM p WHERE round(y - 60, 6) < 0")
def negative_v001(spark, sf):
    return audit.negative_values(p2(spark, sf).withColumn("y", F.round(F.col("y") - 60, 6)))


@query(f"WITH {P2} SELECT unique_id, ds, CASE WHEN round(y - 60, 6) < 0 THEN 0 ELSE round(y - 60, 6) END AS y FROM p")
def clean_clip(spark, sf):
    return audit.clip_negative(p2(spark, sf).withColumn("y", F.round(F.col("y") - 60, 6)))


@query(f"WITH {P2}, {ZEROS} SELECT unique_id, min(ds) AS first_ds, min(ds) FILTER (y <> 0) AS start_ds FROM q GROUP BY 1 HAVING min(ds) FILTER (y <> 0) > min(ds)")
def leading_zeros_v002(spark, sf):
    return audit.leading_zeros(zeros(spark, sf))


@query(f"WITH {P2}, {ZEROS}, s AS (SELECT unique_id, min(ds) FILTER (y <> 0) AS s FROM q GROUP BY 1) SELECT q.* FROM q JOIN s USING (unique_id) WHERE s IS NULL OR ds >= s")
def clean_trim(spark, sf):
    return audit.trim_leading_zeros(zeros(spark, sf))


@query(f"""WITH {P2}, {GRID.format(lo='lo', hi='all_hi')} SELECT 'D001' AS test_id, 'fail' AS severity, CAST(0 AS BIGINT) AS n_rows
    UNION ALL SELECT 'D002', 'fail', (SELECT count(*) FROM g ANTI JOIN p USING (unique_id, ds)) UNION ALL SELECT 'F001', 'fail', 0
    UNION ALL SELECT 'V001', 'case_specific', (SELECT count(*) FROM p WHERE y < 0)
    UNION ALL SELECT 'V002', 'case_specific', (SELECT count(*) FROM (SELECT unique_id FROM p GROUP BY 1 HAVING min(ds) FILTER (y <> 0) > min(ds)))""")
def audit_report(spark, sf):
    return audit.report(p2(spark, sf), "D")


# ---- grids and features ------------------------------------------------------------------------------------------

for _name, _lo, _hi, _sql in (("per_serie", "per_serie", "per_serie", ("lo", "hi")), ("global", "global", "global", ("all_lo", "all_hi")), ("literal", "2023-12-30", "global", ("TIMESTAMP '2023-12-30'", "all_hi"))):

    @query(f"WITH {P2}, {GRID.format(lo=_sql[0], hi=_sql[1])} SELECT g.unique_id, g.ds, p.y FROM g LEFT JOIN p USING (unique_id, ds)", f"fill_gaps_{_name}")
    def _fill(spark, sf, lo=_lo, hi=_hi):
        return grid.fill_gaps(p2(spark, sf), D, lo, hi)


@query(f"""WITH {P2} SELECT unique_id, count(*) AS n, count(DISTINCT ds) AS n_distinct, date_diff('day', min(ds), max(ds)) + 1 AS n_expected,
    count(*) = count(DISTINCT ds) AND count(*) = date_diff('day', min(ds), max(ds)) + 1 AS ok FROM p GROUP BY 1""")
def contiguity_check(spark, sf):
    return grid.contiguity(p2(spark, sf), D)


@query(f"WITH {P3}, l AS (SELECT unique_id, max(ds) AS last FROM p GROUP BY 1) SELECT unique_id, last + to_months(CAST(k AS INTEGER)) AS ds, CAST(k AS INTEGER) AS k FROM l, (SELECT unnest(range(1, 7)) AS k)")
def future_grid(spark, sf):
    return grid.future_grid(p3(spark, sf), 6, MS)


@query(f"""WITH {P1}, b AS (SELECT ds, row_number() OVER (ORDER BY ds) AS biz FROM (SELECT DISTINCT ds + to_days(CAST(k AS INTEGER)) AS ds FROM p, (SELECT unnest(range(0, 22)) AS k)) WHERE isodow(ds) < 6),
    l AS (SELECT unique_id, max(ds) AS last FROM p WHERE isodow(ds) < 6 GROUP BY 1)
    SELECT l.unique_id, f.ds, CAST(k AS INTEGER) AS k FROM l JOIN b ON b.ds = l.last, (SELECT unnest(range(1, 6)) AS k) JOIN b f ON f.biz = b.biz + k""")
def future_business_days(spark, sf):
    own = p1(spark, sf)
    days = own.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(21)), lambda k: D.add(F.col("ds"), k))).alias("ds")).filter(F.weekday("ds") < 5)
    return grid.future_on_calendar(own.filter(F.weekday("ds") < 5), 5, days)


@query(f"WITH {P1} SELECT *, CAST(year(ds) AS INTEGER) AS year, CAST(month(ds) AS INTEGER) AS month, CAST(day(ds) AS INTEGER) AS day, CAST(isodow(ds) - 1 AS INTEGER) AS weekday, CAST(week(ds) AS INTEGER) AS week, CAST(quarter(ds) AS INTEGER) AS quarter, CAST(dayofyear(ds) AS INTEGER) AS dayofyear FROM p")
def date_features_daily(spark, sf):
    return C.date_features(p1(spark, sf), [*C.default_parts("days"), "week", "quarter", "dayofyear"])


@query("SELECT event_id, ts AS ds, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour, CAST(minute(ts) AS INTEGER) AS minute, CAST(second(ts) AS INTEGER) AS second FROM events")
def date_features_seconds(spark, sf):
    return C.date_features(spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").alias("ds")), [*C.default_parts("seconds"), "weekday"])


@query("SELECT event_id, round(sin(hour(ts) * 2 * pi() / 24), 4) + 0.0 AS hour_sin, round(cos(hour(ts) * 2 * pi() / 24), 4) + 0.0 AS hour_cos FROM events")
def cyclic_hour(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", *[v.alias(k) for k, v in C.cyclic(F.hour("ts"), 24, "hour").items()])


@query(f"WITH {P1} SELECT *, " + ", ".join(f"CAST(CASE WHEN isodow(ds) - 1 = {i} THEN 1 ELSE 0 END AS DOUBLE) AS weekday_{i}" for i in range(7)) + " FROM p")
def one_hot_weekday(spark, sf):
    return C.one_hot(p1(spark, sf).withColumn("weekday", F.weekday("ds")), "weekday", list(range(7))).drop("weekday")


@query(f"WITH {P1} SELECT *, " + ", ".join(f"CAST(isodow(ds) - 1 = {i} AS INTEGER) AS day_{i}" for i in range(7)) + " FROM p")
def weekday_dummies(spark, sf):
    return p1(spark, sf).withColumns(C.weekday_dummies())


@query(f"WITH {P1} SELECT *, CAST(CAST(ds AS DATE) IN (DATE '2024-01-01', DATE '2024-01-15') AS INTEGER) AS big, CAST(CAST(ds AS DATE) IN (DATE '2024-01-10') AS INTEGER) AS small FROM p")
def special_dates(spark, sf):
    return C.special_dates(p1(spark, sf), {"big": ["2024-01-01", "2024-01-15"], "small": ["2024-01-10"]})


@query(f"WITH {P1} SELECT *, CAST(CAST(ds AS DATE) = DATE '2024-01-01' AS INTEGER) AS US_new_year, CAST(CAST(ds AS DATE) = DATE '2024-01-06' AS INTEGER) AS DE_kings FROM p")
def holidays_table(spark, sf):
    table = spark.createDataFrame([("US", "new_year", "2024-01-01"), ("DE", "kings", "2024-01-06"), ("FR", "bastille", "2024-07-14")], "country string, name string, date string").withColumn("date", F.col("date").cast("date"))
    return C.holidays(p1(spark, sf), table, ["US", "DE"], [("US", "new_year"), ("DE", "kings")]).select("unique_id", "ds", "y", "US_new_year", "DE_kings")


@query(f"WITH {P1}, {POS} SELECT unique_id, ds, y, " + ", ".join(f"round({f}(rn * {2 * math.pi * i / 7!r}::DOUBLE), 6) + 0.0 AS {f}{i}_7" for f in ("sin", "cos") for i in (1, 2)) + " FROM r")
def fourier_k2(spark, sf):
    rows = panel.with_positions(p1(spark, sf))
    new = C.fourier(F.col("rn"), 7, 2)
    return rounded(rows.withColumns(new), list(new), 6).drop("rn", "n")


@query(f"""WITH {P2} SELECT *, lag(y, 1) OVER s AS lag_1, lag(y, 7) OVER s AS lag_7, round(avg(y) OVER w, 6) AS mean_7, round(stddev_samp(y) OVER w, 6) AS std_7 FROM p
    WINDOW s AS (PARTITION BY unique_id ORDER BY ds), w AS (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""")
def lag_rolling(spark, sf):
    return rounded(grid.lags(p2(spark, sf), [1, 7], [7]), ["mean_7", "std_7"])


@query(f"""WITH {P2}, {GRID.format(lo='all_lo', hi='all_hi')}, f AS (SELECT g.unique_id, g.ds, p.y, row_number() OVER (PARTITION BY g.unique_id ORDER BY g.ds) AS rn FROM g LEFT JOIN p USING (unique_id, ds)),
    e AS (SELECT *, max(CASE WHEN y IS NOT NULL THEN rn END) OVER (PARTITION BY unique_id ORDER BY rn) AS a, min(CASE WHEN y IS NOT NULL THEN rn END) OVER (PARTITION BY unique_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM f)
    SELECT e.unique_id, e.ds, round(coalesce(e.y, l.y + (h.y - l.y) * (e.rn - a) / nullif(b - a, 0), l.y, h.y), 6) AS y
    FROM e LEFT JOIN f l ON l.unique_id = e.unique_id AND l.rn = e.a LEFT JOIN f h ON h.unique_id = e.unique_id AND h.rn = e.b""")
def interpolate_linear(spark, sf):
    return rounded(grid.interpolate(grid.fill_gaps(p2(spark, sf), D, "global", "global")), ["y"])


# ---- forecasts ---------------------------------------------------------------------------------------------------

_LAST = "l AS (SELECT unique_id, max(ds) AS last, count(*) AS n, avg(y) AS m, max_by(y, ds) AS b, min_by(y, ds) AS a FROM p GROUP BY 1), k AS (SELECT CAST(unnest(range(1, 15)) AS INTEGER) AS k)"
_VALUES = {
    "zero": "0.0::DOUBLE", "naive": "b", "hist_avg": "round(m, 6)", "drift": "round(b + k * (b - a) / nullif(n - 1, 0), 6)",
    "linear_trend": "round((SELECT regr_intercept(y, rn) + regr_slope(y, rn) * (l.n + k) FROM r WHERE r.unique_id = l.unique_id), 6)",
    "window_avg": "round((SELECT avg(y) FROM r WHERE r.unique_id = l.unique_id AND rn > l.n - 7), 6)",
    "seasonal_naive": "(SELECT y FROM r WHERE r.unique_id = l.unique_id AND rn = l.n - 7 + 1 + (k - 1) % 7)",
}
for _m, _v in _VALUES.items():

    @query(f"WITH {P2}, {POS}, {_LAST} SELECT l.unique_id, last + to_days(k) AS ds, {_v} AS {_m} FROM l, k", f"fc_{_m}")
    def _fc(spark, sf, m=_m):
        out = forecast.STRATEGIES[m](p2(spark, sf), 14, D)
        return out if m in ("zero", "naive", "seasonal_naive") else rounded(out, [m])


@query(f"WITH {P1}, {POS}, {_LAST} SELECT l.unique_id, last + to_days(k) AS ds, round(exp((SELECT avg(ln(y)) FROM r WHERE r.unique_id = l.unique_id)), 3) AS hist_avg FROM l, k")
def fc_bounded_log(spark, sf):
    return rounded(forecast.bounded(p1(spark, sf), lambda d: forecast.hist_avg(d, 14, D), "hist_avg"), ["hist_avg"], 3)


_EXOG = f"""{P3}, s AS (SELECT unique_id, regr_slope(y, x) AS b, avg(y) AS ym, avg(x) AS xm, max(ds) AS last, max_by(x, ds) AS lx FROM p GROUP BY 1), k AS (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS k)"""


def _exog(spark, sf):
    own = p3(spark, sf)
    future = grid.future_grid(own, 3, MS).join(own.groupBy("unique_id").agg(F.max_by("x", "ds").alias("lx")), "unique_id")
    return own, future.select("unique_id", "ds", (F.col("lx") + F.col("k")).alias("x"))


@query(f"WITH {_EXOG} SELECT unique_id, last + to_months(k) AS ds, round(ym + b * (lx + k - xm), 1) AS exogenous FROM s, k")
def fc_exogenous(spark, sf):
    return rounded(forecast.exogenous(*_exog(spark, sf), "x"), ["exogenous"], 1).select("unique_id", "ds", "exogenous")


@query(f"""WITH {_EXOG}, e AS (SELECT unique_id, last + to_months(k) AS ds, round(ym + b * (lx + k - xm), 1) AS exogenous, round(b * (lx + k - xm), 1) AS x, round(ym, 1) AS base_value FROM s, k)
    SELECT unique_id, ds, exogenous, 'x' AS feature, x AS contribution FROM e UNION ALL SELECT unique_id, ds, exogenous, 'base_value', base_value FROM e""")
def explain_linear(spark, sf):
    return rounded(explain.contributions(*_exog(spark, sf), "x"), ["exogenous", "contribution"], 1)


@query(f"WITH {P3} SELECT unique_id, ds, y, 'x' || f AS scenario, round(x * CAST(f AS DOUBLE), 6) AS x FROM p, (VALUES ('0.95'), ('1'), ('1.05')) t(f)")
def whatif_scenario(spark, sf):
    return rounded(explain.what_if(p3(spark, sf), "x", [0.95, 1.0, 1.05]), ["x"])


@query(f"""WITH {P1}, {POS}, {_LAST} SELECT r.unique_id, r.ds, f.y AS seasonal_naive FROM r JOIN r f ON f.unique_id = r.unique_id AND f.rn = r.rn - 7
    UNION ALL SELECT l.unique_id, last + to_days(k), {_VALUES['seasonal_naive']} FROM l, k""")
def add_history(spark, sf):
    own = p1(spark, sf)
    return forecast.with_history(own, forecast.seasonal_naive(own, 14, D), 7)


_SES = f"""WITH RECURSIVE {P2}, {ZEROS}, r AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS rn, count(*) OVER (PARTITION BY unique_id) AS n, max(ds) OVER (PARTITION BY unique_id) AS last FROM q),"""
_AHEAD = "k AS (SELECT CAST(unnest(range(1, 8)) AS INTEGER) AS k)"


@query(f"{_SES} s AS (SELECT unique_id, rn, n, last, y AS l FROM r WHERE rn = 1 UNION ALL SELECT r.unique_id, r.rn, r.n, r.last, 0.1::DOUBLE * r.y + 0.9::DOUBLE * s.l FROM s JOIN r ON r.unique_id = s.unique_id AND r.rn = s.rn + 1), {_AHEAD} SELECT unique_id, last + to_days(k) AS ds, round(l, 6) AS ses FROM s, k WHERE rn = n")
def ses(spark, sf):
    return rounded(recursive.smoothing(zeros(spark, sf), 7, D, "ses"), ["ses"])


@query(f"""{_SES} s AS (SELECT unique_id, rn, n, last, CASE WHEN y <> 0 THEN y END AS z, CASE WHEN y <> 0 THEN 1::DOUBLE END AS x, CASE WHEN y <> 0 THEN 0 ELSE 1 END AS gap FROM r WHERE rn = 1
    UNION ALL SELECT r.unique_id, r.rn, r.n, r.last, CASE WHEN r.y <> 0 THEN coalesce(0.1::DOUBLE * r.y + 0.9::DOUBLE * z, r.y) ELSE z END,
    CASE WHEN r.y <> 0 THEN coalesce(0.1::DOUBLE * (gap + 1) + 0.9::DOUBLE * x, (gap + 1)::DOUBLE) ELSE x END, CASE WHEN r.y <> 0 THEN 0 ELSE gap + 1 END
    FROM s JOIN r ON r.unique_id = s.unique_id AND r.rn = s.rn + 1), {_AHEAD} SELECT unique_id, last + to_days(k) AS ds, round(coalesce(z / x, 0), 6) AS croston FROM s, k WHERE rn = n""")
def croston(spark, sf):
    return rounded(recursive.smoothing(zeros(spark, sf), 7, D, "croston"), ["croston"])


@query(f"""{_SES} s AS (SELECT unique_id, rn, n, last, CASE WHEN y <> 0 THEN y END AS z, CASE WHEN y <> 0 THEN 1::DOUBLE ELSE 0::DOUBLE END AS x FROM r WHERE rn = 1
    UNION ALL SELECT r.unique_id, r.rn, r.n, r.last, CASE WHEN r.y <> 0 THEN coalesce(0.1::DOUBLE * r.y + 0.9::DOUBLE * z, r.y) ELSE z END, CASE WHEN r.y <> 0 THEN 0.1::DOUBLE + 0.9::DOUBLE * x ELSE 0.9::DOUBLE * x END
    FROM s JOIN r ON r.unique_id = s.unique_id AND r.rn = s.rn + 1), {_AHEAD} SELECT unique_id, last + to_days(k) AS ds, round(coalesce(z * x, 0), 6) AS tsb FROM s, k WHERE rn = n""")
def tsb(spark, sf):
    return rounded(recursive.smoothing(zeros(spark, sf), 7, D, "tsb"), ["tsb"])


@query(f"""WITH RECURSIVE {P2}, {ZEROS}, r AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS rn FROM q),
    z AS (SELECT unique_id, count(*) AS n, max(ds) AS last, greatest(1, coalesce(CAST(round(count(*) / nullif(count(*) FILTER (y <> 0), 0)) AS INTEGER), 1)) AS size FROM r GROUP BY 1),
    b AS (SELECT unique_id, (rn - n % size - 1) // size AS b, sum(y) AS v, any_value(size) AS size, any_value(last) AS last FROM r JOIN z USING (unique_id) WHERE rn > n % size GROUP BY 1, 2),
    s AS (SELECT unique_id, b, size, last, v AS l FROM b WHERE b = 0 UNION ALL SELECT b.unique_id, b.b, b.size, b.last, 0.1::DOUBLE * b.v + 0.9::DOUBLE * s.l FROM s JOIN b ON b.unique_id = s.unique_id AND b.b = s.b + 1),
    {_AHEAD} SELECT unique_id, last + to_days(k) AS ds, round(max_by(l, b) / any_value(size), 6) AS adida FROM s, k GROUP BY unique_id, last, k""")
def adida(spark, sf):
    return rounded(recursive.adida(zeros(spark, sf), 7, D), ["adida"])


@query()
def theta(spark, sf):
    return rounded(recursive.theta(p2(spark, sf), 7, D), ["theta"])


for _m in models.MODELS:

    @query(name=_m)
    def _fitted(spark, sf, m=_m):
        return rounded(models.MODELS[m](zeros(spark, sf), 7, D), [m])


def _two(spark, sf):
    return tuple(d.withColumn("q", F.quarter("ds").cast("double")) for d in _exog(spark, sf))


_REGRESSION = f"""{P3}, z AS (SELECT *, CAST(quarter(ds) AS DOUBLE) AS q FROM p), m AS (SELECT unique_id, avg(y) AS ym, avg(x) AS xm, avg(q) AS qm, var_pop(x) AS a, covar_pop(x, q) AS b, var_pop(q) AS c,
    covar_pop(x, y) AS d, covar_pop(q, y) AS e, max(ds) AS last, max_by(x, ds) AS lx FROM z GROUP BY 1), k AS (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS k),
    s AS (SELECT unique_id, last + to_months(k) AS ds, ym, (d * c - e * b) / (a * c - b * b) * (lx + k - xm) AS x, (e * a - d * b) / (a * c - b * b) * (quarter(last + to_months(k)) - qm) AS q FROM m, k)"""


@query(f"WITH {_REGRESSION} SELECT unique_id, ds, round(ym + x + q, 1) AS regression FROM s")
def fc_regression(spark, sf):
    return rounded(models.regression(*_two(spark, sf), ["x", "q"]), ["regression"], 1).select("unique_id", "ds", "regression")


@query(f"WITH {_REGRESSION} SELECT unique_id, ds, round(ym + x + q, 1) AS regression, feature, round(v, 1) AS contribution FROM s, LATERAL (SELECT unnest(['x', 'q', 'base_value']) AS feature, unnest([x, q, ym]) AS v)")
def explain_regression(spark, sf):
    return rounded(explain.contributions_of(*_two(spark, sf), ["x", "q"]), ["regression", "contribution"], 1)


@query("SELECT 'series_' || CAST(s + 1 AS VARCHAR) AS unique_id, TIMESTAMP '2020-01-01' + to_days(CAST(i AS INTEGER)) AS ds, round(100 + 0.1::DOUBLE * i + 10 * sin(2 * pi() * i / 7 + s) + CASE WHEN i = 30 THEN 50 ELSE 0 END, 6) AS y FROM range(5) a(s), range(60) b(i)")
def synthetic_series(spark, sf):
    return rounded(tables.synthetic_panel(spark, 5, 60, D, spikes={30: 50}), ["y"])


# ---- cross-validation and accuracy -------------------------------------------------------------------------------


@query(f"WITH {P1}, {POS}, {CV3} SELECT unique_id, ds, cutoff, y, seasonal_naive FROM cv")
def cv_windows(spark, sf):
    return validation.seasonal_cv(p1(spark, sf), 7, 7, 3).drop("k")


@query(f"WITH {P2}, {POS}, {CV.format(h=5, p=2, w=4, s=3)} SELECT unique_id, ds, cutoff, y, seasonal_naive FROM cv")
def cv_overlap(spark, sf):
    return validation.seasonal_cv(p2(spark, sf), 5, 3, 4, step=2).drop("k")


@query(f"WITH {P2}, {POS}, {CV.format(h=5, p=2, w=4, s=3)} SELECT unique_id, CAST(w AS INTEGER) AS w, cutoff, c AS n_train FROM c WHERE c >= 1")
def cv_cutoffs(spark, sf):
    return validation.cutoffs(p2(spark, sf), 5, 4, step=2)


@query(f"WITH {P1}, {POS}, {CV3} SELECT cv.unique_id, cv.ds, cv.cutoff, round((SELECT avg(y) FROM r WHERE r.unique_id = cv.unique_id AND r.rn <= cv.c), 6) AS hist_avg, y FROM cv")
def cv_any_model(spark, sf):
    return rounded(validation.train_test_cv(p1(spark, sf), lambda d: forecast.hist_avg(d, 7, D), 7, 3), ["hist_avg"])


@query(f"WITH {P1}, {POS}, {CV3} SELECT cutoff, round(avg(abs(y - seasonal_naive)), 6) AS mae, round(avg((y - seasonal_naive) ** 2), 6) AS mse, round(sqrt(avg((y - seasonal_naive) ** 2)), 6) AS rmse FROM cv GROUP BY 1")
def cv_metrics_by_cutoff(spark, sf):
    y, f = F.col("y"), F.col("seasonal_naive")
    own = validation.seasonal_cv(p1(spark, sf), 7, 7, 3).groupBy("cutoff").agg(M.mae(y, f).alias("mae"), M.mse(y, f).alias("mse"), M.rmse(y, f).alias("rmse"))
    return rounded(rounded(own, ["mae", "rmse"]), ["mse"], 6)


def tested(spark, sf, **how):
    """Forecasts of three models for the last week of each user's days, with the actual values."""
    own = p2(spark, sf)
    cv = lambda d: forecast.forecast_with(d, ["naive", "hist_avg", "drift"], 7, D, **how)
    split = panel.holdout(own, 7)
    test = split.filter("part = 'test'").select("unique_id", "ds", "y")
    return test.join(cv(split.filter("part = 'train'").drop("part")), ["unique_id", "ds"]), split.filter("part = 'train'").drop("part")


TESTED = P2 + """, r0 AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS back FROM p), tr AS (SELECT unique_id, ds, y FROM r0 WHERE back > 7),
    l AS (SELECT unique_id, max(ds) AS last, max_by(y, ds) AS b, min_by(y, ds) AS a, avg(y) AS m, count(*) AS n FROM tr GROUP BY 1),
    t AS (SELECT r0.unique_id, r0.ds, r0.y, b AS naive, m AS hist_avg, b + k * (b - a) / nullif(n - 1, 0) AS drift FROM l, (SELECT CAST(unnest(range(1, 8)) AS INTEGER) AS k)
          JOIN r0 ON r0.unique_id = l.unique_id AND r0.ds = l.last + to_days(k) AND r0.back <= 7)"""
_M = {"mae": "avg(abs(y - {f}))", "mse": "avg((y - {f}) ** 2)", "rmse": "sqrt(avg((y - {f}) ** 2))", "mape": "avg(abs(y - {f}) / nullif(abs(y), 0))", "smape": "avg(coalesce(abs(y - {f}) / nullif(abs(y) + abs({f}), 0), 0))", "bias": "avg({f} - y)"}
_THREE = ["naive", "hist_avg", "drift"]


def _table(metrics: Sequence[str], by: str = "unique_id") -> str:
    return " UNION ALL ".join(f"SELECT {by}, '{m}' AS metric, " + ", ".join(f"{_M[m].format(f=f)} AS {f}" for f in _THREE) + f" FROM t GROUP BY {by}" for m in metrics)


for _n, _ms in (("eval_mae_mse_rmse", ["mae", "mse", "rmse"]), ("eval_mape_smape", ["mape", "smape", "bias"])):

    @query(f"WITH {TESTED}, e AS ({_table(_ms)}) SELECT unique_id, metric, " + ", ".join(f"round({f}, 8) AS {f}" for f in _THREE) + " FROM e", _n)
    def _eval(spark, sf, ms=_ms):
        return rounded(evaluate.evaluate(tested(spark, sf)[0], _THREE, ms, ["unique_id"]), _THREE, 8)


@query(f"WITH {TESTED}, e AS ({_table(['mae', 'rmse'])}) SELECT unique_id, metric, forecaster, round(value, 8) AS value FROM (UNPIVOT e ON naive, hist_avg, drift INTO NAME forecaster VALUE value)")
def eval_long(spark, sf):
    return rounded(evaluate.evaluate_long(tested(spark, sf)[0], _THREE, ["mae", "rmse"]), ["value"], 8)


@query(f"""WITH {TESTED}, d AS (SELECT unique_id, abs(y - lag(y, 7) OVER (PARTITION BY unique_id ORDER BY ds)) AS d FROM tr), s AS (SELECT unique_id, avg(d) AS s FROM d GROUP BY 1),
    e AS (SELECT unique_id, avg(abs(y - naive)) AS mae FROM t GROUP BY 1) SELECT unique_id, round(coalesce(CASE WHEN s >= 0.01 THEN mae / s END, 0), 6) AS mase FROM e JOIN s USING (unique_id)""")
def eval_mase(spark, sf):
    test, train = tested(spark, sf)
    return rounded(evaluate.mase(test, train, "naive", 7), ["mase"])


@query(f"WITH {TESTED} SELECT unique_id, round(avg(greatest(0.9 * (y - naive), -0.1 * (y - naive))), 6) AS p90, round(avg(greatest(0.1 * (y - naive), -0.9 * (y - naive))), 6) AS p10 FROM t GROUP BY 1")
def eval_pinball(spark, sf):
    y, f = F.col("y"), F.col("naive")
    return rounded(tested(spark, sf)[0].groupBy("unique_id").agg(M.pinball(y, f, 0.9).alias("p90"), M.pinball(y, f, 0.1).alias("p10")), ["p90", "p10"])


@query(f"WITH {TESTED} SELECT round((sum(greatest(0.1 * (y - naive), -0.9 * (y - naive))) / sum(abs(y)) + sum(greatest(0.5 * (y - hist_avg), -0.5 * (y - hist_avg))) / sum(abs(y)) + sum(greatest(0.9 * (y - drift), -0.1 * (y - drift))) / sum(abs(y))) / 3, 6) AS scaled_crps FROM t")
def eval_scaled_crps(spark, sf):
    return rounded(evaluate.scaled_crps(tested(spark, sf)[0], {0.1: "naive", 0.5: "hist_avg", 0.9: "drift"}), ["scaled_crps"], 6)


@query(f"WITH {TESTED} SELECT " + ", ".join(f"round((sum(abs({f} - y)) + abs(sum({f} - y))) / sum(y), 6) AS {f}" for f in _THREE) + " FROM t")
def eval_total_score(spark, sf):
    return rounded(tested(spark, sf)[0].agg(*[M.score(F.col("y"), F.col(f)).alias(f) for f in _THREE]), _THREE)


@query(f"WITH {TESTED}, e AS ({_table(['mae', 'rmse'])}) SELECT unique_id, metric, " + ", ".join(f"round({f} / nullif(hist_avg, 0), 6) AS {f}" for f in _THREE) + " FROM e")
def relative_to_baseline(spark, sf):
    return rounded(evaluate.relative(evaluate.evaluate(tested(spark, sf)[0], _THREE, ["mae", "rmse"], ["unique_id"]).select("unique_id", "metric", *_THREE), ["naive", "drift", "hist_avg"], "hist_avg"), _THREE)


@query(f"""WITH {TESTED}, e AS ({_table(['mae', 'rmse'])}), u AS (UNPIVOT e ON naive, hist_avg, drift INTO NAME forecaster VALUE value),
    b AS (SELECT forecaster, avg(value) FILTER (metric = 'mae') AS mae, avg(value) FILTER (metric = 'rmse') AS rmse FROM u GROUP BY 1)
    SELECT forecaster, round(mae, 6) AS mae, round(rmse, 6) AS rmse, CAST(row_number() OVER (ORDER BY mae, forecaster) AS INTEGER) AS rank FROM b""")
def leaderboard_pivot(spark, sf):
    return rounded(evaluate.leaderboard(evaluate.evaluate_long(tested(spark, sf)[0], _THREE, ["mae", "rmse"]), ["mae", "rmse"]), ["mae", "rmse"])


@query(f"""WITH {TESTED}, e AS ({_table(['mae'])}) SELECT unique_id, CASE WHEN naive <= hist_avg AND naive <= drift THEN 'naive' WHEN hist_avg <= drift THEN 'hist_avg' ELSE 'drift' END AS best, round(least(naive, hist_avg, drift), 6) AS value FROM e""")
def best_model_argmin(spark, sf):
    """Exact ties are common, as values are in cents; last bits decide them. Sums run as the SQL's do: means from the last day back, errors forward."""
    errors = evaluate.ordered_mae(tested(spark, sf, hist_avg={"ordered": True})[0], _THREE, ["unique_id"])
    return rounded(evaluate.best_model(errors, _THREE, ["unique_id"]), ["value"])


@query(f"WITH {TESTED} " + " UNION ALL ".join(f"SELECT 'users' AS dataset, '{f}' AS forecaster, round(avg(abs(y - {f})), 6) AS mae, round(sqrt(avg((y - {f}) ** 2)), 6) AS rmse FROM t" for f in _THREE))
def arena_report(spark, sf):
    return rounded(arena.compete({"users": (p2(spark, sf), "D")}, _THREE, 7), ["mae", "rmse"])


@query(f"WITH {TESTED} SELECT unique_id, ds, round((naive + hist_avg + drift) / 3, 6) AS ensemble FROM t")
def ensemble_mean(spark, sf):
    return rounded(forecast.ensemble(tested(spark, sf)[0], _THREE), ["ensemble"]).select("unique_id", "ds", "ensemble")


# ---- intervals and anomalies -------------------------------------------------------------------------------------

_WIDTHS = "wd AS (SELECT unique_id, k, quantile_cont(abs(y - seasonal_naive), 0.8) AS w80, quantile_cont(abs(y - seasonal_naive), 0.9) AS w90 FROM cv GROUP BY 1, 2)"
_CONF = f"{P1}, {POS}, {CV3}, {_WIDTHS}, {_LAST}, f AS (SELECT l.unique_id, last + to_days(k) AS ds, {_VALUES['seasonal_naive']} AS v, k FROM l, k WHERE k <= 7)"


def conformal(spark, sf):
    own = p1(spark, sf)
    fc = forecast.seasonal_naive(own, 7, D).join(grid.future_grid(own, 7, D), ["unique_id", "ds"])
    widths = intervals.conformal_widths(validation.seasonal_cv(own, 7, 7, 3), [80, 90], "seasonal_naive")
    return intervals.with_conformal(fc, widths, [80, 90], "seasonal_naive").drop("k")


@query(f"""WITH {_CONF} SELECT unique_id, ds, v AS seasonal_naive, round(v - w90, 6) AS "seasonal_naive-lo-90", round(v - w80, 6) AS "seasonal_naive-lo-80", round(v + w80, 6) AS "seasonal_naive-hi-80", round(v + w90, 6) AS "seasonal_naive-hi-90" FROM f JOIN wd USING (unique_id, k)""")
def intervals_conformal(spark, sf):
    return rounded(conformal(spark, sf), [f"seasonal_naive-{s}-{x}" for s in ("lo", "hi") for x in (80, 90)])


@query(f"""WITH {_CONF} SELECT unique_id, ds, v AS seasonal_naive, round(v - w80, 6) AS "seasonal_naive-q-10", v AS "seasonal_naive-q-50", round(v + w80, 6) AS "seasonal_naive-q-90", round(v + w90, 6) AS "seasonal_naive-q-95" FROM f JOIN wd USING (unique_id, k)""")
def quantile_projection(spark, sf):
    out = intervals.to_quantiles(conformal(spark, sf), [0.1, 0.5, 0.9, 0.95], "seasonal_naive", ["unique_id", "ds"])
    return rounded(out, [f"seasonal_naive-q-{q}" for q in (10, 90, 95)])


@query(f"WITH {_CONF} SELECT unique_id, ds, '80' AS level, round(v - w80, 6) AS lo, round(v + w80, 6) AS hi FROM f JOIN wd USING (unique_id, k) UNION ALL SELECT unique_id, ds, '90', round(v - w90, 6), round(v + w90, 6) FROM f JOIN wd USING (unique_id, k)")
def interval_map(spark, sf):
    own = intervals.interval_map(conformal(spark, sf), [80, 90], "seasonal_naive", ["unique_id", "ds"])
    return own.select("unique_id", "ds", F.explode("intervals").alias("level", "i")).select("unique_id", "ds", "level", F.round("i.lo", 6).alias("lo"), F.round("i.hi", 6).alias("hi"))


_HIST = f"{P2}, {POS}, f AS (SELECT r.unique_id, r.ds, r.y, b.y AS s FROM r JOIN r b ON b.unique_id = r.unique_id AND b.rn = r.rn - 7), e AS (SELECT *, {z_of(95)!r}::DOUBLE * stddev_samp(y - s) OVER (PARTITION BY unique_id) AS w FROM f)"


@query(f"""WITH {_HIST} SELECT unique_id, ds, y, s AS seasonal_naive, y < s - w OR y > s + w AS anomaly, round(s - w, 6) AS "seasonal_naive-lo-95", round(s + w, 6) AS "seasonal_naive-hi-95" FROM e""")
def anomaly_historical(spark, sf):
    return rounded(anomaly.historical(p2(spark, sf), 7, 95), ["seasonal_naive-lo-95", "seasonal_naive-hi-95"])


@query(f"WITH {_HIST} SELECT unique_id, count(*) FILTER (y < s - w OR y > s + w) AS n_anomalies, count(*) AS n FROM e GROUP BY 1")
def anomaly_summary(spark, sf):
    return anomaly.historical(p2(spark, sf), 7, 95).groupBy("unique_id").agg(F.count_if("anomaly").alias("n_anomalies"), F.count(F.lit(1)).alias("n"))


_ONLINE = f"""{P1}, {POS}, {CV.format(h=4, p=4, w=4, s=7)}, x AS (SELECT unique_id, ds, first(y) AS y, avg(seasonal_naive) AS f FROM cv WHERE c >= 1 GROUP BY 1, 2),
    o AS (SELECT *, y - f AS r, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) <= 4 AS live FROM x),
    m AS (SELECT *, avg(CASE WHEN NOT live THEN r END) OVER s AS mu, stddev_samp(CASE WHEN NOT live THEN r END) OVER s AS sd FROM o WINDOW s AS (PARTITION BY unique_id))"""
_Z = f"{z_of(90)!r}::DOUBLE"


@query(f"""WITH {_ONLINE} SELECT unique_id, ds, y, f AS seasonal_naive, y < f + mu - {_Z} * sd OR y > f + mu + {_Z} * sd AS anomaly, round((r - mu) / nullif(sd, 0), 6) AS anomaly_score,
    round(f + mu - {_Z} * sd, 6) AS "seasonal_naive-lo-90", round(f + mu + {_Z} * sd, 6) AS "seasonal_naive-hi-90" FROM m WHERE live""")
def anomaly_online_uni(spark, sf):
    return rounded(anomaly.online(p1(spark, sf), 4, 4, 7, 90, calibration=12), ["anomaly_score", "seasonal_naive-lo-90", "seasonal_naive-hi-90"])


@query(f"""WITH {_ONLINE}, z AS (SELECT *, (r - mu) / nullif(sd, 0) AS score FROM m), a AS (SELECT ds, sum(score * score) AS acc, bool_or(live) AS late FROM z GROUP BY 1),
    q AS (SELECT quantile_cont(acc, 0.9) AS q FROM a WHERE NOT late)
    SELECT z.unique_id, z.ds, z.y, z.f AS seasonal_naive, acc > q AS anomaly, round(score, 6) AS anomaly_score, round(acc, 6) AS accumulated_anomaly_score FROM z JOIN a USING (ds), q WHERE z.live""")
def anomaly_online_multi(spark, sf):
    return rounded(anomaly.online_multivariate(p1(spark, sf), 4, 4, 7, 90, calibration=12), ["anomaly_score", "accumulated_anomaly_score"])


# ---- models, covariates and detectors by the entry points --------------------------------------------------------

_AVG = "(SELECT avg(y) FROM r WHERE r.unique_id = cv.unique_id AND r.rn <= cv.c)"


@query(f"""WITH {P1}, {POS}, {CV3}, v AS (SELECT unique_id, k, quantile_cont(abs(y - {_AVG}), 0.8) AS w FROM cv GROUP BY 1, 2), l AS (SELECT unique_id, max(ds) AS last, avg(y) AS m FROM p GROUP BY 1)
    SELECT unique_id, last + to_days(k) AS ds, round(m, 6) AS hist_avg, round(m - w, 6) AS "hist_avg-lo-80", round(m + w, 6) AS "hist_avg-hi-80" FROM l JOIN v USING (unique_id)""")
def fc_levels_hist_avg(spark, sf):
    """Intervals come from the errors of the model that is asked for."""
    return rounded(api.forecast_panel(p1(spark, sf), 7, "D", "hist_avg", level=[80]), ["hist_avg", "hist_avg-lo-80", "hist_avg-hi-80"])


@query(f"""WITH {P1}, {POS}, {CV.format(h=5, p=5, w=4, s=7)}, x AS (SELECT *, dense_rank() OVER (PARTITION BY unique_id ORDER BY c) AS w FROM cv),
    v AS (SELECT a.unique_id, a.k, a.w, quantile_cont(abs(b.y - b.seasonal_naive), 0.8) AS q FROM x a JOIN x b ON b.unique_id = a.unique_id AND b.k = a.k AND b.w BETWEEN a.w - 2 AND a.w - 1 GROUP BY 1, 2, 3)
    SELECT unique_id, ds, y, seasonal_naive, cutoff, round(seasonal_naive - q, 6) AS "seasonal_naive-lo-80", round(seasonal_naive + q, 6) AS "seasonal_naive-hi-80" FROM x JOIN v USING (unique_id, k, w) WHERE w > 2""")
def cv_levels(spark, sf):
    """A window's intervals come from windows that end before it begins."""
    out = api.cross_validation(p1(spark, sf), 5, "D", n_windows=2, level=[80], calibration_windows=2)
    return rounded(out, ["seasonal_naive-lo-80", "seasonal_naive-hi-80"])


@query(f"""WITH {P1}, {POS}, {_LAST} SELECT * FROM (SELECT unique_id, ds, round(avg(y) OVER (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS hist_avg FROM p) WHERE hist_avg IS NOT NULL
    UNION ALL SELECT unique_id, last + to_days(k), round(m, 6) FROM l, k""")
def history_of_model(spark, sf):
    return rounded(api.forecast_panel(p1(spark, sf), 14, "D", "hist_avg", add_history=True), ["hist_avg"])


_BAND = """SELECT unique_id, ds, y, round(f, {n}) AS {m}, y < f - w OR y > f + w AS anomaly, round(f - w, {n}) AS "{m}-lo-95", round(f + w, {n}) AS "{m}-hi-95" FROM (SELECT *, {z}::DOUBLE * stddev_samp(y - f) OVER (PARTITION BY unique_id) AS w FROM f WHERE f IS NOT NULL)"""


@query(f"WITH {P2}, f AS (SELECT *, avg(y) OVER (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM p) {_BAND.format(n=6, m='hist_avg', z=repr(z_of(95)))}")
def anomaly_of_model(spark, sf):
    out = api.detect_anomalies(p2(spark, sf), "D", 95, model="hist_avg", validate=False)
    return rounded(out, ["hist_avg", "hist_avg-lo-95", "hist_avg-hi-95"])


@query(f"WITH {P3}, m AS (SELECT unique_id, avg(y) AS ym, avg(x) AS xm, regr_slope(y, x) AS b FROM p GROUP BY 1), f AS (SELECT p.unique_id, ds, y, ym + b * (x - xm) AS f FROM p JOIN m USING (unique_id)) {_BAND.format(n=1, m='lm', z=repr(z_of(95)))}")
def anomaly_with_covariate(spark, sf):
    out = api.detect_anomalies(p3(spark, sf), "MS", 95, model="lm", exog=["x"], validate=False)
    return rounded(out, ["lm", "lm-lo-95", "lm-hi-95"], 1)


@query(f"""WITH {P1}, {POS}, {CV.format(h=4, p=4, w=4, s=7)}, x AS (SELECT unique_id, ds, y, {_AVG} AS f FROM cv WHERE c >= 1), o AS (SELECT *, y - f AS r, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) <= 4 AS live FROM x),
    m AS (SELECT *, avg(r) FILTER (NOT live) OVER s AS mu, stddev_samp(r) FILTER (NOT live) OVER s AS sd FROM o WINDOW s AS (PARTITION BY unique_id))
    SELECT unique_id, ds, y, round(f, 6) AS hist_avg, y < f + mu - {z_of(90)!r}::DOUBLE * sd OR y > f + mu + {z_of(90)!r}::DOUBLE * sd AS anomaly, round((r - mu) / nullif(sd, 0), 6) AS anomaly_score,
    round(f + mu - {z_of(90)!r}::DOUBLE * sd, 6) AS "hist_avg-lo-90", round(f + mu + {z_of(90)!r}::DOUBLE * sd, 6) AS "hist_avg-hi-90" FROM m WHERE live""")
def anomaly_online_of_model(spark, sf):
    own = p1(spark, sf)
    cv = lambda n, apart: validation.train_test_cv(own, lambda d: forecast.hist_avg(d, 4, D), 4, n, apart)
    out = anomaly.online(own, 4, 4, 1, 90, calibration=12, name="hist_avg", windows=cv)
    return rounded(out, ["hist_avg", "anomaly_score", "hist_avg-lo-90", "hist_avg-hi-90"])


_LAGGED = f"{P3}, r AS (SELECT *, row_number() OVER s AS rn, count(*) OVER (PARTITION BY unique_id) AS n, lag(x, 3) OVER s AS z FROM p WINDOW s AS (PARTITION BY unique_id ORDER BY ds))"


@query(f"""WITH {_LAGGED}, c AS (SELECT unique_id, n - 3 - 3 * (1 - w) AS c, ds AS cutoff FROM r, (SELECT unnest(range(2)) AS w) WHERE rn = n - 3 - 3 * (1 - w)),
    m AS (SELECT c.unique_id, c.c, cutoff, avg(y) AS ym, avg(z) AS zm, regr_slope(y, z) AS b FROM c JOIN r ON r.unique_id = c.unique_id AND rn <= c.c AND z IS NOT NULL GROUP BY 1, 2, 3)
    SELECT r.unique_id, ds, y, round(ym + b * (z - zm), 1) AS lm, cutoff FROM m JOIN r ON r.unique_id = m.unique_id AND rn BETWEEN m.c + 1 AND m.c + 3""")
def cv_past_covariate(spark, sf):
    """A covariate of the past alone enters as its values of h rows before."""
    return rounded(api.cross_validation(p3(spark, sf), 3, "MS", 2, model="lm", hist=["x"], validate=False), ["lm"], 1)


@query(f"""WITH {_LAGGED}, m AS (SELECT unique_id, avg(y) AS ym, avg(z) AS zm, regr_slope(y, z) AS b, max(ds) AS last, max(n) AS n FROM r WHERE z IS NOT NULL GROUP BY 1)
    SELECT m.unique_id, last + to_months(CAST(k AS INTEGER)) AS ds, round(ym + b * (x - zm), 1) AS lm FROM m, (SELECT unnest(range(1, 4)) AS k) JOIN r ON r.unique_id = m.unique_id AND r.rn = m.n + k - 3""")
def fc_past_covariate(spark, sf):
    return rounded(api.forecast_panel(p3(spark, sf), 3, "MS", "lm", hist=["x"], validate=False), ["lm"], 1)


@query(f"""WITH {P1}, {_LAST}, w AS (SELECT unique_id, isodow(ds) AS d, avg(y) AS m FROM p GROUP BY 1, 2)
    SELECT l.unique_id, last + to_days(k) AS ds, round(w.m, 6) AS lm FROM l, k JOIN w ON w.unique_id = l.unique_id AND w.d = isodow(last + to_days(k))""")
def fc_date_features(spark, sf):
    """Regression on a column for each weekday: the weekdays' means."""
    return rounded(api.forecast_panel(p1(spark, sf), 14, "D", "lm", dates=["weekday"], one_hot=["weekday"]), ["lm"])


@query(f"WITH {P1}, {POS}, {CV3} SELECT unique_id, ds, y, round((SELECT avg(y) FROM r WHERE r.unique_id = cv.unique_id AND r.rn <= cv.c AND isodow(r.ds) = isodow(cv.ds)), 6) AS lm, cutoff FROM cv")
def cv_categorical(spark, sf):
    own = p1(spark, sf).withColumn("day", F.date_format("ds", "EEEE"))
    return rounded(api.cross_validation(own, 7, "D", 3, model="lm", exog=["day"], categorical=["day"]), ["lm"])


@query(f"""WITH {P1}, {POS}, {CV3}, d AS (SELECT *, abs(y - lag(y, 7) OVER (PARTITION BY unique_id ORDER BY ds)) AS d FROM r), e AS (SELECT unique_id, cutoff, any_value(c) AS c, avg(abs(y - seasonal_naive)) AS mae FROM cv GROUP BY 1, 2),
    s AS (SELECT e.unique_id, e.cutoff, any_value(mae) AS mae, avg(d) AS s FROM e JOIN d ON d.unique_id = e.unique_id AND d.rn <= e.c GROUP BY 1, 2) SELECT unique_id, cutoff, round(coalesce(CASE WHEN s >= 0.01 THEN mae / s END, 0), 6) AS mase FROM s""")
def mase_by_cutoff(spark, sf):
    own = p1(spark, sf)
    return rounded(evaluate.mase(validation.seasonal_cv(own, 7, 7, 3), own, "seasonal_naive", 7), ["mase"])


@query(f"WITH {P2} SELECT unique_id, count(*) AS n, 28 AS needed, count(*) || ' rows, 28 needed' AS reason FROM p GROUP BY 1 HAVING count(*) < 28")
def short_series(spark, sf):
    return panel.short_series(p2(spark, sf), "days", need=28)


# ---- hierarchies -------------------------------------------------------------------------------------------------

SPEC = [["total"], ["total", "region"], ["total", "region", "nation"]]
P5 = """b AS (SELECT 'all' AS total, r_name AS region, n_name AS nation, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS ds, round(sum(o_totalprice), 2) AS y
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 2, 3, 4)"""
_ALL = """h AS (SELECT 'all' AS unique_id, ds, sum(y) AS y, 'total' AS level FROM b GROUP BY ds UNION ALL SELECT 'all/' || region, ds, sum(y), 'total/region' FROM b GROUP BY region, ds
    UNION ALL SELECT 'all/' || region || '/' || nation, ds, sum(y), 'total/region/nation' FROM b GROUP BY region, nation, ds)"""


@query(f"WITH {P5}, {_ALL} SELECT unique_id, ds, round(y, 2) AS y, level FROM h")
def hier_grouping_sets(spark, sf):
    return rounded(hierarchy.aggregate(tables.nations_panel(spark, sf), SPEC), ["y"], 2)


@query(f"WITH {P5} SELECT DISTINCT unnest(['all', 'all/' || region, 'all/' || region || '/' || nation]) AS agg_id, 'all/' || region || '/' || nation AS bottom_id FROM b")
def hier_summing_edges(spark, sf):
    return hierarchy.summing_edges(tables.nations_panel(spark, sf), SPEC)


def _bottom(spark, sf):
    own = tables.nations_panel(spark, sf)
    return own, own.select(F.concat_ws("/", "total", "region", "nation").alias("unique_id"), "ds", "y")


_BOTTOM = "p AS (SELECT 'all/' || region || '/' || nation AS unique_id, region, ds, y FROM b), l AS (SELECT unique_id, region, max(ds) AS last, avg(y) AS m FROM p GROUP BY 1, 2), f AS (SELECT unique_id, region, last + to_months(CAST(k AS INTEGER)) AS ds, m FROM l, (SELECT unnest(range(1, 4)) AS k))"


@query(f"WITH {P5}, {_BOTTOM}, a AS (SELECT unnest(['all', 'all/' || region, unique_id]) AS unique_id, ds, m FROM f) SELECT unique_id, ds, round(sum(m), 1) AS hist_avg FROM a GROUP BY 1, 2")
def hier_bottom_up(spark, sf):
    own, bottom = _bottom(spark, sf)
    return rounded(hierarchy.bottom_up(forecast.hist_avg(bottom, 3, MS), hierarchy.summing_edges(own, SPEC), "hist_avg"), ["hist_avg"], 1)


@query(f"WITH {P5}, {_BOTTOM}, t AS (SELECT ds, sum(y) AS y FROM b GROUP BY 1), n AS (SELECT max(ds) AS last, max_by(y, ds) AS v FROM t), s AS (SELECT unique_id, sum(y) / (SELECT sum(y) FROM p) AS s FROM p GROUP BY 1) SELECT unique_id, last + to_months(CAST(k AS INTEGER)) AS ds, round(s * v, 1) AS naive FROM s, n, (SELECT unnest(range(1, 4)) AS k)")
def hier_top_down(spark, sf):
    own, bottom = _bottom(spark, sf)
    total = own.groupBy(F.lit("all").alias("unique_id"), "ds").agg(F.sum("y").alias("y"))
    return rounded(hierarchy.top_down(bottom, forecast.naive(total, 3, MS), "naive"), ["naive"], 1)


@query()
def hier_min_trace(spark, sf):
    own, _ = _bottom(spark, sf)
    base = forecast.hist_avg(hierarchy.aggregate(own, SPEC), 3, MS)
    return rounded(hierarchy.min_trace(base, hierarchy.summing_edges(own, SPEC), "hist_avg"), ["hist_avg"], 1)


@query(f"WITH {P1}, {POS} SELECT unique_id, '7-day-period-' || CAST((rn - 1) // 7 + 1 AS VARCHAR) AS temporal_id, max(ds) AS ds, round(sum(y), 3) AS y FROM r GROUP BY unique_id, (rn - 1) // 7 HAVING count(*) = 7")
def temporal_buckets(spark, sf):
    return rounded(hierarchy.temporal(p1(spark, sf), 7, "7-day-period"), ["y"], 3)


@query(f"WITH {P1} SELECT CAST(date_trunc('month', ds) AS TIMESTAMP) AS ds, max(CAST(CAST(ds AS DATE) = DATE '2024-01-10' AS INTEGER)) AS small FROM p GROUP BY 1")
def resample_max(spark, sf):
    return hierarchy.resample_max(C.special_dates(p1(spark, sf), {"small": ["2024-01-10"]}), "month", ["small"])


# ---- reshaping and streams ---------------------------------------------------------------------------------------


@query("SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_returnflag AS unique_id, TIMESTAMP '2024-01-01' + to_days(CAST(i AS INTEGER)) AS ds, v AS y FROM (SELECT l_orderkey, l_returnflag, sum(l_quantity) AS a, sum(l_tax) AS b FROM lineitem GROUP BY 1, 2), LATERAL (SELECT unnest([a, round(b, 6)]) AS v, unnest([0, 1]) AS i)")
def wide_to_long(spark, sf):
    wide = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey", "l_returnflag").agg(F.sum("l_quantity").alias("2024-01-01"), F.round(F.sum("l_tax"), 6).alias("2024-01-02"))
    return tables.unpivot_dates(wide, ["l_orderkey", "l_returnflag"])


@query("SELECT CAST(vec_id AS VARCHAR) AS unique_id, TIMESTAMP '2024-01-01' + to_days(CAST(i AS INTEGER)) AS ds, y FROM (SELECT vec_id, unnest(embedding) AS y, generate_subscripts(embedding, 1) - 1 AS i, len(embedding) AS n FROM embeddings) WHERE i >= n - 4")
def arrays_to_long(spark, sf):
    own = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("unique_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("start"), F.col("embedding").alias("target"))
    return tables.arrays_to_long(own, D, last=4)


@query("SELECT CAST(vec_id AS VARCHAR) AS unique_id, TIMESTAMP '2024-01-01' + to_days(CAST(i AS INTEGER)) AS ds, y FROM (SELECT vec_id, unnest(embedding) AS y, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)")
def arrays_to_long_whole(spark, sf):
    own = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("unique_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("start"), F.col("embedding").alias("target"))
    return tables.arrays_to_long(own, D)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Validated daily panel, seasonal-naive forecast of a week."""
    own = p1(spark, sf)
    grid.require_contiguous(own, D)
    return forecast.seasonal_naive(own, 7, D)
