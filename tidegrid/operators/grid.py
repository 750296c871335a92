"""Time grids: gap filling, future stamps, contiguity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.freq import Freq, freq
from tidegrid.operators.panel import ROLES, Roles


def _edge(df: DataFrame, bound: str, per_series: Column, whole: Column, roles: Roles) -> Column:
    if bound == "per_serie":
        return per_series
    if bound == "global":
        return whole
    kind = dict(df.dtypes)[roles.time]
    return F.lit(int(bound) if kind in ("int", "bigint") else bound).cast(kind)


def id_time_grid(df: DataFrame, step: str | int | Freq, start: str = "per_serie", end: str = "global", roles: Roles = ROLES) -> DataFrame:
    """(id, time): every stamp of each series from start to end; each is per_serie, global or a stamp."""
    step = step if isinstance(step, Freq) else freq(step)
    ends = df.groupBy(roles.id).agg(F.min(roles.time).alias("lo"), F.max(roles.time).alias("hi"))
    if "global" in (start, end):
        ends = ends.crossJoin(F.broadcast(df.agg(F.min(roles.time).alias("all_lo"), F.max(roles.time).alias("all_hi"))))  # one row
    else:
        ends = ends.withColumns({"all_lo": F.col("lo"), "all_hi": F.col("hi")})
    first, last = _edge(df, start, F.col("lo"), F.col("all_lo"), roles), _edge(df, end, F.col("hi"), F.col("all_hi"), roles)
    return ends.select(roles.id, F.explode(step.grid(first, last)).alias(roles.time))


def fill_gaps(df: DataFrame, step: str | int | Freq, start: str = "per_serie", end: str = "global", roles: Roles = ROLES) -> DataFrame:
    """The grid with df's rows where it has them and nulls elsewhere."""
    return id_time_grid(df, step, start, end, roles).join(df, [roles.id, roles.time], "left").select(*df.columns)


def missing_dates(df: DataFrame, step: str | int | Freq, start: str = "per_serie", end: str = "global", roles: Roles = ROLES) -> DataFrame:
    return id_time_grid(df, step, start, end, roles).join(df.select(roles.id, roles.time), [roles.id, roles.time], "left_anti")


def future_grid(df: DataFrame, h: int, step: str | int | Freq, roles: Roles = ROLES) -> DataFrame:
    """(id, time, k): the h stamps behind each series' own last one."""
    step = step if isinstance(step, Freq) else freq(step)
    last = df.groupBy(roles.id).agg(F.max(roles.time).alias("last"))
    last = last.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(h))))
    return last.select(roles.id, step.add(F.col("last"), F.col("k")).alias(roles.time), "k")


def contiguity(df: DataFrame, step: str | int | Freq, roles: Roles = ROLES) -> DataFrame:
    """For each series n, n_distinct, n_expected and ok: no stamp is missing, repeated or off the grid from its first one."""
    step = step if isinstance(step, Freq) else freq(step)
    t = F.col(roles.time)
    on = df.withColumn("first", F.min(t).over(roles.whole)).withColumn("on", step.add(F.col("first"), step.steps(F.col("first"), t)) == t)
    by = on.groupBy(roles.id).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(t).alias("n_distinct"), (step.steps(F.min(t), F.max(t)) + 1).alias("n_expected"), F.bool_and("on").alias("on"))
    return by.withColumn("ok", (F.col("n") == F.col("n_distinct")) & (F.col("n") == F.col("n_expected")) & F.col("on")).drop("on")


def require_contiguous(df: DataFrame, step: str | int | Freq, roles: Roles = ROLES) -> None:
    bad = contiguity(df, step, roles).filter(~F.col("ok")).select(roles.id).limit(5).collect()
    if bad:
        raise ValueError(f"series with missing or repeated stamps, or stamps off the grid: {[r[0] for r in bad]}")


def calendar_positions(calendar: DataFrame, time: str = "ds") -> DataFrame:
    """(time, biz): places of a custom calendar's stamps in order, for arithmetic on business days or hours."""
    from pyspark.sql import Window

    return calendar.select(time).distinct().withColumn("biz", F.row_number().over(Window.orderBy(time)))


def future_on_calendar(df: DataFrame, h: int, calendar: DataFrame, roles: Roles = ROLES) -> DataFrame:
    """future_grid() on the stamps of a calendar table."""
    places = calendar_positions(calendar, roles.time)
    last = df.groupBy(roles.id).agg(F.max(roles.time).alias(roles.time)).join(places, roles.time)
    last = last.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(h)))).select(roles.id, "k", (F.col("biz") + F.col("k")).alias("biz"))
    return last.join(places, "biz").select(roles.id, roles.time, "k")


def interpolate(df: DataFrame, roles: Roles = ROLES) -> DataFrame:
    """Null targets on the line between the nearest known ones by position; before the first and behind the last, the nearest."""
    from pyspark.sql import Window

    y = F.col(roles.target)
    up = roles.rising.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = roles.rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = df.withColumn("__rn", F.row_number().over(roles.rising))
    here = F.when(y.isNotNull(), F.struct(F.col("__rn").alias("rn"), y.alias("y")))
    rows = rows.withColumn("__a", F.last(here, ignorenulls=True).over(up)).withColumn("__b", F.first(here, ignorenulls=True).over(down))
    slope = (F.col("__b.y") - F.col("__a.y")) / F.nullif((F.col("__b.rn") - F.col("__a.rn")).cast("double"), F.lit(0.0))
    line = F.col("__a.y") + slope * (F.col("__rn") - F.col("__a.rn"))
    return rows.withColumn(roles.target, F.coalesce(y, line, F.col("__a.y"), F.col("__b.y"))).drop("__rn", "__a", "__b")


def lags(df: DataFrame, shifts: list[int], windows: list[int], roles: Roles = ROLES) -> DataFrame:
    """df with lag_k, and mean_w and std_w over the w rows in front of each row."""
    new = {f"lag_{k}": F.lag(roles.target, k).over(roles.rising) for k in shifts}
    for w in windows:
        before = roles.rising.rowsBetween(-w, -1)
        new |= {f"mean_{w}": F.avg(roles.target).over(before), f"std_{w}": F.stddev_samp(roles.target).over(before)}
    return df.withColumns(new)
