"""Long panels of series: roles of columns, positions, tails, summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Roles:
    """Names of the series, time and target columns."""

    id: str = "unique_id"
    time: str = "ds"
    target: str = "y"

    @property
    def rising(self):
        return Window.partitionBy(self.id).orderBy(self.time)

    @property
    def falling(self):
        return Window.partitionBy(self.id).orderBy(F.col(self.time).desc())

    @property
    def whole(self):
        return Window.partitionBy(self.id)


ROLES = Roles()


def check_schema(df: DataFrame, roles: Roles = ROLES) -> DataFrame:
    """df with a usable time column, or an error; string and date stamps become timestamps without zone. Runs no job."""
    kinds = dict(df.dtypes)
    if missing := [c for c in (roles.id, roles.time, roles.target) if c not in kinds]:
        raise ValueError(f"missing columns: {missing}")
    if kinds[roles.target] not in ("double", "float", "int", "bigint", "smallint", "tinyint") and not kinds[roles.target].startswith("decimal"):
        raise ValueError(f"{roles.target} is not numeric but {kinds[roles.target]}")
    if kinds[roles.time] in ("string", "date"):
        return df.withColumn(roles.time, F.col(roles.time).cast("timestamp_ntz"))
    if not (kinds[roles.time].startswith("timestamp") or kinds[roles.time] in ("int", "bigint")):
        raise ValueError(f"{roles.time} is neither a stamp nor a whole number but {kinds[roles.time]}")
    return df


def single_series(df: DataFrame, roles: Roles = ROLES) -> DataFrame:
    """df with the constant series 0 where it has no id."""
    return df if roles.id in df.columns else df.withColumn(roles.id, F.lit(0))


def with_positions(df: DataFrame, roles: Roles = ROLES) -> DataFrame:
    """df with rn, from 1, and n, the series' length: one exchange and sort, which other windows by series share."""
    return df.withColumns({"rn": F.row_number().over(roles.rising), "n": F.count(F.lit(1)).over(roles.whole)})


def series_stats(df: DataFrame, roles: Roles = ROLES) -> DataFrame:
    return df.groupBy(roles.id).agg(F.count(F.lit(1)).alias("n"), F.min(roles.time).alias("first_ds"), F.max(roles.time).alias("last_ds"), F.avg(roles.target).alias("mean"), F.stddev_samp(roles.target).alias("std"))


def dataset_summary(df: DataFrame, roles: Roles = ROLES) -> DataFrame:
    """One row: series, observations, mean and deviation of the lengths and their range."""
    sizes = df.groupBy(roles.id).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_series"), F.sum("n").alias("n_obs"), F.avg("n").alias("mean_length"), F.stddev_samp("n").alias("std_length"), F.min("n").alias("min_length"), F.max("n").alias("max_length"))


def tail(df: DataFrame, n: int, roles: Roles = ROLES, skip: int = 0) -> DataFrame:
    """The last n rows of each series in front of the last `skip`. Only they leave the map side."""
    at = F.row_number().over(roles.falling)
    return df.withColumn("__at", at).filter((F.col("__at") <= n + skip) & (F.col("__at") > skip)).drop("__at")


def holdout(df: DataFrame, h: int, roles: Roles = ROLES) -> DataFrame:
    """df with `part`: test for the last h rows of each series, else train."""
    return df.withColumn("part", F.when(F.row_number().over(roles.falling) <= h, "test").otherwise("train"))


def at_least(df: DataFrame, n: int, roles: Roles = ROLES) -> DataFrame:
    """The series of n rows or more."""
    long = df.groupBy(roles.id).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= n).select(roles.id)
    return df.join(long, roles.id, "left_semi")


def require_length(df: DataFrame, n: int, roles: Roles = ROLES) -> None:
    least = df.groupBy(roles.id).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0]
    if least is not None and least < n:
        raise ValueError(f"the shortest series has {least} rows; {n} are needed")


#: Rows that a series should have, by the unit of its frequency.
MIN_HISTORY = {"hours": 1008, "days": 300, "weeks": 64}
OTHER_HISTORY = 48


def short_series(df: DataFrame, unit: str, step: int = 1, need: int | None = None, roles: Roles = ROLES) -> DataFrame:
    """(id, n, needed, reason) of series with fewer rows than a frequency's minimum, or than `need`."""
    unit = "weeks" if unit == "days" and step % 7 == 0 else unit
    least = need if need is not None else MIN_HISTORY.get(unit, OTHER_HISTORY)
    rows = df.groupBy(roles.id).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < least).withColumn("needed", F.lit(least))
    return rows.withColumn("reason", F.format_string("%d rows, %d needed", "n", "needed"))


def require_complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df, or an error if a left join left one of the columns without a value. One pass."""
    holes = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns]).first().asDict()
    if holes := {c: n for c, n in holes.items() if n}:
        raise ValueError(f"rows without a value: {holes}")
    return df


def same_ids(a: DataFrame, b: DataFrame, roles: Roles = ROLES) -> bool:
    """Whether two panels have the same series."""
    x, y = a.select(roles.id).distinct(), b.select(roles.id).distinct()
    return not x.exceptAll(y).limit(1).count() and not y.exceptAll(x).limit(1).count()


def dedupe(df: DataFrame, rules: Mapping[str, str | Column], roles: Roles = ROLES) -> DataFrame:
    """One row per series and stamp; every other column needs a rule: an aggregate's name, or an expression."""
    if missing := [c for c in df.columns if c not in (roles.id, roles.time) and c not in rules]:
        raise ValueError(f"no rule for {missing}")
    aggs = [(getattr(F, rule)(c) if isinstance(rule, str) else rule).alias(c) for c, rule in rules.items()]
    return df.groupBy(roles.id, roles.time).agg(*aggs)


def first_of_each(df: DataFrame, order: Sequence[str], roles: Roles = ROLES) -> DataFrame:
    """Of rows with one series and stamp the first by `order`, which should be a total order."""
    w = Window.partitionBy(roles.id, roles.time).orderBy(*order)
    return df.withColumn("__at", F.row_number().over(w)).filter("__at = 1").drop("__at")


def sample_series(df: DataFrame, n: int, roles: Roles = ROLES, digest: str = "md5") -> DataFrame:
    """The rows of the n series whose ids have the least digests; the same ones in each run."""
    ids = df.select(roles.id).distinct().withColumn("__h", getattr(F, digest)(F.col(roles.id).cast("string")))
    return df.join(ids.orderBy("__h", roles.id).limit(n).select(roles.id), roles.id, "left_semi")


def hash_batches(df: DataFrame, n: int, roles: Roles = ROLES) -> DataFrame:
    """df with a batch from 0 to n - 1 by the first 8 digits of the id's MD5, which other engines have too."""
    return df.withColumn("batch", F.conv(F.substring(F.md5(F.col(roles.id).cast("string")), 1, 8), 16, 10).cast("long") % n)


def infer_frequency(df: DataFrame, roles: Roles = ROLES) -> str:
    """The alias of the commonest distance between neighbours in the longest series (ties: the smallest id)."""
    top = df.groupBy(roles.id).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), roles.id).limit(1)
    own = df.join(top.select(roles.id), roles.id, "left_semi").withColumn("__p", F.lag(roles.time).over(roles.rising)).filter("__p is not null")
    months = (F.year(roles.time) - F.year("__p")) * 12 + F.month(roles.time) - F.month("__p")
    seconds = F.unix_timestamp(F.col(roles.time).cast("timestamp")) - F.unix_timestamp(F.col("__p").cast("timestamp"))
    same_day = F.day(roles.time) == F.day("__p")
    row = own.groupBy(F.when(same_day & (months > 0), months).otherwise(0).alias("m"), F.when(same_day & (months > 0), 0).otherwise(seconds).alias("s")).count().orderBy(F.col("count").desc(), "m", "s").first()
    if row is None:
        raise ValueError("no series has two rows")
    if row["m"]:
        return {1: "MS", 3: "QS", 12: "YS"}.get(row["m"], f"{row['m']}MS")
    for size, alias in ((604800, "W"), (86400, "D"), (3600, "h"), (60, "min"), (1, "s")):
        if row["s"] and row["s"] % size == 0:
            return f"{row['s'] // size if row['s'] != size else ''}{alias}"
    raise ValueError("stamps repeat")
