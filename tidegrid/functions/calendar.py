"""Calendar features as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weekdays count from Monday as 0, weeks are ISO weeks.
PARTS: dict[str, Callable[[Column], Column]] = {
    "year": F.year, "quarter": F.quarter, "month": F.month, "week": F.weekofyear, "day": F.day, "weekday": F.weekday,
    "dayofyear": F.dayofyear, "hour": F.hour, "minute": F.minute, "second": F.second,
    "millisecond": lambda c: F.floor(F.date_format(c, "SSSSSS").cast("int") / 1000).cast("int"),
    "microsecond": lambda c: F.date_format(c, "SSSSSS").cast("int"),
}
_BY_UNIT = {
    "months": ["year", "month"], "days": ["year", "month", "day", "weekday"], "hours": ["year", "month", "day", "hour"],
    "minutes": ["year", "month", "day", "hour", "minute"], "seconds": ["year", "month", "day", "hour", "minute", "second"],
}


def default_parts(unit: str, step: int = 1) -> list[str]:
    """The parts that a frequency gets unless others are named; weekly steps have week and weekday, quarters the quarter, years the year alone."""
    if unit == "days" and step % 7 == 0:
        return ["year", "week", "weekday"]
    if unit == "months" and step % 12 == 0:
        return ["year"]
    if unit == "months" and step % 3 == 0:
        return ["year", "quarter"]
    return _BY_UNIT.get(unit, [])


def date_features(df: DataFrame, features: Sequence[str | Callable[[Column], Mapping[str, Column]]], time: str = "ds") -> DataFrame:
    """df with a column for each part; a callable gives named columns of its own."""
    new: dict[str, Column] = {}
    for f in features:
        new |= f(F.col(time)) if callable(f) else {f: PARTS[f](F.col(time)).cast("int")}
    return df.withColumns(new)


def one_hot(df: DataFrame, column: str, values: Sequence | None = None) -> DataFrame:
    """df with a 0/1 column for each value, in ascending order. Give the values, or the distinct ones are looked up: on history and future together, so that both have the same columns."""
    values = sorted(r[0] for r in df.select(column).distinct().limit(10_001).collect() if r[0] is not None) if values is None else values
    if len(values) > 10_000:
        raise ValueError(f"{column} has too many values for columns of their own")
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)) for v in values})


def special_dates(df: DataFrame, dates: Mapping[str, Sequence[str]], time: str = "ds") -> DataFrame:
    return df.withColumns({name: F.to_date(time).isin([F.lit(d).cast("date") for d in days]).cast("int") for name, days in dates.items()})


def holidays(df: DataFrame, table: DataFrame, countries: Sequence[str], names: Sequence[tuple[str, str]], time: str = "ds") -> DataFrame:
    """A 0/1 column `country_name` for each of the names, from a table (country, name, date) of a calendar's size."""
    known = {c for c, _ in names}
    if missing := [c for c in countries if c not in known]:
        raise ValueError(f"no holidays for {missing}")
    own = [(c, n) for c, n in names if c in set(countries)]
    wide = table.filter(F.col("country").isin(list(countries))).groupBy("date").agg(*[F.max(((F.col("country") == c) & (F.col("name") == n)).cast("int")).alias(f"{c}_{n}") for c, n in own])
    met = df.withColumn("__day", F.to_date(time)).join(wide.withColumnRenamed("date", "__day"), "__day", "left").drop("__day")
    return met.withColumns({f"{c}_{n}": F.coalesce(F.col(f"`{c}_{n}`"), F.lit(0)) for c, n in own})


def fourier(position: Column, season: int, k: int) -> dict[str, Column]:
    """sin and cos of the first k harmonics of a season along a position."""
    turn = lambda i: position * (2 * math.pi * i / season)
    return {f"{f.__name__}{i}_{season}": f(turn(i)) for f in (F.sin, F.cos) for i in range(1, k + 1)}


def cyclic(part: Column, period: int, name: str) -> dict[str, Column]:
    return {f"{name}_sin": F.round(F.sin(part * (2 * math.pi / period)), 4), f"{name}_cos": F.round(F.cos(part * (2 * math.pi / period)), 4)}


def weekday_dummies(time: str = "ds") -> dict[str, Column]:
    return {f"day_{i}": (F.weekday(time) == i).cast("int") for i in range(7)}
