"""Data quality: five checks and the repairs of four of them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.grid import missing_dates
from tidegrid.operators.panel import ROLES, Roles, check_schema, dedupe

FAIL, CASE = ("D001", "D002", "F001"), ("V001", "V002")


def duplicate_rows(df: DataFrame, roles: Roles = ROLES) -> DataFrame:
    """D001: all rows that share series and stamp with another."""
    twice = df.groupBy(roles.id, roles.time).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")
    return df.join(twice, [roles.id, roles.time], "left_semi")


def categorical_columns(df: DataFrame, roles: Roles = ROLES) -> list[str]:
    """F001: columns of strings besides series and stamp. A look at the schema, no job."""
    return [c for c, kind in df.dtypes if kind == "string" and c not in (roles.id, roles.time)]


def negative_values(df: DataFrame, roles: Roles = ROLES) -> DataFrame:
    """V001."""
    return df.filter(F.col(roles.target) < 0)


def first_nonzero(df: DataFrame, roles: Roles = ROLES) -> DataFrame:
    """(id, first_ds, start_ds): a series' first stamp and that of its first value that isn't zero; a null value isn't."""
    live = F.col(roles.target).isNull() | (F.col(roles.target) != 0)
    return df.groupBy(roles.id).agg(F.min(roles.time).alias("first_ds"), F.min(F.when(live, F.col(roles.time))).alias("start_ds"))


def leading_zeros(df: DataFrame, roles: Roles = ROLES) -> DataFrame:
    """V002: series that begin with zeros and have other values behind them."""
    return first_nonzero(df, roles).filter("start_ds > first_ds")


def clip_negative(df: DataFrame, roles: Roles = ROLES) -> DataFrame:
    y = F.col(roles.target)
    return df.withColumn(roles.target, F.when(y < 0, F.lit(0).cast(dict(df.dtypes)[roles.target])).otherwise(y))


def trim_leading_zeros(df: DataFrame, roles: Roles = ROLES, drop_all_zero: bool = False) -> DataFrame:
    """Rows from the first value on that isn't zero; series of zeros stay whole, or go if drop_all_zero is set."""
    live = (F.col(roles.target).isNull() | (F.col(roles.target) != 0)).cast("int")
    so_far = F.max(live).over(roles.rising.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    keep = so_far == 1
    if not drop_all_zero:
        keep |= F.max(live).over(roles.whole) == 0
    return df.withColumn("__keep", keep).filter("__keep").drop("__keep")


@dataclass
class Audit:
    """all_pass, and the rows of each check that found some; D002 is None where duplicates hide it."""

    all_pass: bool
    fail: dict[str, DataFrame | None]
    case_specific: dict[str, DataFrame]


def audit(df: DataFrame, step: str | int, start: str = "per_serie", end: str = "global", roles: Roles = ROLES) -> Audit:
    df = check_schema(df, roles)
    fail: dict[str, DataFrame | None] = {}
    case: dict[str, DataFrame] = {}
    some = lambda d: bool(d.limit(1).count())
    if some(twice := duplicate_rows(df, roles)):
        fail |= {"D001": twice, "D002": None}
    elif some(gaps := missing_dates(df, step, start, end, roles)):
        fail["D002"] = gaps
    if words := categorical_columns(df, roles):
        fail["F001"] = df.select(*words)
    if some(below := negative_values(df, roles)):
        case["V001"] = below
    if some(zeros := leading_zeros(df, roles)):
        case["V002"] = zeros
    return Audit(not fail and not case, fail, case)


def report(df: DataFrame, step: str | int, start: str = "per_serie", end: str = "global", roles: Roles = ROLES) -> DataFrame:
    """(test_id, severity, n_rows) for all checks at once; D002 is null where stamps repeat."""
    df = check_schema(df, roles)
    one = lambda d, test, severity: d.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(test).alias("test_id"), F.lit(severity).alias("severity"), "n_rows")
    rows = one(duplicate_rows(df, roles), "D001", "fail")
    twice = F.broadcast(rows.select(F.col("n_rows").alias("twice")))  # one row
    gaps = one(missing_dates(df, step, start, end, roles), "D002", "fail").crossJoin(twice)
    rows = rows.unionByName(gaps.select("test_id", "severity", F.when(F.col("twice") == 0, F.col("n_rows")).alias("n_rows")))
    words = df.sparkSession.range(1).select(F.lit("F001").alias("test_id"), F.lit("fail").alias("severity"), F.lit(len(categorical_columns(df, roles))).cast("long").alias("n_rows"))
    return rows.unionByName(words).unionByName(one(negative_values(df, roles), "V001", "case_specific")).unionByName(one(leading_zeros(df, roles), "V002", "case_specific"))


def clean(df: DataFrame, found: Audit, step: str | int, clean_case_specific: bool = False, rules: Mapping[str, str | Column] | None = None, start: str = "per_serie", end: str = "global", roles: Roles = ROLES) -> tuple[DataFrame, Audit]:
    """df repaired as far as the audit's findings go, and its audit. Clipping can make new leading zeros, which a second pass trims."""
    df = check_schema(df, roles)
    if "D001" in found.fail:
        if not rules:
            raise ValueError("repeated stamps need an aggregation rule for each other column")
        df = dedupe(df, rules, roles)
    if found.fail.get("D002") is not None:
        df = df.unionByName(missing_dates(df, step, start, end, roles), allowMissingColumns=True)
    if clean_case_specific:
        if "V001" in found.case_specific:
            df = clip_negative(df, roles)
        if "V002" in found.case_specific:
            df = trim_leading_zeros(df, roles)
    return df, audit(df, step, start, end, roles)
