"""What features contribute to a linear forecast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.forecast import exogenous
from tidegrid.operators.models import regression
from tidegrid.operators.panel import ROLES, Roles


def contributions(df: DataFrame, future: DataFrame, x: str, roles: Roles = ROLES, name: str = "exogenous") -> DataFrame:
    """(id, time, name, feature, contribution): the feature's part and base_value, which sum to the forecast."""
    return to_long(exogenous(df, future, x, roles, name), [x, "base_value"], [roles.id, roles.time, name])


def contributions_of(df: DataFrame, future: DataFrame, xs: Sequence[str], roles: Roles = ROLES, name: str = "regression") -> DataFrame:
    """The same for a regression on several covariates."""
    return to_long(regression(df, future, xs, roles, name), [*xs, "base_value"], [roles.id, roles.time, name])


def to_long(wide: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return wide.unpivot(list(keys), list(features), "feature", "contribution")


def what_if(df: DataFrame, column: str, factors: Sequence[float]) -> DataFrame:
    """df once for each factor, with `scenario` and the column scaled."""
    rows = F.explode(F.array(*[F.struct(F.lit(f"x{f:g}").alias("scenario"), F.lit(float(f)).alias("factor")) for f in factors]))
    return df.withColumn("__s", rows).withColumns({"scenario": F.col("__s.scenario"), column: F.col(column) * F.col("__s.factor")}).drop("__s")
