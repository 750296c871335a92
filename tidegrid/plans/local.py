"""The entry points for frames in memory: pandas, or anything that turns into an Arrow table, in; the same kind out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidegrid.operators.panel import ROLES, Roles
from tidegrid.plans import api


@dataclass(frozen=True)
class Local:
    """Calls of plans.api with frames in memory. Results are sorted by series and stamp. What comes back must fit the driver, as what was given did."""

    spark: SparkSession
    roles: Roles = ROLES

    def frame(self, data: Any) -> DataFrame:
        """A Spark frame of pandas, Arrow or polars data; Spark frames stay as they are."""
        if isinstance(data, DataFrame):
            return data
        if hasattr(data, "to_arrow"):  # polars
            data = data.to_arrow()
        if isinstance(data, pa.Table):
            return self.spark.createDataFrame(data)
        data = data.copy()
        for c in data.columns:
            if isinstance(data[c].dtype, pd.CategoricalDtype):
                data[c] = data[c].astype(object)
        return self.spark.createDataFrame(data)

    def back(self, df: DataFrame, like: Any) -> Any:
        if isinstance(like, DataFrame):
            return df
        keys = [c for c in (self.roles.id, "cutoff", self.roles.time) if c in df.columns]
        rows = df.orderBy(*keys)
        if hasattr(like, "to_arrow"):
            return type(like)(rows.toArrow())
        return rows.toArrow() if isinstance(like, pa.Table) else rows.toPandas()

    def call(self, what: Callable[..., DataFrame], data: Any, *args, **how) -> Any:
        given = {k: self.frame(v) if k in ("future", "weights") and v is not None else v for k, v in how.items()}
        return self.back(what(self.frame(data), *args, roles=self.roles, **given), data)

    def forecast(self, data: Any, *args, **how) -> Any:
        return self.call(api.forecast_panel, data, *args, **how)

    def cross_validation(self, data: Any, *args, **how) -> Any:
        return self.call(api.cross_validation, data, *args, **how)

    def detect_anomalies(self, data: Any, *args, **how) -> Any:
        return self.call(api.detect_anomalies, data, *args, **how)

    def detect_anomalies_online(self, data: Any, *args, **how) -> Any:
        return self.call(api.detect_anomalies_online, data, *args, **how)

    def finetune(self, data: Any, *args, **how) -> Any:
        return self.call(api.finetune, data, *args, **how)

    def evaluate(self, data: Any, *args, **how) -> Any:
        return self.call(api.evaluate_forecasts, data, *args, **how)
