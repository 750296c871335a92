"""Reading panels from files and tables, reshaping them to long form, and writing results once."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.freq import Freq


def parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def parquet_with_file(spark: SparkSession, glob: str, column: str = "file") -> DataFrame:
    """Many files as one table, with each row's file name."""
    return spark.read.parquet(glob).withColumn(column, F.element_at(F.split(F.input_file_name(), "/"), -1))


def csv_wide(spark: SparkSession, path: str, keys: Sequence[str], sep: str = "-", value: str = "y") -> DataFrame:
    """A wide CSV, a column for each date, as (unique_id, ds, y); the id joins the key columns. All columns are read as strings, so that nothing is inferred."""
    return unpivot_dates(spark.read.csv(path, header=True), keys, sep, value)


def unpivot_dates(wide: DataFrame, keys: Sequence[str], sep: str = "-", value: str = "y") -> DataFrame:
    dates = [c for c in wide.columns if c not in keys]
    own = wide.select(F.concat_ws(sep, *keys).alias("unique_id"), *[F.col(f"`{c}`").cast("double").alias(c) for c in dates])
    long = own.unpivot("unique_id", dates, "ds", value)
    return long.withColumn("ds", F.col("ds").cast("timestamp_ntz"))


def arrays_to_long(df: DataFrame, step: Freq, start: str = "start", target: str = "target", last: int | None = None, id: str = "unique_id") -> DataFrame:
    """Rows (id, start, array of values) as a long panel; of each array all values or the last few."""
    rows = df.select(id, F.col(start).alias("__s"), F.size(target).alias("__n"), F.posexplode(target).alias("__i", "y"))
    if last:
        rows = rows.filter(F.col("__i") >= F.col("__n") - last)
    return rows.select(id, step.add(F.col("__s"), F.col("__i")).alias("ds"), "y")


def synthetic_panel(spark: SparkSession, series: int, n: int, step: Freq, start: str = "2020-01-01", base: float = 100.0, trend: float = 0.1, amplitude: float = 10.0, season: int = 7, noise: float = 0.0, spikes: Mapping[int, float] | None = None, seed: int = 0) -> DataFrame:
    """(unique_id, ds, y): trend, a wave of one season, normal noise and shifts at given positions (from 0). Noise comes from hashes, so that partitions don't matter."""
    rows = spark.range(series * n).select(F.floor(F.col("id") / n).alias("s"), (F.col("id") % n).alias("i"))
    y = base + trend * F.col("i") + amplitude * F.sin(2 * math.pi * F.col("i") / season + F.col("s"))
    if noise:
        u, v = ((F.shiftrightunsigned(F.xxhash64("s", "i", F.lit(seed), F.lit(k)), 11) + 0.5) / float(1 << 53) for k in (1, 2))
        y += noise * F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)
    for at, shift in (spikes or {}).items():
        y += F.when(F.col("i") == at, float(shift)).otherwise(0.0)
    return rows.select(F.concat(F.lit("series_"), (F.col("s") + 1).cast("string")).alias("unique_id"), step.add(F.lit(start).cast("timestamp_ntz"), F.col("i")).alias("ds"), y.alias("y"))


def single_value(df: DataFrame, column: str):
    """The one value that a column holds, or an error."""
    n, v = df.agg(F.count_distinct(column), F.first(column, ignorenulls=True)).first()
    if n != 1:
        raise ValueError(f"{column} has {n} values instead of one")
    return v


def fold_case(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def repair_stamps(stamp: Column) -> Column:
    """Strings that end in a stray second are set to the minute."""
    return F.regexp_replace(stamp, ":01$", ":00")


def write_once(df: DataFrame, path: str, kind: str = "parquet") -> bool:
    """Writes df unless the path already has a finished result; tells whether it wrote."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return False
    df.write.mode("overwrite").format(kind).save(path)
    return True


def events_panel(spark: SparkSession, sf_dir: str, unit: str = "day", by: str = "event_type") -> DataFrame:
    """(unique_id, ds, y): sums of event values by type or user."""
    own = spark.read.parquet(f"{sf_dir}/events.parquet")
    return own.groupBy(F.col(by).cast("string").alias("unique_id"), F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("ds")).agg(F.round(F.sum("value"), 6).alias("y"))


def orders_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly order totals by priority."""
    own = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return own.groupBy(F.col("o_orderpriority").alias("unique_id"), F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("ds")).agg(F.round(F.sum("o_totalprice"), 2).alias("y"), F.count(F.lit(1)).cast("double").alias("x"))


def nations_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly order totals by region and nation: the bottom of a hierarchy. The dimensions are joined behind the aggregation by customer's nation."""
    read = lambda t, *c: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*c)
    orders = read("orders", "o_custkey", "o_orderdate", "o_totalprice").join(read("customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    by = orders.groupBy("c_nationkey", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("ds")).agg(F.round(F.sum("o_totalprice"), 2).alias("y"))
    named = by.join(read("nation", "n_nationkey", "n_name", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey")).join(read("region", "r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.select(F.lit("all").alias("total"), F.col("r_name").alias("region"), F.col("n_name").alias("nation"), "ds", "y")
