"""What the corpus operators share: reading tables, cutting lineage, joins on keys that may be hot, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and the controls tab to carriage return.
WS = "\\x20\\x09-\\x0D"
#: A table of at most so many bytes may be broadcast.
BROADCAST_BYTES = 32 << 20
#: A key is hot if it holds more than this part of all rows; so there are at most so many of them.
HOT_KEYS = 500
#: Rows and bytes of an Arrow batch of whole texts.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20

_written: list[str] = []


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, local mode gets a temporary folder; a cluster has no place that would do, so that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tidegrid-")
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Lets Arrow batches to Python hold BATCH_ROWS rows and BATCH_BYTES bytes, where the session still has Spark's defaults: rows are whole texts, and a batch is held by the JVM and by the worker at once.

    These are settings of the session, read when a plan runs, so they can't be taken back here. They change no result."""
    for name, usual, own in (("maxRecordsPerBatch", 10_000, BATCH_ROWS), ("maxBytesPerBatch", 64 << 20, BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(key, str(usual)).rstrip("b") == str(usual):
            spark.conf.set(key, str(own))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: the lineage ends there, and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _written:
        _written.remove(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables from materialize() that nothing reads any more: all that was made of them is a table of its own by now."""
    for t in tables:
        if path := getattr(t, "_table", None):
            _delete(t.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Deletes what materialize() wrote and nobody discarded. Call it when the results of all operators have been written or read."""
    for path in list(_written):
        _delete(spark, path)


def checked_broadcast(df: DataFrame, row_bytes: int | Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if its rows take at most limit bytes; otherwise df as it is, for a shuffled join.

    row_bytes is a row's size, or an expression for it where rows hold arrays or text; the sum is taken first, so df should be cheap to read, such as a table from materialize()."""
    size = df.count() * row_bytes if isinstance(row_bytes, int) else df.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def hot_join(rows: DataFrame, groups: DataFrame, on: Sequence[str], count: str, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) to groups, which have one row for each key with `count`, the number of rows that hold the key.

    A key that holds more than one in HOT_KEYS of these rows is hot. There are at most HOT_KEYS such keys however large the
    tables are, so that part of groups is broadcast and hot rows stay where they are; the others are shuffled."""
    total = groups.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > max(total / HOT_KEYS, 1000)
    if not groups.filter(hot).limit(1).count():
        return rows.join(groups, list(on), how)
    names = [c for c in groups.columns if c not in on]
    tagged = groups.filter(hot).select(*on, F.struct(F.lit(True).alias("hot"), *names).alias("__hot"))
    marked = rows.join(F.broadcast(tagged), list(on), "left")
    split = marked.filter("__hot is not null").select(*rows.columns, *[F.col(f"__hot.{c}").alias(c) for c in names])
    usual = marked.filter("__hot is null").select(*rows.columns).join(groups.filter(~hot), list(on), how)
    return usual.select(*split.columns).unionByName(split)


def normalised(text: Column) -> Column:
    """Null as empty; each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WS}]+", " ")
