"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then a hash of the whole text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import checked_broadcast, discard, hot_join, materialize, normalised

PREFIX_CHARS = 256


def _shared(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: Sequence[str] = (), derive: dict[str, Column] | None = None) -> DataFrame:
    """key, the carried and derived columns, keep_id, group_size and kept, one row for each row of docs.

    Texts are equal if they are identical once runs of white space are single spaces; null counts as empty. The row
    with the smallest key of each group stays, one without a key only where none has one. Rows that repeat a key and its text are one
    document: they are counted in group_size and are kept or dropped alike. Other columns, whatever their names, don't
    matter; an empty table gives an empty result.

    Each text is read and normalised once for its length and the hash of its first PREFIX_CHARS characters, and for the
    `derive` expressions, which may use the normalised text as __norm. Texts whose length, or whose length and prefix, nobody
    shares are then done; only the others are read again and hashed whole (SHA-256), however long they are. Carry
    small columns only: they take part in a shuffle."""
    derive = derive or {}
    small = [F.col(f"`{c}`") for c in carry]
    base = docs.select(F.col(key).alias("__key"), F.struct(F.lit(0).alias("__"), *small).alias("__carry"), normalised(F.col(text)).alias("__norm"))
    sides = [F.octet_length("__norm").alias("__len"), F.xxhash64(F.substring("__norm", 1, PREFIX_CHARS)).alias("__head")]
    more = F.struct(F.lit(0).alias("__"), *[e.alias(c) for c, e in derive.items()]).alias("__more")
    rows = materialize(base.select("__key", "__carry", more, *sides), "dedup-rows")

    lengths = materialize(_shared(rows, "__len"), "dedup-lengths")
    heads = materialize(_shared(hot_join(rows.select("__len", "__head"), lengths, ["__len"], "__n").drop("__n"), "__len", "__head"), "dedup-heads")
    marked = materialize(hot_join(rows, heads, ["__len", "__head"], "__n", "left"), "dedup-marked")
    keys = materialize(marked.filter("__n is not null").select(F.col("__key").alias("__k")).distinct(), "dedup-keys")

    again = base.join(checked_broadcast(keys, 16), F.col("__key").eqNullSafe(F.col("__k")), "left_semi")
    again = again.select("__key", "__carry", more, *sides, F.sha2(F.col("__norm").cast("binary"), 256).alias("__full"))
    # a key's rows may have different texts, of which not all are open
    hashed = materialize(again.join(checked_broadcast(heads.select("__len", "__head"), 16), ["__len", "__head"], "left_semi").drop("__len", "__head"), "dedup-hashes")
    groups = materialize(hashed.groupBy("__full").agg(F.min("__key").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "dedup-groups")
    met = hot_join(hashed, groups, ["__full"], "group_size").select("__key", "__carry", "__more", "keep_id", "group_size")
    single = marked.filter("__n is null").select("__key", "__carry", "__more", F.col("__key").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    discard(rows, lengths, heads, keys)
    out = met.unionByName(single).withColumn("kept", F.col("__key").eqNullSafe(F.col("keep_id")))
    return out.select(F.col("__key").alias(key), *[F.col(f"__carry.`{c}`").alias(c) for c in carry], *[F.col(f"__more.`{c}`").alias(c) for c in derive], "keep_id", "group_size", "kept")
