"""Boilerplate lines: those that stand on many sites. DataFrame and SQL functions only.

For each line hash a HyperLogLog sketch of the sites it stands on is built and merged by aggregation. An estimate far
from the threshold decides at once; lines near it get an exact distinct count. Spread lines are then cut from the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import checked_broadcast, materialize

#: Of a sketch: log2 of its registers; and the part of the threshold around it in which the exact count decides, over six standard errors.
SKETCH_BITS, MARGIN = 12, 0.1
_BLANK = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def spread_lines(docs: DataFrame, site: str = "source", text: str = "text", min_sites: int = 8) -> DataFrame:
    """(h, n): hash and bytes of each line, without white space around it, that stands on min_sites sites or more. Blank lines never do; a null site is a site of its own."""
    line = F.btrim(F.col("line"), F.lit(_BLANK))
    rows = docs.select(F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("")).alias("site"), F.explode(_lines(F.col(text))).alias("line"))
    rows = rows.select("site", F.xxhash64(line).alias("h"), F.octet_length(line).alias("n")).filter("n > 0")
    sketches = rows.groupBy("h", "n").agg(F.hll_sketch_agg("site", F.lit(SKETCH_BITS)).alias("sketch"))
    guess = sketches.select("h", "n", F.hll_sketch_estimate("sketch").alias("sites"))
    guess = materialize(guess.filter(F.col("sites") >= min_sites * (1 - MARGIN)), "line-spread")
    sure = guess.filter(F.col("sites") > min_sites * (1 + MARGIN)).select("h", "n")
    near = materialize(guess.filter(F.col("sites") <= min_sites * (1 + MARGIN)).select("h", "n"), "line-near")
    exact = rows.join(checked_broadcast(near, 24), ["h", "n"], "left_semi").groupBy("h", "n").agg(F.count_distinct("site").alias("sites"))
    return sure.unionByName(exact.filter(F.col("sites") >= min_sites).select("h", "n"))


def line_dedup(docs: DataFrame, key: str = "doc_id", site: str = "source", text: str = "text", min_sites: int = 8) -> DataFrame:
    """docs with spread lines cut from `text`, and n_lines and n_removed (longs), which replace columns of these names.

    A document of spread lines only would become empty and stays as it is: removing whole copies is for the operators
    on documents. Null texts stay null, blank lines stay. Equal lines of one document are cut alike; rows that repeat a key and
    text are treated alike; null keys are keys. Other columns pass through; an empty table stays empty. A text's lines are
    handled as rows until what is cut is known; only for a document with cuts a number for each is gathered again."""
    spread = materialize(spread_lines(docs, site, text, min_sites), "line-boilerplate")
    own = docs.select(F.col(key).alias("__key"), F.xxhash64(F.col(text)).alias("__text"), F.posexplode(_lines(F.col(text))).alias("pos", "line"))
    line = F.btrim(F.col("line"), F.lit(_BLANK))
    own = own.select("__key", "__text", "pos", F.xxhash64(line).alias("h"), F.octet_length(line).alias("n"))
    hit = own.join(checked_broadcast(spread.withColumn("cut", F.lit(True)), 24), ["h", "n"], "left")
    # of each document with cuts and other text, which of its lines go; repeated rows say the same twice, which a set ignores
    each, other = F.struct("pos", F.coalesce("cut", F.lit(False)).alias("cut")), (F.col("n") > 0) & F.col("cut").isNull()
    marks = hit.groupBy("__key", "__text").agg(F.collect_set(each).alias("marks"), F.bool_or(F.coalesce("cut", F.lit(False))).alias("any"), F.bool_or(other).alias("other"))
    marks = materialize(marks.filter("any and other").select("__key", "__text", F.transform(F.array_sort("marks"), lambda x: x["cut"]).alias("__cut")), "line-marks")
    named = checked_broadcast(marks, 48 + F.size("__cut"))
    met = docs.join(named, docs[key].eqNullSafe(F.col("__key")) & (F.xxhash64(docs[text]) == F.col("__text")), "left")
    kept = F.array_join(F.filter(_lines(F.col(text)), lambda x, i: ~F.get("__cut", i)), "\n")
    n_lines, n_cut = F.size(_lines(F.col(text))).cast("long"), F.size(F.filter("__cut", lambda x: x)).cast("long")
    met = met.withColumn("__n", n_lines).withColumn("__m", F.when(F.col("__cut").isNull(), F.lit(0).cast("long")).otherwise(n_cut))
    met = met.withColumn(text, F.when(F.col("__cut").isNull(), F.col(text)).otherwise(kept))
    return met.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")], F.col("__n").alias("n_lines"), F.col("__m").alias("n_removed"))
