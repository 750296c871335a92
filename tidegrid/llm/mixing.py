"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame and SQL functions only.

A source's documents take target / source_size copies each. The whole part is certain; the rest, as a mass of words
between 0 and the document's size, is rounded in pairs: words move from one document of a pair to the other, in a
random direction whose odds keep each expected mass, until one of the two is left out or taken whole. The other goes on
to the next pair. The words of a pair stay the same in sum, so a source misses its target by one document at most.
Blocks of about BLOCK documents are rounded on their own; what each leaves over meets in blocks of the level above.
Rows that repeat a key and size are one item: among equal masses rounding in pairs leaves as many whole ones as fit and
one rest, which is what goes on, so that a hot key is one number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import WS, checked_broadcast, materialize

BLOCK = 512
_ITEM = "struct<size:bigint,key:bigint,mass:double>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WS}]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """From (source, size): one row per source with source_size, n, target and its place in the order of code points, null last.

    Targets share the whole size by the repeating weights; none is above `most` times its source's size, and what it
    would have beyond that goes to the others by weight. With sources in the order of limit / weight, the limited
    ones come first; the first that is not limited sets the words per weight of all that follow. Their order is that of
    all sources, so one task sorts them: a row of a few bytes for each source."""
    return _targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), weights, most)


def _targets(by: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    order = Window.orderBy(F.col("source").isNull(), "source")
    place = F.row_number().over(order) - 1
    by = by.withColumn("place", place).withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("place", F.lit(len(weights))) + 1))
    by = by.withColumn("most", F.col("source_size") * most)
    rising = Window.orderBy(F.col("most") / F.col("w"), "place")
    everything = Window.partitionBy()
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    rest = F.sum("w").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    by = by.withColumn("per", left / rest)
    free = F.col("most") > F.col("per") * F.col("w")
    level = F.first(F.when(free, F.col("per")), ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least("most", F.coalesce(level * F.col("w"), F.col("most")))
    return by.select("source", "source_size", "n", "place", target.alias("target"))


def _uniform(*what: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*what), 11) / float(1 << 53)


def _round_block(items: str, level: int, seed: int) -> str:
    """SQL: items one after another against the one carried; the result has the decided ones and the carried one."""
    u = f"(shiftrightunsigned(xxhash64(x.key, x.size, {seed}, {level}), 11) / 9007199254740992D)"
    up, down = "least(s.c.size - s.c.mass, x.mass)", "least(s.c.mass, x.size - x.mass)"
    carry = lambda who, mass: f"named_struct('size', {who}.size, 'key', {who}.key, 'mass', {mass})"
    say = lambda who, take: f"array_append(s.out, named_struct('key', {who}.key, 'size', {who}.size, 'take', {take}))"
    then = lambda c, out: f"named_struct('c', {c}, 'out', {out})"
    return f"""aggregate({items}, named_struct('c', cast(null as {_ITEM}), 'out', cast(array() as array<struct<key:bigint,size:bigint,take:int>>)), (s, x) -> case
        when s.c is null then {then(carry("x", "x.mass"), "s.out")}
        when {u} * ({up} + {down}) < {down} then case
            when s.c.size - s.c.mass <= x.mass then {then(carry("x", "x.mass - (s.c.size - s.c.mass)"), say("s.c", 1))}
            else {then(carry("s.c", "s.c.mass + x.mass"), say("x", 0))} end
        when s.c.mass <= x.size - x.mass then {then(carry("x", "x.mass + s.c.mass"), say("s.c", 0))}
        else {then(carry("s.c", "s.c.mass - (x.size - x.mass)"), say("x", 1))} end)"""


def _repeated(rows: DataFrame, count: str, chunk: int = 4096) -> DataFrame:
    """rows, each `count` times, without that column; no array holds more than `chunk` of them."""
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / chunk)))
    rows = rows.filter(F.col(count) > 0).withColumn("__at", at)
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(chunk).cast("long"), F.col(count) - F.col("__at") * chunk)))
    return rows.withColumn("__each", each).drop("__at", "__each", count)


def mix_sizes(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """From (key, source, size): key, source, size, source_size, target, copies, taken, a row for each row.

    Empty documents (size 0) get the certain copies only and take no words. Null keys and sources are a key and a source.
    Rows that repeat a key are rounded together, each of them to one copy more or less. The same rows give the same
    mix, in whatever order and partitions they come. An empty table gives an empty result."""
    items = materialize(sizes.groupBy("source", "key", "size").agg(F.count(F.lit(1)).alias("m")), "mix-items")
    by = items.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = materialize(_targets(by, weights, most), "mix-targets")
    top = targets.agg(F.max("n")).first()[0]
    if top is None:
        none = {"source_size": "long", "target": "double", "copies": "int", "taken": "long"}
        return items.select("key", "source", "size", *[F.lit(None).cast(k).alias(c) for c, k in none.items()])
    t = checked_broadcast(targets.withColumnRenamed("source", "__source"), 64 + F.coalesce(F.octet_length(F.col("__source").cast("string")), F.lit(0)))
    rows = items.join(t, items["source"].eqNullSafe(F.col("__source")))
    ratio = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.col("target") / F.col("source_size"), F.lit(float(most))))
    rows = rows.withColumn("ratio", ratio).withColumn("base", F.floor("ratio").cast("int"))
    parts = F.when(F.col("size") > 0, (F.col("ratio") - F.col("base")) * F.col("m")).otherwise(0.0)
    whole = F.floor(F.col("parts") + 1e-9 * F.col("m")).cast("long")
    rows = rows.withColumn("parts", parts).withColumn("whole", whole).withColumn("mass", F.greatest((F.col("parts") - F.col("whole")) * F.col("size"), F.lit(0.0)))
    keys = ["place", "source", "source_size", "target", "base"]
    n_blocks = F.ceil(F.col("n") / block)
    # an item's place in its block comes from its size first, so that documents of like size are paired
    first = rows.filter("mass > 0").groupBy(*keys, F.pmod(F.xxhash64("key", "size", F.lit(seed)), n_blocks).alias("block"))
    level = first.agg(F.array_sort(F.collect_list(F.struct("size", "key", "mass"))).alias("items"))
    decided, k, blocks = [], 0, -(-top // block)
    while True:
        done = materialize(level.select(*keys, "block", F.expr(_round_block("items", k, seed)).alias("r")), "mix-level")
        decided.append(done.select(*keys, F.explode("r.out").alias("d")).select(*keys, "d.*"))
        if blocks == 1:
            break
        k, blocks = k + 1, -(-blocks // block)
        level = done.groupBy(*keys, F.floor(F.col("block") / block).alias("block")).agg(F.array_sort(F.collect_list("r.c")).alias("items"))
    last = done.select(*keys, F.col("r.c.key").alias("key"), F.col("r.c.size").alias("size"), (_uniform(F.col("r.c.key"), F.lit(seed), F.lit(-1)) * F.col("r.c.size") < F.col("r.c.mass")).cast("int").alias("take"))
    rest = F.col("m") - F.col("whole") - (F.col("mass") > 0).cast("long")
    sure = F.explode(F.array(F.struct(F.lit(1).alias("take"), F.col("whole").alias("times")), F.struct(F.lit(0).alias("take"), rest.alias("times"))))
    out = _repeated(rows.select(*keys, "key", "size", sure.alias("s")).select(*keys, "key", "size", "s.*"), "times")
    for d in (last, *decided):
        out = out.unionByName(d)
    copies = F.col("base") + F.col("take")
    return out.select("key", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """docs with each row as often as the mix takes it; null texts count as empty, null keys and sources are a key and a source.

    Rows that repeat a key, source and size share their copies evenly; equal ones are one row that stands there as often as
    their sum says. Other columns pass through, whatever their names; an empty table stays empty."""
    named = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col(key).cast("long").alias("k"), F.col(source).alias("s"), word_count(F.col(text)).alias("z"))
    own = [f"c{i}" for i in range(len(docs.columns))]
    mixed = mix_sizes(named.select(F.col("k").alias("key"), F.col("s").alias("source"), F.col("z").alias("size")), **how)
    shares = mixed.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("m"), F.sum("copies").cast("long").alias("copies"))
    shares = materialize(shares.filter("copies > 0"), "mix-shares")
    size = 64 + F.coalesce(F.octet_length(F.col("source").cast("string")), F.lit(0))
    same = lambda: F.col("k").eqNullSafe(F.col("key")) & F.col("s").eqNullSafe(F.col("source")) & (F.col("z") == F.col("size"))
    once = _repeated(named.join(checked_broadcast(shares.filter("m = 1"), size), same()).select(*own, "copies"), "copies")
    again = shares.filter("m > 1")
    if again.limit(1).count():
        met = named.join(checked_broadcast(again, size), same()).groupBy(*own, "key", "source", "size", "m", "copies").agg(F.count(F.lit(1)).alias("r"))
        order = Window.partitionBy("key", "source", "size").orderBy(F.xxhash64(*own), *own)
        before = F.coalesce(F.sum("r").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        extra = F.greatest(F.least(F.pmod("copies", "m") - before, F.col("r")), F.lit(0))
        met = met.withColumn("times", F.col("r") * F.floor(F.col("copies") / F.col("m")) + extra)
        once = once.unionByName(_repeated(met.select(*own, "times"), "times"))
    return once.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
