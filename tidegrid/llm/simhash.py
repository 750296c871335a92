"""SimHash near-duplicates: fingerprints, pigeonhole blocks, links and components.

A fingerprint has a bit set where more than half of the hashes of a text's word shingles have it set. Two texts
are linked if their fingerprints differ in at most `distance` bits. 64 bits in distance + extra blocks: a linked
pair agrees in at least `extra` whole blocks, so it meets in one of the tables that are keyed by `extra` blocks each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import hot_join, materialize, small_batches
from tidegrid.llm.components import connected_components, forest

SEED = 42
_RUN = re.compile(rb"[\x20\x09-\x0D]+")
_CHUNK = 1 << 16
#: Fingerprints of one bucket that one task compares; larger buckets are dealt out as pairs of parts.
BUCKET_ROWS = 4096


def normal_bytes(text: str) -> bytes:
    """UTF-8 with A-Z in lower case and words joined by single spaces."""
    low = text.encode("utf-8", "surrogatepass").lower()
    return b" ".join(low.split()) if len(low) < 1 << 20 else _RUN.sub(b" ", low).strip(b" ")


def shingle_bounds(buf: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the n-word shingles in a text from normal_bytes(); all of it if it has fewer words."""
    if not buf:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(buf, np.uint8) == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(buf)]))
    return (starts[: 1 - n or None], ends[n - 1 :]) if len(starts) >= n else (starts[:1], ends[-1:])


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """Hashes of a text's n-word shingles, in order."""
    buf, digest = normal_bytes(text or ""), xxhash.xxh64_intdigest
    starts, ends = shingle_bounds(buf, n)
    parts = []
    for at in range(0, len(starts), _CHUNK):
        part = zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist(), strict=True)
        parts.append(np.array([digest(buf[s:e], SEED) for s, e in part], np.uint64))
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes; zero of none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # sums of at most 255 bits fit a byte, and bytes add up fastest
            counts += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, n: int = 4) -> int:
    """The 64-bit fingerprint as an unsigned integer; zero without any word."""
    return majority(shingle_hashes(text, n))


def with_fingerprint(docs: DataFrame, n: int = 4, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of `text` as a signed long in the column `into`, which replaces one of that name; other columns pass through.

    Null, empty and wordless texts have fingerprint 0. Equal texts get equal ones; an empty table stays empty. A text is
    read whole, however long it is; its hashes, 8 bytes a word, are held by a task."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, n) for t in texts], np.uint64).view(np.int64))

    small_batches(docs.sparkSession)
    return docs.withColumn(into, prints(F.col(text)))


def block_masks(distance: int, extra: int) -> list[int]:
    """Masks over 64 bits, one for each choice of `extra` of distance + extra blocks."""
    edges = np.linspace(0, 64, distance + extra + 1).round().astype(int)
    blocks = [(1 << int(b)) - (1 << int(a)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(c) for c in combinations(blocks, extra)]


def blocks_for(rows: int, distance: int, most: int = 4) -> int:
    """Blocks that a table's key should join so that buckets stay small: with `extra` of distance + extra blocks a key has 64 * extra / (distance + extra) bits."""
    return next((e for e in range(2, most) if rows >> 64 * e // (distance + e) <= 16), most)


def _pairs(a: np.ndarray, b: np.ndarray | None, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Close pairs within a, or between a and b, compared a slice of rows at a time."""
    other = a if b is None else b
    step = max(1, (1 << 20) // max(1, len(other)))
    for at in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[at : at + step, None] ^ other[None, at if b is None else 0 :]) <= distance)
        x, y = a[at + i], other[j + (at if b is None else 0)]
        keep = x != y
        yield x[keep], y[keep]


def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by bucket: a spanning forest of the links within each bucket. Keeps one bucket in memory, of BUCKET_ROWS rows for each of its two parts at most."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: list[pa.RecordBatch] = []

    def solve(t: pa.Table) -> pa.RecordBatch | None:
        key, sub, side, fp = (t.column(c).to_numpy() for c in ("key", "sub", "side", "fp"))
        fp = fp.astype(np.int64).view(np.uint64)
        cut = np.flatnonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1])) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(key)]))
        out_a, out_b = [], []
        sizes = ends - starts
        two = starts[sizes == 2]  # most buckets hold a pair
        hit = two[(side[two] != side[two + 1]) | (side[two] == 0)]
        hit = hit[np.bitwise_count(fp[hit] ^ fp[hit + 1]) <= distance]
        out_a.append(fp[hit]), out_b.append(fp[hit + 1])
        for s, e in zip(starts[sizes > 2], ends[sizes > 2], strict=True):
            own, left = fp[s:e], side[s:e]
            pairs = list(_pairs(own, None, distance) if left[0] == 0 else _pairs(own[left == 1], own[left == 2], distance))
            x, y = np.concatenate([p[0] for p in pairs] or [fp[:0]]), np.concatenate([p[1] for p in pairs] or [fp[:0]])
            x, y = forest(x, y)
            out_a.append(x), out_b.append(y)
        a, b = np.concatenate(out_a).view(np.int64), np.concatenate(out_b).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema) if len(a) else None

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held)
        key, sub = t.column("key").to_numpy(), t.column("sub").to_numpy()
        open_from = _tail(key, sub)
        if open_from and (done := solve(t.slice(0, open_from))):
            yield done
        held = t.slice(open_from).combine_chunks().to_batches()
    if held and (done := solve(pa.Table.from_batches(held))):
        yield done


def _tail(key: np.ndarray, sub: np.ndarray) -> int:
    """Where the last bucket, which may go on in the next batch, begins."""
    other = np.flatnonzero((key != key[-1]) | (sub != sub[-1]))
    return int(other[-1]) + 1 if len(other) else 0


def close_links(prints: DataFrame, distance: int = 4, extra: int | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that connect all pairs within `distance` bits: of each bucket a spanning forest, not all pairs.

    Of how many blocks a key consists follows from the number of fingerprints, so that the pairs that meet grow with it and not
    with its square: random ones meet in buckets of 16 at most up to 2 ** 25 of them by two blocks, 2 ** 31 by three, 2 ** 36 by
    four. Buckets above bucket_rows are dealt out: their fingerprints fall into parts by a hash, and each pair of parts is a bucket of its own."""
    spark, masks = prints.sparkSession, block_masks(distance, extra or blocks_for(prints.count(), distance))
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64)))) for i, m in enumerate(masks)])
    rows = materialize(prints.select("fp", F.explode(keys).alias("key")), "simhash-blocks")
    sizes = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "simhash-sizes")
    hot = sizes.filter(F.col("m") > bucket_rows)
    rows = hot_join(rows, sizes, ["key"], "m")
    plain = rows.filter(F.col("m") <= bucket_rows).select("key", F.lit(0).alias("sub"), F.lit(0).alias("side"), "fp")
    if hot.limit(1).count():
        parts = F.ceil(2 * F.col("m") / bucket_rows).cast("int")
        split = rows.filter(F.col("m") > bucket_rows).select("key", "fp", parts.alias("p"), F.pmod(F.xxhash64("fp", F.lit(7)), parts).cast("int").alias("i"))
        other = F.explode(F.sequence(F.lit(0), F.col("p") - 1))
        split = split.select("key", "fp", "p", "i", other.alias("j"))
        low, high = F.least("i", "j"), F.greatest("i", "j")
        plain = plain.unionByName(split.select("key", (1 + low * F.col("p") + high).alias("sub"), F.when(F.col("i") == F.col("j"), 0).when(F.col("i") < F.col("j"), 1).otherwise(2).alias("side"), "fp"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = plain.repartition(n, "key", "sub").sortWithinPartitions("key", "sub", "side")
    return dealt.mapInArrow(lambda it: _links(it, distance), "a long, b long")


def simhash_groups(docs: DataFrame, n: int = 4, distance: int = 4, key: str = "doc_id", text: str = "text", extra: int | None = None) -> DataFrame:
    """One row for each row of docs: key, fingerprint (long) and component_id, the smallest key that chains of links reach.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows get equal rows; extra
    columns are ignored. An empty table gives an empty result."""
    prints = materialize(with_fingerprint(docs.select(key, text), n, text).select(key, F.col("fingerprint").alias("fp")), "simhash-prints")
    heads = materialize(prints.groupBy("fp").agg(F.min(key).alias("head"), F.count(F.lit(1)).alias("m")), "simhash-heads")
    parts = connected_components(close_links(heads.select("fp"), distance, extra))
    linked = heads.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = linked.groupBy("root").agg(F.min("head").alias("component_id"))
    named = materialize(linked.join(least, "root").select("fp", "component_id", "m"), "simhash-named")
    return hot_join(prints, named, ["fp"], "m").select(key, F.col("fp").alias("fingerprint"), "component_id")
