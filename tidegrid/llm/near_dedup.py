"""Near copies removed: one document of each group of similar texts stays.

Links come from SimHash fingerprints within `distance` bits, and from bands of min-hashes, since fingerprints of texts
that share only four fifths of their shingles often differ in ten bits or more, which blocks of 64 bits can't find.
Every link is verified: the Jaccard similarity of the texts' sets of word shingles. Sets are hashed once, and only those that
share a bucket are kept and shuffled. All pairs that meet in a bucket are compared, but for those that verified links
connect already.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import checked_broadcast, discard, hot_join, materialize, small_batches
from tidegrid.llm.components import connected_components
from tidegrid.llm.simhash import BUCKET_ROWS, block_masks, blocks_for, majority, shingle_hashes

#: Bands of a signature and min-hashes in each: a pair at similarity 0.8 misses all 16 bands of 5 once in 500.
BANDS, ROWS = 16, 5
#: Shingle sets of one bucket that one task holds and compares; larger buckets are dealt out as pairs of parts.
SET_ROWS = 1024

_rng = np.random.default_rng(7)
_MULTIPLY = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles."""
    return np.unique(shingle_hashes(text, n))


def bands(shingles: np.ndarray) -> np.ndarray:
    """One key for each band; texts without a word have a key of their own kind."""
    if not len(shingles):
        return np.arange(BANDS, dtype=np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        h = shingles[at : at + 2048, None] * _MULTIPLY + _ADD
        np.minimum(least, (h ^ (h >> np.uint64(29))).min(0), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = (key ^ least[r::ROWS]) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    return key


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


_SIGNED = pa.schema([("key", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("fp", pa.int64()), ("size", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _sign(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets, fp, size, keys = [], [], [], []
        for text in batch.column("text"):
            h = shingle_hashes(text.as_py(), n)
            s = np.unique(h)
            sets.append(blake2b(s.tobytes(), digest_size=16).digest())
            fp.append(majority(h))
            size.append(len(s))
            keys.append(bands(s).view(np.int64))
        digest = np.frombuffer(b"".join(sets), np.int64).reshape(-1, 2)
        columns = [pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column("key"), *columns], schema=_SIGNED)


def _verify(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets are similar."""
    for batch in batches:
        out = []
        for a, b, x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
            if similarity(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) >= least:
                out.append((a, b))
        if out:
            yield _pair_batch(out)


def similar_links(candidates: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """Those of the candidate pairs (a, b) of nodes that are similar; words: (sid, words) of each of them."""
    pairs = candidates.join(words.select(F.col("sid").alias("b"), F.col("words").alias("y")), "b").join(words.select(F.col("sid").alias("a"), F.col("words").alias("x")), "a")
    return pairs.select("a", "b", "x", "y").mapInArrow(lambda it: _verify(it, least), "a long, b long")


def _shingles(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("sid", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("words", pa.binary())])
    for batch in batches:
        sets = [shingle_set(t.as_py(), n).tobytes() for t in batch.column("text")]
        digest = np.frombuffer(b"".join(blake2b(s, digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(sets, pa.binary())], schema=schema)


def word_sets(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(sid, words): the shingle sets of nodes (sid, s1, s2), read from the documents (key, text) that they are named by."""
    asked = materialize(nodes.select("sid", "s1", "s2").distinct(), "near-asked")
    texts = docs.join(checked_broadcast(asked.select(F.col("sid").alias("key")).distinct(), 16), "key", "left_semi")
    sets = texts.mapInArrow(lambda it: _shingles(it, n), "sid long, s1 long, s2 long, words binary")
    # a key's rows may have other texts too, and equal ones
    sets = sets.join(checked_broadcast(asked, 32), ["sid", "s1", "s2"], "left_semi").groupBy("sid", "s1", "s2").agg(F.first("words").alias("words"))
    out = materialize(sets.select("sid", "words"), "near-words")
    discard(asked)
    return out


def _dealt(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """The rows (key, sid, root, ...) of buckets that hold more than one root, with sub and side: buckets above bucket_rows are dealt out as pairs of parts.

    All pairs within a bucket of side 0 are to be compared, and those of sides 1 and 2."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    sizes = materialize(sizes.select("key", "m", F.when(F.col("m") > bucket_rows, F.ceil(2 * F.col("m") / bucket_rows)).otherwise(1).cast("int").alias("p")), "near-sizes")
    dealt = hot_join(rows, sizes, ["key"], "m").withColumn("i", F.pmod(F.xxhash64("sid", F.lit(7)), F.col("p")).cast("int"))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
    sub = F.least("i", "j").cast("long") * F.col("p") + F.greatest("i", "j")
    side = F.when(F.col("i") == F.col("j"), 0).when(F.col("i") < F.col("j"), 1).otherwise(2)
    return dealt.select(*[c for c in rows.columns], sub.alias("sub"), side.alias("side"))


def _by_bucket(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key", "sub").sortWithinPartitions("key", "sub")


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole buckets, from rows sorted by bucket."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, sub = batch.column("key").to_numpy(), batch.column("sub").to_numpy()
        other = np.flatnonzero((key != key[-1]) | (sub != sub[-1]))
        cut = int(other[-1]) + 1 if len(other) else 0  # where the last bucket, which may go on, begins
        if cut or (last is not None and last != (key[0], sub[0])):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
        last = (key[-1], sub[-1])
    if held:
        yield pa.Table.from_batches(held)


def _pair_batch(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _set_links(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Of each bucket a spanning forest of its similar pairs, beyond what the roots connect. A pair is compared in the first bucket it shares."""
    for t in _whole_buckets(batches):
        key, sub, at, sid, root, side = (t.column(c).to_numpy() for c in ("key", "sub", "at", "sid", "root", "side"))
        keys = t.column("keys").combine_chunks().flatten().to_numpy().reshape(len(key), -1)
        words = t.column("words")
        starts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1])) + 1, [len(key)]))
        out: list[tuple[int, int]] = []
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if (root[s:e] == root[s]).all():
                continue
            sets = [np.frombuffer(w.as_py(), np.uint64) for w in words.slice(s, e - s)]
            out += [(int(sid[s + i]), int(sid[s + j])) for i, j in bucket_links(sets, root[s:e], side[s:e], keys[s:e, : at[s]], least)]
        if out:
            yield _pair_batch(out)


def bucket_links(sets: list[np.ndarray], root: np.ndarray, side: np.ndarray, earlier: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Similar pairs of places that connect all that similar pairs connect, with the roots; pairs with an equal earlier key aren't looked at."""
    label, size = np.unique(root, return_inverse=True)[1], np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(size)
    mark, out = np.zeros(len(ids) + 1, bool), []
    for i in range(len(sets) - 1):
        other = np.arange(i + 1, len(sets))
        small, large = np.minimum(size[i], size[other]), np.maximum(size[i], size[other])
        open_ = (label[other] != label[i]) & (small >= least * large * (1 - 1e-9))
        if side[i]:
            open_ &= side[other] != side[i]
        other = other[open_]
        if len(other) and earlier.shape[1]:
            other = other[~(earlier[other] == earlier[i]).any(1)]
        if not len(other):
            continue
        mark[ids[ends[i] - size[i] : ends[i]]] = True
        both = np.array([np.count_nonzero(mark[ids[ends[j] - size[j] : ends[j]]]) for j in other])
        mark[ids[ends[i] - size[i] : ends[i]]] = False
        joint = size[i] + size[other] - both
        for j in other[np.where(joint > 0, both / np.maximum(joint, 1), 1.0) >= least]:
            if label[j] != label[i]:
                out.append((i, int(j)))
                label[label == label[j]] = label[i]
    return out


def _close_pairs(batches: Iterator[pa.RecordBatch], distance: int, least: float) -> Iterator[pa.RecordBatch]:
    """All pairs of different roots in a bucket whose fingerprints differ in 1 to `distance` bits and whose sizes allow them to be similar."""
    for t in _whole_buckets(batches):
        key, sub, sid, root, side, fp, size = (t.column(c).to_numpy() for c in ("key", "sub", "sid", "root", "side", "fp", "size"))
        fp = fp.view(np.uint64)
        starts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1])) + 1))
        end = np.repeat(np.append(starts[1:], len(key)), np.diff(np.append(starts, len(key))))
        i, d = np.arange(len(key)), 1
        while len(i := i[i + d < end[i]]):
            j = i + d
            bits = np.bitwise_count(fp[i] ^ fp[j])
            hit = (bits <= distance) & (bits > 0) & (root[i] != root[j]) & ((side[i] == 0) | (side[i] != side[j]))
            hit &= np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j]) * (1 - 1e-9)
            if hit.any():
                a, b = sid[i[hit]], sid[j[hit]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
            d += 1


def near_groups(docs: DataFrame, n: int = 5, least: float = 0.8, distance: int = 4, key: str = "doc_id", text: str = "text", set_rows: int = SET_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(key, leader) for each row with a key: the smallest key of its group of near copies.

    Texts with one set of shingles are one node, named by their smallest key; null and empty texts are one too. Nodes are
    linked if their fingerprints are within `distance` bits or a band of their min-hashes is equal, and their Jaccard
    similarity is `least` or more. In a bucket of equal bands all are first compared with two of its members, which
    connects most copies. Then every pair in a bucket that isn't connected yet is compared. A key whose rows have several
    texts is one document that is like whatever one of them is like."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).filter("key is not null")
    signed = materialize(own.mapInArrow(lambda it: _sign(it, n), "key long, s1 long, s2 long, fp long, size long, bands array<long>"), "near-signed")
    sets = signed.groupBy("s1", "s2").agg(F.min("key").alias("sid"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("fp", "size", "bands")])
    sets = materialize(sets.withColumn("keys", F.array_append("bands", F.xxhash64("fp", F.lit(16)))).drop("bands"), "near-sets")
    rows = sets.select("sid", "s1", "s2", F.posexplode("keys").alias("at", "band"))
    shared = materialize(rows.groupBy("band").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "near-shared")
    rows = materialize(hot_join(rows, shared, ["band"], "m").drop("m"), "near-bands")
    words = word_sets(own, rows, n)
    drawn = F.struct(F.xxhash64("sid", F.lit(0)).alias("h"), "sid")
    ends = rows.groupBy("band").agg(F.min(drawn).alias("lo"), F.max(drawn).alias("hi"), F.count(F.lit(1)).alias("m")).filter("lo.sid <> hi.sid")
    ends = materialize(ends, "near-ends")
    met = hot_join(rows, ends, ["band"], "m").select("sid", F.explode(F.array("lo.sid", "hi.sid")).alias("other")).filter("sid <> other")
    met = materialize(met.select(F.least("sid", "other").alias("a"), F.greatest("sid", "other").alias("b")).distinct(), "near-candidates")
    found = [materialize(similar_links(met, words, least), "near-links")]
    discard(shared, ends, met)

    def rooted() -> DataFrame:
        links = found[0]
        for more in found[1:]:
            links = links.unionByName(more)
        # a key with several texts is several sets of one name
        groups = materialize(connected_components(links), "near-components")
        return sets.join(groups.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))

    named = materialize(rooted().select("sid", "root").distinct(), "near-roots")
    dealt = materialize(_dealt(rows.join(named, "sid").select(F.col("band").alias("key"), "sid", "root", "at"), set_rows), "near-dealt")
    held = dealt.join(words, "sid").join(sets.select("sid", "keys"), "sid")
    found.append(materialize(_by_bucket(held).mapInArrow(lambda it: _set_links(it, least), "a long, b long"), "near-links"))
    discard(rows, named, dealt)

    named = materialize(rooted().select("sid", "s1", "s2", "fp", "size", "root"), "near-roots")
    masks = block_masks(distance, blocks_for(named.count(), distance))
    blocks = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64)))) for i, m in enumerate(masks)])
    rows = materialize(named.select("sid", "root", "fp", "size", F.explode(blocks).alias("key")), "near-blocks")
    close = _by_bucket(_dealt(rows, bucket_rows)).mapInArrow(lambda it: _close_pairs(it, distance, least), "a long, b long")
    close = materialize(close.distinct(), "near-candidates")
    asked = close.select(F.col("a").alias("sid")).unionByName(close.select(F.col("b").alias("sid"))).distinct()
    new = word_sets(own, named.join(asked, "sid", "left_semi").join(words.select("sid").distinct(), "sid", "left_anti"), n)
    found.append(materialize(similar_links(close, words.unionByName(new), least), "near-links"))
    discard(rows, named, close)

    named = rooted()
    least_key = named.groupBy("root").agg(F.min("sid").alias("leader"))
    named = materialize(named.join(least_key, "root").select("s1", "s2", "copies", "leader"), "near-named")
    out = hot_join(signed.select("key", "s1", "s2"), named, ["s1", "s2"], "copies").select("key", "leader")
    discard(words, new, sets, *found)
    return out


def near_dedup(docs: DataFrame, n: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs without the near copies: of each group the row with the smallest key stays. Rows without a key stay; rows that repeat a key are kept or dropped alike.

    Null, empty and wordless texts are copies of one another; texts of fewer than n words are compared as a whole. Other columns
    pass through, whatever their names; an empty table stays empty. A text is read whole, however long it is."""
    groups = near_groups(docs, n, similarity, key=key, text=text, **how)
    dropped = materialize(groups.filter("key <> leader").select(F.col("key").alias("__key")).distinct(), "near-dropped")
    return docs.join(checked_broadcast(dropped, 16), docs[key].cast("long") == F.col("__key"), "left_anti")
