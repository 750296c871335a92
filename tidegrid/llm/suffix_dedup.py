"""Repeated passages: every byte under a string of `length` bytes that also starts elsewhere is found exactly.

1. Anchors route. Each window of `length` bytes names the place of its least-hashed GRAM-byte string, the leftmost of
   equals. Equal windows name the same place in themselves, so they meet in the group of that string's hash. Windows next
   to each other mostly share an anchor: a run of windows with one anchor is a segment, of which a 128-bit digest is
   shuffled, not its text. Segments with equal digests are equal texts, counted by aggregation and repeated as a whole.
2. Groups with different segments get their texts, one of each, and are sorted as suffixes in two stages. Whether windows
   are repeated is decided by the common prefixes of neighbours, byte by byte.
3. Groups of more than GROUP_BYTES, which one task shouldn't sort, are split exactly. A window lies at some offset before
   its anchor; those at offsets low to high have the `low` bytes in front of the anchor and the `length - high` bytes
   from it on in common with their equals. So a group's range of offsets is cut into parts, and within a part segments
   meet only if these bytes are equal. Pieces that are equal there are counted, as above, and different ones go on,
   until groups are small enough to be sorted.
4. The spans of a document are merged and cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import checked_broadcast, discard, hot_join, materialize, small_batches

LENGTH, GRAM = 400, 32
#: Bytes that numpy takes in one step; of a group that one task sorts at most; that are sorted at once; of rows handed on at once.
STEP, GROUP_BYTES, SORT_BYTES, OUT_BYTES = 1 << 18, 1 << 20, 1 << 19, 4 << 20
#: Parts into which the offsets of a group that is too large are cut.
FAN = 4

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_rng = np.random.default_rng(20_240_229)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Rolling:
    """Hashes of any substring of a block of bytes: differences of prefix sums of table[byte] * odd ** place, taken back to place 0."""

    powers, inverses = _powers(_ODD, 1), _powers(_INVERSE, 1)

    def __init__(self, data: np.ndarray) -> None:
        if len(data) >= len(Rolling.powers):
            n = max(1 << 16, len(data) + len(data) // 4)
            Rolling.powers, Rolling.inverses = _powers(_ODD, n), _powers(_INVERSE, n)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * Rolling.powers[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mix((self.sums[ends] - self.sums[starts]) * Rolling.inverses[starts])

    def every(self, n: int) -> np.ndarray:
        """The hash of each n bytes."""
        m = len(self.sums) - n
        return _mix((self.sums[n:] - self.sums[:m]) * Rolling.inverses[:m])


def sliding_least(a: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, from running minima of blocks of w to the right and to the left."""
    n = len(a) - w + 1
    full = np.full(-(-len(a) // w) * w, np.iinfo(a.dtype).max, a.dtype)
    full[: len(a)] = a
    block = full.reshape(-1, w)
    right = np.minimum.accumulate(block, axis=1).ravel()
    left = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[:n], right[w - 1 : w - 1 + n])


def segments(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """first and last window start, anchor's place and anchor's hash of each segment of one text."""
    parts: list[tuple[np.ndarray, ...]] = []
    starts_in_all = len(data) - length + 1
    for at in range(0, max(0, starts_in_all), STEP):
        grams = Rolling(data[at : at + STEP + length - 1]).every(gram)
        places = np.arange(len(grams), dtype=np.uint64)
        least = sliding_least((grams & ~np.uint64((1 << 22) - 1)) | places, length - gram + 1)
        anchor = (least & np.uint64((1 << 22) - 1)).astype(np.int64)
        new = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        s, e = np.concatenate(([0], new)), np.concatenate((new - 1, [len(anchor) - 1]))
        parts.append((s + at, e + at, anchor[s] + at, grams[anchor[s]]))
    if not parts:
        none = np.empty(0, np.int64)
        return none, none, none, none.view(np.uint64)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _types(data: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place is smaller than its successor; the last one isn't."""
    n = len(data)
    differs = np.flatnonzero(np.append(data[1:] != data[:-1], True))
    upto = differs[np.searchsorted(differs, np.arange(n))]
    rising = np.append(data[1:] > data[:-1], False)
    return rising[upto]


def _words(data: np.ndarray, behind: int) -> np.ndarray:
    """The 8 bytes from each place on as one number, in the order of bytes; zeros behind the end, and `behind` more places."""
    wide = np.concatenate((data, np.zeros(behind + 8, np.uint8))).astype(np.uint64)
    out = np.zeros(len(data) + behind, np.uint64)
    for j in range(8):
        out |= wide[j : j + len(out)] << np.uint64(56 - 8 * j)
    return out


def _direct(data: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """places in the order of the first `length` bytes of their suffixes, ties by place: by 16 bytes first, those that are equal so far by all of them."""
    words = _words(data, 8)
    a, b = words[places], words[places + 8]
    by = np.lexsort((b, a))
    order, a, b = places[by], a[by], b[by]
    edges = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]), [True])))
    text = data.tobytes()
    many = np.flatnonzero(np.diff(edges) > 1)
    for s, e in zip(edges[many].tolist(), edges[many + 1].tolist(), strict=True):
        order[s:e] = sorted(order[s:e].tolist(), key=lambda i: text[i : i + length])
    return order


def suffix_order(data: np.ndarray, wanted: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The wanted places in the order of the first `length` bytes of their suffixes, by two-stage sorting.

    Suffixes smaller than their successors are sorted directly; a larger one follows from its successor: buckets of
    first bytes are scanned in ascending order, and each suffix found puts the one before it at the front of its bucket,
    behind those already there. A place's successors, up to the first that is sorted directly, are sorted along."""
    n = len(data)
    small = _types(data)
    stop = np.flatnonzero(small | (np.arange(n) == n - 1))
    # the wanted ones and what lies between each and the next directly sorted place
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(wanted)
    np.add.at(edge, at, 1)
    np.add.at(edge, stop[np.searchsorted(stop, at)] + 1, -1)
    member = np.cumsum(edge[:-1]) > 0
    direct = _direct(data, np.flatnonzero(member & small), length)
    later = member & ~small
    heads = np.concatenate(([0], np.cumsum(np.bincount(data[member], minlength=256))))
    n_later = np.bincount(data[later], minlength=256)
    out = np.full(int(heads[-1]), -1, np.int64)
    bounds = np.concatenate(([0], np.cumsum(np.bincount(data[direct], minlength=256))))
    fill = heads[:-1].copy()

    def put(found: np.ndarray) -> None:
        """Puts the larger suffixes in front of the found ones into their buckets, in the order found."""
        before = found[found > 0] - 1
        before = before[later[before]]
        if len(before):
            c = data[before]
            order = np.argsort(c, kind="stable")
            c = c[order]
            counts = np.bincount(c, minlength=256)
            first = np.cumsum(counts) - counts
            out[fill[c] + np.arange(len(c)) - first[c]] = before[order]
            fill[:] += counts

    if later[n - 1]:  # larger than the empty suffix behind it
        out[fill[data[n - 1]]] = n - 1
        fill[data[n - 1]] += 1
    for c in np.flatnonzero(np.diff(heads)):
        done = heads[c]
        while done < fill[c]:
            here = out[done : fill[c]].copy()
            done = fill[c]
            put(here)
        own = direct[bounds[c] : bounds[c + 1]]
        out[heads[c] + n_later[c] : heads[c + 1]] = own
        put(own)
    return out[wanted[out]]


def common_prefixes(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How many bytes the suffixes at places a and b have in common, each pair for itself, up to `most`."""
    words, out = _words(data, most + 8), np.full(len(a), most)
    live = np.arange(len(a))
    steps = np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64)
    for k in range(0, most, 8):
        x = words[a[live] + k] ^ words[b[live] + k]
        differ = x != 0
        out[live[differ]] = k + 8 - np.searchsorted(steps, x[differ], side="right")
        live = live[~differ]
        if not len(live):
            break
    return np.minimum(np.minimum(out, most), len(data) - np.maximum(a, b))


def repeated_windows(data: np.ndarray, wanted: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of the wanted places begin `length` bytes that begin at another wanted place too: those that have so long a prefix in common with a neighbour in the order of suffixes."""
    order = suffix_order(data, wanted, length)
    long = common_prefixes(data, order[1:], order[:-1], length) >= length
    out = np.zeros(len(data), bool)
    out[order[1:][long]] = True
    out[order[:-1][long]] = True
    return out


def _digests(pieces: Iterator[bytes], salts: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of each piece's 128-bit digest as longs."""
    both = np.frombuffer(b"".join(blake2b(p, digest_size=16, salt=s).digest() for p, s in zip(pieces, salts)), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


class _Out:
    """Rows by name that become a batch when they hold OUT_BYTES."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple, size: int) -> None:
        self.rows.append(row)
        self.size += size + 8 * len(row)

    def full(self, least: int = OUT_BYTES) -> Iterator[pa.RecordBatch]:
        if self.rows and self.size >= least:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)]
            self.rows, self.size = [], 0
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)


def _schema(longs: str, *more: pa.Field) -> pa.Schema:
    return pa.schema([*[(c, pa.int64()) for c in longs.split()], *more])


def _sql(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.bool_(): "boolean", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


_ALONE, _PART = pa.field("alone", pa.bool_()), pa.field("part", pa.binary())
_FOUND = _schema("t1 t2 s e a ah d1 d2")
#: A piece: its group, the group's range of offsets and bytes, its text, anchor, own range of offsets, whether no equal one is known, and its bytes.
_PIECES = _schema("g1 g2 low high bytes t1 t2 a x y", _ALONE, _PART)
_CHILDREN = _schema("g1 g2 low high d1 d2 t1 t2 a x y", _ALONE, _PART)
_SPANS = _schema("t1 t2 a b")


def _find(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held, size = [], 0
        for t1, t2, text in zip(batch.column("t1").to_pylist(), batch.column("t2").to_pylist(), batch.column("text"), strict=True):
            raw = text.as_buffer()
            if raw is None or len(raw) < length:
                continue
            s, e, a, ah = segments(np.frombuffer(raw, np.uint8), length, gram)
            view, n = memoryview(raw), len(s)
            d1, d2 = _digests((view[i:j] for i, j in zip(s.tolist(), (e + length).tolist(), strict=True)), iter(lambda: b"", None))
            held.append((np.full(n, t1, np.int64), np.full(n, t2, np.int64), s, e, a, ah.view(np.int64), d1, d2))
            size += n
            if size > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], schema=_FOUND)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], schema=_FOUND)


def _cut_out(batches: Iterator[pa.RecordBatch], length: int, high: int) -> Iterator[pa.RecordBatch]:
    """The pieces of texts that come with the list of their segments."""
    out = _Out(_PIECES)
    for batch in batches:
        for t1, t2, text, own in zip(batch.column("t1").to_pylist(), batch.column("t2").to_pylist(), batch.column("text"), batch.column("own"), strict=True):
            raw = memoryview(text.as_buffer())
            ah, s, e, a, size, alone = (own.values.field(c).to_pylist() for c in ("ah", "s", "e", "a", "bytes", "alone"))
            for g, first, last, at, b, one in zip(ah, s, e, a, size, alone, strict=True):
                out.add((g, 0, 0, high, b, t1, t2, at, at - last, at - first, one, raw[first : last + length].tobytes()), last + length - first)
                yield from out.full()
    yield from out.full(0)


def _split(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Pieces of groups that are too large, cut to FAN parts of the group's range of offsets; in each they meet by the bytes that equal windows have in common there."""
    out = _Out(_CHILDREN)
    names = ("low", "high", "t1", "t2", "a", "x", "y", "alone", "part")
    for batch in batches:
        for low, high, t1, t2, a, x, y, alone, part in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            n = min(FAN, high - low + 1)
            edges = [low + k * (high - low + 1) // n for k in range(n + 1)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                hi -= 1
                own_x, own_y = max(lo, x), min(hi, y)
                if own_x > own_y:
                    continue
                piece = part[y - own_y : y - own_x + length]
                salts = (lo.to_bytes(8) + hi.to_bytes(8), own_y.to_bytes(8))
                (g1, d1), (g2, d2) = _digests((part[y - lo : y + length - hi], piece), salts)
                out.add((g1, g2, lo, hi, d1, d2, t1, t2, a, own_x, own_y, alone, piece), len(piece))
                yield from out.full()
    yield from out.full(0)


def _compare(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """From pieces sorted by group: the spans of windows that another piece of the group has too. Holds SORT_BYTES and one group of GROUP_BYTES more."""
    held: list[tuple] = []
    size, last = 0, None

    def solve() -> pa.RecordBatch:
        lengths = np.array([len(r[4]) for r in held])
        data = np.frombuffer(b"\xff".join(r[4] for r in held), np.uint8)  # UTF-8 has no such byte
        at = np.cumsum(lengths + 1) - lengths - 1
        edge = np.zeros(len(data) + 1, np.int64)
        edge[at] += 1
        edge[at + lengths - length + 1] -= 1
        hit = repeated_windows(data, np.cumsum(edge[:-1]) > 0, length)
        # runs of repeated windows; separators end them
        change = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
        first, behind = change[::2], change[1::2]
        who = np.searchsorted(at, first, side="right") - 1
        alone = np.array([r[3] for r in held])[who]
        t1, t2, s = (np.array([r[k] for r in held], np.int64)[who] for k in range(3))
        a = s + first - at[who]
        out = [t1[alone], t2[alone], a[alone], (a + (behind - first) - 1 + length)[alone]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in out], schema=_SPANS)

    for batch in batches:
        for g1, g2, t1, t2, a, y, alone, part in zip(*(batch.column(c).to_pylist() for c in ("g1", "g2", "t1", "t2", "a", "y", "alone", "part")), strict=True):
            if (g1, g2) != last:
                last = g1, g2
                if size > SORT_BYTES:
                    yield solve()
                    held, size = [], 0
            held.append((t1, t2, a - y, alone, part))
            size += len(part)
    if held:
        yield solve()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's spans merged where they overlap or touch."""
    schema = _schema("t1 t2", pa.field("starts", pa.list_(pa.int64())), pa.field("ends", pa.list_(pa.int64())))
    for batch in batches:
        starts, ends = [], []
        for own in batch.column("own"):
            a, b = (np.array(own.values.field(k)) for k in ("a", "b"))
            order = np.argsort(a, kind="stable")
            a, b = a[order], np.maximum.accumulate(b[order])
            new = np.concatenate(([True], a[1:] > b[:-1]))
            starts.append(a[new])
            ends.append(b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)])
        lists = [pa.array(x, pa.list_(pa.int64())) for x in (starts, ends)]
        yield pa.RecordBatch.from_arrays([batch.column("t1"), batch.column("t2"), *lists], schema=schema)


def _sorted_spans(pieces: DataFrame, length: int) -> DataFrame:
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(n, "g1", "g2").sortWithinPartitions("g1", "g2").mapInArrow(lambda it: _compare(it, length), _sql(_SPANS))


def _open_groups(pieces: DataFrame, size: str) -> DataFrame:
    """(g1, g2, m, bytes) of groups with pieces that aren't known to be repeated as a whole and have others to be like."""
    sizes = pieces.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("m"), F.sum(size).alias("bytes"), F.bool_or("alone").alias("open"))
    return sizes.filter("open and m > 1").drop("open")


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(t1, t2, starts, ends): for each text with repeated bytes the byte offsets of its spans, in order. docs need longs t1 and t2, the text's identity."""
    own = docs.select("t1", "t2", F.col(text).alias("text"))
    found = materialize(own.mapInArrow(lambda it: _find(it, length, gram), _sql(_FOUND)), "suffix-segments")
    digest = F.struct("d1", "d2")
    shared = found.groupBy("ah").agg(F.count(F.lit(1)).alias("n"), F.min(digest).alias("lo"), F.max(digest).alias("hi")).filter("n > 1")
    shared = materialize(shared.select("ah", "n", (F.col("lo") != F.col("hi")).alias("mixed")), "suffix-anchors")
    met = materialize(hot_join(found, shared, ["ah"], "n").drop("n"), "suffix-shared")
    texts = met.groupBy("ah", "d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.first("mixed").alias("mixed"), F.min(F.struct("t1", "t2", "s", "e", "a")).alias("one"))
    texts = materialize(texts, "suffix-texts")
    whole = hot_join(met.drop("mixed"), texts.filter("n > 1").select("ah", "d1", "d2", "n"), ["ah", "d1", "d2"], "n")
    spans = [materialize(whole.select("t1", "t2", F.col("s").alias("a"), (F.col("e") + length).alias("b")), "suffix-whole")]
    discard(found, shared, met)

    asked = texts.filter("mixed").select("ah", F.col("ah").alias("g1"), F.lit(0).cast("long").alias("g2"), (F.col("n") == 1).alias("alone"), "one.*")
    asked = asked.withColumn("size", F.col("e") + length - F.col("s"))
    groups = materialize(_open_groups(asked, "size"), "suffix-groups")
    asked = hot_join(asked, groups, ["g1", "g2"], "m")
    per_text = asked.groupBy("t1", "t2").agg(F.collect_list(F.struct("ah", "s", "e", "a", "bytes", "alone")).alias("own"))
    # lists grow with the texts: shuffled alike at every size, but for what Spark's own threshold lets it broadcast
    pieces = own.join(per_text, ["t1", "t2"]).mapInArrow(lambda it: _cut_out(it, length, length - gram), _sql(_PIECES))
    some = bool(groups.filter(F.col("bytes") > group_bytes).limit(1).count())
    if some:
        pieces = materialize(pieces, "suffix-pieces")
    spans.append(materialize(_sorted_spans(pieces.filter(F.col("bytes") <= group_bytes), length), "suffix-spans"))
    discard(texts, groups)
    while some:
        children = materialize(pieces.filter(F.col("bytes") > group_bytes).mapInArrow(lambda it: _split(it, length), _sql(_CHILDREN)), "suffix-children")
        discard(pieces)
        keys = ["g1", "g2", "low", "high", "d1", "d2"]
        kinds = children.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t1", "t2", "a", "x", "y", "alone")).alias("one"), F.first("part").alias("part"))
        kinds = materialize(kinds, "suffix-kinds")
        twice = hot_join(children.filter("alone").select(*keys, "t1", "t2", "a", "x", "y"), kinds.filter("n > 1").select(*keys, "n"), keys, "n")
        spans.append(materialize(twice.select("t1", "t2", (F.col("a") - F.col("y")).alias("a"), (F.col("a") - F.col("x") + length).alias("b")), "suffix-whole"))
        left = kinds.select("g1", "g2", "low", "high", *[f"one.{c}" for c in ("t1", "t2", "a", "x", "y")], (F.col("one.alone") & (F.col("n") == 1)).alias("alone"), "part")
        groups = materialize(_open_groups(left.withColumn("size", F.octet_length("part")), "size"), "suffix-groups")
        pieces = materialize(hot_join(left, groups, ["g1", "g2"], "m").select(*_PIECES.names), "suffix-pieces")
        spans.append(materialize(_sorted_spans(pieces.filter(F.col("bytes") <= group_bytes), length), "suffix-spans"))
        some = bool(groups.filter(F.col("bytes") > group_bytes).limit(1).count())
        discard(children, kinds, groups)
    both = spans[0]
    for s in spans[1:]:
        both = both.unionByName(s)
    out = both.groupBy("t1", "t2").agg(F.collect_set(F.struct("a", "b")).alias("own"))
    out = materialize(out.mapInArrow(_merge, "t1 long, t2 long, starts array<long>, ends array<long>"), "suffix-merged")
    discard(*spans)
    return out


def _cut(batches: Iterator[pa.RecordBatch], n: int, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The first n columns, and what stays of the text in column n outside the spans in the two behind it."""
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            batch = whole.slice(at, rows)
            out: list[tuple] = []
            for t, s, e in zip(batch.column(n), batch.column(n + 1).to_pylist(), batch.column(n + 2).to_pylist(), strict=True):
                raw = buffer.to_pybytes() if (buffer := t.as_buffer()) is not None else b""
                kept = b"".join(raw[a:b] for a, b in zip([0, *e], [*s, len(raw)], strict=True)) if s else raw
                out.append((kept, len(raw), len(raw) - len(kept), len(s or ())))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *columns], names=[f"c{i}" for i in range(n)] + ["kept", "n_bytes", "n_removed", "n_spans"])


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, **how) -> DataFrame:
    """docs with kept (binary: the UTF-8 bytes that stay), n_bytes, n_removed and n_spans; null texts count as empty.

    Removed is each byte under a string of `length` bytes that also starts elsewhere in the table, the same text
    included; all copies lose it. Texts shorter than that lose nothing; of very long ones, one at a time is held by a task.
    Extra columns pass through, but for ones with the results' names. Rows that repeat a key and text, null keys
    included, are two places of one text, so they lose all but what is shorter than `length`. An empty table gives an
    empty one. Texts are told apart by 128 bits of key and text, equal segments by 128 bits of BLAKE2; all else is
    compared byte by byte."""
    small_batches(docs.sparkSession)
    n = len(docs.columns)
    # columns get names of their own, whatever the table calls its own
    identity = [F.xxhash64(F.col(key), F.col(text)).alias("t1"), F.xxhash64(F.col(text), F.col(key), F.lit(1)).alias("t2")]
    named = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col(text).alias("text"), *identity)
    spans = repeated_spans(named.select("t1", "t2", "text"), "text", length, **how)
    met = named.join(checked_broadcast(spans, 64 + 16 * F.size("starts")), ["t1", "t2"], "left").select(*[f"c{i}" for i in range(n)], "text", "starts", "ends")
    schema = ", ".join(f"c{i} {kind}" for i, (_, kind) in enumerate(met.dtypes[:n])) + ", kept binary, n_bytes long, n_removed long, n_spans long"
    out = met.mapInArrow(lambda it: _cut(it, n), schema)
    new = ("kept", "n_bytes", "n_removed", "n_spans")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in new], *new)
