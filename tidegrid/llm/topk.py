"""Exact top-k by inner product, pruned by segment statistics at several resolutions.

A vector's segments are described by mean and deviation (the norm of what is left after the mean). The inner product of
two segments of n components is at most n * mean * mean + deviation * deviation, which is the same as a lower bound of
the distance; summed over segments it bounds the score. Coarse bounds drop candidates first, finer ones more, and
exact scores are computed for what is left: for each query its own pairs where few are left, else the queries' and
candidates' matrices at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import materialize

#: Candidates that one task holds, queries that it scores at once, segments of a vector from coarse to fine, and the part of pairs above which a product of matrices is quicker than pairs one by one.
SLOT_ROWS, QUERY_ROWS, LEVELS, DENSE = 8192, 256, (4, 16), 0.05
_LIMIT = (1 << 63) - 1
_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def floor_components(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) for each component, as longs, the nearest long where it doesn't fit; null where the vector or one of its components is null or not finite."""
    own = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(own, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(own, lambda x: F.floor(x * scale)))


def segment_bounds(a: np.ndarray, parts: int) -> np.ndarray:
    """(rows, 2 * parts): what a row contributes to the bound, so that the bound of two rows is their inner product."""
    out = []
    for cut in np.array_split(np.arange(a.shape[1]), min(parts, max(1, a.shape[1]))):
        own = a[:, cut]
        mean = own.mean(1, keepdims=True) if len(cut) else np.zeros((len(a), 1))
        out += [mean[:, 0] * np.sqrt(len(cut)), np.linalg.norm(own - mean, axis=1)]
    return np.stack(out, axis=1)


class Slot:
    """Candidates of one slot, by ascending id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.raw = ids[order], vectors[order]
        self.peak = max(int(self.raw.max(initial=0)), -int(self.raw.min(initial=0)))
        self.exact = self.raw.astype(np.float64)
        self.bounds = [segment_bounds(self.exact, p) for p in LEVELS]

    def scores(self, q: np.ndarray, which: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
        """Integer inner products of q with the candidates `which`, or of q's rows `pairs` with one candidate each; the nearest long where one doesn't fit."""
        peak = self.peak * max(int(q.max(initial=0)), -int(q.min(initial=0))) * max(1, q.shape[1])
        if peak < 1 << 53:  # sums of such integers are exact in doubles
            q, own = q.astype(np.float64), self.exact[which]
        elif peak < 1 << 63:
            own = self.raw[which]
        else:
            q, own = q.astype(object), self.raw[which].astype(object)
        out = q @ own.T if pairs is None else (q[pairs] * own).sum(1)
        return np.clip(out, -_LIMIT - 1, _LIMIT).astype(np.int64) if out.dtype == object else out.astype(np.int64)

    def top(self, qids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query, candidate and score of the k best for each query within this slot."""
        n = len(self.ids)
        wanted = np.ones((len(q), n), bool)
        if n > 4 * k:
            wide = q.astype(np.float64)
            coarse = segment_bounds(wide, LEVELS[0]) @ self.bounds[0].T
            first = np.argpartition(coarse, -2 * k, axis=1)[:, -2 * k :]
            known = self.scores(q, first.ravel(), np.repeat(np.arange(len(q)), 2 * k)).reshape(first.shape).astype(np.float64)
            known[self.ids[first] == qids[:, None]] = -np.inf
            least = np.partition(known, -k, axis=1)[:, -k][:, None]
            slack = 1e-9 * (1 + np.abs(coarse).max(initial=0))
            wanted = coarse >= least - slack
            if wanted.mean() < 0.5:
                rows, columns = np.nonzero(wanted)
                a, b = segment_bounds(wide, LEVELS[1]), self.bounds[1]
                for at in range(0, len(rows), 1 << 15):
                    i, j = rows[at : at + (1 << 15)], columns[at : at + (1 << 15)]
                    wanted[i, j] = np.einsum("ij,ij->i", a[i], b[j]) >= least[i, 0] - slack
            else:
                wanted &= segment_bounds(wide, LEVELS[1]) @ self.bounds[1].T >= least - slack
        wanted &= self.ids[None, :] != qids[:, None]
        if wanted.mean() < DENSE:
            rows, columns = np.nonzero(wanted)
            s = np.concatenate([self.scores(q, columns[at : at + (1 << 15)], rows[at : at + (1 << 15)]) for at in range(0, len(rows), 1 << 15)] or [np.empty(0, np.int64)])
            ends = np.searchsorted(rows, np.arange(len(q) + 1))
            parts = [(s[a:b], columns[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        else:
            every = np.flatnonzero(wanted.any(0))
            s = self.scores(q, every)
            parts = [(s[i][own], every[own]) for i, own in enumerate(wanted[:, every])]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i, (row, ids) in enumerate(parts):
            if len(row) > k:
                keep = np.flatnonzero(row >= np.partition(row, -k)[-k])
                row, ids = row[keep], ids[keep]
            best = np.lexsort((ids, -row.astype(object) if len(row) and row.min() == -_LIMIT - 1 else -row))[:k]
            out.append((np.full(len(best), qids[i]), self.ids[ids[best]], row[best]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _matrix(t: pa.Table) -> np.ndarray:
    flat = t.column("v").combine_chunks().flatten().to_numpy()
    return flat.reshape(t.num_rows, -1) if t.num_rows and len(flat) else np.zeros((t.num_rows, 0), np.int64)


def _score(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows come by slot, candidates before queries; one slot's candidates are held."""
    at, waiting, slot = None, [], None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        keys = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("slot", "dim", "kind")], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if s == e:
                continue
            if (here := tuple(keys[s, :2])) != at:
                at, waiting, slot = here, [], None
            part = t.slice(s, e - s)
            if keys[s, 2] == 0:
                waiting.append(part)
                continue
            if waiting:
                own = pa.concat_tables(waiting)
                slot, waiting = Slot(own.column("vec_id").to_numpy(), _matrix(own)), []
            if slot is None:
                continue
            qids, q = part.column("vec_id").to_numpy(), _matrix(part)
            for a in range(0, len(q), QUERY_ROWS):
                x, y, z = slot.top(qids[a : a + QUERY_ROWS], q[a : a + QUERY_ROWS], k)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(z, pa.int64())], schema=_OUT)


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "v", slot_rows: int = SLOT_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query holds its k highest integer inner products with rows of other keys; ties go to smaller keys.

    `vector` is array<long>; rows where it or the key is null take no part. Only vectors of a query's own length are
    compared with it. A repeated candidate row counts as often as it stands there, a repeated query row once. A score that
    doesn't fit a long is the nearest one, and ties as such. Other columns don't matter; an empty table gives an empty result.
    Candidates are dealt into slots of about slot_rows; each query visits each slot, and a slot passes on its k best."""
    own = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"), is_query.alias("q")).filter("vec_id is not null and v is not null")
    own = materialize(own.withColumn("dim", F.size("v")), "topk-vectors")
    slots = max(1, -(-own.count() // slot_rows))
    candidates = own.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(slots)).cast("int").alias("slot"), "dim", F.lit(0).alias("kind"), "vec_id", "v")
    queries = own.filter("q").select("dim", "vec_id", "v").distinct()
    queries = queries.select(F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), "dim", F.lit(1).alias("kind"), "vec_id", "v")
    n = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = candidates.unionByName(queries).repartition(min(n, slots), "slot").sortWithinPartitions("slot", "dim", "kind")
    best = dealt.mapInArrow(lambda it: _score(it, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
