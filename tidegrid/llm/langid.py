"""Language identification by a bidirectional gated recurrent network over bytes, trained here in numpy.

A text's UTF-8 bytes are read in windows of STEPS; many windows, one beside the other, make up the columns of a step's
matrices. Each window is run with the LEAD bytes before it and behind it, so that both states come to its first and last
positions with what they have read there; these bytes are labelled in their own windows. Both directions' states label
every byte position; a document's probabilities are the means over all its positions. Training is backpropagation
through time, with Adam, on the cross-entropy of all positions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import checked_broadcast, discard, materialize, small_batches

#: Bytes of a window, bytes read on either side of it, units of a direction, windows in one pass, and the code of what lies outside a text.
STEPS, LEAD, UNITS, COLUMNS, PAD = 96, 16, 8, 2048, 256
#: Labelled documents of each language that training reads at most, and bytes of their texts.
SAMPLE, SAMPLE_BYTES = 250, 4 << 20
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def windows(text: str) -> np.ndarray:
    """(windows, LEAD + STEPS + LEAD) bytes of a whole text, PAD where it has none."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = -(-len(raw) // STEPS)
    out = np.full(n * STEPS + 2 * LEAD, PAD, np.uint16)
    out[LEAD : LEAD + len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(out, STEPS + 2 * LEAD)[::STEPS] if n else out[:0].reshape(0, STEPS + 2 * LEAD)


def labelled(x: np.ndarray) -> np.ndarray:
    """Which places of windows (steps, columns) are a text's and the window's own."""
    real = x != PAD
    real[:LEAD] = real[len(x) - LEAD :] = False
    return real


@dataclass
class Direction:
    inputs: np.ndarray  # (3 * UNITS, 257): for update, reset and candidate, by byte
    states: np.ndarray  # (3 * UNITS, UNITS)

    def run(self, x: np.ndarray, tape: list | None = None) -> np.ndarray:
        """States (steps, UNITS, columns) for bytes (steps, columns)."""
        n = self.states.shape[1]
        h = np.zeros((n, x.shape[1]), self.states.dtype)
        out = np.empty((len(x), *h.shape), h.dtype)
        for t in range(len(x)):
            i, s = np.take(self.inputs, x[t], axis=1), self.states @ h
            gates = i[: 2 * n]
            gates += s[: 2 * n]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            z, r = gates[:n], gates[n:]
            c = np.tanh(i[2 * n :] + r * s[2 * n :])
            if tape is not None:
                tape.append((h, z, r, c, s[2 * n :]))
            h = h + z * (c - h)
            out[t] = h
        return out

    def back(self, x: np.ndarray, tape: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of inputs and states from those of the states that run() returned."""
        n = self.states.shape[1]
        deep = np.zeros_like(grad[0])
        to_input, to_states = np.empty((len(x), 3 * n, x.shape[1])), np.zeros_like(self.states)
        for t in range(len(x) - 1, -1, -1):
            h, z, r, c, s = tape[t]
            d = grad[t] + deep
            dz, dc = d * (c - h) * z * (1 - z), d * z * (1 - c * c)
            dr = dc * s * r * (1 - r)
            own = np.concatenate((dz, dr, dc * r))
            to_states += own @ h.T
            deep = d * (1 - z) + self.states.T @ own
            to_input[t] = np.concatenate((dz, dr, dc))
        flat, at = to_input.transpose(1, 0, 2).reshape(3 * n, -1), x.ravel()
        return np.stack([np.bincount(at, w, 257) for w in flat]), to_states


@dataclass
class LanguageModel:
    languages: list[str]
    ways: list[Direction]  # forward, backward
    labels: np.ndarray  # (languages, 2 * UNITS)
    bias: np.ndarray  # (languages, 1)

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (steps, languages, columns) for bytes (steps, columns)."""
        f, b = self.ways[0].run(x), self.ways[1].run(x[::-1])[::-1]
        n = f.shape[1]
        s = self.labels[:, :n] @ f + self.labels[:, n:] @ b + self.bias
        s -= s.max(1, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(1, keepdims=True)
        return s

    def predict(self, texts: Sequence[str | None]) -> list[tuple[str, float]]:
        """Language and its pooled probability; `und` with 0 for null texts and those without a letter of any script."""
        out = [(UNKNOWN, 0.0)] * len(texts)
        own = [i for i, t in enumerate(texts) if t and self.languages and has_letter(t)]
        waiting: list[tuple[int, np.ndarray]] = []
        sums, counts, held = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts)), 0

        def flush() -> None:
            rows = np.concatenate([w for _, w in waiting])
            doc = np.repeat([i for i, _ in waiting], [len(w) for _, w in waiting])
            for at in range(0, len(rows), COLUMNS):
                x = np.ascontiguousarray(rows[at : at + COLUMNS].T)
                real = labelled(x)
                p = (self.positions(x) * real[:, None, :]).sum(0)
                np.add.at(sums, doc[at : at + COLUMNS], p.T)
                np.add.at(counts, doc[at : at + COLUMNS], real.sum(0))

        for i in own:
            waiting.append((i, windows(texts[i])))
            held += len(waiting[-1][1])
            if held >= 8 * COLUMNS:
                flush()
                waiting.clear()
                held = 0
        if waiting:
            flush()
        for i in own:
            p = sums[i] / max(1, counts[i])
            best = int(p.argmax())
            out[i] = (self.languages[best], float(min(1, max(0, p[best]))))
        return out


def train(texts: Sequence[str], languages: Sequence[str], steps: int = 250, batch: int = 96, rate: float = 0.02, seed: int = 3) -> LanguageModel:
    """A model from whole texts and their languages, by as many steps of descent however few the texts are, over their windows in random order, with every language as often; the same texts give the same model."""
    rng = np.random.default_rng(seed)
    names = sorted(set(languages))
    small = lambda *shape: rng.normal(0, 0.3, shape)
    ways = [Direction(small(3 * UNITS, 257), small(3 * UNITS, UNITS)) for _ in range(2)]
    model = LanguageModel(names, ways, small(len(names), 2 * UNITS), np.zeros((len(names), 1)))
    rows, marks = [], []
    for text, language in zip(texts, languages, strict=True):
        w = windows(text)
        rows.append(w)
        marks += [names.index(language)] * len(w)
    if len(names) > 1:
        _descend(model, np.concatenate(rows), np.array(marks), steps, batch, rate, rng)
    for way in model.ways:
        way.inputs, way.states = way.inputs.astype(np.float32), way.states.astype(np.float32)
    model.labels, model.bias = model.labels.astype(np.float32), model.bias.astype(np.float32)
    return model


def gradients(model: LanguageModel, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over positions and its gradients, in the order of parameters(); x: (steps, columns), y: (columns,)."""
    tapes: list[list] = [[], []]
    f, b = model.ways[0].run(x, tapes[0]), model.ways[1].run(x[::-1], tapes[1])[::-1]
    n = f.shape[1]
    s = model.labels[:, :n] @ f + model.labels[:, n:] @ b + model.bias
    s = np.exp(s - s.max(1, keepdims=True))
    p = s / s.sum(1, keepdims=True)
    real = labelled(x)
    weight = real / max(1, real.sum())
    picked = np.take_along_axis(p, np.broadcast_to(y, x.shape)[:, None, :], 1)[:, 0]
    d = p.copy()
    d[:, y, np.arange(len(y))] -= 1
    d *= weight[:, None, :]
    to_labels = np.concatenate([np.einsum("tcn,tun->cu", d, h) for h in (f, b)], axis=1)
    g0 = model.ways[0].back(x, tapes[0], model.labels[:, :n].T @ d)
    g1 = model.ways[1].back(x[::-1], tapes[1], (model.labels[:, n:].T @ d)[::-1])
    return float(-(np.log(np.maximum(picked, 1e-12)) * weight).sum()), [*g0, *g1, to_labels, d.sum((0, 2))[:, None]]


def parameters(model: LanguageModel) -> list[np.ndarray]:
    return [model.ways[0].inputs, model.ways[0].states, model.ways[1].inputs, model.ways[1].states, model.labels, model.bias]


def _descend(model: LanguageModel, rows: np.ndarray, marks: np.ndarray, steps: int, batch: int, rate: float, rng: np.random.Generator) -> None:
    own, order, each = parameters(model), np.empty(0, np.int64), [np.flatnonzero(marks == k) for k in range(len(model.languages))]
    first, second = [np.zeros_like(w) for w in own], [np.zeros_like(w) for w in own]
    for k in range(1, steps + 1):
        if len(order) < batch:
            most = max(map(len, each))
            order = np.concatenate((order, rng.permutation(np.concatenate([np.resize(rng.permutation(e), most) for e in each]))))
        pick, order = order[:batch], order[batch:]
        _, grads = gradients(model, np.ascontiguousarray(rows[pick].T), marks[pick])
        norm = np.sqrt(sum((g**2).sum() for g in grads))
        pace = rate * (1 - 0.9 * k / steps)
        for w, g, a, b in zip(own, grads, first, second, strict=True):
            g = g * min(1, 1 / max(norm, 1e-12))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= pace * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> LanguageModel:
    """Trains on rows that are not held out and have a language and a text with a letter: of each language those that come first by a hash of their keys, at most `sample` rows and `sample_bytes` bytes of whole texts.

    That bounds what the driver gets for a language. Rows that repeat a key count one by one."""
    own = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(language).alias("l")).filter(~held_out(F.col("k")) & F.col("l").isNotNull() & F.col("t").isNotNull())
    order = Window.partitionBy("l").orderBy("h", "k")
    drawn = own.select("k", "l", F.xxhash64("k", F.lit(13)).alias("h")).withColumn("i", F.row_number().over(order)).filter(F.col("i") <= sample)
    drawn = materialize(drawn.select("k", "l").distinct(), "language-sample")
    rows = own.withColumnsRenamed({"k": "key", "l": "lang"}).join(checked_broadcast(drawn, 48), F.col("key").eqNullSafe(F.col("k")) & (F.col("lang") == F.col("l"))).select("k", "l", "t")
    order = Window.partitionBy("l").orderBy(F.xxhash64("k", F.lit(13)), "k", F.xxhash64("t"))
    so_far = F.sum(F.octet_length("t")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= sample).withColumn("bytes", so_far).filter(F.col("bytes") <= sample_bytes)
    rows = rows.select("k", "l", "t").collect()
    discard(drawn)
    rows = sorted((r for r in rows if has_letter(r["t"])), key=lambda r: (r["k"] is None, r["k"], r["t"]))
    return train([r["t"] for r in rows], [r["l"] for r in rows])


def with_language(docs: DataFrame, model: LanguageModel, text: str = "text", into: str = "language") -> DataFrame:
    """docs with a struct (lang_pred, score) for each whole text in the column `into`, which replaces one of that name; other columns pass through.

    Null, empty and letterless texts are `und` with score 0. Equal rows get equal results; an empty table stays empty. Every
    byte of a text is read, however long it is; a model without languages says `und`."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(model.predict(texts.tolist()), columns=["lang_pred", "score"])

    small_batches(docs.sparkSession)
    return docs.withColumn(into, predict(F.col(text)))
