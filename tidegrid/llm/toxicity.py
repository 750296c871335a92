"""Toxicity by a linear-chain conditional random field over words, trained here in numpy.

Labels are given for documents. Words and beginnings of words that toxic documents have far more often than others label
the first tokens; a two-state chain (clean, toxic) over whole documents is fitted to them by gradients from the
forward-backward algorithm. It is then fitted further to the documents' labels themselves: a toxic document has at
least one toxic token, and its tags are those expected under that condition, whatever the first list held. In a text, the
marginals of the toxic state give the offending spans; a logistic model pools them to the score. Messages are kept as
log odds of the toxic state.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field
from sys import intern

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import checked_broadcast, discard, materialize, small_batches

_WORDS = re.compile(r"\w+")
#: Tokens in one piece of a document's chain, which messages cross; tokens in one numpy step.
CHAIN, STEP = 64, 1 << 18
#: Labelled documents of each class that training reads at most, and bytes of their texts.
SAMPLE, SAMPLE_BYTES = 1500, 32 << 20
#: Letters of a word's beginning that may stand for the word.
STEMS = range(4, 9)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Forms(dict):
    """Ids of words: that of a beginning that marks toxic words if the word goes on behind it, else the word's own, else 0. Remembers some words."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        self.vocabulary = vocabulary
        self.stems = any(w.endswith("*") for w in vocabulary)

    def __missing__(self, word: str) -> int:
        get = self.vocabulary.get
        found = next((i for k in STEMS if k < len(word) and (i := get(word[:k] + "*"))), None) if self.stems else None
        found = found or get(word, 0)
        if len(self) >= 60_000:
            self.clear()
        self[word] = found
        return found


@dataclass
class ToxicityModel:
    vocabulary: dict[str, int]  # a word's, or a beginning's with *, place in the weights; 0 is for all other words
    weights: np.ndarray  # (3, V): of the word itself, the one before and the one after
    moves: np.ndarray  # (2, 2) log potentials, first state by next
    start: float
    pool: np.ndarray = field(default_factory=lambda: np.array([-3.0, 6.0, 1.0]))

    def __post_init__(self) -> None:
        self.forms = Forms(self.vocabulary)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"forms": Forms(self.vocabulary)}  # what one worker remembers isn't sent to others

    def ids(self, text: str | None) -> np.ndarray:
        forms = self.forms
        return np.array([forms[w] for w in _WORDS.findall((text or "").lower())], np.int32)

    def emissions(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log odds for each token of documents that lie one behind another."""
        e = self.weights[0][ids]
        ends = np.cumsum(lengths)
        first = np.zeros(len(ids), bool)
        first[(ends - lengths)[lengths > 0]] = True
        e[1:] += np.where(first[1:], 0, self.weights[1][ids[:-1]])
        e[:-1] += np.where(first[1:], 0, self.weights[2][ids[1:]])
        return e

    def marginals(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probability of the toxic state for each token."""
        if not len(ids):
            return np.empty(0)
        place, valid = chains(lengths)
        e = np.where(valid, self.emissions(ids, lengths)[place], 0)
        f, b = carried_messages(e, valid, -(-lengths // CHAIN), self.moves, self.start)
        out = np.empty(len(ids))
        out[place[valid]] = sigmoid((f + b)[valid])
        return out

    def features(self, texts: Sequence[str | None]) -> np.ndarray:
        """(documents, 3): one, the largest marginal, the logarithm of one plus their sum."""
        ids = [self.ids(t) for t in texts]
        out = np.zeros((len(ids), 3))
        out[:, 0] = 1
        lengths = np.array([len(x) for x in ids], np.int64)
        part = np.cumsum(lengths) // STEP
        for p in np.unique(part):
            own = np.flatnonzero((part == p) & (lengths > 0))
            if len(own):
                n = lengths[own]
                m = self.marginals(np.concatenate([ids[i] for i in own]), n)
                at = np.cumsum(n) - n
                out[own, 1] = np.maximum.reduceat(m, at)
                out[own, 2] = np.log1p(np.add.reduceat(m, at))
        return out

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        return sigmoid(self.features(texts) @ self.pool)

    def spans(self, text: str | None, least: float = 0.5) -> list[tuple[int, int]]:
        """Start and end, in code points, of the runs of tokens that are toxic with probability `least` or more."""
        low = (text or "").lower()
        if len(low) != len(text or ""):  # a few letters change their length; their offsets are of the text as it is
            low = text or ""
        words = list(_WORDS.finditer(low))
        ids = np.array([self.forms[w[0].lower()] for w in words], np.int32)
        hot = self.marginals(ids, np.array([len(ids)])) >= least
        out: list[tuple[int, int]] = []
        for k in np.flatnonzero(hot):
            a, b = words[k].span()
            if out and k and hot[k - 1]:
                a = out.pop()[0]
            out.append((a, b))
        return out


def chains(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents cut into chains of CHAIN tokens: (CHAIN, n) places of tokens and which of them exist."""
    ends = np.cumsum(lengths)
    n = -(-lengths // CHAIN)
    begin = np.repeat(ends - lengths, n) + CHAIN * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    place = begin + np.arange(CHAIN)[:, None]
    valid = place < np.repeat(ends, n)
    return np.where(valid, place, 0), valid


def messages(e: np.ndarray, valid: np.ndarray, moves: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log odds of the toxic state; e: (steps, chains)."""
    (a, b), (c, d) = np.exp(moves)
    f, back = np.empty_like(e), np.zeros_like(e)
    f[0] = start + e[0]
    for t in range(1, len(e)):
        x = np.exp(np.clip(f[t - 1], -40, 40))
        f[t] = e[t] + np.log((b + d * x) / (a + c * x))
    for t in range(len(e) - 2, -1, -1):
        x = np.exp(np.clip(e[t + 1] + back[t + 1], -40, 40))
        back[t] = np.where(valid[t + 1], np.log((c + d * x) / (a + b * x)), 0)
    return f, back


def _step(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Log odds after log odds x go through the products p: (2, 2, n)."""
    x = np.exp(np.clip(x, -40, 40))
    return np.log((p[0, 1] + p[1, 1] * x + 1e-300) / (p[0, 0] + p[1, 0] * x + 1e-300))


def carried_messages(e: np.ndarray, valid: np.ndarray, pieces: np.ndarray, moves: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """messages() of whole documents, each cut into so many pieces, one behind another: a column of e is a piece.

    A piece's steps multiply to one 2 x 2 matrix, which carries messages across it; with what comes in from both sides, the messages within follow."""
    pieces = pieces[pieces > 0]
    if not (pieces > 1).any():
        return messages(e, valid, moves, start)
    head = np.cumsum(pieces) - pieces
    first = np.zeros(e.shape[1], bool)
    first[head] = True
    last = np.roll(first, -1)
    m = np.repeat(np.exp(moves)[:, :, None], e.shape[1], 2)
    m[:, 0, first], m[:, 1, first] = 1.0, np.exp(start)
    w = np.exp(np.clip(e, -40, 40))
    p = m.copy()
    p[:, 1] *= w[0]
    (a, b), (c, d) = np.exp(moves)
    for t in range(1, len(e)):
        new = np.stack([np.stack([r[0] * a + r[1] * c, (r[0] * b + r[1] * d) * w[t]]) for r in p])
        p = np.where(valid[t], new / new.sum((0, 1)), p)
    into, after = np.zeros(e.shape[1]), np.zeros(e.shape[1])
    back = p.swapaxes(0, 1)
    order = np.argsort(-pieces, kind="stable")
    head, pieces = head[order], pieces[order]
    for k in range(1, int(pieces[0])):  # documents with more than k pieces
        own = head[: np.searchsorted(-pieces, -k)]
        n = pieces[: len(own)]
        into[own + k] = _step(into[own + k - 1], p[:, :, own + k - 1])
        at = own + n - k
        after[at - 1] = _step(after[at], back[:, :, at])
    f, out = np.empty_like(e), np.zeros_like(e)
    f[0] = e[0] + np.where(first, start, _step(into, np.exp(moves)[:, :, None]))
    for t in range(1, len(e)):
        f[t] = e[t] + _step(f[t - 1], np.exp(moves)[:, :, None])
    out[-1] = np.where(last, 0, after)
    for t in range(len(e) - 2, -1, -1):
        out[t] = np.where(valid[t + 1], _step(e[t + 1] + out[t + 1], np.exp(moves).T[:, :, None]), 0)
    return f, out


def _forms(words: Counter) -> set[str]:
    """Words of a document, and beginnings (with *) of two of its tokens or more: one such token is often chance."""
    stems = Counter()
    for w, k in words.items():
        for n in STEMS:
            if n < len(w):
                stems[w[:n] + "*"] += k
    return set(words) | {w for w, k in stems.items() if k > 1}


def lexicon(texts: Sequence[list[str]], toxic: np.ndarray, odds: float = 20.0, chance: float = 0.05, ways: int = 4) -> set[str]:
    """Words, and beginnings that go on in `ways` ways or more, that mark toxic documents: `odds` times as often in them as elsewhere, and so often that with probability `chance` at most any of the words seen did it by chance.

    A document where a word stands between the same two words as in an earlier one is a copy to it and doesn't count again."""
    inside, outside, met, heard = Counter(), Counter(), set(), set()
    for words, y in zip(texts, toxic, strict=True):
        if not y:
            outside.update(_forms(Counter(words)))
            continue
        around = {hash(k): k[1] for k in zip(["", *words], words, [*words[1:], ""], strict=False)}
        copied = {w for k, w in around.items() if k in met}
        inside.update(_forms(Counter(w for w in words if w not in copied)))
        met.update(around)
        heard.update(words)
    n, m = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    base = n / (n + m)
    inside = {w: k for w, k in inside.items() if k > 3}
    surprise = np.log(max(1, len(inside)) / chance)
    going_on = Counter(w[:k] + "*" for w in heard for k in STEMS if k < len(w))

    def marks(w: str, k: int) -> bool:
        if k / n <= odds * (outside[w] + 1) / m or (w.endswith("*") and going_on[w] < ways):
            return False
        p = k / (k + outside[w])
        return (k + outside[w]) * (p * np.log(p / base) + (1 - p) * np.log((1 - p + 1e-12) / (1 - base))) >= surprise

    return {w for w, k in inside.items() if marks(w, k)}


def train(texts: Sequence[str | None], toxic: Sequence[int], words: int = 20_000, rounds: int = 10, more: int = 3, seed: int = 5, odds: float | None = None) -> ToxicityModel:
    """A model from whole texts and their labels; without any toxic or any clean text, one whose scores are all the same side.

    `odds` are those of a toxic document where they aren't those of the texts, as in a sample by class."""
    y = np.asarray(toxic, np.int64)
    split = [[intern(w) for w in _WORDS.findall((t or "").lower())] for t in texts]  # one string for each word
    bad = lexicon(split, y)
    # of beginnings the shortest stands for those behind it
    bad = {w for w in bad if not w.endswith("*") or not any(w[:k] + "*" in bad for k in STEMS if k < len(w) - 1)}
    seen = Counter(w for s in split for w in set(s))
    common = sorted(bad) + [w for w, k in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if k >= 2 and w not in bad][: max(0, words - len(bad))]
    vocabulary = {w: i + 1 for i, w in enumerate(common)}
    model = ToxicityModel(vocabulary, np.zeros((3, len(vocabulary) + 1)), np.zeros((2, 2)), -3.0)
    model.weights[0] = -1.0
    ids = [np.array([model.forms[w] for w in s], np.int32) for s in split]
    del split, seen
    if bad and sum(map(len, ids)):
        marks = np.zeros(len(vocabulary) + 1, bool)
        marks[[vocabulary[w] for w in bad]] = True
        _descend(model, ids, [marks[x] & bool(k) for x, k in zip(ids, y, strict=True)], y, rounds, more, seed)
    x = model.features(texts)
    pool = np.zeros(3) if y.any() and not y.all() else np.array([6.0 if y.any() else -6.0, 0, 0])
    if y.any() and not y.all():
        for _ in range(60):  # Newton's method with a penalty, and steps short enough to converge where classes are separable
            p = sigmoid(x @ pool)
            h = (x * (p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(3)
            move = np.linalg.solve(h, x.T @ (p - y) + 0.3 * pool)
            pool = pool - move * min(1, 1 / np.linalg.norm(move).clip(1e-9))
        pool[0] += np.log(odds * (1 - y.mean()) / y.mean()) if odds else 0.0
    model.pool = pool
    return model


@dataclass
class Expected:
    """What a chain expects of documents that lie one behind another."""

    token: np.ndarray  # probability of the toxic state
    pairs: np.ndarray  # (4, documents): expected clean-clean, clean-toxic, toxic-clean and toxic-toxic neighbours
    clean: np.ndarray  # (documents,): probability that no token is toxic


def expected(model: ToxicityModel, ids: np.ndarray, lengths: np.ndarray) -> Expected:
    """Marginals of whole documents' chains, none of them empty."""
    place, valid = chains(lengths)
    pieces = -(-lengths // CHAIN)
    doc = np.repeat(np.arange(len(lengths)), pieces)
    e = np.where(valid, model.emissions(ids, lengths)[place], 0)
    f, b = carried_messages(e, valid, pieces, model.moves, model.start)
    p = sigmoid(f + b)
    token = np.empty(len(ids))
    token[place[valid]] = p[valid]
    # neighbours within a piece, and the last of a piece with the first of the next one of its document
    goes_on = np.append(doc[1:] == doc[:-1], False)
    left = np.concatenate((f[:-1], f[-1:]))
    right = np.concatenate(((e + b)[1:], np.roll((e + b)[:1], -1, axis=1)))
    both = np.concatenate((valid[1:] & valid[:-1], goes_on[None, :]))
    x, z = np.exp(np.clip(left, -40, 40)), np.exp(np.clip(right, -40, 40))
    pot = np.exp(model.moves)
    q = np.stack([pot[0, 0] + 0 * x, pot[0, 1] * z, pot[1, 0] * x, pot[1, 1] * x * z])
    q = np.where(both, q / q.sum(0), 0)
    stay = np.where(both, np.log((q[0] + 1e-300) / (q[0] + q[1] + 1e-300)), 0).sum(0)
    head = np.cumsum(pieces) - pieces
    log_clean = np.add.reduceat(stay, head) + np.log1p(-np.minimum(p[0, head], 1 - 1e-12))
    return Expected(token, np.add.reduceat(q.sum(1), head, axis=1), np.exp(np.minimum(log_clean, 0)))


def gradient(model: ToxicityModel, ids: np.ndarray, lengths: np.ndarray, tags: np.ndarray | None, toxic: np.ndarray) -> np.ndarray:
    """Of the negative log-likelihood by all weights, moves and the start: of the tags, or without tags of the documents' labels, where a toxic document is one with a toxic token.

    Expected features of a chain less those of the tags. Given a label, the tags' features are the expected ones under the
    condition; that is the features of a clean chain, further away from or nearer to the chain's own by clean / (1 - clean)."""
    own = expected(model, ids, lengths)
    ends = np.cumsum(lengths)
    first, last = ends - lengths, ends - 1
    if tags is None:
        doc = np.where(toxic > 0, -own.clean / np.maximum(1 - own.clean, 1e-9), 1.0)
        gap = own.token * np.repeat(doc, lengths)
        pairs = (own.pairs - np.stack([lengths - 1, *[0 * lengths] * 3])) @ doc
    else:
        t = tags.astype(float)
        gap = own.token - t
        s, u = t[:-1], t[1:]
        inner = np.ones(len(s), bool)
        inner[last[:-1]] = False
        pairs = own.pairs.sum(1) - np.array([((1 - s) * (1 - u))[inner].sum(), ((1 - s) * u)[inner].sum(), (s * (1 - u))[inner].sum(), (s * u)[inner].sum()])
    size = model.weights.shape[1]
    starts, stops = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
    starts[first] = stops[last] = True
    grad = [np.bincount(ids, gap, size), np.bincount(ids[:-1][~stops[:-1]], gap[1:][~starts[1:]], size), np.bincount(ids[1:][~starts[1:]], gap[:-1][~stops[:-1]], size)]
    return np.concatenate((*grad, pairs, [gap[first].sum()]))


def _descend(model: ToxicityModel, ids: list[np.ndarray], tags: list[np.ndarray], toxic: np.ndarray, rounds: int, more: int, seed: int) -> None:
    """Adam on batches of whole documents: `rounds` times over all of them with the first tags, `more` times with labels alone.

    In the second part toxic documents in which the chain finds nothing take no part: their labels may be wrong."""
    rng = np.random.default_rng(seed)
    own = np.array([i for i, x in enumerate(ids) if len(x)])
    sizes = np.array([len(ids[i]) for i in own])
    theta = np.concatenate((model.weights.ravel(), model.moves.ravel(), [model.start]))
    state, step, n = np.zeros((2, len(theta))), 0, model.weights.size
    for r in range(rounds + more):
        order = rng.permutation(len(own))
        cut = np.flatnonzero(np.diff(np.cumsum(sizes[order]) // min(STEP // 4, 1 + sizes.sum() // 16))) + 1
        for batch in np.split(order, cut):
            docs = own[batch]
            if r >= rounds:
                found = expected(model, np.concatenate([ids[i] for i in docs]), sizes[batch]).clean < 0.5
                batch = batch[found | (toxic[docs] == 0)]
                docs = own[batch]
                if not len(docs):
                    continue
            t = np.concatenate([tags[i] for i in docs]) if r < rounds else None
            flat = gradient(model, np.concatenate([ids[i] for i in docs]), sizes[batch], t, toxic[docs]) / len(docs)
            flat += 1e-4 * theta
            step += 1
            state[0] = 0.9 * state[0] + 0.1 * flat
            state[1] = 0.99 * state[1] + 0.01 * flat**2
            pace = 0.15 if r < rounds else 0.02
            theta = theta - pace * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-6)
            model.weights, model.moves, model.start = theta[:n].reshape(model.weights.shape), theta[n:-1].reshape(2, 2), float(theta[-1])


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> ToxicityModel:
    """Trains on labelled documents that are not held out: of each class those that come first by a hash of their keys, at most `sample` rows and `sample_bytes` bytes of whole texts.

    That bounds what the driver gets. A document labelled both ways counts as toxic; rows without a key or label aren't
    learned from, null texts are empty ones; rows that repeat a key count one by one. Without labels nothing is toxic."""
    own = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("__key")).agg(F.max(label).alias("__y"))
    drawn = None
    for y in (0, 1):
        part = own.filter(F.col("__y") == y).orderBy(F.xxhash64("__key", F.lit(11)), "__key").limit(sample)
        drawn = part if drawn is None else drawn.unionByName(part)
    drawn = materialize(drawn, "toxicity-sample")
    counts = {r["__y"]: r["n"] for r in own.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    rows = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text")).join(checked_broadcast(drawn, 16), "__key")
    order = Window.partitionBy("__y").orderBy(F.xxhash64("__key", F.lit(11)), "__key", F.xxhash64("__text"))
    so_far = F.sum(F.octet_length("__text")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("__at", F.row_number().over(order)).filter(F.col("__at") <= sample).withColumn("__bytes", so_far).filter(F.col("__bytes") <= sample_bytes)
    rows = rows.select("__key", "__text", "__y").collect()
    discard(drawn)
    rows.sort(key=lambda r: (r["__key"], r["__text"]))
    return train([r["__text"] for r in rows], [int(r["__y"]) for r in rows], odds=counts.get(1, 0) / max(1, counts.get(0, 0)))


def with_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", into: str = "toxicity") -> DataFrame:
    """docs with the score of each whole text, 0 to 1, in the column `into`, which replaces one of that name; other columns pass through.

    Null counts as empty and scores as a text without a toxic word. Equal rows get equal scores; an empty table stays
    empty. However long a text, it is one chain; one batch of texts is held by a task."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts.tolist()))

    small_batches(docs.sparkSession)
    return docs.withColumn(into, score(F.col(text)))


def with_toxic_spans(docs: DataFrame, model: ToxicityModel, text: str = "text", into: str = "toxic_spans") -> DataFrame:
    """docs with an array of (start, end) in code points of the offending runs of words; null and empty texts have none. Rows, columns and long texts are treated as by with_toxicity()."""

    @F.pandas_udf("array<array<int>>")
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[list(s) for s in model.spans(t)] for t in texts], dtype=object)

    small_batches(docs.sparkSession)
    return docs.withColumn(into, spans(F.col(text)))
