"""Byte-pair encoding and decoding with the vocabulary and merges of a byte-level tokenizer file.

Forced boundaries: no merge can join two neighbouring bytes that stand side by side in no vocabulary token, so a text
may be cut there; fragments are encoded on their own, each distinct one once, and their ids are concatenated. They are
used twice. A whole text is cut at those in front of white space, where the tokenizer's splitting into words, which
looks at what lies around, is not changed by the cut. Words are then cut at all of them, and what is left is merged here,
in the order of the file's merges.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import small_batches

#: Distinct fragments, and words, that a worker remembers anew before it forgets those of the generation before, and the longest of them in characters.
CACHE_ROWS, CACHE_CHARS = 100_000, 48
#: Symbols up to which all places of the best pair are merged at once; longer fragments take a heap of pairs.
SCAN = 64
#: Bits of an id in a number that holds two; what no merge's number reaches, and the mark of a forced boundary.
BITS, NEVER, CUT = 24, 1 << 62, 1 << 63
LAST = (1 << BITS) - 1


#: How byte-level tokenizers split a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A fragment of one Latin word and the marks after it, which such a splitter takes apart there and nowhere else.
_WORD = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)?((?(1)| ?)[.,;:!?|]+)?\Z").match
#: Letters whose classes no version of Unicode changes: in such text the words are split here, in other by the file's own splitter.
_OTHER = re.compile("[^\x00-\u024f]").search


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 as itself, other bytes from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


def _splitter(inside: np.ndarray) -> Callable[[str], list[str]]:
    """Cuts a text in front of white space, unless other white space comes before it or the two bytes at the cut are inside a token; inside: by first and second byte."""
    held = {b for b in range(256) if inside[b, [9, 10, 11, 12, 13, 32]].any()}
    last = lambda c: chr(c).encode("utf-8", "surrogatepass")[-1]
    no_cut = "".join(f"\\u{c:04x}" for c in range(0x21, 0x10000) if last(c) in held) + "\U00010000-\U0010ffff"
    return re.compile(rf"(?s:.)(?:[^\t-\r ]+|(?<=[\s{no_cut}])[\t-\r ])*").findall


class ForcedBoundaryBPE:
    """The coder of one tokenizer file; texts in, little-endian unsigned 32-bit ids out, and back."""

    def __init__(self, path: str, remember: int = CACHE_ROWS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        plain = not spec["normalizer"] and spec["pre_tokenizer"].get("type") == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space") and not model.get("ignore_merges")
        if not plain or any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
            raise ValueError(f"{path} is not a plain byte-level tokenizer")
        stand = _byte_of_char()
        self.bytes_of: list[bytes] = [b""] * self.tokenizer.get_vocab_size(with_added_tokens=True)
        inside = np.zeros((256, 256), bool)
        for token, i in [*model["vocab"].items(), *((a["content"], a["id"]) for a in added)]:
            known = all(c in stand for c in token)
            self.bytes_of[i] = raw = bytes(stand[c] for c in token) if known else token.encode()
            inside[list(raw[:-1]), list(raw[1:])] = True
        for a in added:
            self.bytes_of[a["id"]] = a["content"].encode()
        vocab = model["vocab"]
        self.byte_id = [vocab.get(c) for c, _ in sorted(stand.items(), key=lambda x: x[1])]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: Of two ids side by side, as one number: the merge's rank and, in the last BITS, the id of both.
        self.merges = {vocab[a] << BITS | vocab[b]: rank << BITS | vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        #: Of two bytes side by side: the number of their merge, NEVER without one, CUT where no token holds them.
        self.pairs = [[CUT if not inside[a, b] else self.merges.get(self.byte_id[a] << BITS | self.byte_id[b], NEVER) for b in range(256)] for a in range(256)]
        self.fragments = _splitter(inside)
        self.added = {a["content"]: a["id"] for a in added}
        self.special = re.compile("|".join(re.escape(a) for a in sorted(self.added, key=len, reverse=True)) or "(?!)")
        self.words = regex.compile(WORDS).findall
        self.remember = remember
        self.known: dict[str, bytes] = {}
        self.known_words: dict[str, list[int]] = {}
        self.older: dict[str, bytes] = {}
        self.older_words: dict[str, list[int]] = {}

    def merged(self, raw: bytes, ranks: list[int]) -> list[int]:
        """Ids of bytes without a forced boundary among them, from the numbers of their pairs: the leftmost pair of the least rank is merged, until none is left."""
        get, ids = self.merges.get, [self.byte_id[b] for b in raw]
        if len(ids) > SCAN:
            return self._merged_by_heap(ids)
        while ranks and (best := min(ranks)) != NEVER:
            i = ranks.index(best)
            ids[i] = new = best & LAST
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << BITS | new, NEVER)
            if i < len(ranks):
                ranks[i] = get(new << BITS | ids[i + 1], NEVER)
        return ids

    def _merged_by_heap(self, ids: list[int]) -> list[int]:
        get, n = self.merges.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i) for i in range(n - 1) if (m := get(ids[i] << BITS | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            best, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or get(ids[i] << BITS | ids[j]) != best:
                continue  # one of the two has been merged with another one
            new = best & LAST
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (m := get(new << BITS | ids[k])) is not None:
                    heapq.heappush(heap, (m, i))
            if (h := before[i]) >= 0 and (m := get(ids[h] << BITS | new)) is not None:
                heapq.heappush(heap, (m, h))
        return [x for x in ids if x >= 0]

    def _word(self, word: str) -> list[int]:
        """Ids of one word, cut at its forced boundaries."""
        if found := self.known_words.get(word):
            return found
        if found := self.older_words.get(word):
            return self._remember_word(word, found)
        raw, rows = word.encode("utf-8", "surrogatepass"), self.pairs
        ranks = [rows[a][b] for a, b in zip(raw, raw[1:])]
        out, at = [], 0
        while CUT in ranks[at:]:
            i = ranks.index(CUT, at)
            out += self.merged(raw[at : i + 1], ranks[at:i])
            at = i + 1
        out += self.merged(raw[at:], ranks[at:])
        return self._remember_word(word, out)

    def _remember_word(self, word: str, ids: list[int]) -> list[int]:
        if len(word) <= CACHE_CHARS:
            if len(self.known_words) >= self.remember:
                self.older_words, self.known_words = self.known_words, {}
            self.known_words[word] = ids
        return ids

    def _fresh(self, fragment: str) -> bytes:
        if found := self.older.get(fragment):
            return self._remember(fragment, found)
        ids, at = array("I"), 0
        if one := _WORD(fragment):
            for word in one.groups():
                if word:
                    ids.extend(self._word(word))
            return self._remember(fragment, ids.tobytes())
        for m in [*self.special.finditer(fragment), None]:
            part = fragment[at : m.start() if m else None]
            words = [part[a:b] for _, (a, b) in self.split(part)] if _OTHER(part) else self.words(part)
            for word in words:
                ids.extend(self._word(word))
            if m:
                ids.append(self.added[m[0]])
                at = m.end()
        return self._remember(fragment, ids.tobytes())

    def _remember(self, fragment: str, ids: bytes) -> bytes:
        if len(fragment) <= CACHE_CHARS:
            if len(self.known) >= self.remember:
                self.older, self.known = self.known, {}
            self.known[fragment] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, 4 bytes each; null as empty."""
        known, fresh = self.known.get, self._fresh  # a generation that is replaced meanwhile still holds what it held
        return b"".join([known(f) or fresh(f) for f in self.fragments(text or "")])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@cache
def coder(file: str, remember: int = CACHE_ROWS) -> ForcedBoundaryBPE:
    """One coder for each worker process, file and number of words to remember (some 250 bytes each, twice): a name among the public tokenizers, whose place each machine knows for itself, or a path."""
    if "/" in file:
        return ForcedBoundaryBPE(file, remember)
    import public_tokenizers

    return ForcedBoundaryBPE(public_tokenizers.path(file), remember)


def encode_column(docs: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """docs with the token ids of `text` as array<int> in the column `into`, which replaces one of that name; `path` is a file of coder().

    Null and empty texts have no ids. Equal rows get equal ids, an empty table stays empty, other columns pass through. A
    text is encoded whole, however long; one batch of texts and their ids is held by a task."""

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        own = coder(path)
        return pd.Series([np.frombuffer(own.encode(t), "<i4") for t in texts], dtype=object)

    small_batches(docs.sparkSession)
    return docs.withColumn(into, encode(F.col(text)))


def decode_column(docs: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """docs with the text of the ids in the column `into`, which replaces one of that name; null as empty. Bytes that aren't UTF-8 become U+FFFD."""

    @F.pandas_udf("string")
    def decode(rows: pd.Series) -> pd.Series:
        own = coder(path)
        return pd.Series([own.decode(np.asarray([] if r is None else r, "<u4").tobytes()) for r in rows], dtype=object)

    small_batches(docs.sparkSession)
    return docs.withColumn(into, decode(F.col(ids)))
