"""The corpus operators against brute force and on awkward rows: nulls, empty texts, repeated rows, empty tables, clashing columns."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidegrid.llm import bpe, chat, langid, line_dedup, mixing, near_dedup, simhash, suffix_dedup, topk, toxicity
from tidegrid.llm.components import connected_components
from tidegrid.llm.exact_dedup import exact_dedup
from tidegrid.llm.queries import TOKENIZER

WORDS = [a + b for a in ("the", "an", "er", "in", "st", "re") for b in ("ha", "on", "ed", "ing", "ly", "tion", "ble", "es")]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def near_texts(r, n=30):
    out = []
    for _ in range(n):
        base = prose(r, r.randint(30, 90)).split()
        out.append(" ".join(base))
        for _ in range(r.randint(0, 2)):
            copy = list(base)
            copy[r.randrange(len(copy))] = "changed"
            out.append("  ".join(copy))
    return out + [None, "", "one", "One", " \t"]


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


# ---- SimHash -----------------------------------------------------------------------------------------------------


def slow_fingerprint(text, n=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    r = random.Random(1)
    for text in [*near_texts(r), "ÀB c  d e", prose(r, 700), "a " * 70_000]:
        if len(text or "") < 10_000:
            assert simhash.fingerprint(text) == slow_fingerprint(text)
    assert simhash.fingerprint("a " * 70_000) == simhash.fingerprint("a a a a")


@pytest.mark.parametrize("bucket_rows", [4096, 4])
def test_simhash_links(spark, bucket_rows):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(12)]
    prints = list({b ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 4))) & (2**64 - 1) for b in base for _ in range(9)})
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    links = simhash.close_links(spark.createDataFrame([(p,) for p in signed], "fp long"), 4, bucket_rows=bucket_rows)
    for a, b in links.collect():
        assert bin((a ^ b) & (2**64 - 1)).count("1") <= 4
    got = {x["node"]: x["root"] for x in connected_components(links).collect()}
    want = components(range(len(signed)), lambda i, j: bin((signed[i] ^ signed[j]) & (2**64 - 1)).count("1") <= 4)
    groups = lambda f: sorted(Counter(f(i) for i in range(len(signed))).values())
    assert groups(lambda i: got.get(signed[i], signed[i])) == groups(want.get)


def test_simhash_groups(documents):
    texts = near_texts(random.Random(3))
    df = documents(texts).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1))
    got = {x["doc_id"]: x for x in simhash.simhash_groups(df.repartition(3)).collect()}
    want = components(range(len(texts)), lambda i, j: bin(slow_fingerprint(texts[i]) ^ slow_fingerprint(texts[j])).count("1") <= 4)
    assert {i: x["component_id"] for i, x in got.items()} == want
    assert simhash.simhash_groups(documents([]).select("doc_id", "text")).count() == 0
    twice = documents([(5, "a b c d e"), (5, "a b c d e"), (7, "a b c d e")])
    assert [tuple(x)[::2] for x in sorted(simhash.simhash_groups(twice).collect())] == [(5, 5), (5, 5), (7, 5)]


def test_components_of_a_chain(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7)]
    got = {x["node"]: x["root"] for x in connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[300] == got[200] == got[100] == 100
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_dedup(documents):
    texts = near_texts(random.Random(4))
    sets = [set(near_dedup.shingle_set(t, 5).tolist()) for t in texts]
    want = components(range(len(texts)), lambda i, j: (len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] | sets[j] else 1) >= 0.8)
    kept = {x["doc_id"] for x in near_dedup.near_dedup(documents(texts).withColumn("sid", F.lit(0))).collect()}
    assert kept == set(want.values())
    assert near_dedup.near_dedup(documents([])).count() == 0


def test_near_dedup_of_chains(documents):
    """Where each text is like the next one only, a chain is one group."""
    r, texts = random.Random(22), []
    for c in range(20):
        words = [f"w{c}x{i}" for i in range(200)]
        for k in range(40):
            for i in range(3):
                words[(9 * k + 66 * i) % 200] = f"new{c}y{k}z{i}"
            texts.append(" ".join(words))
    r.shuffle(texts)
    sets = [set(near_dedup.shingle_set(t, 5).tolist()) for t in texts]
    want = components(range(len(texts)), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    assert len(set(want.values())) == 20
    got = near_dedup.near_groups(documents(texts))
    assert {x["key"]: x["leader"] for x in got.collect()} == want


def test_near_dedup_of_awkward_rows(documents):
    """Keys with several texts, repeated rows, null keys, very long texts."""
    a, b, long = prose(random.Random(23), 40), prose(random.Random(24), 40), prose(random.Random(25), 60_000)
    rows = [(1, a), (1, a), (2, b), (1, b), (None, a), (5, long), (6, long + " end"), (7, None), (8, " "), (9, "one"), (4, "two")]
    got = sorted((x["doc_id"] or 0, x["text"] or "") for x in near_dedup.near_dedup(documents(rows).withColumn("words", F.lit(0))).collect())
    assert got == sorted([(1, a), (1, a), (1, b), (0, a), (5, long), (7, ""), (9, "one"), (4, "two")])


@pytest.mark.parametrize("set_rows", [1024, 64])
def test_near_dedup_of_a_star(documents, set_rows):
    """Copies that are like their original but not like each other all meet it, however large their buckets."""
    r = random.Random(21)
    base, texts = [f"w{i}" for i in range(204)], []
    for k in range(600):
        copy = list(base)
        for part in r.sample(range(20), 4):
            copy[10 * part + r.randrange(2, 8)] = f"x{k}y{part}"
        texts.append(" ".join(copy))
    texts.insert(300, " ".join(base))
    own = [near_dedup.shingle_set(t, 5) for t in texts]
    met = [near_dedup.bands(s) for s in own]
    prints = [simhash.fingerprint(t, 5) for t in texts]
    linked = lambda i, j: ((met[i] == met[j]).any() or bin(prints[i] ^ prints[j]).count("1") <= 4) and near_dedup.similarity(own[i], own[j]) >= 0.8
    want = components(range(len(texts)), linked)
    assert len(set(want.values())) < 5
    got = near_dedup.near_groups(documents(texts), set_rows=set_rows, bucket_rows=set_rows)
    assert {x["key"]: x["leader"] for x in got.collect()} == want


# ---- exact and line dedup ----------------------------------------------------------------------------------------


def test_exact_dedup(documents):
    texts = ["a  b", "a b", "a\tb", " a b", None, "", " ", "x" * 300 + "1", "x" * 300 + "2", "x" * 300 + "1"]
    df = documents(texts).withColumn("keep_id", F.lit("clash"))
    got = {x["doc_id"]: (x["keep_id"], x["group_size"], x["kept"]) for x in exact_dedup(df).collect()}
    assert got == {0: (0, 3, True), 1: (0, 3, False), 2: (0, 3, False), 3: (3, 1, True), 4: (4, 2, True), 5: (4, 2, False), 6: (6, 1, True), 7: (7, 2, True), 8: (8, 1, True), 9: (7, 2, False)}
    assert exact_dedup(documents([])).count() == 0
    assert [tuple(x) for x in exact_dedup(documents([(1, "a"), (1, "a")])).collect()] == [(1, 1, 2, True)] * 2


def test_exact_dedup_of_awkward_rows(documents):
    """Null keys, very long texts that differ at the end, one key with an open and a single text, clashing columns."""
    long = "word " * 60_000
    rows = [(None, "a"), (4, "a"), (None, "b"), (5, long + "x"), (6, long + "y"), (7, long + "x"), (4, "single text")]
    df = documents(rows).withColumn("__len", F.lit(1)).withColumn("kept", F.lit(2))
    out = exact_dedup(df, carry=["lang"], derive={"size": F.length("__norm")})
    got = sorted(((x["doc_id"], x["keep_id"], x["group_size"], x["kept"], x["size"]) for x in out.collect()), key=str)
    assert got == sorted([(None, 4, 2, False, 1), (4, 4, 2, True, 1), (None, None, 1, True, 1), (5, 5, 2, True, 300_001), (6, 6, 1, True, 300_001), (7, 5, 2, False, 300_001), (4, 4, 1, True, 11)], key=str)


def test_line_dedup(documents):
    own = [f"own text of document {i} that is long enough" for i in range(6)]
    texts = [f"{o}\n Terms of use \n\nlast {i}" for i, o in enumerate(own)] + ["Terms of use", None, "", own[0]]
    df = documents(texts, source=["a", "b", "c", None, "a", "b", "z", "a", "b", "c"]).withColumn("pos", F.lit(1)).withColumn("h", F.lit(2))
    got = {x["doc_id"]: x for x in line_dedup.line_dedup(df, min_sites=3).collect()}
    assert got[0]["text"] == f"{own[0]}\n\nlast 0" and (got[0]["n_lines"], got[0]["n_removed"]) == (4, 1)
    assert got[6]["text"] == "Terms of use" and got[7]["text"] is None and got[8]["text"] == "" and got[9]["text"] == own[0]
    assert all(got[i]["n_removed"] == 1 for i in range(6))
    assert line_dedup.line_dedup(documents([])).count() == 0
    assert sorted(line_dedup.line_dedup(df.drop("pos", "h"), min_sites=30).select("text").collect(), key=str) == sorted(df.select("text").collect(), key=str)


def test_line_dedup_of_mostly_boilerplate(documents):
    """A short text loses the long license around it; a document of spread lines only stays."""
    license = "Permission is granted to anyone to use this text in any way and for any purpose whatever\n" * 4
    texts = [f"{license}own {i}\n{license}" for i in range(4)] + [license]
    got = {x["doc_id"]: x for x in line_dedup.line_dedup(documents(texts, source=list("abcde")), min_sites=3).collect()}
    assert all(got[i]["text"] == f"own {i}\n" and got[i]["n_removed"] == 8 for i in range(4))
    assert got[4]["text"] == license and got[4]["n_removed"] == 0


def test_line_dedup_of_awkward_rows(documents):
    """Repeated rows, null keys, ties of lines within a text, and a text of very many lines."""
    rows = [(1, "a\nx\nx\nown"), (1, "a\nx\nx\nown"), (None, "x\nleft"), (None, None), (2, "x\n" * 20_000 + "end"), (3, "x")]
    df = documents(rows, source=["s", "s", "t", "t", "u", "v"]).withColumn("n_lines", F.lit("clash")).withColumn("cut", F.lit(1))
    got = sorted(((x["doc_id"], x["text"], x["n_lines"], x["n_removed"]) for x in line_dedup.line_dedup(df, min_sites=4).collect()), key=str)
    assert got == sorted([(1, "a\nown", 4, 2)] * 2 + [(None, "left", 2, 1), (None, None, 1, 0), (2, "end", 20_001, 20_000), (3, "x", 1, 0)], key=str)


# ---- byte-pair coding --------------------------------------------------------------------------------------------


def test_bpe_equals_the_library():
    own, r = bpe.coder(TOKENIZER), random.Random(5)
    parts = ["a", "b'", "'s", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "à", "à ", "ñ", "日本", "1", "<|endoftext|>", "<|", "#", "😀", "é", " the", "word.", " Ǆ"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(3000)] + ["x" * 5000, "à la " * 500, "".join(r.choice("etaoinshr") for _ in range(3000)), "ab" * 400 + "!?" * 300]
    for t in texts:
        ids = own.tokenizer.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == np.array(ids, "<u4").tobytes(), t
        assert own.decode(own.encode(t)) == own.tokenizer.decode(ids, skip_special_tokens=False)
        assert "".join(own.fragments(t)) == t
    assert own.encode(None) == b"" and own.decode(b"") == ""


def test_bpe_columns(documents):
    df = documents(["Hello there, world.", None, "", "é <|endoftext|> x"]).withColumn("ids", F.lit("clash"))
    out = bpe.decode_column(bpe.encode_column(df, TOKENIZER), TOKENIZER).orderBy("doc_id").collect()
    assert [x["decoded"] for x in out] == ["Hello there, world.", "", "", "é <|endoftext|> x"]
    assert 50256 in out[3]["ids"] and out[1]["ids"] == []
    assert bpe.encode_column(documents([]), TOKENIZER).count() == 0


# ---- mixing ------------------------------------------------------------------------------------------------------


def test_targets(spark):
    rows = [("a", 100), ("b", 1000), ("c", 10), ("d", 500), (None, 40), ("e", 0)]
    got = {x["source"]: x["target"] for x in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    weights = dict(zip(["a", "b", "c", "d", "e", None], [5, 2, 1, 5, 2, 1]))
    size, target, free = dict(rows), {}, set(weights)
    left = float(sum(size.values()))
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            break
        target |= {s: 3.0 * size[s] for s in over}
        left, free = left - sum(3 * size[s] for s in over), free - over
    assert got == pytest.approx(target | share)


def test_mix(documents):
    r = random.Random(6)
    texts = [prose(r, r.choice([1, 5, 40, 400])) for _ in range(600)] + ["", None]
    source = [r.choice("aaab") for _ in texts[:-2]] + ["c", None]
    df = documents(texts, source=source)
    sizes = df.select(F.col("doc_id").alias("key"), "source", mixing.word_count(F.col("text")).alias("size"))
    rows = mixing.mix_sizes(sizes, block=16).collect()
    assert len(rows) == len(texts)
    assert all(x["size"] == len((texts[x["key"]] or "").split()) for x in rows)
    assert all(x["taken"] <= 3 * x["size"] and x["taken"] == x["copies"] * x["size"] for x in rows)
    for s in "ab":
        own = [x for x in rows if source[x["key"]] == s]
        assert abs(sum(x["taken"] for x in own) - own[0]["target"]) <= 400  # one document
    again = mixing.mix_sizes(sizes.repartition(7), block=16).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mix_sizes(sizes.filter("false")).count() == 0
    assert mixing.mix_documents(df, block=16).count() == sum(x["copies"] for x in rows)


def test_mix_of_a_hot_key(documents, spark):
    """A key that a third of all rows repeat, and null keys: each row counts, and the target is met."""
    rows = [(7, "a b c d e")] * 3000 + [(None, "x y")] * 11 + [(100 + i, prose(random.Random(i), 9)) for i in range(900)]
    df = documents(rows, source=["s" if i % 2 else "t" for i in range(len(rows))]).withColumn("copies", F.lit("clash"))
    sizes = df.select(F.col("doc_id").alias("key"), "source", mixing.word_count(F.col("text")).alias("size"))
    got = mixing.mix_sizes(sizes, block=16).collect()
    assert len(got) == len(rows)
    for s in "st":
        own = [x for x in got if x["source"] == s]
        assert abs(sum(x["taken"] for x in own) - own[0]["target"]) <= 9
        assert len({x["copies"] for x in own if x["key"] == 7}) <= 2
    out = mixing.mix_documents(df, block=16)
    assert out.columns == df.columns and out.count() == sum(x["copies"] for x in got)
    assert Counter(x["source"] for x in out.filter("doc_id = 7").collect()) == Counter({s: sum(x["copies"] for x in got if x["source"] == s and x["key"] == 7) for s in "st"})
    assert mixing.mix_documents(df.filter("false")).count() == 0
    assert mixing.mix_documents(documents([(1, "w " * 200_000), (2, "a")], source=["a", "b"])).count() >= 1


def test_pairs_keep_words_and_odds(spark):
    """Every block keeps its words, and a document is taken about as often as its mass says."""
    taken, n = Counter(), 300
    items = [(k, 10 * (k + 1)) for k in range(6)]
    rows = spark.range(n).withColumn("items", F.expr("array(" + ",".join(f"named_struct('size', {s}L, 'key', id * 10 + {k}, 'mass', {0.3 * s}D)" for k, s in items) + ")"))
    for x in rows.select(F.expr(mixing._round_block("items", 0, 3)).alias("r")).collect():
        r = x["r"]
        assert sum(d["take"] * d["size"] for d in r["out"]) + r["c"]["mass"] == pytest.approx(0.3 * 210)
        assert len(r["out"]) == 5
        for d in r["out"]:
            taken[d["key"] % 10] += d["take"]
        taken[r["c"]["key"] % 10] += r["c"]["mass"] / r["c"]["size"]
    assert all(abs(taken[k] / n - 0.3) < 0.1 for k in range(6))


# ---- chats -------------------------------------------------------------------------------------------------------


def test_chats(spark):
    r = random.Random(7)
    parts = ["###", "</turn>", "\\", "\\h", "h", ":", " ", "\n", "é日", "#", "<", "text", "### user: x</turn>\n"]
    rows = [(c, t, r.choice(["user", "assistant", "system", "a:b", None]), r.choice([None, "", "".join(r.choice(parts) for _ in range(r.randint(1, 9)))])) for c in [*range(40), None] for t in r.sample(range(20), r.randint(1, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("mask", F.lit(0))
    got = {x["conv_id"]: x for x in chat.format_chats(df.repartition(5)).collect()}
    for c in {x[0] for x in rows}:
        turns = [(b or "", t or "") for _, _, b, t in sorted((x for x in rows if x[0] == c), key=lambda x: x[1])]
        assert chat.parse(got[c]["formatted"]) == turns
        m = got[c]["mask"]
        assert [chat.unescape(got[c]["formatted"][a:b]) for a, b in zip(m[::2], m[1::2])] == [t for b, t in turns if b == "assistant"]
        assert got[c]["n_turns"] == len(turns)
    assert chat.format_chats(df.filter("false")).count() == 0


def test_chat_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(c, t, "user", f"{c}-{t}") for c, n in ((1, 2), (2, 11), (3, 1), (4, 3)) for t in range(n)]
        got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)).collect()
        assert {x["conv_id"]: [t for _, t in chat.parse(x["formatted"])] for x in got} == {c: [f"{c}-{t}" for t in range(n)] for c, n in ((1, 2), (2, 11), (3, 1), (4, 3))}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# ---- repeated passages -------------------------------------------------------------------------------------------


def slow_spans(texts, n):
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        mark = [False] * len(t)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                mark[i : i + n] = [True] * n
        out.append(mark)
    return out


@pytest.mark.parametrize("group_bytes", [1 << 20, 100])
def test_suffix_dedup(documents, group_bytes):
    r = random.Random(8)
    shared = [prose(r, 14), prose(r, 30), "ab" * 60, "é" * 50]
    texts = [None, "", "short", "z" * 200, "z" * 199]
    for _ in range(40):
        parts = [prose(r, r.randint(0, 20)) for _ in range(2)]
        cut = r.choice(shared)[r.randint(0, 9) :]
        texts.append(parts[0] + cut + parts[1])
    raw = [(t or "").encode() for t in texts]
    df = documents(texts).withColumn("tid", F.lit("clash")).withColumn("starts", F.lit(1)).withColumn("own", F.lit(1))
    got = {x["doc_id"]: x for x in suffix_dedup.suffix_dedup(df, length=40, gram=8, group_bytes=group_bytes).collect()}
    for i, mark in enumerate(slow_spans(raw, 40)):
        assert bytes(got[i]["kept"]) == bytes(b for b, m in zip(raw[i], mark) if not m)
        assert got[i]["n_spans"] == sum(m and not (k and mark[k - 1]) for k, m in enumerate(mark))
        assert got[i]["n_bytes"] == len(raw[i]) and got[i]["starts"] == 1
    assert suffix_dedup.suffix_dedup(documents([]), length=40, gram=8).count() == 0
    assert [x["n_removed"] for x in suffix_dedup.suffix_dedup(documents([(1, "q" + prose(r, 30)), (1, "w")] * 2), length=40, gram=8).orderBy("n_bytes").collect()][:2] == [0, 0]


def test_suffix_order():
    r = random.Random(9)
    for _ in range(150):
        data = bytes(r.choice(b"abc"[: r.randint(1, 3)]) for _ in range(r.randint(1, 200)))
        n = r.choice([1, 3, 9])
        wanted = np.array([r.random() < 0.6 for _ in data])
        order = suffix_dedup.suffix_order(np.frombuffer(data, np.uint8), wanted, n)
        assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist()
        assert [data[i : i + n] for i in order] == sorted(data[i : i + n] for i in order)


def test_repeats_follow_from_order_and_bytes():
    """Neighbours in the order of suffixes decide by their bytes; with another order repeats are lost."""
    r = random.Random(16)
    parts = [prose(r, 30).encode() for _ in range(6)]
    data = np.frombuffer(b"\xff".join(r.choice(parts)[r.randrange(40) :] for _ in range(30)), np.uint8)
    wanted = np.array([b"\xff" not in data[i : i + 50].tobytes() and i + 50 <= len(data) for i in range(len(data))])
    seen = Counter(data[i : i + 50].tobytes() for i in np.flatnonzero(wanted))
    hit = suffix_dedup.repeated_windows(data, wanted, 50)
    assert [i for i in np.flatnonzero(wanted) if seen[data[i : i + 50].tobytes()] > 1] == np.flatnonzero(hit).tolist()
    a, b = rng_pairs(len(data))
    want = [next((k for k in range(50) if max(i, j) + k >= len(data) or data[i + k] != data[j + k]), 50) for i, j in zip(a, b)]
    assert suffix_dedup.common_prefixes(data, a, b, 50).tolist() == want
    kept, suffix_dedup.suffix_order = suffix_dedup.suffix_order, lambda d, w, n: np.random.default_rng(0).permutation(np.flatnonzero(w))
    try:
        assert not (suffix_dedup.repeated_windows(data, wanted, 50) == hit).all()
    finally:
        suffix_dedup.suffix_order = kept


def rng_pairs(n):
    rng = np.random.default_rng(17)
    a, b = rng.integers(0, n, 300), rng.integers(0, n, 300)
    return a[a != b], b[a != b]


# ---- vectors -----------------------------------------------------------------------------------------------------


def test_topk(spark):
    rng = np.random.default_rng(10)
    v = rng.integers(-3, 4, (400, 8)) / 4
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1001, [float("nan")] * 8), (1002, [None] + [0.0] * 7), (1050, [1.0, 2.0]), (1100, [float("inf")] * 8), (1150, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("slot", F.lit("clash"))
    own = df.select("vec_id", topk.floor_components(F.col("embedding")).alias("v"))
    got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in topk.exact_topk(own, F.col("vec_id") % 50 == 0, 5, slot_rows=90).collect()}
    whole = {i: [int(np.floor(256 * x)) for x in r] for i, r in rows if r and None not in r and np.isfinite(r).all()}
    want = {}
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], w)), i) for i, w in whole.items() if i != q and len(w) == len(whole[q]))[:5]
        want |= {(q, k): (i, -s) for k, (s, i) in enumerate(best, 1)}
    assert got == want
    assert topk.exact_topk(own.filter("false"), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_topk_of_awkward_rows(spark):
    """Numbers that don't fit, repeated rows, null keys, empty vectors; and clusters, where bounds leave few pairs."""
    rows = [(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.5, 0.5]), (None, [1.0, 1.0]), (50, []), (51, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    own = df.select("vec_id", topk.floor_components(F.col("embedding")).alias("v"), "rank")
    got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in topk.exact_topk(own, F.col("vec_id") % 50 == 0, 5).collect()}
    assert got == {(0, 1): (1, 2**63 - 1), (0, 2): (3, 2**63 - 1), (0, 3): (2, -(2**63)), (0, 4): (2, -(2**63)), (50, 1): (51, 0)}
    rng = np.random.default_rng(19)
    v = (rng.integers(-400, 400, (40, 64))[rng.integers(0, 40, 1500)] + rng.integers(-3, 4, (1500, 64))).astype(np.int64)
    slot = topk.Slot(np.arange(1500), v)
    q, c, s = slot.top(np.arange(0, 1500, 100), v[::100], 5)
    for i in range(0, 1500, 100):
        want = sorted((-int(v[i] @ v[j]), j) for j in range(1500) if j != i)[:5]
        assert [(-x, j) for j, x in zip(c[q == i].tolist(), s[q == i].tolist())] == want


# ---- trained models ----------------------------------------------------------------------------------------------


def test_toxicity(documents, spark):
    r = random.Random(11)
    bad = ["idiot", "scum", "moron"]
    texts, toxic = [], []
    for i in range(300):
        words = prose(r, 40).split()
        if i % 3 == 0:
            for _ in range(3):
                words.insert(r.randrange(40), r.choice(bad))
        texts.append(" ".join(words))
        toxic.append(int(i % 3 == 0))
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    docs = documents([*texts, None, ""])
    model = toxicity.fit(docs, labels)
    out = {x["doc_id"]: x["toxicity"] for x in toxicity.with_toxicity(docs, model).collect()}
    assert np.mean([(out[i] >= 0.5) == bool(y) for i, y in enumerate(toxic)]) > 0.98
    assert out[300] < 0.5 and out[301] < 0.5 and all(0 <= s <= 1 for s in out.values())
    text = "the on you idiot the on"
    assert [text[a:b] for a, b in model.spans(text)] == ["idiot"]
    assert toxicity.with_toxic_spans(documents([text, None]), model).orderBy("doc_id").first()["toxic_spans"] == [[11, 16]]
    none = toxicity.fit(docs, labels.filter("false"))
    assert none.scores(["anything", None]).max() < 0.5


def test_chain_messages():
    """Marginals by forward and backward messages equal those by enumeration."""
    rng = np.random.default_rng(12)
    e, moves, start = rng.normal(size=(5, 1)), rng.normal(size=(2, 2)), 0.3
    f, b = toxicity.messages(e, np.ones((5, 1), bool), moves, start)
    total, on = 0.0, np.zeros(5)
    for k in range(32):
        s = [k >> i & 1 for i in range(5)]
        w = np.exp(start * s[0] + sum(e[i, 0] * s[i] for i in range(5)) + sum(moves[s[i], s[i + 1]] for i in range(4)))
        total += w
        on += w * np.array(s)
    assert (1 / (1 + np.exp(-(f + b)[:, 0]))) == pytest.approx(on / total)


def test_chain_across_pieces():
    """Documents of several pieces have the messages of one whole chain."""
    rng = np.random.default_rng(15)
    lengths = np.array([1, 64, 65, 0, 300, 130, 7, 200, 128])
    model = toxicity.ToxicityModel({}, rng.normal(size=(3, 50)), np.array([[1.5, -1.0], [-1.0, 1.5]]), -0.7)
    ids = rng.integers(0, 50, lengths.sum()).astype(np.int32)
    e, at, want = model.emissions(ids, lengths), 0, []
    for n in lengths[lengths > 0]:
        f, b = toxicity.messages(e[at : at + n, None], np.ones((n, 1), bool), model.moves, model.start)
        want += toxicity.sigmoid(f + b)[:, 0].tolist()
        at += n
    assert model.marginals(ids, lengths) == pytest.approx(np.array(want), abs=1e-9)


def test_toxicity_of_awkward_rows(documents, spark):
    """Repeated rows, null keys, clashing columns, an empty table and a very long text."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    texts = [(i, "you vile scum " * 3 if i % 2 else "a fine day out here") for i in range(40)]
    docs = documents([*texts, texts[3], (None, "scum"), (None, None), (99, "fine day " * 60_000 + "scum")]).withColumn("toxicity", F.lit("clash")).withColumn("__y", F.lit(1))
    model = toxicity.fit(docs, labels)
    out = toxicity.with_toxicity(docs, model).collect()
    assert len(out) == 44 and len({x["toxicity"] for x in out if x["doc_id"] == 3}) == 1 and all(0 <= x["toxicity"] <= 1 for x in out)
    assert toxicity.with_toxicity(docs.filter("false"), model).count() == 0
    assert not any(x["h"] is None for x in docs.select(toxicity.held_out(F.col("doc_id")).alias("h")).collect())
    assert toxicity.fit(docs, labels, sample=3, sample_bytes=60).scores(["scum", ""]).max() <= 1


@pytest.mark.parametrize("tagged", [True, False])
def test_chain_gradient(tagged):
    """Of tags and of documents' labels, against differences of the likelihood by enumeration."""
    rng = np.random.default_rng(18)
    lengths, toxic = np.array([5, 1, 4]), np.array([1, 0, 1])
    model = toxicity.ToxicityModel({}, rng.normal(0, 1, (3, 6)), rng.normal(0, 1, (2, 2)), -0.4)
    ids, tags = rng.integers(0, 6, 10).astype(np.int32), rng.random(10) < 0.4

    def loss():
        e, at, total = model.emissions(ids, lengths), 0, 0.0
        for n, y in zip(lengths, toxic):
            score = {}
            for k in range(2**n):
                s = [k >> i & 1 for i in range(n)]
                score[k] = model.start * s[0] + sum(e[at + i] * s[i] for i in range(n)) + sum(model.moves[s[i], s[i + 1]] for i in range(n - 1))
            z = np.log(sum(np.exp(list(score.values()))))
            if tagged:
                total += z - score[sum(int(t) << i for i, t in enumerate(tags[at : at + n]))]
            else:
                clean = np.exp(score[0] - z)
                total -= np.log(1 - clean) if y else np.log(clean)
            at += n
        return total

    got = toxicity.gradient(model, ids, lengths, tags if tagged else None, toxic)
    flat = [(model.weights, i) for i in np.ndindex(3, 6)] + [(model.moves, i) for i in np.ndindex(2, 2)]
    for (w, i), g in zip(flat, got):
        w[i] += 1e-5
        up = loss()
        w[i] -= 2e-5
        down = loss()
        w[i] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(g, abs=1e-6)
    model.start += 1e-5
    up = loss()
    model.start -= 2e-5
    assert (up - loss()) / 2e-5 == pytest.approx(got[-1], abs=1e-6)


def test_language(documents):
    r = random.Random(13)
    other = ["über", "schön", "ßen", "keit", "für", "heit", "ung"]
    texts, langs = [], []
    for i in range(160):
        texts.append(prose(r, 30) if i % 2 else " ".join(r.choice(other) for _ in range(30)))
        langs.append("en" if i % 2 else "de")
    docs = documents([*texts, None, "", "123 !", "x"], lang=[*langs, "en", "de", "en", None])
    model = langid.fit(docs)
    out = {x["doc_id"]: x["language"] for x in langid.with_language(docs, model).collect()}
    assert np.mean([out[i]["lang_pred"] == y for i, y in enumerate(langs)]) > 0.97
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (160, 161, 162))
    assert out[163]["lang_pred"] in ("en", "de") and 0 <= out[163]["score"] <= 1
    assert langid.fit(docs.filter("false")).predict(["text"]) == [("und", 0.0)]


def test_language_of_awkward_rows(documents):
    """Signs that aren't letters, repeated rows, null keys, NUL bytes, clashing columns, an empty table, a very long text."""
    texts = [(i, "the on thing and so" if i % 2 else "über schön für ung") for i in range(60)]
    more = [(60, "½ ² ① Ⅷ 3"), (61, "日本"), (62, "the\0on\0thing"), (1, texts[1][1]), (None, "the on"), (None, None), (63, "the on thing " * 50_000)]
    docs = documents([*texts, *more], lang=["en" if i % 2 else "de" for i in range(60)] + [None] * len(more)).withColumn("language", F.lit("clash")).withColumn("t", F.lit(1))
    model = langid.fit(docs, sample=20, sample_bytes=500)
    out = langid.with_language(docs, model).collect()
    by = {x["doc_id"]: x["language"]["lang_pred"] for x in out}
    assert len(out) == 67 and by[60] == "und" and by[61] in ("en", "de") and by[62] == by[63] == "en"
    assert len({str(x["language"]) for x in out if x["doc_id"] == 1}) == 1
    assert langid.with_language(docs.filter("false"), model).count() == 0
    x = langid.windows("é" * 200)
    assert x[:, langid.LEAD : langid.LEAD + langid.STEPS].ravel()[:400].tolist() == list(("é" * 200).encode())


def test_gru_gradients():
    rng = np.random.default_rng(14)
    way = lambda: langid.Direction(rng.normal(0, 0.3, (24, 257)), rng.normal(0, 0.3, (24, 8)))
    model = langid.LanguageModel(["a", "b", "c"], [way(), way()], rng.normal(0, 0.3, (3, 16)), np.zeros((3, 1)))
    x, y = rng.integers(0, 5, (12 + 2 * langid.LEAD, 6)).astype(np.uint16), rng.integers(0, 3, 6)
    _, grads = langid.gradients(model, x, y)
    for w, g in zip(langid.parameters(model), grads):
        at = tuple(rng.integers(0, min(5, k)) for k in w.shape)
        w[at] += 1e-5
        up = langid.gradients(model, x, y)[0]
        w[at] -= 2e-5
        down = langid.gradients(model, x, y)[0]
        w[at] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(g[at], abs=1e-7)


def test_digest_of_ids():
    own = bpe.coder(TOKENIZER)
    assert hashlib.sha256(own.encode("a b")).hexdigest() == hashlib.sha256(np.array(own.tokenizer.encode("a b").ids, "<u4").tobytes()).hexdigest()
