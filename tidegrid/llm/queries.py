"""The corpus queries with production parameters: (spark, sf_dir) -> DataFrame, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import bpe, chat, langid, mixing, toxicity, topk
from tidegrid.llm.common import load, small_batches
from tidegrid.llm.exact_dedup import exact_dedup
from tidegrid.llm.line_dedup import line_dedup
from tidegrid.llm.simhash import simhash_groups
from tidegrid.llm.suffix_dedup import suffix_dedup

#: A file of the public tokenizers; its place is looked up where it is read.
TOKENIZER = "byte_bpe_50k.json"


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 4-word shingles, linked at 4 bits or fewer."""
    out = simhash_groups(load(spark, sf_dir, "documents"), n=4, distance=4)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies; every text's digest, which the contract asks for, comes from the pass that takes lengths and prefixes."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    out = exact_dedup(docs, derive={"text_sha256": F.sha2(F.col("__norm").cast("binary"), 256)})
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str, path: str = TOKENIZER) -> DataFrame:
    """Encodes and decodes each whole text; of ids and text the digests come back."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sha = bpe.coder(path, 300_000), lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                ids = own.encode(text.as_py())
                rows.append((len(ids) // 4, sha(ids), sha(own.decode(ids).encode("utf-8", "surrogatepass"))))
            n, ids, texts = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], schema=schema)

    small_batches(spark)
    return load(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.with_language(docs.select("doc_id", "text"), langid.fit(docs), into="out")
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "out.lang_pred", "out.score")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on 8 sources or more are cut, but from documents that consist of such lines."""
    out = line_dedup(load(spark, sf_dir, "documents"), min_sites=8)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "source", mixing.word_count(F.col("text")).alias("size"))
    out = mixing.mix_sizes(docs, weights=(5, 2, 1), most=3.0)
    return out.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations and one that holds control strings; every column but formatted_chars is read back from the output."""
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "mask")), strict=True):
                turns, sha, loss, chars = chat.parse(text), hashlib.sha256(), hashlib.sha256(), 0
                for role, said in turns:
                    sha.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for a, b in zip(mask[::2], mask[1::2], strict=True):
                    said = chat.unescape(text[a:b])
                    chars += len(said)
                    loss.update(said.encode("utf-8", "surrogatepass"))
                rows.append((conv, len(turns), sha.hexdigest(), chars, loss.hexdigest(), len(text)))
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    out = chat.format_chats(turns.unionByName(more)).select("conv_id", "formatted", "mask")
    return out.mapInArrow(read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes under repeated strings of 400 bytes are removed."""
    out = suffix_dedup(load(spark, sf_dir, "documents").select("doc_id", "text"), length=400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all other vectors for each vec_id divisible by 50."""
    own = load(spark, sf_dir, "embeddings").select("vec_id", topk.floor_components(F.col("embedding")).alias("v"))
    return topk.exact_topk(own, F.col("vec_id") % 50 == 0, k=5)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "labels")
    out = toxicity.with_toxicity(docs, toxicity.fit(docs, labels), into="score")
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_language_id": op4_language_id,
    "op5_line_dedup": op5_line_dedup,
    "op6_mix_sources": op6_mix_sources,
    "op7_chat_format": op7_chat_format,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_exact_topk": op9_exact_topk,
    "op10_toxicity": op10_toxicity,
}

_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_NORM} AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)""",
    "op5_line_dedup": r"""
        WITH l AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        t AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS own FROM l),
        s AS (SELECT own FROM t WHERE own <> '' GROUP BY own HAVING count(DISTINCT coalesce('s' || source, '')) >= 8),
        m AS (SELECT t.*, s.own IS NOT NULL AS hit FROM t LEFT JOIN s ON t.own = s.own),
        d AS (SELECT *, bool_or(own <> '' AND NOT hit) OVER (PARTITION BY doc_id) AS cuts FROM m)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (hit AND cuts) AS n_removed,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT (hit AND cuts)), '')) AS kept_sha256
        FROM d GROUP BY doc_id""",
    "op7_chat_format": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
                   UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e') AS coded FROM t)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length(role) + length(coded) + 14) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op9_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
              FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 5""",
}
