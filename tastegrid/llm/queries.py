"""The registered queries of this folder: each operator over its whole table."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from hashlib import sha256

import public_tokenizers
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.llm import (
    chat,
    exact_dedup,
    fim,
    licenses,
    mixing,
    near_dup,
    packing,
    quality,
    secret_scan,
    spelling,
    token_files,
    topk,
    url_filter,
)
from tastegrid.sources.workspace import fresh_path

# The functions below travel to the workers inside the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# Vocabulary files are a parameter; these two lie beside the installed tokenizers.
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

# Sources with a target weight of their own; all others share the rest by their sizes.
MIXTURE = mixing.Mixture({"src0": 0.10, "src1": 0.10, "src2": 0.08, "src3": 0.06}, rest=0.66)

URL_RULES = (
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_near_dup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_groups(_table(spark, folder, "documents"), words=3, at_least=(17, 20))


def op2_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.notices(_table(spark, folder, "documents"))


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(_table(spark, folder, "documents"), MIXTURE)


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(_table(spark, folder, "pages"), URL_RULES)


# A conversation whose texts hold the marks of the template.
MARKED_CHAT = [(-7, turn, role, "\\### Assistant: </turn> ok") for turn, role in enumerate(("user", "assistant"))]
CHAT_DIGEST = (
    "conv_id BIGINT, n_turns BIGINT, turns_sha256 STRING, loss_chars BIGINT, loss_sha256 STRING, "
    "formatted_chars BIGINT"
)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is read back from formatted chats."""
    for batch in batches:
        rows = []
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "formatted", "spans"))
        for conv_id, text, spans in zip(*columns):
            turns = chat.read_turns(text)
            trained = "".join(
                chat.unescape(text[s["text_begin"] : s["text_end"]]) for s in spans if s["loss"]
            )
            said = "".join(f"{role}\n{said}\n" for role, said in turns)
            rows.append((conv_id, len(turns), sha256(said.encode()).hexdigest(), len(trained),
                         sha256(trained.encode()).hexdigest(), len(text)))
        names = [c.split()[0] for c in CHAT_DIGEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)


def op5_chat(spark: SparkSession, folder: str) -> DataFrame:
    chats = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.createDataFrame(MARKED_CHAT, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    return chat.format_chats(chats.unionByName(marked)).mapInArrow(_digest, CHAT_DIGEST)


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(_table(spark, folder, "documents"))


def op7_topk(spark: SparkSession, folder: str) -> DataFrame:
    scaled = F.transform("embedding", lambda x: F.floor(64 * x.cast("double")))
    embeddings = _table(spark, folder, "embeddings")
    vectors = embeddings.where(topk.usable(F.col("embedding"))).select("vec_id", scaled.alias("vector"))
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0)


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), packing.PackConfig(WORD_TOKENIZER))


def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    return token_files.round_trip(_table(spark, folder, "documents"), path, BYTE_TOKENIZER)


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, folder, "documents"))


def op11_fim(spark: SparkSession, folder: str) -> DataFrame:
    return fim.digests(fim.transform(_table(spark, folder, "documents")))


def op12_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(_table(spark, folder, "documents")))


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variant_forms(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dup": op1_near_dup,
    "op2_licenses": op2_licenses,
    "op3_mixing": op3_mixing,
    "op4_url_filter": op4_url_filter,
    "op5_chat": op5_chat,
    "op6_quality": op6_quality,
    "op7_topk": op7_topk,
    "op8_packing": op8_packing,
    "op9_token_files": op9_token_files,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_fim": op11_fim,
    "op12_secrets": op12_secrets,
    "op13_spelling": op13_spelling,
}
