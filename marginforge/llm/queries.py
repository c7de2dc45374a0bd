"""The contract queries opN_<name> and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, hnsw, jaccard, mixing, quality, sharding, topk, toxicity, urls
from .common import crc_mod, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded again."""
    import public_tokenizers as P

    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    out = bpe.round_trip(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op2_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"])
    out = sharding.kd_shards(docs, 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "source"])
    return mixing.plan_copies(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op7_source_mixing"] = mixing.ORACLE


@query
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings, formatted and read back."""
    own = table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', :said), (-7L, 1L, 'assistant', :said) AS t(conv_id, turn, role, text)", {"said": said})
    return chat.read_back(chat.format_chats(own.unionByName(extra)))


ORACLES["op9_chat_format"] = chat.ORACLE

URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


@query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules, else by its host's standing in the link graph."""
    return urls.judge(table(spark, sf_dir, "pages", ["page_id", "url", "html"]), URL_RULES)


def quality_model(spark: SparkSession, sf_dir: str):
    """Weights from labels that are not held out (crc32 of the id, modulo 4, is 2)."""
    return quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", crc_mod(F.col("doc_id"), 4) != 2)


@query
def op4_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document."""
    out = quality.score(table(spark, sf_dir, "documents", ["doc_id", "text"]), quality_model(spark, sf_dir))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def toxicity_model(spark: SparkSession, sf_dir: str):
    """Weights from labels that are not held out (crc32 of the id, modulo 3, is 1)."""
    return toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", crc_mod(F.col("doc_id"), 3) != 1)


@query
def op6_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document."""
    out = toxicity.score(table(spark, sf_dir, "documents", ["doc_id", "text"]), toxicity_model(spark, sf_dir))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


@query
def op3_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest by cosine of every vector whose id is divisible by 50."""
    return hnsw.nearest(table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]), every=50, k=5)


@query
def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest integer inner products of every vector whose id is divisible by 20."""
    return topk.largest(table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]), every=20, k=20)


ORACLES["op5_exact_topk"] = topk.ORACLE


@query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets are at least 90 % alike."""
    return jaccard.join_documents(table(spark, sf_dir, "documents", ["doc_id", "text"]), words=3, percent=90)
