"""The corpus pipeline: filters, near-duplicate removal, mixing and encoding, in stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. Labels are read from the
input tables; texts only from the stage's own docs.

All but the last stage return the columns of docs, whatever they are called, with
the values that came in; docs need doc_id, text and source. Null and empty texts are
scored by the classifiers' bias, link with nothing and have no words or tokens; of
rows that share an id the near-duplicate stage keeps one, rows without id all stay;
among near copies the smallest id stays; without labels the classifiers reject
nothing; empty tables pass through. The last stage returns the id, the language and
source where there are any, and the token digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginforge.llm import bpe, jaccard, mixing, quality, toxicity
from marginforge.llm.common import dropped, table, written

#: A document is rejected where a score says so at these levels.
QUALITY_LEAST, TOXICITY_MOST = 0.5, 0.6


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    w = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", F.lit(True))
    return quality.kept(docs, lambda d, names: quality.score(d, w, names=names), lambda score: score >= QUALITY_LEAST)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    w = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", F.lit(True))
    return quality.kept(docs, lambda d, names: toxicity.score(d, w, names=names), lambda score: score < TOXICITY_MOST)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, 0.8)."""
    return jaccard.keep_one(docs, words=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.emit(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded bytes, beside the documents' ids and sources."""
    import public_tokenizers as P

    some = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    return bpe.round_trip(docs.select(*some, "text"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).drop("text")


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("jaccard", jaccard_stage), ("mixing", mixing_stage), ("encoding", encoding_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            out = written(out, f"pipeline-{name}")
            dropped(docs)
            docs = out
    return out


#: Trained classifiers have no SQL form; tests hold the stages to brute force.
ORACLE_SQL = None
