"""The corpus pipeline: five stages over documents, each written and read again as the next one's input.

Documents go by quality rules and recurring lines, one of each group of near copies stays, documents that hold benchmark
passages go, and the texts left are tokenised.  All but the last stage return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import bpe, decontam, jaccard, linededup, quality
from trailmark.llm.common import stored, table
from trailmark.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def has_words() -> Column:
    """Whether the text has a word."""
    return F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the cutoffs of their language."""
    return quality.filtered(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines whose template an earlier document has; those left without words go."""
    return linededup.cleaned(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id.

    A document without an id is named by its text and comes after all others.  Rows with the same id and text come out
    once.  Documents without words are in no group and stay.
    """
    nameless = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 2)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.coalesce(F.col("doc_id").cast("bigint"), nameless).alias("id"))
    rows = rows.withColumn("text", F.col("doc.text"))
    classes = stored(jaccard.join(rows, key="id", block_words=700_000).where("set_id is not null and doc_id = component_id"), "copies")
    named = rows.where(has_words()).join(classes.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi")
    if not classes.groupBy("doc_id").count().where("count > 1").isEmpty():
        named = named.withColumn("hash", F.xxhash64("text")).dropDuplicates(["id", "hash"])
    return named.select("doc.*").unionByName(docs.where(~has_words()))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and of the decoded text of every document."""
    return bpe.digests(docs, tokenizer_path(), block_words=3_000_000)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_copies", near_copies),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_tokens", bpe_tokens),
]

#: No SQL: near copies and token ids are beyond it; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
