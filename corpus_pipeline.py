"""A training-corpus pipeline over ``documents``: each stage applies one corpus operator.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of
``documents``; each is written as Parquet and read again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm.common import staged
from kerbline.llm.mixing import mix_sources
from kerbline.llm.near_copies import keep_one_of_each
from kerbline.llm.packing import pack_documents
from kerbline.llm.quality_rules import good_rows
from kerbline.llm.queries import word_vocabulary
from kerbline.llm.secret_scan import redacted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject; the target is labelled rows of quality 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return good_rows(docs, labels.where("quality = 1").select("doc_id"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: SimHash sub-prints, five words, Jaccard 0.8."""
    return keep_one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; ``n_chars`` follows the text."""
    masked = redacted(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources, at most half again; none is lost."""
    return mix_sources(docs, repetition_limit=1.5).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids, a row for each piece of a document."""
    packed = pack_documents(docs, word_vocabulary(), end_id=2, max_tokens=4096)
    return packed.select("sequence_id", "offset", "doc_id", "start", "length", "doc_tokens", F.crc32("ids").alias("ids_crc32"), "ids")


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("secret scan", secrets),
    ("mixing", mixing),
    ("packing", packing),
]

#: Hashes and token ids put it beyond SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
