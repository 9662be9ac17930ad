"""The operators applied to the synthetic tables: one query each, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ngram_model, toxicity
from .corpus_sql import LINE_DEDUP, vector_codes_sql
from .line_dedup import line_dedup
from .mixing import mix_sources
from .packing import pack_documents
from .permutation_index import nearest
from .quality_rules import quality_rules
from .secret_scan import listed, secret_spans
from .simhash_dedup import simhash_groups
from .spelling_variants import spelling_variants
from .substring_dedup import substring_dedup
from .token_store import store_and_read
from .vector_codes import books_digest, vector_codes


def word_vocabulary() -> str:
    """The public vocabulary file that the contracts name."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"), window=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"), shingle=3, threshold=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op3_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix_sources(table(spark, sf_dir, "documents"), repetition_limit=2.0)
    return found.select("row.doc_id", F.col("mix_source").alias("source"), F.col("mix_tokens").alias("n_tokens"), "mix_pass", "mix_block", "mix_slot")


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pack_documents(table(spark, sf_dir, "documents"), word_vocabulary(), end_id=2, max_tokens=4096)
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "segment", "loss_tokens")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"), gap=200)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed(F.concat("base", "linked")).alias("spans"),
    )


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_read(table(spark, sf_dir, "documents"), word_vocabulary(), end_id=2)


def remainder(column: str, of: int):
    """CRC-32 of a number's text, modulo ``of``; 0 for null."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(0)) % of


def op7_ngram_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 7) == 2
    model = ngram_model.fit(docs.where(~held_out))
    found = ngram_model.score(docs, model, held_out)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op8_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op9_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = remainder("doc_id", 5) == 0
    model = toxicity.fit(docs, labels.where(~held_out))
    found = toxicity.score(docs, model)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic_tokens", spans.alias("spans"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return quality_rules(table(spark, sf_dir, "documents"), good)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = vector_codes(table(spark, sf_dir, "embeddings"))
    return found.withColumn("codebooks_sha256", F.lit(books_digest(books)))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_temperature_mixing": op3_temperature_mixing,
    "op4_vector_packing": op4_vector_packing,
    "op5_secret_scan": op5_secret_scan,
    "op6_token_store": op6_token_store,
    "op7_ngram_model": op7_ngram_model,
    "op8_permutation_index": op8_permutation_index,
    "op9_toxicity_crf": op9_toxicity_crf,
    "op10_quality_rules": op10_quality_rules,
    "op11_vector_codes": op11_vector_codes,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_line_dedup": op13_line_dedup,
}

#: The others can't be put as SQL that runs on whole tables; tests/llm holds brute-force versions.
ORACLE: dict[str, str] = {"op11_vector_codes": vector_codes_sql(), "op13_line_dedup": LINE_DEDUP}
