"""Registered queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import decontaminate
from .embed_dedup import embedding_dedup
from .fim import fill_in_middle, restored
from .licenses import license_scan
from .ngram_join import ngram_join
from .packing import pack, pieces
from .pii import BASE, find_pii, joined
from .ppm import lm_score
from .prefix_trie import prefix_trie
from .quality import quality
from .sql import ORACLE as ORACLE
from .substring import substring_dedup
from .token_files import fresh_folder, read_token_files, write_token_files
from .toxicity import toxicity
from .util import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    best = F.array_max(F.transform("spans", lambda s: s["score"]))
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(joined(F.col("spans"), BASE), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), best.alias("best_score"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(pieces(table(spark, sf_dir, "documents"), tokenizer_path()))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark)
    write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer_path())
    return read_token_files(spark, folder)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {q.__name__: q for q in (op1_substring_dedup, op2_quality, op3_decontaminate, op4_embedding_dedup, op5_ngram_join, op6_toxicity, op7_license_scan, op8_pii, op9_lm_score, op10_packing, op11_fill_in_middle, op12_token_files, op13_prefix_trie)}
