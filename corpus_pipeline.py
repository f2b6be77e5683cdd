"""A training-corpus pipeline: five of the operators, one after another, over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, whatever else they are named.

In every stage an empty table gives an empty one, texts of any length are read whole, and repeated rows are judged each, with one
result for equal rows. Columns other than doc_id, text and n_chars pass through untouched, also under names that the operators use.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonolake.llm.decontaminate import decontaminate
from sonolake.llm.ngram_join import ngram_join
from sonolake.llm.packing import pack, pieces
from sonolake.llm.pii import find_pii
from sonolake.llm.quality import fit, compiled, with_statistics
from sonolake.llm.queries import tokenizer_path
from sonolake.llm.util import held_out, scratch, table
from sonolake.session import ship


def _wrapped(docs: DataFrame) -> DataFrame:
    """doc_id, text, and everything but the text in one column, so that no name clashes with an operator's."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("_row"))


def _unwrapped(rows: DataFrame, docs: DataFrame, **new) -> DataFrame:
    """The columns of docs again; `new` gives some of them new values."""
    return rows.select(*(new.get(c, F.col("text") if c == "text" else F.col("_row")[c]).alias(c) for c in docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (a score of 0.5 or more).

    Null and empty texts are scored by statistics of 0, like any other; a null id is judged by its text. Without labels every
    document scores 0.5 and stays.
    """
    ship(spark)
    rules, bias = fit(docs, table(spark, sf_dir, "labels"), "quality", held_out("doc_id", 3, 1))
    return _unwrapped(with_statistics(_wrapped(docs), ("text", "_row")).where(compiled(rules, bias) >= 0.5), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies (5-word shingles, Jaccard >= 0.8).

    Null ids and texts without words are in no group and stay. Rows of one id are one document: all of them stay or go.
    """
    ship(spark)
    gone = ngram_join(docs, n=5, num=80).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window. Null texts, and all texts where the benchmark is empty, stay."""
    ship(spark)
    return _unwrapped(decontaminate(_wrapped(docs), table(spark, sf_dir, "benchmark"), keep=True).where("n_hit = 0"), docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked; n_chars follows where something was. Null texts stay null."""
    ship(spark)
    masked = find_pii(_wrapped(docs), masked=True, keep=True)
    new = {"text": F.when(F.col("text").isNotNull(), F.col("masked"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("spans") > 0, F.length("masked").cast("long")).otherwise(F.col("_row")["n_chars"])
    return _unwrapped(masked, docs, **new)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequence and offset. A null or empty text is one piece, the end token; pieces of
    equal ids and of null ids are separate pieces with that id."""
    ship(spark)
    return pack(pieces(docs, tokenizer_path()))


STAGES = [("quality classifier", quality_stage), ("n-gram Jaccard join", near_duplicate_stage), ("benchmark decontamination", decontaminate_stage), ("PII", pii_stage), ("best-fit packing", packing_stage)]

#: SQL cannot express the classifier and the tokenizer; tests/llm/test_pipeline.py holds run() against plain rules for each stage.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents, writing what each returns to the shared folder."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    base = f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
