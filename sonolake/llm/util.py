"""Shared Spark helpers: input shaping, cutting lineage, connected components."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; one of its own only where that is unset (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a checkpoint in the shared folder."""
    scratch(df.sparkSession)
    return df.checkpoint()


def text_size(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """(rows, bytes of text), from which partition counts follow."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("b")).first()
    return int(row["n"]), int(row["b"])


def parts(amount: int, each: int) -> int:
    return max(1, math.ceil(amount / each))


def held_out(doc_id: str, modulus: int, remainder: int):
    """Whether crc32(doc_id as text) modulo `modulus` is `remainder`; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % F.lit(modulus) == F.lit(remainder), F.lit(False))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (a, b): the smallest node reachable.

    Each round takes the smallest label among the neighbours (map-side combined) and then
    the label of that label, so long chains halve each round. Hubs are safe: messages are
    minima, and the joins are plain joins whose skewed sides AQE can split. Rounds are cut by written
    tables, not checkpoints: a checkpoint keeps the size estimate of the joins before it, and those multiply.
    """
    spark = edges.sparkSession
    folder = f"{scratch(spark)}/components-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        df.write.option("compression", "none").parquet(f"{folder}/{name}")  # small tables; no codec buffers
        return spark.read.schema(schema).parquet(f"{folder}/{name}")

    ways = F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = kept(edges.where("a is not null and b is not null").select(F.inline(ways)).distinct(), "edges")
    labels = kept(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")), "labels")
    for k in range(most_rounds):
        near = both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        new = kept(labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component")), f"near-{k}")
        if not new.where("old <> component").limit(1).count():
            return labels
        up = new.select(F.col("node").alias("component"), F.col("component").alias("top"))
        labels = kept(new.join(up, "component").select("node", F.least("component", "top").alias("component")), f"labels-{k}")
    raise RuntimeError("components did not settle")
