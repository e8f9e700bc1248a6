"""The corpus pipeline: toxicity, exact dedup, near dups, mixing, encoding.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor kept, and is written as
Parquet and read again before the next one.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm import bpe, exact_dedup, mixing, near_dups, toxicity
from leafmill.llm.common import cut, free_name, shared_dir, utf8, whole
from leafmill.shared import remove


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half; scored and filtered where they are read.

    Null and empty texts stay, as do all documents where there are no labels to learn from. Rows that
    repeat get the same verdict.
    """
    labels = toxicity.training_rows(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = free_name(docs, "score")
    return toxicity.score(docs, toxicity.fit(docs, labels), keep=name).where(F.col(f"`{name}`") < 0.5).drop(name)


def _told_apart(docs: DataFrame, text_key: Column) -> DataFrame:
    """``row, id, key``: the columns as one, the identifier, and what tells rows of one identifier apart."""
    return docs.select(whole(docs), F.col("doc_id").alias("id"), text_key.alias("key"))


def _kept(docs: DataFrame, text_key: Column, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are in ``kept`` (``id, key, n``), one of those that repeat both."""
    mine = _told_apart(docs, text_key).alias("d")
    same = F.col("d.id").eqNullSafe(F.col("k.id")) & (F.col("d.key") == F.col("k.key"))
    found = mine.join(kept.select("id", "key").alias("k"), same, "left_semi")
    if kept.where("n > 1").take(1):
        found = found.dropDuplicates(["id", "key"])
    return found.select("row.*")


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest identifier, once; null counts as the empty text."""
    found = exact_dedup.exact_dedup(docs, keep="max").where("kept").groupBy("id", F.col("text_sha256").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return _kept(docs, F.sha2(F.coalesce("text", F.lit("")), 256), cut(found))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar texts (five words, 0.8) the smallest document; texts without words all stay."""
    found = near_dups.jaccard_components(docs).where("first").groupBy("id", F.col("text_hash").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return _kept(docs, F.xxhash64(utf8()), cut(found))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, each copy in its place of the training order.

    Rows of one identifier are told apart by source and text; equal ones are dealt their copies one by one.
    """
    plan = mixing.planned(docs).where("copies > 0").select("id", "source", "th", "size", "offset", "source_size", "target", "schedule", "reached", "copies")
    mine = docs.select(whole(docs), F.col("doc_id").alias("id"), F.col("source").alias("source"), F.xxhash64(utf8()).alias("th"))
    keys = ["id", "source", "th"]
    repeated = bool(plan.groupBy(*keys).count().where("count > 1").take(1))
    if repeated:
        plan = plan.withColumn("turn", F.row_number().over(Window.partitionBy(*keys).orderBy("offset")))
        mine = mine.withColumn("turn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("row"))))
        keys = [*keys, "turn"]
    due = mixing.passes(plan).groupBy(*keys).agg(F.sort_array(F.collect_list("position")).alias("due"))
    same = reduce(lambda a, b: a & b, [F.col(f"d.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys])
    again = mine.alias("d").join(due.alias("p"), same).select("row", "d.id", F.posexplode("due").alias("pass", "position"))
    return again.orderBy("position", "pass", "id").select("row.*")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document and what they decode to; a null text has none."""
    import public_tokenizers

    encoded = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=True)
    return encoded.withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dups", near_dup_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: The first stage is a trained model, the third a similarity join that SQL makes in quadratic time.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; intermediate tables go to the shared folder and are removed when the next one stands."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4()}"
    before = None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            here = f"{folder}/{i}-{name}"
            docs.write.parquet(here)
            docs = spark.read.parquet(here)
            if before is not None:
                remove(spark, before)
            before = here
    return docs
