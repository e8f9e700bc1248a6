"""Exact dedup: a tree-merge of sorted digest runs.

Every row belongs to one of ``runs`` runs by a hash of its identifier. A run is first reduced to
its distinct digests (with map-side combining, so a group of copies never travels as such); then
the runs are merged ``fanout`` at a time in rounds: the runs whose numbers agree but for the next
digits exchange entries, equal digests become neighbours by a sort, and the smallest identifier
and the summed count are retained. An entry is a digest together with the text's length and a
second, independent hash; entries that differ in any of these never merge, which is the check at
every level. A round's keys are (run, digest), so that no task holds a whole run, and no digest
has more than ``fanout`` entries in any group. The winners go down the tree again in the same way,
only for digests seen more than once, so that a text with copies in a third of all rows is spread
over all runs.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import cut, parallel

ENTRY = ["digest", "n_bytes", "second"]


def digests(docs: DataFrame, key: str, text: str, keep: str, runs: int) -> DataFrame:
    """One row per input row: identifier, its rank (smaller wins), run and entry."""
    body = F.coalesce(F.col(text), F.lit(""))
    # the complement turns the order round and, unlike a minus sign, cannot overflow
    rank = F.col(key) if keep == "min" else F.bitwise_not(F.col(key))
    return docs.select(
        F.col(key).cast("long").alias("id"),
        rank.cast("long").alias("rank"),
        F.pmod(F.xxhash64(F.col(key)), F.lit(runs)).cast("int").alias("run"),
        F.unhex(F.sha2(body, 256)).alias("digest"),
        F.octet_length(body).cast("long").alias("n_bytes"),
        F.xxhash64(body).alias("second"),
    )


def merge_round(level: DataFrame, fanout: int) -> DataFrame:
    """Merge runs ``fanout`` at a time: sort equal entries together, retain the smallest rank."""
    up = level.withColumn("run", F.floor(F.col("run") / fanout).cast("int"))
    same = Window.partitionBy("run", *ENTRY)
    return (
        up.withColumn("copies", F.sum("copies").over(same))
        .withColumn("place", F.row_number().over(same.orderBy(F.col("rank").asc_nulls_last())))
        .where("place = 1")
        .drop("place")
    )


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "min", runs: int | None = None, fanout: int = 8) -> DataFrame:
    """Return ``id, keep_id, group_size, kept, text_sha256``, one row per input row.

    ``keep`` is ``min`` or ``max``: which identifier of equal texts stays. There are as many ``runs``, a
    power of ``fanout``, as a shuffle has partitions, so that a task gets one run's share of a hot text. Texts are compared as
    they are; a null text counts as the empty one. Rows that repeat an identifier and its text are
    all marked kept, if that identifier is; a null identifier stays only where all of its group are
    null. An empty table gives an empty result; other columns are not looked at.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is min or max")
    if runs is None:
        least, runs = parallel(docs.sparkSession, 64), fanout
        while runs < least:
            runs *= fanout
    base = cut(digests(docs, key, text, keep, runs))
    levels = [base.groupBy("run", *ENTRY).agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("copies"))]
    width = runs
    while width > 1:
        levels.append(merge_round(levels[-1], fanout))
        width = -(-width // fanout)
    won = levels[-1].where("copies > 1").select("run", *ENTRY, F.col("rank").alias("best"), F.col("copies").alias("total"))
    for below in reversed(levels[:-1]):
        won = (
            below.select(F.col("run").alias("child"), F.floor(F.col("run") / fanout).cast("int").alias("run"), *ENTRY)
            .join(won, ["run", *ENTRY])
            .select(F.col("child").alias("run"), *ENTRY, "best", "total")
        )
    best = F.when(F.col("total").isNull(), F.col("rank")).otherwise(F.col("best"))
    return base.join(won, ["run", *ENTRY], "left").select(
        "id",
        (best if keep == "min" else F.bitwise_not(best)).alias("keep_id"),
        F.coalesce("total", F.lit(1)).cast("long").alias("group_size"),
        best.eqNullSafe(F.col("rank")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op5_exact_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs, keep="max").withColumnRenamed("id", "doc_id")


OP5_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.body) AS text_sha256
FROM d JOIN g USING (body)
"""
