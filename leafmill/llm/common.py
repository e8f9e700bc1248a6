"""Pieces that several training-data operators share."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.shared import cut, shared_dir, spread  # noqa: F401  the operators take them from here


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files and checkpoints of tables that are no longer used.

    The cleaner learns of them only when the driver collects its garbage; loops call this each round.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Remembered:
    """A bounded memory in two generations: what was used since the last turn outlives the next one."""

    def __init__(self, most: int):
        self.most = most
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def utf8(text: str = "text"):
    """A text column as its bytes; null counts as empty."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what reaches a Python worker at once, for tables whose rows may be long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def parallel(spark: SparkSession, least: int = 1) -> int:
    """How many partitions a shuffle gets unless adaptive execution joins them."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def join_sized(left: DataFrame, right: DataFrame, on, how: str = "inner", row_bytes: int = 64, most: int = 16 << 20) -> DataFrame:
    """Join a table that has been cut: broadcast if its rows are counted to fit ``most`` bytes, else shuffled."""
    small = right.count() * row_bytes <= most
    return left.join(F.broadcast(right) if small else right, on, how)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as it takes to be none of the columns' (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole(df: DataFrame, name: str = "row"):
    """All columns as one struct, in which no name clashes with a helper column's."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)
