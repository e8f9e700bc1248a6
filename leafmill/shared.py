"""Tables that are cut: written to the folder that driver and executors share, and gone on from there."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session without that setting gets a temporary folder of its own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    own = "file://" + tempfile.mkdtemp(prefix="leafmill-")
    sc.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: lost executors don't lose it, and what made the rows isn't run again for them.

    Spark's own cleaner can remove it once nothing refers to it.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def running_before(rows: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """Add the sum of ``value`` over all rows before a row, in the order of columns that together tell rows apart.

    Ranges are summed by themselves; only one sum for each comes to the driver.
    """
    ranged = cut(rows.withColumn(name, value).repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    before, sums = 0, []
    for r in ranged.groupBy("__range").agg(F.sum(name).alias("s")).orderBy("__range").collect():  # a row for each partition
        sums.append((r["__range"], before))
        before += r["s"] or 0
    starts = F.broadcast(rows.sparkSession.createDataFrame(sums, "__range int, __start long"))
    earlier = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn(name, F.coalesce(F.sum(name).over(earlier), F.lit(0))).join(starts, "__range").withColumn(name, F.col(name) + F.col("__start")).drop("__range", "__start")


def spread(df: DataFrame, *keys: str | Column, rows_a_task: int = 100_000) -> DataFrame:
    """A scan with fewer partitions than there are cores, or with more than ``rows_a_task`` rows in each, dealt out; any other as it is.

    For work that costs much more than moving the rows: what a task holds doesn't grow with the table, since rows
    are counted (by the files' footers) and a split may hold any number of small ones. With ``keys`` equal ones
    come to one partition, so that what is grouped by them later needs no further shuffle.
    """
    spark = df.sparkSession
    want = max(min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-df.count() // rows_a_task))
    return df.repartition(want, *keys) if keys or df._jdf.queryExecution().toRdd().getNumPartitions() < want else df


def _located(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more, wherever Spark's file systems find it."""
    target, files = _located(spark, path)
    files.delete(target, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none if there is no such folder."""
    target, files = _located(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(target)) if files.exists(target) else []
