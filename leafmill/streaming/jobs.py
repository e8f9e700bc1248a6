"""Batch jobs and call telemetry: job tables, streams, adaptive concurrency, page streams.

A stream's transformations are the same functions as a batch's; :func:`run_once` drives one to its end.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from leafmill.shared import shared_dir

#: States by what they mean for a wait (fixed values); others, such as finalizing, mean none of these.
DONE, FAILED = ("completed",), ("failed", "error", "expired", "cancelled")
PENDING = ("queued", "validating", "in_progress")


def is_pending(status: Column, flag: Column | None = None) -> Column:
    """Still to be waited for; ``flag`` is what the service itself may say."""
    known = F.coalesce(status.isin(*PENDING), F.lit(False))
    return known if flag is None else F.coalesce(flag, F.lit(False)) | known


def latest_status(events: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Each job's latest state; of the same time the last in the order of ``extra``."""
    order = F.struct("ts", *(extra or []))
    return events.groupBy("batch_id").agg(F.max_by(F.struct(*[c for c in events.columns if c != "batch_id"]), order).alias("s")).select("batch_id", "s.*")


def status_rollup(jobs: DataFrame) -> DataFrame:
    """Totals over jobs by status sets."""
    s = F.col("status")
    return jobs.agg(F.count(F.lit(1)).alias("jobs"), F.count_if(s.isin(*DONE)).alias("completed"), F.count_if(is_pending(s)).alias("in_progress"), F.count_if(s.isin(*FAILED)).alias("failed"), F.count_if(s == "expired").alias("expired"))


def wait_summary(jobs: DataFrame) -> DataFrame:
    """After a wait: how many are completed, pending, failed and expired, and whether it ended with some still pending."""
    r = status_rollup(jobs)
    return r.select("jobs", "completed", F.col("in_progress").alias("pending"), "failed", "expired", (F.col("in_progress") > 0).alias("wait_expired"))


def wait_for_jobs(read_status, poll_s: float = 5, most_s: float = 300, clock=None, sleep=None) -> DataFrame:
    """Read states until none is pending or the time is over; polls are a second apart at least."""
    import time

    clock, sleep = clock or time.monotonic, sleep or time.sleep
    end = clock() + most_s
    while True:
        now = read_status()
        if not now.where(is_pending(F.col("status"))).take(1) or clock() >= end:
            return now
        sleep(max(1.0, poll_s))


class JobTable:
    """Jobs as an append-only table of events: submit, status, results, cancel, list."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def _append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/events")

    def submit(self, pages: DataFrame, size: int = 50) -> DataFrame:
        """A job for every ``size`` pages of a source."""
        from leafmill.operators.merge import fixed_chunks

        run = str(uuid.uuid4())
        parts = fixed_chunks(pages, size, ["source_path"], ["page"])
        jobs = parts.groupBy("source_path", "chunk").agg(F.count(F.lit(1)).cast("int").alias("total"))
        jobs = jobs.select(F.concat_ws("-", F.lit(run), F.sha1("source_path"), F.col("chunk").cast("string")).alias("batch_id"), F.current_timestamp().alias("ts"), F.lit("validating").alias("status"), "total", F.lit(0).alias("completed"), F.lit(0).alias("failed"))
        self._append(jobs)
        return self.list().where(F.col("batch_id").startswith(run))

    def record(self, events: DataFrame) -> None:
        self._append(events.select("batch_id", "ts", "status", "total", "completed", "failed"))

    def list(self) -> DataFrame:
        return latest_status(self.spark.read.parquet(f"{self.path}/events"), ["completed", "failed", "status"])

    def status(self, batch_id: str) -> DataFrame:
        return self.list().where(F.col("batch_id") == batch_id)

    def status_all(self) -> DataFrame:
        return status_rollup(self.list())

    def cancel(self, batch_id: str) -> None:
        self._append(self.status(batch_id).where(is_pending(F.col("status"))).withColumn("status", F.lit("cancelling")).withColumn("ts", F.current_timestamp()).select("batch_id", "ts", "status", "total", "completed", "failed"))

    def results(self, lines: DataFrame) -> DataFrame:
        from leafmill.sources.pages import read_batch_lines

        return read_batch_lines(lines)


class Controller:
    """Concurrency by latency and errors, one call at a time.

    A call that fails (status 400 or more) counts as an error and moves the time of the last change: 429
    halves the concurrency, a server error takes 30 %. A call that succeeds feeds the moving average of the
    latency (a zero begins it anew); then, ``apart_s`` seconds after the last change at the earliest and once
    ``least`` calls are counted, the concurrency goes up by 30 % if errors and latency are low, down by 30 % if
    either is high, and the counters begin anew whether it changed or not.
    """

    FIELDS = ("concurrency", "ema", "successes", "errors", "changed")

    def __init__(self, begun: float, start: int = 20, low: int = 2, high: int = 50, alpha: float = 0.3, apart_s: float = 5.0, least: int = 10):
        self.low, self.high, self.alpha, self.apart_s, self.least = low, high, alpha, apart_s, least
        self.concurrency, self.ema, self.successes, self.errors, self.changed = start, 0.0, 0, 0, begun

    def report(self, now: float, status: int, latency_ms: float) -> int:
        if status >= 400:
            self.errors += 1
            if status == 429:
                self.concurrency = max(self.low, self.concurrency // 2)
            elif status >= 500:
                self.concurrency = max(self.low, int(self.concurrency * 0.7))
            self.changed = now
        else:
            self.ema = latency_ms if self.ema == 0 else self.ema * (1 - self.alpha) + latency_ms * self.alpha
            self.successes += 1
            self._adjust(now)
        return self.concurrency

    def _adjust(self, now: float) -> None:
        calls = self.successes + self.errors
        if now - self.changed < self.apart_s or calls < self.least:
            return
        rate = self.errors / calls
        if rate < 0.05 and self.ema < 3000:
            self.concurrency = min(self.high, int(self.concurrency * 1.3))
        elif rate > 0.15 or self.ema > 10_000:
            self.concurrency = max(self.low, int(self.concurrency * 0.7))
        self.successes = self.errors = 0
        self.changed = now


def adaptive_concurrency(calls: DataFrame, keys: list[str], order: list[str], **settings) -> DataFrame:
    """The controller over recorded calls, per key in order: the batch twin of the stream.

    State runs from call to call, so a key's calls are one sorted partition stream: nothing is collected.
    """
    names = [*keys, *order, "concurrency", "ema"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, c = None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                k = tuple(getattr(row, x) for x in keys)
                if k != last:
                    last, c = k, Controller(row.at, **settings)
                out.append((*k, *(getattr(row, x) for x in order), c.report(row.at, row.status, row.latency_ms), c.ema))
            yield pd.DataFrame(out, columns=names)

    kinds = dict(calls.dtypes)
    schema = ", ".join(f"{x} {kinds[x]}" for x in [*keys, *order]) + ", concurrency int, ema double"
    source = calls.select(*dict.fromkeys([*keys, *order, "at", "status", "latency_ms"]))
    return source.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


class _Adaptive(StatefulProcessor):
    """One controller a key. Its state is dropped when the key has been silent for ``idle_s`` of event time."""

    def __init__(self, idle_s: float, kind):
        self.idle_s, self.kind = idle_s, kind

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("controller", "concurrency int, ema double, successes int, errors int, changed double, until long")

    def handleInputRows(self, key, rows, timerValues):
        calls = sorted((r for pdf in rows for r in pdf.itertuples(index=False)), key=lambda r: r.at)
        kept = self.state.get() if self.state.exists() else None
        c = Controller(calls[0].at)
        if kept is not None:
            for name, v in zip(Controller.FIELDS, kept, strict=False):
                setattr(c, name, v)
            self.handle.deleteTimer(kept[-1])
        for r in calls:
            c.report(float(r.at), int(r.status), float(r.latency_ms))
        until = int((max(calls[-1].at, timerValues.getCurrentWatermarkInMs() / 1000) + self.idle_s) * 1000)
        self.state.update((*(getattr(c, n) for n in Controller.FIELDS), until))
        self.handle.registerTimer(until)
        yield pd.DataFrame({"key": [key[0]], "at": [calls[-1].at], "concurrency": [c.concurrency], "ema": [c.ema], "calls": [len(calls)], "ended": [False]}).astype({"concurrency": "int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        c = self.state.get()
        self.state.clear()
        yield pd.DataFrame({"key": [key[0]], "at": [expiredTimerInfo.getExpiryTimeInMs() / 1000], "concurrency": [c[0]], "ema": [c[1]], "calls": [0], "ended": [True]}).astype({"concurrency": "int32"})

    def close(self) -> None:
        pass


def adaptive_stream(calls: DataFrame, key: str, late: str = "1 hour", idle_s: float = 3600) -> DataFrame:
    """The controller as a stateful stream over ``key, ts, status, latency_ms``: a row for each key and batch.

    Rows that come together are taken in the order of ``ts``. A key that has been silent for ``idle_s`` of event
    time, counted from the watermark, says so in a row that ``ended`` and begins anew if it comes back. Needs the RocksDB state store.
    """
    kind = calls.schema[key].dataType
    source = calls.withWatermark("ts", late).select(F.col(key).alias("key"), F.col("ts").cast("double").alias("at"), "ts", "status", "latency_ms")
    out = StructType([StructField("key", kind), StructField("at", DoubleType()), StructField("concurrency", IntegerType()), StructField("ema", DoubleType()), StructField("calls", LongType()), StructField("ended", BooleanType())])
    return source.groupBy("key").transformWithStateInPandas(_Adaptive(idle_s, kind), out, "Append", "EventTime").withColumnRenamed("key", key)


def page_stream(pages: DataFrame, on_batch, checkpoint: str, key: str = "page_key", at: str | None = None, late: str = "1 day"):
    """Each page once: repeats are dropped, batches handed to ``on_batch(rows, number)``.

    With a time column ``at`` a page is remembered for ``late`` after it was seen, so that the state stays
    bounded; without one it is remembered for ever.
    """
    once = pages.withWatermark(at, late).dropDuplicatesWithinWatermark([key]) if at else pages.dropDuplicates([key])
    return once.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, width: str, keys: list[str], late: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts and sums by window (sliding if ``slide``) and keys; an extension for event streams."""
    e = events.withWatermark("ts", late) if late else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return e.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, key: str, late: str | None = None) -> DataFrame:
    """Sessions of a key that a pause of ``gap`` ends; an extension for event streams."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def templates(pages: DataFrame, ttl_s: int = 300) -> DataFrame:
    """For each page the latest template of its source and type that is at most ``ttl_s`` old.

    An as-of lookup: the last earlier page of the same key, by a window over the key's times.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("template_key").orderBy("ts", "page").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.struct("ts", "page", "structure")).over(w)
    p = pages.withColumn("template_key", F.concat_ws("::", "source_path", "document_type")).withColumn("t", last)
    fresh = F.col("t").isNotNull() & (F.col("ts").cast("double") - F.col("t.ts").cast("double") <= ttl_s)
    return p.select("source_path", "page", "ts", F.when(fresh, F.col("t.page")).alias("template_page"), F.when(fresh, F.col("t.structure")).alias("hint"))


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it has put out.

    Batches go to the shared folder, not through the driver; of a complete result the last one counts.
    """
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4()}"
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/rows")

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/rows")

    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
