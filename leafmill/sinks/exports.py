"""Exports: checkpoints, JSON and NDJSON, report, workbook rows, envelope.

Writes go through Spark's committers, so files appear whole or not at all.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions.text import blank, or_, page_json_name
from leafmill.operators.normalize import explode_list
from leafmill.shared import listed

STREAMS = {"raw_pages": None, "semantic_pages": None, "entities": "entities", "relationships": "relationships", "review_issues": "issues", "raw_page_index": None}
SHEETS = ["Overview", "Integrated Records", "Detected Fields", "Tables", "Entities", "Relationships", "Review Issues", "Raw Page Index", "Attention Fields"]


def page_key(path: str = "source_path", page: str = "page") -> Column:
    """A page of a source: the whole path counts, not only its last part."""
    return F.concat_ws("#", F.sha1(F.col(path)), F.col(page).cast("string"))


def not_checkpointed(pages: DataFrame, folder: str) -> DataFrame:
    """Resuming: the pages of which no checkpoint exists. A run that broke off after its pages is finished first."""
    finish_runs(pages.sparkSession, folder)
    done = committed(pages.sparkSession, folder)
    if done is None:
        return pages
    done = done.select(F.col("source_path").alias("__path"), F.col("page").alias("__page"))
    return pages.join(done, F.col("source_path").eqNullSafe(F.col("__path")) & F.col("page").eqNullSafe(F.col("__page")), "left_anti")


def stream_rows(pages: DataFrame, name: str) -> DataFrame:
    """The rows of one of the NDJSON streams."""
    if name == "raw_pages":
        return pages.select("source_path", "page", "raw_markdown", "raw_html", "text_items", "tables", "uncertain_tokens", F.col("response").alias("model_raw_response"))
    if name == "semantic_pages":
        return pages.drop("response", "reasoning")
    if name == "raw_page_index":
        return page_index(pages)
    return explode_list(pages, STREAMS[name])


def committed(spark: SparkSession, folder: str, name: str = "pages") -> DataFrame | None:
    """What runs that are in the commit log have written of the pages or of a stream; None if there are none."""
    if not listed(spark, f"{folder}/commits"):
        return None
    log = spark.read.parquet(f"{folder}/commits").select("run").distinct()
    rows = spark.read.parquet(f"{folder}/pages") if name == "pages" else spark.read.json(f"{folder}/{name}.ndjson")
    return rows.join(log, "run", "left_semi") if "run" in rows.columns else rows.limit(0)


def _finish(spark: SparkSession, folder: str, run: str) -> None:
    """A run's streams from its pages, over whatever an earlier try has left, and then its line in the log."""
    added = spark.read.parquet(f"{folder}/pages/run={run}").drop("page_key", "file")
    for name in STREAMS:
        stream_rows(added, name).write.mode("overwrite").option("ignoreNullFields", "false").option("compression", "gzip").json(f"{folder}/{name}.ndjson/run={run}")
    spark.createDataFrame([(run,)], "run string").coalesce(1).write.mode("append").parquet(f"{folder}/commits")


def _runs(spark: SparkSession, folder: str) -> set[str]:
    return {r["run"] for r in spark.read.parquet(f"{folder}/commits").select("run").collect()} if listed(spark, f"{folder}/commits") else set()  # one name a run


def finish_runs(spark: SparkSession, folder: str) -> None:
    """Runs whose pages are whole but that aren't in the log: their pages aren't asked for again."""
    names = [n.removeprefix("run=") for n in listed(spark, f"{folder}/pages") if n.startswith("run=")]
    for run in sorted(set(names) - _runs(spark, folder)):
        if "_SUCCESS" in listed(spark, f"{folder}/pages/run={run}"):
            _finish(spark, folder, run)


def checkpoint_pages(pages: DataFrame, folder: str, stream: str = "call", batch: int | None = None, make=None) -> DataFrame:
    """Append the pages that aren't there yet, failed ones too, and their streams; return artifact rows.

    A page that is given twice is one page. Each run writes folders of its own, pages first, and is in the commit log
    once all are whole; readers (:func:`committed`) take what the log holds. ``stream`` and ``batch`` name a run of a
    page stream: one that is tried again writes the same folders, or nothing if it is in the log. One writer at a time.
    With ``make`` the rows given are answers, and it makes pages of those that are new: so answers alone are shuffled.
    A source's pages are written beside one another, without what can be told from path and page, which compresses badly.
    """
    spark = pages.sparkSession
    run = f"{hashlib.sha1(stream.encode()).hexdigest()}-{uuid.uuid4() if batch is None else batch}"
    if batch is None or run not in _runs(spark, folder):
        todo = not_checkpointed(pages, folder)
        if run not in _runs(spark, folder):
            new = todo.drop("page_key", "file").dropDuplicates(["source_path", "page"]).sortWithinPartitions("source_path", "page")
            (new if make is None else make(new)).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/pages/run={run}")
            _finish(spark, folder, run)
    return committed(spark, folder).select(F.lit("page_json").alias("kind"), "source_path", "page", F.concat(F.lit(folder + "/"), page_json_name("source_path", "page")).alias("path"))


def append_batches(folder: str, stream: str, make=None):
    """What a page stream hands its batches to (of answers, if ``make`` makes pages of them): each is appended exactly once, however often it is tried."""
    return lambda rows, number: checkpoint_pages(rows, folder, stream, number, make)


def page_index(pages: DataFrame) -> DataFrame:
    return pages.select("source_path", "page", F.length("raw_markdown").alias("chars"), F.size("text_items").alias("text_item_count"), F.size("tables").alias("table_count"))


def detected_field_rows(pages: DataFrame) -> DataFrame:
    """The 13 columns of a detected field, with their fallbacks."""
    f = explode_list(pages, "fields")
    return f.select(
        "source_path",
        "page",
        "field_id",
        or_("field_name_model", "label_original").alias("field_name"),
        or_("label_original", "field_name_model").alias("label"),
        or_("value_original", "value_normalized").alias("value"),
        or_("value_normalized", "value_original").alias("value_normalized"),
        "value_type_model",
        "confidence",
        F.coalesce("evidence.raw_text", F.lit("")).alias("evidence"),
        F.coalesce("attention_match", F.lit("")).alias("attention_match"),
        "needs_review",
        F.col("page_number").alias("evidence_page"),
    )


def table_rows(pages: DataFrame, columns: int | None = None) -> DataFrame:
    """Table rows with ``row_index`` from 1; cells as an array, or as ``col_1`` to ``col_n``."""
    t = pages.select("source_path", "page", F.explode_outer("tables").alias("t")).select("source_path", "page", "t.table_id", F.posexplode_outer("t.rows").alias("i", "cells")).where("i is not null")
    t = t.select("source_path", "page", "table_id", (F.col("i") + 1).alias("row_index"), "cells")
    return t if columns is None else t.select("source_path", "page", "table_id", "row_index", *[F.get("cells", F.lit(i)).alias(f"col_{i + 1}") for i in range(columns)])


def attention_rows(pages: DataFrame) -> DataFrame:
    a = explode_list(pages, "attention")
    return a.select("source_path", "page", "name", F.array_join("aliases", ", ").alias("aliases"), "status", "matched", F.size("candidates").alias("candidate_count"), "needs_review")


def record_rows(records: DataFrame, names: list[str], compat: bool = False) -> DataFrame:
    """Records as columns: fields are prefixed unless ``compat`` lets them replace what they are called like."""
    wide = records.groupBy("source_path", "page", "record_id", "record_type", "confidence", "needs_review").pivot("name", names).agg(F.first("value"))
    fixed = [c for c in ("source_path", "page", "record_id", "record_type", "confidence", "needs_review") if not (compat and c in names)]
    return wide.select(*fixed, *[F.col(f"`{n}`").alias(n if compat else f"field.{n}") for n in names if not (compat and n in fixed)])


def _field_names(records: DataFrame, most: int = 16_000) -> list[str]:
    """The fields of all records, which become columns; more than a sheet holds is an error."""
    names = [r["name"] for r in records.select("name").distinct().orderBy("name").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} fields: more columns than a sheet holds")
    return names


def overview_rows(pages: DataFrame) -> DataFrame:
    """Counts per source."""
    one = lambda c: F.sum(F.size(c)).cast("long")
    return pages.groupBy("source_path").agg(F.count(F.lit(1)).alias("pages"), one("fields").alias("fields"), one("tables").alias("tables"), one("entities").alias("entities"), one("relationships").alias("relationships"), one("issues").alias("issues"), F.bool_or("review_required").alias("review_required"))


def column_widths(rows: DataFrame, sample: int = 100) -> dict[str, int]:
    """Width of each column by its first rows: longest text plus 2, within 10 and 60."""
    head = rows.limit(sample).select([F.least(F.length(blank(F.col(f"`{c}`").cast("string"))), F.lit(80)).alias(c) for c in rows.columns])
    most = head.agg(*[F.max(f"`{c}`").alias(c) for c in rows.columns]).first()
    return {c: min(60, max(10, max(most[c] or 0, len(c)) + 2)) for c in rows.columns}


def flat(rows: DataFrame) -> DataFrame:
    """Every column as text: nested ones as JSON, null as empty."""
    nested = ("array", "struct", "map")
    return rows.select([blank(F.to_json(f"`{n}`") if t.startswith(nested) else F.col(f"`{n}`").cast("string")).alias(n) for n, t in rows.dtypes])


def report(pages: DataFrame, most_records: int = 100, most_issues: int = 200) -> DataFrame:
    """A Markdown report per source: heading, classification, first records and issues, and how many more.

    Pages are made once: a page's lines are one list, exploded once, numbered within source and kind and
    rolled up once by source.
    """
    from leafmill.operators.merge import record_list

    def lines(xs: Column, kind: int, first: str, second: str, text) -> Column:
        return F.transform(xs, lambda x: F.struct(F.lit(kind).alias("kind"), x[first].alias("first"), x[second].alias("second"), text(x).alias("text")))

    said = F.concat(
        F.array(F.struct(F.lit(0).alias("kind"), F.lit("").alias("first"), F.lit("").alias("second"), F.col("classification.type").alias("text"))),
        lines(record_list(), 1, "record_id", "name", lambda x: F.concat_ws(" ", x["record_id"], x["name"], F.lit("="), x["value"])),
        lines(F.col("issues"), 2, "type", "message", lambda x: F.concat_ws(" ", x["severity"], x["type"], x["message"])),
    )
    rows = pages.select("source_path", "page", F.explode_outer(said).alias("x")).select("source_path", "page", "x.*")
    order = Window.partitionBy("source_path", "kind").orderBy("page", "first", "second")
    placed = rows.withColumn("place", F.row_number().over(order))

    def listed(kind: int, most: int) -> Column:
        few = F.collect_list(F.when((F.col("kind") == kind) & (F.col("place") <= most), F.struct("place", "text")))
        return F.array_join(F.transform(F.array_sort(few), lambda x: F.concat(F.lit("- "), x["text"])), "\n")

    count = lambda kind: F.count_if(F.col("kind") == kind)
    head = F.when(F.col("kind") == 0, F.col("text"))
    both = placed.groupBy("source_path").agg(
        count(0).alias("n"), F.min_by(head, F.when(head.isNotNull(), F.col("page"))).alias("kind"),
        listed(1, most_records).alias("records"), count(1).alias("records_n"), listed(2, most_issues).alias("issues"), count(2).alias("issues_n"),
    )

    def part(title, name, most):
        n = F.col(f"{name}_n")
        return F.concat(F.lit(f"\n\n## {title}\n"), F.when(n > 0, F.col(name)).otherwise("none"), F.when(n > most, F.concat(F.lit("\n... "), (n - most).cast("string"), F.lit(" more"))).otherwise(""))

    text = F.concat(F.lit("# "), "source_path", F.lit("\n\npages: "), F.col("n").cast("string"), F.lit("\nclassification: "), "kind", part("Records", "records", most_records), part("Issues", "issues", most_issues))
    return both.select("source_path", text.alias("markdown"))


def envelope(tool: str, ok: bool, data: DataFrame, limit_rows: int = 1000, folder: str | None = None) -> DataFrame:
    """A result as one JSON text: status, tool, number of rows, and the rows.

    More than ``limit_rows`` rows are written to ``folder`` as JSON lines, and the text says where; without
    a folder that is an error, so that no row is left out unseen.
    """
    spark = data.sparkSession
    n = data.count()
    head = [F.lit(ok).alias("success"), F.lit(tool).alias("tool"), F.lit(n).alias("rows")]
    if n <= limit_rows:
        return data.agg(F.to_json(F.struct(*head, F.collect_list(F.struct(*data.columns)).alias("data"))).alias("envelope"))
    if folder is None:
        raise ValueError(f"{n} rows are more than the {limit_rows} that a text holds; give a folder for them")
    data.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)
    return spark.range(1).select(F.to_json(F.struct(*head, F.lit(folder).alias("data_path"))).alias("envelope"))


def export(pages: DataFrame, folder: str, formats: list[str] | None = None) -> DataFrame:
    """Result, records and NDJSON always; report and workbook if asked for. Returns the artifacts."""
    from leafmill.operators.merge import integrated_records
    from leafmill.plans.policy import export_formats
    from leafmill.sinks.workbook import write_workbook

    spark: SparkSession = pages.sparkSession
    wanted = export_formats(formats)
    records, issues = integrated_records(pages), explode_list(pages, "issues")
    made = [("result", f"{folder}/extraction_result.json"), ("records", f"{folder}/integrated_records.json")]
    pages.write.mode("overwrite").option("ignoreNullFields", "false").json(made[0][1])
    records.write.mode("overwrite").option("ignoreNullFields", "false").json(made[1][1])
    for name in STREAMS:
        stream_rows(pages, name).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/{name}.ndjson")
        made.append((name, f"{folder}/{name}.ndjson"))
    if "markdown" in wanted or "md" in wanted:
        report(pages).select(F.col("markdown").alias("value")).write.mode("overwrite").text(f"{folder}/report.md")
        made.append(("report", f"{folder}/report.md"))
    if "xlsx" in wanted:
        sheets = {
            "Overview": overview_rows(pages),
            "Integrated Records": record_rows(records, _field_names(records)),
            "Detected Fields": detected_field_rows(pages),
            "Tables": table_rows(pages),
            "Entities": explode_list(pages, "entities"),
            "Relationships": explode_list(pages, "relationships"),
            "Review Issues": issues,
            "Raw Page Index": page_index(pages),
        }
        attention = attention_rows(pages)
        if attention.take(1):
            sheets["Attention Fields"] = attention
        write_workbook({k: flat(v) for k, v in sheets.items()}, f"{folder}/extraction.xlsx")
        made.append(("workbook", f"{folder}/extraction.xlsx"))
    return spark.createDataFrame(made, "kind string, path string")


def artifact_name(kind: str, base: str, page: int | None = None) -> str:
    """A file's name: the base made safe, the page with four digits."""
    import re

    safe = re.sub(r"[^A-Za-z0-9._一-鿿-]+", "_", base)
    return f"{safe}-p{page:04d}.{kind}" if page is not None else f"{safe}.{kind}"


