"""The five requests: inspect, prepare, analyze, extract, jobs.

Each takes and returns DataFrames; nothing runs before the caller asks for rows, apart from exports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions.tokens import image_tokens, strategy
from leafmill.operators import merge
from leafmill.operators.normalize import attention_hints, normalize_pages
from leafmill.plans.policy import Accuracy, accuracy, document_prompt, preprocess_variants
from leafmill.shared import cut
from leafmill.sources.pages import PageModel, batch_requests, expand_pages, extension, media_type, scan_model, video_chunks
from leafmill.sources.scans import pack_pages as pack_pages_of
from leafmill.sources.scans import scan_packs, scan_videos


class Engine:
    def __init__(self, spark: SparkSession, model: PageModel | None = None, policy: Accuracy | None = None):
        self.spark, self.model, self.policy = spark, model, policy or accuracy()

    def inspect(self, sources: DataFrame) -> DataFrame:
        """``source_path, total_pages, width, height`` to type, token estimate and recommended strategy."""
        per = image_tokens(F.col("width"), F.col("height"))
        return sources.select("source_path", media_type("source_path").alias("media_type"), "total_pages", per.alias("tokens_per_page"), (per * F.col("total_pages")).alias("tokens"), strategy(F.col("total_pages")).alias("strategy"))

    def prepare(self, images: DataFrame, variants: list[str] | None = None) -> DataFrame:
        """One row per image and variant, with samples, steps and the original's digest."""
        from leafmill.operators.imaging import prepare

        named = F.explode(F.array(*[F.lit(v) for v in preprocess_variants(variants)]))
        return prepare(images.withColumn("preset", named))

    def _pages(self, sources: DataFrame, pages: str | None) -> DataFrame:
        given = sources if "pages" in sources.columns else sources.withColumn("pages", F.lit(pages))
        return expand_pages(given)

    def analyze(self, sources: DataFrame, prompt: str, pages: str | None = None, asked_strategy: str | None = None, pack_pages: int = 20, chunk_s: float = 1800.0) -> dict[str, DataFrame]:
        """Free-form answers by kind of source: ``pages``, ``videos`` and ``summary``.

        Documents are read page by page, in packs or as batch lines, by their number of pages (or as asked);
        images are documents of one page; recordings are read in stretches and joined. ``batch`` holds the
        request lines, for which no model is asked here. What can't be read is an error row.
        """
        kind = media_type("source_path", "media_type" if "media_type" in sources.columns else None)
        typed = sources.withColumn("__kind", kind)
        documents = typed.where("__kind in ('pdf', 'image')")
        if "total_pages" not in sources.columns:
            documents = documents.withColumn("total_pages", F.lit(1))
        documents = documents.withColumn("total_pages", F.when(F.col("__kind") == "image", 1).otherwise(F.col("total_pages")))
        asked = self._pages(documents, pages)
        count = F.count(F.lit(1)).over(Window.partitionBy("source_path"))
        how = strategy(count, F.lit(asked_strategy)) if asked_strategy else strategy(count)
        routed = asked.where("error is null").drop("error").withColumn("strategy", how)
        model = self._need()
        single = scan_model(routed.where("strategy = 'concurrent'").drop("strategy"), model, prompt, self.policy.concurrency)
        packs = merge.fixed_chunks(routed.where("strategy = 'multi-image'").drop("strategy"), pack_pages, ["source_path"], ["page"]).withColumnRenamed("chunk", "pack")
        packed = pack_pages_of(scan_packs(packs, model, prompt))
        other = typed.where("__kind = 'unknown'").select("source_path", F.lit(0).alias("page"), F.lit("page").alias("stage"), F.concat(F.lit("Unsupported file type: "), extension("source_path")).alias("error"))
        answers = single.unionByName(packed, allowMissingColumns=True).unionByName(self._failed(asked), allowMissingColumns=True).unionByName(other, allowMissingColumns=True)
        out = {"pages": cut(answers)}
        out["summary"] = merge.run_summary(out["pages"].select("source_path", "page", F.col("error").isNull().alias("success"), (F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))).alias("tokens"), "error"), ["source_path"])
        if "duration_s" in sources.columns:
            stretches = video_chunks(typed.where("__kind = 'video'").select("source_path", "duration_s"), "duration_s", chunk_s)
            out["videos"] = merge.video_summary(cut(scan_videos(stretches.withColumn("chunk", F.coalesce("chunk", F.lit(0))), model, prompt)))
        lines = routed.where("strategy = 'batch'")
        if {"content", "mime"} <= set(routed.columns):
            out["batch"] = batch_requests(lines, model.name, prompt)
        else:
            out["batch"] = lines.select("source_path", "page")
        return out

    def extract(self, sources: DataFrame, attention: list | None = None, rules: str | None = None, pages: str | None = "1", grain: str = "page", folder: str | None = None) -> dict[str, DataFrame]:
        """The flagship: pages, documents, fields, records, issues; with ``folder`` resumed and checkpointed there.

        Pages that have a checkpoint aren't asked again: the model sees the rest only. The pages are kept
        reliably, in ``folder`` or the shared folder, before anything is made of them: each is asked once.
        """
        from leafmill.sinks.exports import checkpoint_pages, committed, not_checkpointed

        hints = attention_hints(attention or [])
        asked = self._pages(sources, pages)
        todo = not_checkpointed(asked, folder) if folder else asked
        answers = scan_model(todo.where("error is null").drop("error"), self._need(), document_prompt(hints, rules, grain), self.policy.concurrency)
        found = normalize_pages(answers.unionByName(self._failed(todo), allowMissingColumns=True), hints)
        if folder:
            checkpoint_pages(found, folder)
            found = committed(self.spark, folder).drop("page_key", "file", "run")
        else:
            found = cut(found)
        return self.roll_up(found, [h["name"] for h in hints if h["required"]])

    @staticmethod
    def roll_up(pages: DataFrame, required: list[str] | None = None) -> dict[str, DataFrame]:
        from leafmill.operators.normalize import explode_list

        return {
            "pages": pages,
            "documents": merge.documents(pages),
            "fields": merge.final_fields(pages),
            "records": merge.integrated_records(pages),
            "detected": merge.detected_documents(pages),
            "issues": explode_list(pages, "issues"),
            "attention": merge.attention_mapped(pages),
            "attention_missing": merge.attention_review(pages, required or []),
            "costs": merge.cost_rollup(pages, ["source_path"]),
        }

    def jobs(self, path: str):
        from leafmill.streaming.jobs import JobTable

        return JobTable(self.spark, path)

    def _need(self) -> PageModel:
        if self.model is None:
            raise ValueError("no page model given")
        return self.model

    @staticmethod
    def _failed(asked: DataFrame) -> DataFrame:
        return asked.where("error is not null").select("source_path", F.coalesce("page", F.lit(0)).alias("page"), F.lit("page").alias("stage"), "error")


def extract_with_retry(pages: DataFrame, model: PageModel, prompt: str, rules: DataFrame) -> DataFrame:
    """Extract, validate, and ask once more where a rule is broken, telling the model which.

    The second scan sees only those pages. Answers are kept reliably, so that each scan runs once and
    what is broken belongs to the answers that are kept.
    """
    from leafmill.operators.normalize import explode_list
    from leafmill.operators.validate import validate_rules

    first = cut(normalize_pages(scan_model(pages, model, prompt)))
    fields = explode_list(first, "fields").select("source_path", "page", F.col("field_name_model").alias("field"), F.col("value_original").alias("value"))
    broken = validate_rules(fields, rules).groupBy("source_path", "page").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(": ", "field", "rule"))), "; ").alias("broken"))
    broken = cut(broken)
    again = scan_model(pages.join(broken, ["source_path", "page"]), model, prompt + "\nCorrect what the rules reject; it is listed with the page.")
    second = cut(normalize_pages(again))
    kept = first.join(broken.select("source_path", "page"), ["source_path", "page"], "left_anti")
    return kept.unionByName(second, allowMissingColumns=True)
