"""Scans: files, page ranges, model answers, batch results."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions.text import blank, response_text
from leafmill.functions.tokens import media_chunks
from leafmill.schemas import RESPONSES

#: Extensions that are images and videos (fixed values).
IMAGES = (".png", ".jpg", ".jpeg", ".webp", ".gif")
VIDEOS = (".mp4", ".mpeg", ".mov", ".avi", ".flv", ".mpg", ".webm", ".wmv", ".3gpp")
#: Types by extension (fixed values).
MIME = {
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".webp": "image/webp",
    ".gif": "image/gif",
    ".mp4": "video/mp4",
    ".mpeg": "video/mpeg",
    ".mov": "video/quicktime",
    ".avi": "video/x-msvideo",
    ".flv": "video/x-flv",
    ".mpg": "video/mpeg",
    ".webm": "video/webm",
    ".wmv": "video/x-ms-wmv",
    ".3gpp": "video/3gpp",
}


def extension(path) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def media_type(path, override=None) -> Column:
    """By extension; an override other than ``auto`` is taken as it is."""
    e = extension(path)
    auto = F.when(e == ".pdf", "pdf").when(e.isin(*IMAGES), "image").when(e.isin(*VIDEOS), "video").otherwise("unknown")
    if override is None:
        return auto
    given = blank(override)
    return F.when((given != "") & (given != "auto"), given).otherwise(auto)


def mime(path) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    known = F.coalesce(F.try_element_at(table, extension(path)), F.lit("application/octet-stream"))
    return F.when(media_type(path) == "pdf", F.lit("application/pdf")).otherwise(known)


def is_image(path) -> Column:
    return extension(path).isin(*IMAGES)


def is_video(path) -> Column:
    return extension(path).isin(*VIDEOS)


def files(spark: SparkSession, paths: list[str], content: bool = False) -> DataFrame:
    """Each requested path as a row, missing and empty ones with an error. Contents only if asked for."""
    named = [p for p in paths if p]
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(named) if named else None
    asked = spark.createDataFrame([(p,) for p in paths], "asked string")
    if there is None:
        return asked.withColumn("error", F.lit("file_path required"))
    keep = ["path", "length", "modificationTime", *(["content"] if content else [])]
    found = there.select(*keep).withColumn("__key", F.regexp_replace("path", "^file:/*", "/"))
    both = asked.withColumn("__key", F.regexp_replace("asked", "^file:/*", "/")).join(found, "__key", "left").drop("__key")
    error = F.when(blank("asked") == "", "file_path required").when(F.col("path").isNull(), "file not found")
    return both.withColumn("media_type", media_type("asked")).withColumn("mime", mime("asked")).withColumn("error", error)


def page_range(text, total: Column) -> Column:
    """``pages`` and ``error`` of a range such as "1-5,10".

    A part's end beyond the total is cut to it; a start or single page beyond it, below 1 or not a
    number is an error, as is a text of commas and blanks alone. Further dashes are ignored. No text at all means all pages.
    """
    parts = F.filter(F.transform(F.split(blank(text), ","), lambda p: F.trim(p)), lambda p: p != "")
    num = lambda s: F.when(F.trim(s).rlike(r"^\d+$"), F.trim(s).cast("int"))
    one = F.transform(parts, lambda p: F.struct(num(F.get(F.split(p, "-"), F.lit(0))).alias("a"), F.when(p.contains("-"), num(F.get(F.split(p, "-"), F.lit(1)))).otherwise(num(p)).alias("b")))
    bad = ((F.size(parts) == 0) & (blank(text) != "")) | F.exists(one, lambda r: r["a"].isNull() | r["b"].isNull() | (r["a"] < 1) | (r["a"] > total) | (r["b"] < r["a"]))
    spans = F.transform(one, lambda r: F.sequence(r["a"], F.least(r["b"], total)))
    none = F.array().cast("array<int>")
    pages = F.when(blank(text) == "", F.when(total > 0, F.sequence(F.lit(1), total)).otherwise(none)).when(bad, none).otherwise(F.array_sort(F.array_distinct(F.flatten(F.when(bad, F.array(none)).otherwise(spans)))))
    return F.struct(pages.alias("pages"), F.when(bad, F.concat(F.lit("invalid page range: "), blank(text))).alias("error"))


def expand_pages(sources: DataFrame, text="pages", total="total_pages") -> DataFrame:
    """A row per page asked for; a wrong range is one row with an error. Comes before any model call."""
    r = sources.withColumn("__r", page_range(F.col(text), F.col(total)))
    return r.select(*sources.columns, F.explode_outer("__r.pages").alias("page"), F.col("__r.error").alias("error"))


def video_chunks(videos: DataFrame, duration: str, seconds: float) -> DataFrame:
    """Stretches of a recording; one without a length is an error row."""
    r = videos.withColumn("__c", media_chunks(F.col(duration), seconds))
    error = F.when(~(F.col(duration) > 0) | F.col(duration).isNull(), "no duration")
    return r.select(*videos.columns, F.explode_outer("__c").alias("c"), error.alias("error")).select(*videos.columns, F.col("c.index").alias("chunk"), F.col("c.start").alias("start_s"), F.col("c.end").alias("end_s"), "error")


class PageModel(ABC):
    """What reads pages. One call per row; a failure is a row with an error, never an exception."""

    name = "model"

    @abstractmethod
    def read(self, prompt: str, row: dict) -> dict:
        """``response`` and, if known, ``reasoning, input_tokens, output_tokens``."""

    def read_pack(self, prompt: str, rows: list[dict]) -> dict:
        """One answer to several pages; as :meth:`read`."""
        raise NotImplementedError(f"{self.name} takes one image at a time")

    def watch(self, prompt: str, row: dict) -> dict:
        """An answer to a stretch of a recording; as :meth:`read`."""
        raise NotImplementedError(f"{self.name} takes no video")

    def recognise(self, task: str, row: dict, result_schema: dict | None = None) -> dict:
        """Native recognition: ``text``, ``ocr_result`` and, if known, tokens."""
        raise NotImplementedError(f"{self.name} has no native recognition")

    def supports(self, kind: str) -> bool:
        """``multi_image``, ``video``, ``batch`` or ``native_ocr``."""
        return kind == "multi_image"


class StubModel(PageModel):
    """Answers with the JSON of the row's own columns: the offline backend."""

    name = "stub"

    def supports(self, kind: str) -> bool:
        return kind in ("multi_image", "video", "native_ocr")

    @staticmethod
    def _fields(row: dict) -> list[dict]:
        return [{"label": k, "value": v, "confidence": "high"} for k, v in row.items() if k not in ("source_path", "page", "content", "pack", "chunk")]

    def _answer(self, prompt: str, fields: list[dict]) -> dict:
        body = {"schema": "universal_document_semantics_v2", "document_classification": {"type": "record", "confidence": "high"}, "field_candidates": fields}
        text = json.dumps(body, default=str, ensure_ascii=False)
        return {"response": text, "input_tokens": len(prompt) // 4, "output_tokens": len(text) // 4}

    def read(self, prompt: str, row: dict) -> dict:
        return self._answer(prompt, self._fields(row))

    def read_pack(self, prompt: str, rows: list[dict]) -> dict:
        return self._answer(prompt, [f for r in rows for f in self._fields(r)])

    def watch(self, prompt: str, row: dict) -> dict:
        return {"response": f"{row['source_path']} from {row['start_s']:g} to {row['end_s']:g} s", "input_tokens": len(prompt) // 4, "output_tokens": 8}

    def recognise(self, task: str, row: dict, result_schema: dict | None = None) -> dict:
        lines = [f"{f['label']}: {f['value']}" for f in self._fields(row)]
        words = [{"text": t, "location": [0, 10 * i, 100, 10 * i, 100, 10 * i + 8, 0, 10 * i + 8]} for i, t in enumerate(lines)]
        values = {f["label"]: f["value"] for f in self._fields(row) if result_schema is None or f["label"] in result_schema}
        found = {"kv_result": values} if task == "key_information_extraction" else {"words_info": words}
        return {"text": "\n".join(lines), "ocr_result": json.loads(json.dumps(found, default=str)), "input_tokens": 10, "output_tokens": len(lines)}


def retryable_error(e: Exception) -> bool:
    status = getattr(e, "status", None)
    return status == 429 or (isinstance(status, int) and status >= 500)


def with_retries(call, most: int = 3, base_s: float = 1.0, jitter=lambda: 0.0, sleep=None):
    """Call again after base * 2**i seconds plus jitter, on 429 and 5xx only. Returns result and attempts."""
    import time

    sleep = sleep or time.sleep
    for i in range(most + 1):
        try:
            return call(), i + 1
        except Exception as e:
            if i == most or not retryable_error(e):
                raise
            sleep(base_s * 2**i + jitter())
    raise AssertionError


def within(call, seconds: float | None):
    """What ``call()`` returns, or a TimeoutError after ``seconds``; the call itself is left to end by itself."""
    if seconds is None:
        return call()
    from threading import Thread

    out: list = []

    def run():
        try:
            out.append((call(), None))
        except Exception as e:  # noqa: BLE001  raised below, in the caller's thread
            out.append((None, e))

    t = Thread(target=run, daemon=True)
    t.start()
    t.join(seconds)
    if not out:
        raise TimeoutError(f"timed out after {seconds:g} s")
    if out[0][1] is not None:
        raise out[0][1]
    return out[0][0]


def scan_model(pages: DataFrame, model: PageModel, prompt: str, in_flight: int | None = None, retries: int = 3, base_s: float = 1.0, timeout_s: float | None = None, timeouts: int = 2) -> DataFrame:
    """The model as a scan: pages to answers. ``in_flight`` bounds the calls at once by partitions.

    A call that takes longer than ``timeout_s`` is made once more (``timeouts`` in all), then it is an error.
    """
    names = pages.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                base = {"source_path": row["source_path"], "page": row["page"], "stage": "page", "error": None}
                try:
                    for left in range(timeouts - 1, -1, -1):
                        try:
                            got, _ = with_retries(lambda row=row: within(lambda: model.read(prompt, {k: row[k] for k in names}), timeout_s), retries, base_s)
                            break
                        except TimeoutError:
                            if not left:
                                raise
                    out.append(base | {k: got.get(k) for k in ("response", "reasoning", "input_tokens", "output_tokens", "estimated_image_tokens", "elapsed_ms")})
                except Exception as e:  # noqa: BLE001  a page that fails is a row
                    out.append(base | {"error": str(e) or type(e).__name__})
            cols = ["source_path", "page", "stage", "response", "reasoning", "input_tokens", "output_tokens", "estimated_image_tokens", "elapsed_ms", "error"]
            yield pd.DataFrame(out, columns=cols, dtype=object).astype({c: "Int64" for c in cols[5:9]}) if out else pd.DataFrame(columns=cols)

    # fewer partitions without a shuffle of contents: as many calls at once as there are partitions
    source = pages.coalesce(in_flight) if in_flight else pages
    answers = source.mapInPandas(run, RESPONSES)
    return answers.withColumn("response", F.when(F.col("error").isNull(), response_text("response", "reasoning")))


def replay(spark: SparkSession, path: str) -> DataFrame:
    """Recorded answers instead of a model."""
    return spark.read.schema(RESPONSES).parquet(path)


def page_prompt(page: Column, pack: Column | None = None) -> Column:
    """``[Page n]`` or ``[Pages a,b]`` in front of a prompt."""
    if pack is None:
        return F.concat(F.lit("[Page "), page.cast("string"), F.lit("]"))
    return F.concat(F.lit("[Pages "), F.array_join(pack.cast("array<string>"), ","), F.lit("]"))


BATCH_LINE = "custom_id string, response struct<status_code:int,body:struct<choices:array<struct<message:struct<content:string>>>,usage:struct<prompt_tokens:bigint,completion_tokens:bigint>>>, error struct<message:string>"


def read_batch_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Batch output lines to pages: a line that can't be read is page 0 with an error."""
    j = F.from_json(value, BATCH_LINE)
    r = lines.withColumn("j", F.when(F.try_parse_json(value).isNotNull(), j))
    page = F.coalesce(F.nullif(F.regexp_extract(F.coalesce("j.custom_id", F.lit("")), r"(\d+)$", 1), F.lit("")).cast("int"), F.lit(0))
    ok = F.coalesce(F.col("j.response.status_code") == 200, F.lit(False))
    text = F.get("j.response.body.choices", F.lit(0))["message"]["content"]
    error = F.when(F.col("j").isNull(), "parse error").when(~ok, F.coalesce("j.error.message", F.concat(F.lit("status "), F.col("j.response.status_code").cast("string")), F.lit("unknown error")))
    return r.select(page.alias("page"), ok.alias("success"), F.when(ok, F.coalesce(text, F.lit(""))).alias("text"), F.col("j.response.body.usage.prompt_tokens").alias("input_tokens"), F.col("j.response.body.usage.completion_tokens").alias("output_tokens"), error.alias("error"))


def batch_requests(pages: DataFrame, model: str, prompt: str, max_tokens: int = 4096) -> DataFrame:
    """Request lines, one per page; a page that failed to render is an error row and has no line."""
    image = F.struct(F.lit("image_url").alias("type"), F.struct(F.concat(F.lit("data:"), F.col("mime"), F.lit(";base64,"), F.translate(F.base64("content"), "\r\n", "")).alias("url")).alias("image_url"))
    text = F.struct(F.lit("text").alias("type"), F.concat(page_prompt(F.col("page")), F.lit("\n"), F.lit(prompt)).alias("text"))
    content = F.concat(F.lit("["), F.to_json(image), F.lit(","), F.to_json(text), F.lit("]"))
    head = F.to_json(F.struct(F.concat(F.lit("page-"), F.col("page").cast("string")).alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url")))
    body = F.concat(F.lit('{"model":"'), F.lit(model), F.lit(f'","max_tokens":{max_tokens},"messages":[{{"role":"user","content":'), content, F.lit("}]}"))
    line = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"body":'), body, F.lit("}"))
    return pages.select("source_path", "page", F.when(F.col("content").isNotNull(), line).alias("line"), F.when(F.col("content").isNull(), "render failed").alias("error"))


def pdf_pages(contents: DataFrame, content: str = "content", backend=None) -> DataFrame:
    """Add ``total_pages`` by what a backend sees (:class:`leafmill.sources.scans.PdfBackend`); null for what it can't open."""
    from leafmill.sources.scans import PlainPdf

    seen = backend or PlainPdf()

    @F.pandas_udf(T.IntegerType())
    def count(files: pd.Series) -> pd.Series:
        def one(body):
            try:
                return len(seen.sizes(bytes(body or b"")))
            except Exception:  # noqa: BLE001  what can't be opened has no count
                return None

        return files.map(one).astype("Int32")

    return contents.withColumn("total_pages", count(F.col(content)))


def capabilities(provider: str, region: str = "") -> dict:
    """What a provider is known to support."""
    native = provider.lower().startswith("qwen") or "dashscope" in provider.lower()
    return {"multi_image": True, "video": native, "batch": native and region in ("", "cn", "intl"), "native_ocr": native, "pixel_controls": native}
