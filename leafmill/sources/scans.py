"""Model scans beyond single pages (packs, recordings, native recognition) and the seam for PDF and media libraries.

Backends are a caller's: a failure is a row with an error, and a call is made once per row or pack.
"""

from __future__ import annotations

import json
import re
import zlib
from abc import ABC, abstractmethod
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import blank, response_text
from leafmill.sources.pages import PageModel, with_retries

#: What a native recogniser can be asked for (fixed values).
OCR_TASKS = ("text_recognition", "key_information_extraction", "document_parsing", "table_parsing", "formula_recognition", "multi_lan", "advanced_recognition")
_GOT = ("response", "reasoning", "input_tokens", "output_tokens", "estimated_image_tokens", "elapsed_ms")


def _called(call, retries: int, base_s: float) -> dict:
    try:
        got, _ = with_retries(call, retries, base_s)
        return {k: got.get(k) for k in _GOT} | {"error": None}
    except Exception as e:  # noqa: BLE001  what fails is a row
        return dict.fromkeys(_GOT) | {"error": str(e) or type(e).__name__}


_ANSWER = "response string, reasoning string, input_tokens long, output_tokens long, estimated_image_tokens long, elapsed_ms long, error string"


def _frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    whole = pd.DataFrame(rows, columns=columns, dtype=object)
    return whole.astype({c: "Int64" for c in ("input_tokens", "output_tokens", "estimated_image_tokens", "elapsed_ms") if c in columns})


def scan_packs(pages: DataFrame, model: PageModel, prompt: str, pack: str = "pack", retries: int = 3, base_s: float = 1.0) -> DataFrame:
    """A row per source and pack: its pages in order, and the model's one answer to all of them.

    Packs come from :func:`leafmill.operators.merge.fixed_chunks` or ``pack_by_budget``, which bound them.
    The prompt begins with ``[Pages a,b]``. A model that takes one image at a time gives an error row.
    """
    kinds = dict(pages.dtypes)
    columns = ["source_path", pack, "pages", "stage", *_GOT, "error"]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("page").to_dict("records")
        named = [int(r["page"]) for r in rows]
        asked = f"[Pages {','.join(map(str, named))}]\n{prompt}"

        def call():
            if not model.supports("multi_image"):
                raise ValueError(f"{model.name} takes one image at a time")
            return model.read_pack(asked, rows)

        return _frame([{"source_path": key[0], pack: key[1], "pages": named, "stage": "pack"} | _called(call, retries, base_s)], columns)

    schema = f"source_path string, `{pack}` {kinds[pack]}, pages array<int>, stage string, {_ANSWER}"
    return pages.groupBy("source_path", pack).applyInPandas(run, schema).withColumn("response", F.when(F.col("error").isNull(), response_text("response", "reasoning")))


def pack_pages(packs: DataFrame) -> DataFrame:
    """A pack's answer as one row per page: the answer with each, the tokens dealt evenly and rounded."""
    from leafmill.functions.tokens import js_round

    n = F.size("pages")
    share = lambda c: js_round(F.col(c) / n).cast("long").alias(c)
    return packs.select("source_path", F.explode("pages").alias("page"), "stage", "response", share("input_tokens"), share("output_tokens"), "error")


def scan_videos(chunks: DataFrame, model: PageModel, prompt: str, retries: int = 3, base_s: float = 1.0) -> DataFrame:
    """A row per stretch of a recording (``source_path, chunk, start_s, end_s, error``): ``success``, ``text``, tokens, ``error``.

    Stretches that are errors already aren't asked for. :func:`leafmill.operators.merge.video_summary` joins them.
    """
    names = chunks.columns
    columns = ["source_path", "chunk", "success", "text", "input_tokens", "output_tokens", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                if "error" in names and isinstance(row["error"], str):
                    got = dict.fromkeys(_GOT) | {"error": row["error"]}
                elif not model.supports("video"):
                    got = dict.fromkeys(_GOT) | {"error": f"{model.name} takes no video"}
                else:
                    got = _called(lambda row=row: model.watch(prompt, row), retries, base_s)
                out.append({"source_path": row["source_path"], "chunk": row["chunk"], "success": got["error"] is None, "text": got["response"], "input_tokens": got["input_tokens"], "output_tokens": got["output_tokens"], "error": got["error"]})
            yield _frame(out, columns)

    return chunks.mapInPandas(run, "source_path string, chunk int, success boolean, text string, input_tokens long, output_tokens long, error string")


def scan_ocr(pages: DataFrame, model: PageModel, task: str, result_schema: dict | None = None, retries: int = 3, base_s: float = 1.0) -> DataFrame:
    """Native recognition of pages: ``source_path, page, task, text, words, ocr_result``, tokens and error.

    ``task`` is one of :data:`OCR_TASKS`; ``result_schema`` goes along with key information only. ``words``
    are the lines found, with the box that holds their four corners.
    """
    if task not in OCR_TASKS:
        raise ValueError(f"no such task: {task}")
    given = result_schema if task == "key_information_extraction" else None
    columns = ["source_path", "page", "task", "text", "ocr_result", "input_tokens", "output_tokens", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                base = {"source_path": row["source_path"], "page": row["page"], "task": task, "error": None}
                try:
                    if not model.supports("native_ocr"):
                        raise ValueError(f"{model.name} has no native recognition")
                    got, _ = with_retries(lambda row=row: model.recognise(task, row, given), retries, base_s)
                    found = got.get("ocr_result")
                    out.append(base | {"text": str(got.get("text") or ""), "ocr_result": None if found is None else json.dumps(found, ensure_ascii=False), "input_tokens": got.get("input_tokens"), "output_tokens": got.get("output_tokens")})
                except Exception as e:  # noqa: BLE001
                    out.append(base | {"text": None, "ocr_result": None, "input_tokens": None, "output_tokens": None, "error": str(e) or type(e).__name__})
            yield _frame(out, columns)

    answers = pages.mapInPandas(run, "source_path string, page int, task string, text string, ocr_result string, input_tokens long, output_tokens long, error string")
    return answers.withColumn("words", words_info("ocr_result"))


def words_info(ocr_result: str):
    """The lines of ``words_info`` with a text, and the box of their corners."""
    from leafmill.operators.normalize import rotated_box, words_box

    kind = "struct<words_info:array<struct<text:string,location:array<double>,rotate_rect:array<double>>>>"
    given = F.from_json(ocr_result, kind)["words_info"]

    def one(w):
        r = w["rotate_rect"]
        corners = F.when(F.size(w["location"]) >= 8, words_box(w["location"]))
        turned = F.when(F.size(r) >= 4, rotated_box(F.get(r, F.lit(0)), F.get(r, F.lit(1)), F.get(r, F.lit(2)), F.get(r, F.lit(3))))
        return F.struct(F.trim(blank(w["text"])).alias("text"), F.coalesce(corners, turned).alias("bbox"))

    return F.filter(F.transform(F.coalesce(given, F.array().cast("array<struct<text:string,location:array<double>,rotate_rect:array<double>>>")), one), lambda w: w["text"] != "")


class PdfBackend(ABC):
    """Opens documents and draws pages; an exception is that document's or page's error."""

    @abstractmethod
    def sizes(self, content: bytes) -> list[tuple[float, float]]:
        """Width and height of each page in points."""

    def render(self, content: bytes, page: int, scale: float) -> bytes:
        raise NotImplementedError("this backend draws no pages")


class PlainPdf(PdfBackend):
    """Without a library: page objects and boxes where they stand in the file or in Flate object streams.

    Encrypted files and other filters are errors, as a broken file is.
    """

    PAGE = re.compile(rb"/Type\s*/Page(?![a-zA-Z])")
    BOX = re.compile(rb"/MediaBox\s*\[\s*([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s*\]")
    STREAM = re.compile(rb"/Type\s*/ObjStm\b.*?stream\r?\n(.*?)endstream", re.S)
    ROTATED = re.compile(rb"/Rotate\s+(90|270)\b")

    def sizes(self, content: bytes) -> list[tuple[float, float]]:
        if not content.lstrip()[:5] == b"%PDF-":
            raise ValueError("Cannot open PDF: no header")
        if b"/Encrypt" in content:
            raise ValueError("PDF open failed: encrypted")
        parts = [content]
        for m in self.STREAM.finditer(content):
            try:
                parts.append(zlib.decompressobj().decompress(m[1]))
            except zlib.error as e:
                raise ValueError(f"Cannot open PDF: {e}") from e
        out, default = [], None
        for part in parts:
            places = [m.start() for m in self.PAGE.finditer(part)]
            common = self.BOX.search(part)
            default = default or (common and common.groups())
            for at in places:
                # a page's own dictionary, or what it inherits
                a, b = max(part.rfind(b"obj", 0, at), 0), part.find(b"endobj", at)
                own = part[a : b if b >= 0 else at + 2000]
                box = self.BOX.search(own)
                x1, y1, x2, y2 = map(float, box.groups() if box else default or (0, 0, 612, 792))
                w, h = abs(x2 - x1), abs(y2 - y1)
                out.append((h, w) if self.ROTATED.search(own) else (w, h))
        if not out:
            raise ValueError("Cannot open PDF: no pages found")
        return out


def pdf_info(files: DataFrame, backend: PdfBackend | None = None, content: str = "content") -> DataFrame:
    """``source_path, file_mb, total_pages, pages, error``: pages with their rounded width and height in points.

    One row per file; contents pass through Arrow in batches and stay where they are.
    """
    backend = backend or PlainPdf()
    page = pa.struct([("page", pa.int32()), ("w_pt", pa.int32()), ("h_pt", pa.int32())])
    schema = pa.schema([("source_path", pa.string()), ("file_mb", pa.float64()), ("total_pages", pa.int32()), ("pages", pa.list_(page)), ("error", pa.string())])

    def run(batches):
        for batch in batches:
            rows = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row = {"source_path": path, "file_mb": None, "total_pages": None, "pages": None, "error": None}
                try:
                    body = raw.as_py() or b""
                    sizes = backend.sizes(body)
                    # halves up, as rounding goes for positive sizes
                    named = [{"page": i, "w_pt": int(w + 0.5), "h_pt": int(h + 0.5)} for i, (w, h) in enumerate(sizes, 1)]
                    row |= {"file_mb": round(len(body) / 2**20 + 1e-9, 2), "total_pages": len(sizes), "pages": named}
                except Exception as e:  # noqa: BLE001
                    row["error"] = str(e) or type(e).__name__
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    source = files.select(F.col("source_path").cast("string"), F.col(content).cast("binary"))
    return source.mapInArrow(run, "source_path string, file_mb double, total_pages int, pages array<struct<page:int,w_pt:int,h_pt:int>>, error string")


def render_pages(pages: DataFrame, backend: PdfBackend, scale: str = "scale", content: str = "content", most_megapixels: float = 25.0) -> DataFrame:
    """Pages (``source_path, page, scale, w_pt, h_pt`` and the file's content) to images: ``image, mime, megapixels, error``.

    A page that would be larger than ``most_megapixels`` is an error before it is drawn.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                size = r["w_pt"] * r["scale"] * r["h_pt"] * r["scale"] / 1e6
                row = {"source_path": r["source_path"], "page": r["page"], "image": None, "mime": "image/png", "megapixels": size, "error": None}
                try:
                    if size > most_megapixels:
                        raise ValueError(f"page {r['page']} is {size:.1f} megapixels, {most_megapixels:g} are allowed")
                    row["image"] = backend.render(r["content"], r["page"], r["scale"])
                except Exception as e:  # noqa: BLE001
                    row["error"] = str(e) or type(e).__name__
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("source_path", pa.string()), ("page", pa.int32()), ("image", pa.binary()), ("mime", pa.string()), ("megapixels", pa.float64()), ("error", pa.string())]))

    named = pages.select("source_path", F.col("page").cast("int").alias("page"), F.col(scale).cast("double").alias("scale"), F.col("w_pt").cast("double").alias("w_pt"), F.col("h_pt").cast("double").alias("h_pt"), F.col(content).cast("binary").alias("content"))
    return named.mapInArrow(run, "source_path string, page int, image binary, mime string, megapixels double, error string")


def render_once(pages: DataFrame, backend: PdfBackend, scale: str = "scale", content: str = "content", most_megapixels: float = 25.0) -> DataFrame:
    """As :func:`render_pages`, each page of equal contents and options drawn once, for all its sources.

    What a cache of a long-lived process does, over the whole table: a render is told by the content's digest.
    """
    keyed = pages.withColumn("render_key", F.concat_ws("-", F.sha1(content), F.col("page").cast("string"), F.col(scale).cast("string")))
    once = keyed.dropDuplicates(["render_key"]).drop("source_path").withColumnRenamed("render_key", "source_path")
    drawn = render_pages(once, backend, scale, content, most_megapixels).withColumnRenamed("source_path", "render_key").drop("page")
    return keyed.select("source_path", "page", "render_key").join(drawn, "render_key", "left").drop("render_key")


def probe_durations(videos: DataFrame, probe) -> DataFrame:
    """Add ``duration_s`` and ``error``: what ``probe(path)`` says; none, nothing finite or nothing above 0 is an error."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in videos.schema)

    def run(batches):
        for batch in batches:
            lengths, errors = [], []
            for path in batch.column(batch.schema.get_field_index("source_path")).to_pylist():
                try:
                    seconds = float(probe(path))
                    if not 0 < seconds < float("inf"):
                        raise ValueError("could not determine video duration")
                    lengths.append(seconds)
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    lengths.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths, pa.float64()), pa.array(errors, pa.string())], [*batch.schema.names, "duration_s", "error"])

    return videos.mapInArrow(run, f"{kept}, duration_s double, error string")
