"""Scans beyond single pages, library seams, and extractions that ask more than once."""

import sys
import zlib

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from leafmill.operators import merge
from leafmill.plans import passes
from leafmill.plans.engine import Engine
from leafmill.sources import scans
from leafmill.sources.pages import PageModel, StubModel

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't find the tests
SPECS = "name string, ord int, label_pattern string, required boolean"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([("a.pdf", i, f"v{i}") for i in range(1, 8)] + [("b.pdf", 1, "w")], "source_path string, page int, colour string")


class OnePage(StubModel):
    def supports(self, kind):
        return False


def test_packs(spark, pages):
    packed = merge.fixed_chunks(pages, 3, ["source_path"], ["page"]).withColumnRenamed("chunk", "pack")
    got = scans.scan_packs(packed, StubModel(), "read").orderBy("source_path", "pack").collect()
    assert [(r.source_path, r.pages) for r in got] == [("a.pdf", [1, 2, 3]), ("a.pdf", [4, 5, 6]), ("a.pdf", [7]), ("b.pdf", [1])]
    assert all(r.error is None and f'"v{r.pages[0]}"' in r.response for r in got[:3])
    each = scans.pack_pages(scans.scan_packs(packed, StubModel(), "read")).collect()
    assert len(each) == 8 and {r.page for r in each if r.source_path == "a.pdf"} == set(range(1, 8))
    assert all("one image at a time" in r.error for r in scans.scan_packs(packed, OnePage(), "read").collect())


def test_videos(spark):
    from leafmill.sources.pages import video_chunks

    v = spark.createDataFrame([("x.mp4",), ("broken.mp4",), ("still.mp4",)], "source_path string")
    probed = scans.probe_durations(v, lambda path: {"x.mp4": 25, "still.mp4": 0}[path])
    assert {r.source_path: r.error is None for r in probed.collect()} == {"x.mp4": True, "broken.mp4": False, "still.mp4": False}
    stretches = video_chunks(probed.drop("error"), "duration_s", 10).withColumn("chunk", F.coalesce("chunk", F.lit(0)))
    got = {r.source_path: r for r in merge.video_summary(scans.scan_videos(stretches, StubModel(), "watch")).collect()}
    assert got["x.mp4"].success and got["x.mp4"].text.count("[Chunk") == 3 and "20 to 25 s" in got["x.mp4"].text
    assert not got["broken.mp4"].success and not got["still.mp4"].success


def test_native_recognition(spark, pages):
    got = scans.scan_ocr(pages, StubModel(), "advanced_recognition").where("source_path = 'b.pdf'").first()
    assert got.text == "colour: w" and got.words[0].text == "colour: w" and got.words[0].bbox.x2 == 100
    assert all("no native" in r.error for r in scans.scan_ocr(pages, OnePage(), "table_parsing").collect())
    with pytest.raises(ValueError):
        scans.scan_ocr(pages, StubModel(), "anything")


def pdf(objects: bytes) -> bytes:
    return b"%PDF-1.7\n" + objects + b"\n%%EOF"


def test_pdf_info(spark):
    plain = pdf(b"1 0 obj<</Type/Pages/MediaBox [0 0 595.28 841.89]/Count 2>>endobj 2 0 obj<</Type/Page/Parent 1 0 R>>endobj 3 0 obj<</Type /Page /MediaBox [0 0 200 100.5] /Rotate 90>>endobj")
    packed = pdf(b"1 0 obj<</Type/ObjStm/Filter/FlateDecode>>stream\n" + zlib.compress(b"<</Type/Page/MediaBox[0 0 300 400]>>") + b"endstream endobj")
    files = [("a", plain), ("b", packed), ("c", b"no"), ("d", pdf(b"/Encrypt 1 0 R /Type/Page")), ("e", None)]
    got = {r.source_path: r for r in scans.pdf_info(spark.createDataFrame(files, "source_path string, content binary")).collect()}
    assert [(p.w_pt, p.h_pt) for p in got["a"].pages] == [(595, 842), (101, 200)] and got["a"].total_pages == 2
    assert [(p.page, p.w_pt, p.h_pt) for p in got["b"].pages] == [(1, 300, 400)]
    assert all(got[k].error for k in "cde") and "encrypted" in got["d"].error
    from leafmill.sources.pages import pdf_pages

    counted = {r.source_path: r.total_pages for r in pdf_pages(spark.createDataFrame(files, "source_path string, content binary")).collect()}
    assert counted == {"a": 2, "b": 1, "c": None, "d": None, "e": None}


def test_rendering(spark):
    class Drawn(scans.PlainPdf):
        def render(self, content, page, scale):
            return f"{page}@{scale}".encode()

    rows = [("a", 1, 2.0, 600, 800, b"x"), ("a", 2, 20.0, 600, 800, b"x")]
    d = spark.createDataFrame(rows, "source_path string, page int, scale double, w_pt int, h_pt int, content binary")
    got = {r.page: r for r in scans.render_pages(d, Drawn()).collect()}
    assert bytes(got[1].image) == b"1@2.0" and got[1].error is None and "megapixels" in got[2].error and got[2].image is None
    assert "draws no pages" in {r.page: r for r in scans.render_pages(d, scans.PlainPdf()).collect()}[1].error


class Unsure(PageModel):
    """Unsure of one field until it is asked again; counts its calls in a file."""

    name = "unsure"

    def __init__(self, log):
        self.log = str(log)

    def read(self, prompt, row):
        import json

        with open(self.log, "a") as f:
            f.write(f"{row['source_path']}#{row['page']}\n")
        again = "Look again" in prompt
        fields = [{"label": "Total", "value": "7" if again or row["page"] % 2 else "7[?]", "confidence": "high"}, {"label": "Name", "value": "x", "confidence": "high"}]
        return {"response": json.dumps({"field_candidates": fields}), "input_tokens": 1, "output_tokens": 1}


def test_second_pass_for_the_uncertain_only(spark, pages, tmp_path):
    specs = spark.createDataFrame([("Total", 0, None, True), ("Name", 1, None, True), ("Never", 2, None, False)], SPECS)
    log = tmp_path / "calls"
    sure = specs.where("name <> 'Never'")
    got = passes.two_pass_extract(pages, Unsure(log), "read", sure).collect()
    calls = log.read_text().split()
    assert len(calls) == 8 + 3 and sorted(calls)[:2] == ["a.pdf#1", "a.pdf#2"]  # pages 2, 4 and 6 once more
    assert len(got) == 16 and {r.value for r in got if r.spec == "Total"} == {"7"}
    assert {r.passes for r in got if r.spec == "Name"} == {1} and {(r.page, r.passes) for r in got if r.spec == "Total" and r.source_path == "a.pdf"} == {(i, 2 - i % 2) for i in range(1, 8)}


def test_layers_take_crops_in_doubt(spark, tmp_path):
    class Layered(PageModel):
        def read(self, prompt, row):
            import json

            if prompt == "crop":
                return {"response": json.dumps({"value": bytes(row["content"]).decode()})}
            box = {"x1": 0, "y1": 0, "x2": 100, "y2": 100}
            return {"response": json.dumps({"field_candidates": [{"label": "Total", "value": "?[?]", "confidence": "low", "bbox": box}, {"label": "Name", "value": "n", "confidence": "high"}]})}

    p = spark.createDataFrame([("a", 1, 1000, 1000, b"crop me")], "source_path string, page int, width int, height int, content binary")
    specs = spark.createDataFrame([("Total", 0, None, True), ("Name", 1, None, True)], SPECS)
    got = passes.layered_extract(p, Layered(), "read", specs, "crop", crop=lambda content, box: content)
    assert {r.spec: (r.value, r.from_crop, r.verified) for r in got["fields"].collect()} == {"Total": ("crop me", True, True), "Name": ("n", False, True)}
    assert got["guard"].first().unverified == 0
    plain = passes.layered_extract(p, Layered(), "read", specs, "crop")
    assert plain["guard"].first().review and plain["guard"].first().unverified == 1


def test_model_first_needs_evidence(spark):
    class Reader(StubModel):
        def recognise(self, task, row, result_schema=None):
            got = super().recognise(task, row, result_schema)
            if task == "key_information_extraction":
                got["ocr_result"]["kv_result"] = {"COLOUR": {"value": row["colour"]}, "size": "42", "none": "n/a"}
            return got

    p = spark.createDataFrame([("a", 1, "red")], "source_path string, page int, colour string")
    got = passes.model_first(p, Reader(), [{"name": "colour"}, {"name": "size"}, {"name": "none", "required": False}])
    entries = {r.name: r for r in got["entries"].collect()}
    assert entries["colour"].verified and entries["colour"].evidence_source == "line" and entries["colour"].confidence == "high"
    assert entries["size"].reasons == ["evidence_not_found_in_ocr_text"] and entries["size"].required_unverified
    assert entries["none"].validation_state == "missing" and not entries["none"].required_unverified
    assert got["report"].first().risk == "high" and [(r.name, r.value) for r in got["final"].collect()] == [("colour", "red")]


def test_analyze_routes_by_kind_and_size(spark):
    rows = [("a.pdf", 2, None), ("long.pdf", 60, None), ("huge.pdf", 300, None), ("i.png", None, None), ("v.mp4", None, 30.0), ("t.txt", None, None)]
    d = spark.createDataFrame(rows, "source_path string, total_pages int, duration_s double")
    got = Engine(spark, StubModel()).analyze(d, "read", chunk_s=20)
    pages = got["pages"].groupBy("source_path", "stage").count().collect()
    assert {(r.source_path, r.stage): r["count"] for r in pages} == {("a.pdf", "page"): 2, ("long.pdf", "pack"): 60, ("i.png", "page"): 1, ("t.txt", "page"): 1}
    assert got["batch"].count() == 300 and {r.source_path: r.success for r in got["videos"].collect()} == {"v.mp4": True}
    summary = {r.source_path: r for r in got["summary"].collect()}
    assert summary["t.txt"].errors == ["Page 0: Unsupported file type: .txt"] and summary["a.pdf"].errors == [] and summary["long.pdf"].successful == 60


def test_each_page_is_asked_once(spark, pages, tmp_path):
    log = tmp_path / "calls"
    got = Engine(spark, Unsure(log)).extract(pages.select("source_path", "colour").distinct().withColumn("total_pages", F.lit(1)), pages="1")
    for name in ("pages", "documents", "fields", "records", "issues"):
        got[name].count()
    assert len(log.read_text().split()) == 8


def test_votes_are_adopted_by_agreement(spark, pages):
    class Voter(PageModel):
        def read(self, prompt, row):
            return {"response": "7" if row["spec"] == "Total" or row["vote_idx"] == 0 else f"other {row['vote_idx']}"}

    fields = [("b.pdf", 1, "Total", True, "1", "low", False, False), ("b.pdf", 1, "Name", True, "2", "low", False, False), ("a.pdf", 1, "Total", True, "3", "high", True, False), ("a.pdf", 2, "Total", True, "", "low", False, False)]
    d = spark.createDataFrame(fields, "source_path string, page int, spec string, required boolean, value string, confidence string, verified boolean, from_crop boolean")
    got = {(r.source_path, r.page, r.spec): (r.value, r.confidence, r.verified) for r in passes.extra_votes(d, pages, Voter()).collect()}
    assert got == {("b.pdf", 1, "Total"): ("7", "high", True), ("b.pdf", 1, "Name"): ("2", "low", False), ("a.pdf", 1, "Total"): ("3", "high", True), ("a.pdf", 2, "Total"): ("", "low", False)}


def test_patterns_that_are_none_end_no_job(spark):
    from leafmill.operators.validate import validate_rules

    f = spark.createDataFrame([("a", "x1"), ("b", "x1"), ("c", "x1"), ("d", None)], "field string, value string")
    r = spark.createDataFrame([("a", "[0-"), ("b", "(?P<n>x)(?P=n)"), ("c", r"\d"), ("d", "x")], "field string, pattern string").selectExpr("*", "cast(null as int) as min_length", "cast(null as int) as max_length", "cast(null as array<string>) as allowed_values")
    assert {(x.field, x.rule) for x in validate_rules(f, r).collect()} == {("b", "pattern"), ("d", "pattern")}


def test_layout_answers(spark):
    rows = [("a", 1, '```json\n{"fields":[{"name":"n","label":"L","value":"v","confidence":"high","bbox":{"x1":1,2,3,4}}]}\n```'), ("a", 2, '{"fields":[{"name":"n","value":"v","bbox":{"x1":1,"y1":,}}]}'), ("a", 3, "nothing")]
    got = {(r.page, r.name, r.value, r.confidence) for r in passes.layout_fields(spark.createDataFrame(rows, "source_path string, page int, response string"), [{"name": "n"}]).collect()}
    assert got == {(1, "n", "v", "high"), (2, "n", "v", "low"), (3, "n", "", "low")}


def test_only_broken_answers_are_asked_again(spark, tmp_path):
    class Fixer(PageModel):
        def read(self, prompt, row):
            return {"response": '{"fixed": true}' if row["page"] == 3 else "still nothing"}

    rows = [("a", 1, '{"x": 1}'), ("a", 2, "{'x': 1,}"), ("a", 3, "none"), ("a", 4, "none"), ("a", 5, None)]
    got = {r.page: r.object for r in passes.structured(spark.createDataFrame(rows, "source_path string, page int, response string"), Fixer()).collect()}
    assert got[1] == '{"x": 1}' and got[2] is not None and got[3] == '{"fixed": true}' and got[4] is None and got[5] is None


def test_slow_calls_are_errors(spark, pages):
    class Slow(PageModel):
        def read(self, prompt, row):
            import time

            time.sleep(0 if row["page"] % 2 else 20)
            return {"response": "{}"}

    from leafmill.sources.pages import scan_model

    got = {r.page: r.error for r in scan_model(pages.where("source_path = 'a.pdf' and page < 4"), Slow(), "read", timeout_s=0.3).collect()}
    assert got == {1: None, 2: "timed out after 0.3 s", 3: None}


def test_equal_pages_are_drawn_once(spark):
    class Counted(scans.PlainPdf):
        def render(self, content, page, scale):
            return bytes(content) + str(page).encode()

    rows = [("a", 1, 1.0, 10, 10, b"x"), ("b", 1, 1.0, 10, 10, b"x"), ("c", 1, 1.0, 10, 10, b"y"), ("c", 2, 9999.0, 1000, 1000, b"y")]
    d = spark.createDataFrame(rows, "source_path string, page int, scale double, w_pt int, h_pt int, content binary")
    got = {(r.source_path, r.page): (None if r.image is None else bytes(r.image), r.error is None) for r in scans.render_once(d, Counted()).collect()}
    assert got == {("a", 1): (b"x1", True), ("b", 1): (b"x1", True), ("c", 1): (b"y1", True), ("c", 2): (None, False)}


def test_swaps_and_waits(spark):
    from leafmill.operators import matching
    from leafmill.streaming import jobs

    v = spark.createDataFrame([("n", " Name "), ("m", "value")], "field string, value string")
    layout = spark.createDataFrame([("n", "name", "Ann", 0), ("m", "Mode", "other", 1)], "field string, label string, value string, idx int")
    assert {r.field: r.value for r in matching.undo_label_swaps(v, layout, ["field"]).collect()} == {"n": "Ann", "m": "value"}
    states = spark.createDataFrame([(s,) for s in ("completed", "queued", "failed", "expired", "finalizing")], "status string")
    r = jobs.wait_summary(states).first()
    assert (r.completed, r.pending, r.failed, r.expired, r.wait_expired) == (1, 1, 2, 1, True)


def test_semantic_pages(spark):
    from leafmill.operators import semantic
    from leafmill.operators.first_version import first_pages

    answer = '{"raw_markdown":"Total: 7\\nno label","text_items":["Date: 2024","x"],"tables":[{"rows":[["Name","Size"],["Ann","3"],["City","42 km"]]}],"field_candidates":[{"name":"a","label":"A","value":"1","confidence":"high"},{"name":"a","label":"A","value":" 1","confidence":"high"}],"mapped_fields":{"b":{"value":"2","confidence":"high"}}}'
    d = spark.createDataFrame([("s", 1, answer), ("s", 2, "{}")], "source_path string, page int, r string").selectExpr("source_path", "page", "from_json(r, 'map<string,string>') as doc")
    hints = spark.createDataFrame([("total", ["total"], True), ("never", ["never"], False)], "name string, aliases array<string>, required boolean")
    got = semantic.semantic_pages(first_pages(d), hints)
    found = {(r.name, r.value, r.source) for r in got["candidates"].collect()}
    assert {("a", "1", "field"), ("b", "2", "mapped"), ("total", "7", "text"), ("date", "2024", "text"), ("ann", "3", "table")} <= found and len(found) == got["candidates"].count()
    pages = {r.page: r for r in got["pages"].collect()}
    assert pages[1].document_type == "table_document_candidate" and pages[2].document_type == "document" and pages[2].needs_review
    assert {(r.page, r.hint): r.matched for r in got["attention"].collect()} == {(1, "total"): True, (1, "never"): False, (2, "total"): False, (2, "never"): False}
    assert {(r.page, r.type, r.severity, r.message) for r in got["issues"].collect()} == {(2, "no_field_candidates", "high", "the page has no field"), (None, "attention_field_not_found", "medium", "never")}
