"""JSON trees, and appends that may be tried again."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import trees
from leafmill.operators.normalize import normalize_pages
from leafmill.sinks import exports
from leafmill.streaming.jobs import page_stream

ODD = [None, "", "nope", '{"a":1', '{"universal_schema":"universal_document_semantics_v2","value":1}']


def grown(r: random.Random, depth: int):
    if depth == 0 or r.random() < 0.2:
        return r.choice([None, True, False, 3, 1.25, "x [?]", "  ", "tab\t\"quoted\" {[", "LOW", "low", ""])
    if r.random() < 0.4:
        return [grown(r, depth - 1) for _ in range(r.randrange(4))]
    names = r.sample(["confidence", "verified", "value", "needs_review", "a b", 'q"t', "input_tokens", "output_tokens", "stats"], r.randrange(5))
    return {n: (True if n == "verified" and r.random() < 0.5 else grown(r, depth - 1)) for n in names}


def plainly_marked(node):
    if isinstance(node, list):
        return [plainly_marked(x) for x in node]
    if not isinstance(node, dict):
        return node
    out = {k: plainly_marked(v) for k, v in node.items()}
    if {"confidence", "verified", "value"} & set(node):
        value, level = node.get("value"), node.get("confidence")
        shown = "" if value is None else value if isinstance(value, str) else json.dumps(value)
        out["needs_review"] = node.get("verified") is not True or str(level or "").lower() == "low" or "[?]" in shown or not shown.strip()
    return out


def test_marks_at_any_depth(spark):
    r = random.Random(3)
    given = [grown(r, 6) for _ in range(60)]
    rows = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(given)] + [(100 + i, t) for i, t in enumerate(ODD)], "k int, t string")
    got = {x.k: x.t for x in trees.mark_review_fields(rows, "t").collect()}
    assert all(json.loads(got[i]) == plainly_marked(t) for i, t in enumerate(given))
    assert [got[100 + i] for i in range(len(ODD))] == ODD


def test_marks_deeper_than_one_expression(spark):
    deep = {"value": "x"}
    for _ in range(trees.LEVELS + 3):
        deep = {"value": [deep], "verified": True}
    rows = spark.createDataFrame([(json.dumps(deep),), ('{"value":1}',), (None,), ("nope",)], "t string")
    got = [x.t for x in trees.mark_review_fields(rows, "t").collect()]
    assert json.loads(next(x for x in got if x and len(x) > 50)) == plainly_marked(deep)
    assert sorted((x for x in got if not x or len(x) < 50), key=str) == [None, "nope", '{"value":1,"needs_review":true}']


def test_token_metrics(spark):
    r = random.Random(5)
    given = [grown(r, 5) for _ in range(40)] + [{"x": [{"input_tokens": 3, "output_tokens": "4"}], "stats": {"totalApiCalls": 2}}, {"stats": {"totalApiCalls": 2}}]

    def summed(node, out):
        if isinstance(node, list):
            for x in node:
                summed(x, out)
        if isinstance(node, dict):
            number = lambda v: v if isinstance(v, int | float) and not isinstance(v, bool) else None
            a, b, told = number(node.get("input_tokens")), number(node.get("output_tokens")), node.get("stats")
            out["in"] += a or 0
            out["out"] += b or 0
            out["entries"] += a is not None or b is not None
            out["told"] += (number(told.get("totalApiCalls")) or 0) if isinstance(told, dict) else 0
            for x in node.values():
                summed(x, out)
        return out

    rows = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(given)] + [(100, None), (101, "nope")], "k int, t string")
    got = {x.k: x for x in trees.token_metrics(rows, ["k"], "t").collect()}
    for i, t in enumerate(given):
        s = summed(t, {"in": 0, "out": 0, "entries": 0, "told": 0})
        assert (got[i].input_tokens or 0, got[i].output_tokens or 0) == (s["in"], s["out"])
        assert (got[i].api_calls or 0, got[i].compat_calls or 0) == (s["entries"] or s["told"], s["entries"] + s["told"])
    assert got[100].api_calls is None and got[101].api_calls is None
    assert trees.token_metrics(rows.limit(0), ["k"], "t").count() == 0


def answers(spark, pages):
    body = '{"field_candidates":[{"label":"a","value":"%d"}],"entities":[{"value":"e"}],"review_issues":[{"message":"m"}]}'
    rows = [("s.pdf", n, body % n) for n in pages]
    return normalize_pages(spark.createDataFrame(rows, "source_path string, page int, response string").withColumn("reasoning", F.lit(None).cast("string")))


def contents(spark, folder):
    return {n: exports.committed(spark, folder, n).count() for n in ("pages", *exports.STREAMS)}


@pytest.mark.parametrize("broken", ["raw_pages", "raw_page_index"])
def test_a_batch_that_fails_is_whole_or_absent(spark, tmp_path, monkeypatch, broken):
    folder, real = str(tmp_path / "ck"), exports.stream_rows
    exports.checkpoint_pages(answers(spark, [1]), folder, "q/1", 0)
    before = contents(spark, folder)

    def fails(pages, name):
        if name == broken:
            raise RuntimeError("lost")
        return real(pages, name)

    monkeypatch.setattr(exports, "stream_rows", fails)
    with pytest.raises(RuntimeError):
        exports.checkpoint_pages(answers(spark, [2, 3]), folder, "q/1", 1)
    assert contents(spark, folder) == before
    monkeypatch.setattr(exports, "stream_rows", real)
    for _ in range(2):  # tried again, and once more when it is there
        exports.checkpoint_pages(answers(spark, [2, 3]), folder, "q/1", 1)
        after = contents(spark, folder)
        assert after["pages"] == after["raw_pages"] == after["semantic_pages"] == after["entities"] == 3


def test_calls_finish_what_broke_off(spark, tmp_path, monkeypatch):
    folder, real = str(tmp_path / "ck"), exports.stream_rows
    monkeypatch.setattr(exports, "stream_rows", lambda pages, name: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        exports.checkpoint_pages(answers(spark, [1, 2]), folder)
    assert exports.committed(spark, folder) is None
    monkeypatch.setattr(exports, "stream_rows", real)
    assert exports.not_checkpointed(answers(spark, [1, 2, 3]), folder).count() == 1
    assert exports.checkpoint_pages(answers(spark, [1, 2, 3]), folder).count() == 3
    assert contents(spark, folder)["raw_pages"] == 3


def test_page_stream_appends_once(spark, tmp_path):
    folder, source = str(tmp_path / "ck"), str(tmp_path / "in")
    pages = answers(spark, [1, 2])
    for round_ in range(2):
        pages.withColumn("page_key", exports.page_key()).write.mode("append").parquet(source)
        stream = spark.readStream.schema(pages.withColumn("page_key", exports.page_key()).schema).parquet(source)
        page_stream(stream, exports.append_batches(folder, "pages"), str(tmp_path / "state")).awaitTermination()
        assert contents(spark, folder)["pages"] == 2
