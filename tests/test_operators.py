import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leafmill.operators import consensus, imaging, matching, merge, semantic, validate
from leafmill.operators.normalize import attention_hints, explode_list, normalize_pages
from leafmill.plans.engine import Engine
from leafmill.sinks.exports import checkpoint_pages, export, not_checkpointed
from leafmill.sinks.workbook import read_workbook
from leafmill.sources.pages import StubModel, with_retries
from leafmill.streaming import jobs

ANSWER = {
    "document_classification": {"type": "form", "confidence": "HIGH"},
    "raw_content": {"raw_markdown": "a\n b", "text_items": ["x", {"text": ""}], "tables": [{"rows": [["h", "i"], ["1", 2], "alone"]}]},
    "field_candidates": [{"label": "attention_target", "value": "v1", "confidence": "high"}, {"name": ""}, {"label": "other_visible_field", "value": "v2"}],
    "entities": [{"type": "person", "name": "n"}],
    "relationships": [{"from": "a", "target_id": "b"}],
    "review_issues": [{"severity": "LOW", "reason": "r"}],
}


@pytest.fixture(scope="module")
def pages(spark):
    rows = [("a.pdf", 1, json.dumps(ANSWER), 5, 6, 1, None), ("a.pdf", 2, None, 0, 0, 1, "boom"), ("b.pdf", 1, "not json", 1, 1, 1, None)]
    d = spark.createDataFrame(rows, "source_path string, page int, response string, input_tokens long, output_tokens long, elapsed_ms long, error string")
    d = d.withColumn("estimated_image_tokens", F.lit(0).cast("long"))
    hints = attention_hints(["attention_target", {"name": "missing", "required": True}, {"label": "missing"}])
    return normalize_pages(d, hints).cache()


def test_normalised_page(pages):
    p = pages.where("source_path = 'a.pdf' and page = 1").first()
    assert [f.field_id for f in p.fields] == ["field_p1_1", "field_p1_3"]  # places before filtering
    assert p.fields[1].confidence == "low" and p.fields[1].needs_review
    assert p.raw_markdown == "a b" and [t.text for t in p.text_items] == ["x"]
    assert p.tables[0].rows == [["h", "i"], ["1", "2"], ["alone"]]
    assert p.relationships[0].to == "b" and p.relationships[0].type == "related_to"
    assert p.issues[0].severity == "low" and p.review_required
    assert {a.name: a.needs_review for a in p.attention} == {"attention_target": False, "missing": True}


def test_failures_are_rows(pages):
    bad = pages.where("not parsed").collect()
    assert len(bad) == 2 and all(r.review_required and r.issues[0].severity == "high" for r in bad)
    assert all(a.status == "not_evaluated" for r in bad for a in r.attention)


def test_merge(pages):
    d = {r.source_path: r for r in merge.documents(pages).collect()}
    assert d["a.pdf"].page_count == 2 and not d["a.pdf"].success and d["a.pdf"].failed_pages == [2]
    names = {r.name for r in merge.final_fields(pages).collect()}
    assert names == {"attention_target", "other_visible_field"}
    assert merge.cost_rollup(pages, ["source_path"]).where("source_path = 'a.pdf'").first().estimated_image_tokens is None


def test_exports_and_resume(spark, pages, tmp_path):
    made = {r.kind: r.path for r in export(pages, str(tmp_path / "out")).collect()}
    assert {"result", "records", "report", "workbook", "semantic_pages"} <= set(made)
    assert spark.read.text(made["semantic_pages"]).count() == pages.count()
    book = read_workbook(made["workbook"])
    assert len(book) == 9
    fields = {r["field_name"] for r in book["Detected Fields"]}
    assert {"attention_target", "other_visible_field"} <= fields
    import zipfile

    assert not any(b"<f>" in zipfile.ZipFile(made["workbook"]).read(n) for n in zipfile.ZipFile(made["workbook"]).namelist())
    folder = str(tmp_path / "ck")
    assert checkpoint_pages(pages, folder).count() == 3
    assert not_checkpointed(pages, folder).count() == 0 and checkpoint_pages(pages, folder).count() == 3


def test_engine(spark):
    s = spark.createDataFrame([("x.pdf", 3), ("y.pdf", 1)], "source_path string, total_pages int")
    found = Engine(spark, StubModel()).extract(s, ["total_pages"], pages="1-2")
    assert found["documents"].count() == 2
    assert found["pages"].where("not parsed").count() == 0
    assert {r.source_path: r.page_count for r in found["documents"].collect()} == {"x.pdf": 2, "y.pdf": 1}
    assert Engine(spark).inspect(s.withColumn("width", F.lit(100)).withColumn("height", F.lit(100))).count() == 2


def test_packing(spark):
    d = spark.createDataFrame([("a", i, t) for i, t in enumerate([50, 60, 200, 10, 10])], "k string, i int, t int")
    got = {r.i: r.pack for r in merge.pack_by_budget(d, "k", ["i"], "t", 100).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3}


def test_matching_keeps_the_empty_label(spark):
    c = spark.createDataFrame([("d", "", "", "v", 0), ("d", "total", "Total", "7", 1)], "doc string, name string, label string, value string, idx int")
    specs = spark.createDataFrame([(0, "sum", "sum|total", True), (1, "other", "other", True)], "ord int, name string, label_pattern string, required boolean")
    got = {(r.spec, r.value) for r in matching.match_specs(c, specs, ["doc"]).collect()}
    assert got == {("sum", "v"), ("other", "v"), ("sum", "7")}


def test_contains_join_equals_the_plain_one(spark):
    t = spark.createDataFrame([(0, "abc def ghi"), (1, "x"), (2, ""), (3, None)], "d int, text string")
    v = spark.createDataFrame([(0, "C d"), (1, "ghi"), (2, "x"), (3, ""), (4, None), (5, "abcdefghi")], "i int, item string")
    for few in (0, 1000):
        got = {(r.d, r.i) for r in matching.contains_joins(t, v, "text", "item", few=few).collect()}
        assert got == {(0, 0), (0, 1), (0, 5), (1, 2)}


def test_rules_and_guards(spark):
    d = spark.createDataFrame([("k", "t", "10"), ("k", "a", "4x"), ("k", "b", "5")], "k string, name string, value string")
    rules = spark.createDataFrame([("t", "t = a + b"), ("a", "a != b")], "name string, context_rule string")
    assert [r.note for r in validate.cross_field(d, rules, ["k"]).collect()] == ["sum_differs"]
    both = spark.createDataFrame([("t", "t = a + b, b != c")], "name string, context_rule string")
    assert sorted(r.note for r in validate.cross_field(d.union(spark.createDataFrame([("k", "c", " 5 ")], d.schema)), both, ["k"]).collect()) == ["sum_differs", "values_equal"]
    pairs = spark.createDataFrame([(1, "a", "a", "high"), (1, None, "b", "high"), (2, "A", "a", "high"), (3, "a", None, None), (4, "a", "a", "low")], "k int, layout_value string, field_value string, confidence string")
    assert {r.k: r.skip for r in validate.skip_validation(pairs, ["k"]).collect()} == {1: True, 2: False, 3: False, 4: False}
    phones = spark.createDataFrame([("4123 4567", "HK"), ("(852-1234 5678", "hk"), ("(+45) 1234 5678", "852"), ("(+45) 1234 5678", None)], "p string, h string")
    got = [tuple(r[0]) for r in phones.select(validate.phone_check(F.col("p"), F.col("h"))).collect()]
    assert got[:2] == [(True, "", []), (False, "(85212345678", [])] and got[2][:2] == (True, "") and got[3][:2] == (True, "") and len(got[2][2]) == 1
    o = spark.createDataFrame([(1, "abcde"), (2, "ab"), (3, "same")], "i int, value string")
    c = spark.createDataFrame([(1, "xbcde"), (2, "xb"), (3, "same"), (4, "new")], "i int, value string")
    assert {r.i: (r.value, r.corrected) for r in matching.correct_values(o, c, ["i"]).collect()} == {1: ("abcde", False), 2: ("xb", True), 3: ("same", False), 4: ("new", True)}


def test_votes(spark):
    v = spark.createDataFrame([("f", 0, "a", 0.5), ("f", 1, "b?", 0.5), ("f", 2, "a", 0.1), ("g", 0, "2", 0.5), ("g", 1, "1", 0.5)], "field string, vote_idx int, raw string, temperature double")
    got = {r.field: r for r in consensus.weighted_vote(v, ["field"]).collect()}
    assert got["f"].value == "a" and got["f"].frequency == 2 and got["g"].value == "1"
    e = spark.createDataFrame([(["a", "a"],), (["a"],), (["ab", "cd"],)], "v array<string>").select(consensus.entropy(F.col("v"))).collect()
    assert [r[0] for r in e] == [0.0, 0.0, 1.0]
    p = spark.createDataFrame([("f", 0, "ab"), ("f", 1, "abc"), ("g", 0, ""), ("h", 0, "x"), ("h", 1, "x")], "field string, pass_idx int, value string")
    d = {r.field: r for r in consensus.dual_pass(p, ["field"]).collect()}
    assert d["f"].value == "abc" and d["g"].value == "" and d["h"].confidence == "high"


def test_first_version_pages(spark):
    d = spark.createDataFrame([("Name: Ann\nA   spaced value\n7: x\na & b \\\\\n\\hline c \\& d & e \\\\",)], "t string")
    got = d.select(semantic.labelled_text(F.col("t")).alias("l"), semantic.latex_rows(F.col("t")).alias("r")).first()
    assert [(x.label, x.value, x.rule) for x in got.l] == [("Name", "Ann", "colon_labeled_text")]
    assert got.r == [["a", "b"], ["c", "d", "e"]]


def test_image_measures(spark):
    import numpy as np

    dark = np.full((64, 64), 20, np.uint8).tobytes()
    d = spark.createDataFrame([(bytearray(dark), 64), (None, 64)], "g binary, w int")
    got = d.select(imaging.is_inverted(imaging.darkness("g", "w")), imaging.quality_level(imaging.quality_measures("g", "w"))).collect()
    assert [tuple(r) for r in got] == [(True, "low"), (False, "low")]


def test_controller_and_retries():
    c = jobs.Controller(0, start=20)
    assert c.report(1, 429, 0) == 10 and c.report(2, 500, 0) == 7 and c.report(3, 404, 0) == 7
    assert (c.errors, c.successes, c.changed, c.ema) == (3, 0, 3, 0)
    for _ in range(8):
        c.report(7.9, 200, 100)  # 5 s haven't passed since the last error
    assert c.concurrency == 7 and c.report(8, 200, 100) == 4 and (c.errors, c.successes, c.changed) == (0, 0, 8)  # 3 of 12 failed
    for k in range(10):
        c.report(13 + k / 10, 200, 100)
    assert c.concurrency == 5 and c.changed == 13.9
    small = jobs.Controller(0, start=3)
    for k in range(10):
        small.report(5, 200, 100)
    assert small.concurrency == 3 and small.successes == 0  # 30 % of it is less than one, and the counters begin anew all the same
    slow = jobs.Controller(0)
    for k in range(10):
        slow.report(6, 200, 5000)
    assert slow.concurrency == 20 and slow.successes == 0

    class Busy(Exception):
        status = 503

    tries = []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise Busy
        return "ok"

    assert with_retries(call, sleep=lambda s: None) == ("ok", 3)


def test_stream_equals_batch(spark, tmp_path):
    e = spark.createDataFrame([(i, i // 3 * 3600, "ab"[i % 2], float(i)) for i in range(40)], "id int, at int, k string, value double").withColumn("ts", F.timestamp_seconds("at"))
    e.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    got = jobs.run_once(jobs.tumbling(stream, "2 hours", ["k"], "1 hour"), "w", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, jobs.tumbling(e, "2 hours", ["k"]).collect()))


def test_job_table(spark, tmp_path):
    t = jobs.JobTable(spark, str(tmp_path / "jobs"))
    t.submit(spark.createDataFrame([("a", i) for i in range(7)], "source_path string, page int"), 3)
    assert sorted(r.total for r in t.list().collect()) == [1, 3, 3]
    t.cancel(t.list().first().batch_id)
    # a job that is being cancelled is none of queued, validating and in_progress
    assert t.status_all().first().in_progress == 2 and t.status_all().first().jobs == 3


def test_records_of_the_model_or_of_fields(spark):
    import json

    from leafmill.operators.normalize import normalize_pages

    given = {"field_candidates": [{"label": "A", "value": "1"}], "integrated_records": [{"record_id": "r", "record_type": "row", "fields": {"x": "1", "y": "2"}}, {"fields": {"z": "3"}}, {"confidence": "high"}]}
    own = {"field_candidates": [{"label": "A", "value": "1"}, {"label": "B", "value": "2"}, {"label": "A", "value": "3"}], "document_classification": {"type": "bill", "confidence": "high"}}
    answers = [("a", 1, json.dumps(given)), ("a", 2, json.dumps(own)), ("a", 3, "nothing")]
    d = spark.createDataFrame(answers, "source_path string, page int, response string")
    got = {(r.page, r.record_id, r.record_type, r.confidence, r.name, r.value) for r in merge.integrated_records(normalize_pages(d)).collect()}
    assert got == {(1, "r", "row", "low", "x", "1"), (1, "r", "row", "low", "y", "2"), (1, "page_1_2", "document", "low", "z", "3"), (2, "page_2", "bill", "high", "B", "2"), (2, "page_2", "bill", "high", "A", "3")}


def test_containment_of_large_lists(spark):
    import random

    from leafmill.operators import containment

    rnd = random.Random(3)
    long_ = ["".join(rnd.choices("abé日🙂", k=rnd.choice([1, 2, 3, 5, 8, 30, 200]))) for _ in range(150)] + ["", None, "hot"] + [f"hot {i}" for i in range(120)] * 2
    short = [t[i : i + rnd.choice([1, 2, 3, 6, 7, 14, 15, 16, 31, 40])] for t in long_ if t for i in (0, len(t) // 3)] + ["", None, "zzz", "hot", "a" * 300]
    a, b = spark.createDataFrame([(x,) for x in long_], "text string"), spark.createDataFrame([(x,) for x in short], "text string")
    xs, ys = {x for x in long_ if x is not None}, {y for y in short if y is not None}
    assert {tuple(r) for r in containment.contained(a, b, parts=2).collect()} == {(x, y) for x in xs for y in ys if y and y in x}
    found = [tuple(r) for r in containment.either_way(a, b).collect()]
    assert len(found) == len(set(found)) and set(found) == {(x, y) for x in xs for y in ys if y in x or x in y}
    assert "Cartesian" not in containment.contained(a, b)._jdf.queryExecution().toString() and "NestedLoop" not in containment.contained(a, b)._jdf.queryExecution().toString()
    assert containment.either_way(a.limit(0), b).count() == 0 and containment.contained(a, b.limit(0)).count() == 0


def test_long_lists_of_patterns(spark, monkeypatch):
    c = spark.createDataFrame([(1, "Total due", "", "9"), (2, "x", "Tot", "8"), (2, "", "", "")], "doc int, name string, label string, value string")
    specs = spark.createDataFrame([(0, "a", "due|none"), (1, "total", None), (2, "long", "the total due of all")], "ord int, name string, label_pattern string")
    hints = spark.createDataFrame([("h", ["due 9", "zz"], True)], "name string, aliases array<string>, required boolean")
    want = [{tuple(r) for r in f.collect()} for f in (matching.match_specs(c, specs, ["doc"]), matching.attention_candidates(c, hints, ["doc"]))]
    monkeypatch.setattr(matching, "SHORT_LIST", 0)
    assert [{tuple(r) for r in f.collect()} for f in (matching.match_specs(c, specs, ["doc"]), matching.attention_candidates(c, hints, ["doc"]))] == want


@pytest.mark.parametrize("sizes", [(0, 1), (0, 3, 7, 40), (5,), (1, 200)])
def test_effects_of_packing(sizes):
    """What a run does to every load is what running it does."""
    import json
    import random

    from leafmill.operators.recurrences import Packing

    rnd, m = random.Random(len(sizes)), Packing(30)
    for n in (1, 2, 5, 60):
        values = [rnd.choice([*sizes, None]) for _ in range(n)]
        effect = json.loads(json.dumps(m.effect(values)))
        for state in [None, *([3, load] for load in range(60))]:
            assert list(m.after(state, effect)) == list(m.run(state, values)[1]), (values, state)


def test_recurrences_of_one_key_that_holds_nearly_all(spark):
    import random

    from leafmill.operators import recurrences

    rnd = random.Random(8)
    rows = [("hot", i // 2, rnd.choice([None, 0, 5, 90, 300])) for i in range(4000)] + [(k, i, i * 7 % 50) for k in ("a", "b", None) for i in range(3)]
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    d = spark.createDataFrame(shuffled, "k string, i int, t long").repartition(5)
    want_packs, want_average = Counter(), Counter()
    packing, average = recurrences.Packing(200), recurrences.MovingAverage(0.3)
    for k in ("hot", "a", "b", None):
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], -1 if r[2] is None else r[2]))
        want_packs.update((k, i, t, p) for (_, i, t), p in zip(mine, packing.run(None, [r[2] for r in mine])[0], strict=True))
        want_average.update((k, i, t, None if a is None else round(a, 6)) for (_, i, t), a in zip(mine, average.run(None, [r[2] for r in mine])[0], strict=True))
    got = merge.pack_by_budget(d, "k", ["i"], "t", 200)
    assert Counter(tuple(r) for r in got.collect()) == want_packs
    assert Counter((r.k, r.i, r.t, None if r.average is None else round(r.average, 6)) for r in recurrences.moving_average(d, ["k"], ["i"], "t", 0.3).collect()) == want_average
    assert merge.pack_by_budget(d.limit(0), "k", ["i"], "t", 200).count() == 0
    # no partition holds the hot key
    assert max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()) < 2000


def test_adaptive_stream_restarts_and_forgets(spark, tmp_path):
    """Two runs of a stream over halves of the calls give what the batch gives; a key that is silent for long is dropped."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    calls = [("a", i * 2, 200 if i % 7 else 429, 100.0 + i) for i in range(40)] + [("b", i * 3, 200, 4000.0) for i in range(20)]
    d = spark.createDataFrame(calls, "k string, at long, status int, latency_ms double").withColumn("ts", F.timestamp_seconds("at"))
    late = spark.createDataFrame([("c", 10_000_000, 200, 1.0)], "k string, at long, status int, latency_ms double").withColumn("ts", F.timestamp_seconds("at"))
    folder, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    for part in (d.where("at < 30"), d.where("at >= 30"), late, late.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY"))):
        part.coalesce(1).write.mode("append").parquet(folder)
        stream = jobs.adaptive_stream(spark.readStream.schema(d.schema).parquet(folder), "k")
        stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out).collect()
    batch = jobs.adaptive_concurrency(d.withColumn("at", F.col("at").cast("double")), ["k"], ["at"]).collect()
    for k in "ab":
        want = max((r for r in batch if r.k == k), key=lambda r: r["at"])
        last = max((r for r in rows if r.k == k and not r.ended), key=lambda r: r["at"])
        assert (last.concurrency, last.ema) == (want.concurrency, want.ema)
        assert [r for r in rows if r.k == k and r.ended]
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_rows_of_very_many_cells(spark):
    d = spark.range(1).select(F.array(F.concat(F.array(F.lit("Total due")), F.transform(F.sequence(F.lit(1), F.lit(10_005)), lambda i: i.cast("string")))).alias("rows"))
    (found,) = d.select(semantic.table_candidates(F.col("rows"))).first()[0]
    assert len(found.value.split(" | ")) == 10_005
