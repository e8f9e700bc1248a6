"""What a task holds, how often pages are made and what is written don't grow faster than the input."""

import glob
import os
import random

from pyspark.sql import functions as F

from leafmill.functions.json_text import mend_text
from leafmill.operators import merge
from leafmill.operators.normalize import explode_list, normalize_pages
from leafmill.operators.semantic import row_records
from leafmill.shared import spread
from leafmill.sinks import exports


def answers(spark, *bodies):
    return spark.createDataFrame([("a", i + 1, b) for i, b in enumerate(bodies)], "source_path string, page int, response string")


def test_rows_of_a_task_are_bounded(spark):
    rows = spread(spark.range(0, 1000, 1, 4), rows_a_task=10)
    assert rows.rdd.getNumPartitions() == 100 and rows.count() == 1000
    keyed = spread(spark.range(1000).withColumn("k", F.col("id") % 7), "k", rows_a_task=100)
    assert keyed.rdd.getNumPartitions() == 10 and keyed.groupBy("k").count().count() == 7


def test_a_report_makes_pages_once(spark, tmp_path):
    body = '{"field_candidates": [{"label": "B", "value": "2"}, {"label": "A", "value": "1"}], "entities": [{"value": "e"}]}'
    answers(spark, body, "nothing").write.parquet(f"{tmp_path}/in")
    report = exports.report(normalize_pages(spark.read.parquet(f"{tmp_path}/in"), repair=False))
    assert report._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    text = report.first().markdown
    assert text.index("page_1 A = 1") < text.index("page_1 B = 2") and "pages: 2" in text and "- high page_failed" in text


def test_tidy_and_untidy_lists_give_the_same_cells(spark):
    values = ["plain", "in between", " led", "ended ", "two  spaces", "a\\tb", "wide space", "x　y", "it's 'so' said"]
    body = '{"field_candidates": [%s], "entities": [{"value": "e"}]}'
    one = answers(spark, *[body % ('{"label":"L","value":"%s"}' % v) for v in values])
    got = {r.page: r.value_original for r in explode_list(normalize_pages(one, repair=False), "fields").collect()}
    assert [got[i + 1] for i in range(len(values))] == ["plain", "in between", "led", "ended", "two spaces", "a b", "wide space", "x y", "it's 'so' said"]


def test_streams_are_written_compressed(spark, tmp_path):
    pages = normalize_pages(answers(spark, '{"entities": [{"value": "e"}]}').withColumn("reasoning", F.lit(None).cast("string")), repair=False)
    exports.checkpoint_pages(pages, str(tmp_path))
    assert glob.glob(f"{tmp_path}/entities.ndjson/run=*/*.json.gz")
    assert exports.committed(spark, str(tmp_path), "entities").first().value == "e"


def test_quoted_texts_are_taken_in_runs():
    assert mend_text("{a: 'one \"two\" \\u0041 \\n three', b: “x's y”, c: [1, 2,") == '{"a": "one \\"two\\" A \\n three", "b": "x\'s y", "c": [1, 2]}'


def test_containment_of_many_marks(spark, monkeypatch):
    from leafmill.operators import containment

    left = spark.createDataFrame([(f"some line {i} of text number {i * i}",) for i in range(60)], "text string")
    right = spark.createDataFrame([(f"line {i} of",) for i in range(0, 90, 3)] + [("7",)], "text string")
    ls, rs = [r.text for r in left.collect()], [r.text for r in right.collect()]
    want = {(a, b) for a in ls for b in rs if b in a or a in b}
    for few in (1_000_000, 0):
        monkeypatch.setattr(containment, "FEW", few)
        assert {tuple(r) for r in containment.either_way(left, right).collect()} == want


def made(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_flags_and_issues_need_no_fields(spark):
    """A field's members that only it has aren't made for what pages are reviewed by; what is made says the same."""
    body = '{"field_candidates": [{"label": "A", "value": "1", "confidence": "HIGH"}, {"label": "B", "confidence": "low"}, {"x": 1}], "entities": [{"value": " "}]}'
    pages = normalize_pages(answers(spark, body, '{"field_candidates": [{"name": "n", "value": "v", "confidence": "high"}], "entities": [{"name": "e"}]}', "nothing"), repair=False)
    assert " AS fields#" in made(pages)
    for names in (["needs_review", "review_required", "parsed"], ["issues"], ["classification"]):
        assert " AS fields#" not in made(pages.select(*names))
    rows = {r.page: r for r in pages.collect()}
    assert [(i.type, i.message) for i in rows[1].issues] == [("field_missing_evidence", "B"), ("no_entities_returned", "the page has no entity")]
    assert [r.needs_review for _, r in sorted(rows.items())] == [True, False, True] and [len(r.fields) for _, r in sorted(rows.items())] == [2, 1, 0]
    assert [i.type for i in rows[3].issues] == ["page_failed"] and not rows[2].issues


def test_names_of_a_table_are_made_once_a_table(spark):
    rows = F.array(F.array(F.lit("A b"), F.lit("")), F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.array(F.lit(" p  q "), F.lit(None).cast("string")))
    got = spark.range(1).select(row_records(rows).alias("r"))
    assert [tuple(r) for r in got.first().r] == [(1, "ab", "x"), (1, "col_2", "y"), (1, "col_3", "z"), (2, "ab", "p q"), (2, "col_2", "")]
    of_row = made(spark.range(1).select(row_records(F.array(F.array(F.col("id").cast("string"))))))
    assert "transform(array(transform(" in of_row


def test_detected_documents_need_no_fields(spark, tmp_path):
    field = '"field_candidates": [{"label": "A", "value": "1"}]'
    bodies = ['{"document_classification": {"type": "order", "confidence": "HIGH", "reason": " so  it is "}, %s}' % field, '{"document_classification": {"type": "", "confidence": "low"}, %s}' % field]
    bodies += ['{"document_classification": {"type": "order", "confidence": "high"}}', "nothing", '{"document_classification": {"type": "order", "confidence": "medium", "needs_review": true}, %s}' % field]
    answers(spark, *bodies).write.parquet(f"{tmp_path}/in")
    found = merge.detected_documents(normalize_pages(spark.read.parquet(f"{tmp_path}/in"), repair=False))
    short = found.select("document_id", "source_path", "page", "document_type", "confidence")
    plan = short._jdf.queryExecution().optimizedPlan().toString()
    assert "document_classification" in plan and "field_candidates" not in plan
    want = [("doc_00001", "order", "high", "so it is", False), ("doc_00002", "document", "low", "", True), ("doc_00003", "order", "high", "", True), ("doc_00004", "document", "low", "", True), ("doc_00005", "order", "medium", "", True)]
    got = sorted(found.collect(), key=lambda r: r.page)
    assert [(r.document_id, r.document_type, r.confidence, r.reason, r.needs_review) for r in got] == want
    assert sorted(tuple(r) for r in short.collect()) == [(w[0], "a", i + 1, w[1], w[2]) for i, w in enumerate(want)]


def test_rows_of_a_table_are_parsed_at_once(spark, tmp_path):
    tables = ['[{"rows":[["Part","a b"],["1",null,{"k": [1.50]}]]}]', '[{"rows": [["a  b", " c "], [], [2, true]]}]', '[{"rows":[["a",1.50],"b  c",null,{"v":2},"[3,4]"]}]', '[{"rows": "[[1,2]]"},{"value": "[5"}, " x "]', '[["a","b"],["c"]]', "null"]
    answers(spark, *['{"raw_content": {"tables": %s}}' % t for t in tables]).write.parquet(f"{tmp_path}/in")
    pages = normalize_pages(spark.read.parquet(f"{tmp_path}/in"), repair=False).select("page", "tables")
    plan = made(pages)
    assert "ArrayType(ArrayType(StringType" in plan and "__tidy_tables" in plan
    got = {r.page: [t.rows for t in r.tables] for r in pages.collect()}
    assert got[1] == [[["Part", "a b"], ["1", "", '{"k":[1.5]}']]] and got[2] == [[["a b", "c"], [], ["2", "true"]]]
    assert got[3] == [[["a", "1.5"], ["b c"], [""], ['{"v":2}'], ["3", "4"]]]
    assert got[4] == [[["1", "2"]], [["[5"]], [["x"]]] and got[5] == [[["a"], ["b"]], [["c"]]] and got[6] == []


def test_candidates_are_made_of_exploded_fields(spark):
    """A list of candidates is neither made where its size is asked for nor within the expression that makes the fields."""
    from leafmill.queries import QUERIES

    found = QUERIES["lossless_candidates"](spark, "/root/testdata/sf0.001")
    plan = made(found)
    assert "Generate explode(fields#" in plan and "(size(" not in plan
    assert found.count() == 5 * spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()


def test_candidates_of_no_fields(spark):
    from leafmill.operators import first_version as v1

    body = '{"field_candidates": [{"label": " a  b ", "value": "1", "confidence": "HIGH"}, {"name": "n", "value": "v", "confidence": "odd"}]}'
    got = v1.lossless_candidates(normalize_pages(answers(spark, body, '{"field_candidates": []}', "nothing"), repair=False), "fields").collect()
    assert sorted((r.source_path, r.page, r.c.name, r.c.label, r.c.value, r.c.confidence, r.c.needs_review) for r in got) == [("a", 1, "a b", "a b", "1", "high", False), ("a", 1, "n", "", "v", "low", True)]


def written(spark):
    from leafmill.shared import shared_dir

    return sum(os.path.getsize(f) for f in glob.glob(f"{shared_dir(spark).removeprefix('file://')}/**", recursive=True) if os.path.isfile(f))


def test_containment_writes_what_is_found(spark):
    """Texts whose grams all patterns share are written for the pairs that are found, not for their grams."""
    from leafmill.operators import containment

    rng = random.Random(1)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    ls, rs = [digits(120) for _ in range(3000)], [digits(6) for _ in range(200)]
    before = written(spark)
    pairs = containment.contained(spark.createDataFrame([(x,) for x in ls], "text string"), spark.createDataFrame([(x,) for x in rs], "text string"))
    assert {tuple(r) for r in pairs.collect()} == {(a, b) for a in ls for b in rs if b in a}
    assert written(spark) - before < 1_000_000


def test_containment_at_the_bounds_of_lengths(spark, monkeypatch):
    from leafmill.operators import containment

    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("ab1é😀") for _ in range(n))
    base = [text(n) for n in (1, 2, 3, 7, 8, 15, 16, 17, 30, 31, 32, 33, 47, 48, 64, 200) for _ in range(4)]
    piece = lambda b, n: b[(i := rng.randrange(len(b))) : i + n]
    ls = base + [piece(b, n) for b in base for n in (2, 31, 32)] + ["", None, "a" * 100]
    rs = [piece(b, n) for b in base for n in (1, 33, 64)] + [text(5) + b + text(5) for b in base[::3]] + ["a" * 50, "a" * 120, "", None]
    want = sorted({(a, b) for a in ls if a is not None for b in rs if b is not None if a in b or b in a})
    monkeypatch.setattr(containment, "BLOCK", 10)
    one, other = (spark.createDataFrame([(x,) for x in xs], "text string") for xs in (ls, rs))
    assert sorted(tuple(r) for r in containment.either_way(one, other).collect()) == want


def test_answers_are_told_apart_before_pages_are_made(spark, tmp_path):
    """Answers are shuffled, not pages; what path and page tell isn't written; pages without a path are appended once too."""
    seen = []

    def make(new):
        seen.append(made(new))
        return normalize_pages(new, repair=False)

    body = '{"entities": [{"value": "e"}]}'
    first = spark.createDataFrame([("a/b.pdf", 1, body), ("a/b.pdf", 1, body), (None, 1, body)], "source_path string, page int, response string")
    later = first.unionByName(spark.createDataFrame([("a/b.pdf", 2, body)], first.schema))
    append = exports.append_batches(str(tmp_path), "q", make)
    append(first, 0)
    paths = append(later, 1)
    append(later, 1)
    assert len(seen) == 2 and all("Aggregate [source_path" in p and "from_json" not in p for p in seen)
    pages = exports.committed(spark, str(tmp_path))
    assert sorted((r.source_path or "", r.page) for r in pages.collect()) == [("", 1), ("a/b.pdf", 1), ("a/b.pdf", 2)]
    assert not {"page_key", "file"} & set(pages.columns) and exports.committed(spark, str(tmp_path), "entities").count() == 3
    assert sorted(r.path.removeprefix(str(tmp_path)) for r in paths.where("source_path IS NOT NULL").collect()) == ["/pages/b-p0001.json", "/pages/b-p0002.json"]
