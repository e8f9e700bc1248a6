import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.functions import json_text, text
from leafmill.functions.tokens import image_tokens, media_chunks, strategy
from leafmill.plans import policy
from leafmill.sources.pages import page_range


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_positional_boxes_are_named(spark):
    d = spark.createDataFrame([('{"schema": "s", "bbox": { "x1": 10, 20, 30, 40 }}',)], "t string")
    m = json_text.members(json_text.object_text("t"))
    b = json_text.box(json_text.members(m["bbox"]))
    assert rows(d.select(m["schema"], b["x1"], b["y1"], b["x2"], b["y2"])) == [("s", 10, 20, 30, 40)]


@pytest.mark.parametrize(
    "said, want",
    [
        ('```json\n{"a": 1}\n```', "1"),
        ('Here: {"a": 1} done', "1"),
        ('{"a": 1,}', "1"),
        ("{'a': '1'", "1"),
        ("{a: 1, b: [2, 3", "1"),
        ("", None),
        ("no object here", None),
        ("42", None),
    ],
)
def test_tolerant_json(spark, said, want):
    d = spark.createDataFrame([(said,)], "t string")
    got = d.select(json_text.members(json_text.object_text("t"))["a"]).first()[0]
    assert got == want


@given(st.dictionaries(st.text("abc", min_size=1), st.one_of(st.none(), st.integers(), st.text("xy,'\"\\ {}[]\n"))))
def test_mending_keeps_sound_json(value):
    import json

    assert json.loads(json_text.mend_text(json.dumps(value))) == value


def test_anything_becomes_an_array(spark):
    d = spark.createDataFrame([(None,), ("[1, 2]",), ('{"a": "x", "b": "y"}',), ("z",)], "t string")
    assert [r[0] for r in d.select(json_text.as_array("t")).collect()] == [[], ["1", "2"], ["x", "y"], ["z"]]


def test_keys(spark):
    d = spark.createDataFrame([("Invoice No.",)], "t string")
    assert rows(d.select(text.comparable("t"), text.canonical("t"), text.evidence_key("t"))) == [("invoiceno", "invoiceno", "INVOICENO")]


def test_width_is_taken_for_an_identity(spark):
    d = spark.createDataFrame([("B0O", "width"), ("O1/l2", "date"), ("a;", None)], "v string, h string")
    assert [r[0] for r in d.select(text.correct_characters("v", "h")).collect()] == ["800", "01-12", "a"]


CASES = [("1-3,5", 10, [1, 2, 3, 5]), ("5,3,3", 10, [3, 5]), ("2-99", 6, [2, 3, 4, 5, 6]), ("1-3-5", 10, [1, 2, 3]), ("", 3, [1, 2, 3]), ("0", 5, None), ("-3", 5, None), ("99", 5, None), (",", 4, None), (" ", 4, None), (None, 2, [1, 2])]


def test_page_ranges(spark):
    d = spark.createDataFrame([(a, b) for a, b, _ in CASES], "t string, n int").select(page_range("t", F.col("n")).alias("r"))
    for r, (_, _, want) in zip(d.collect(), CASES, strict=True):
        assert (r.r.error is not None) == (want is None)
        assert r.r.pages == (want or [])


def test_tokens_of_images(spark):
    d = spark.createDataFrame([(100, 100), (15, 100), (10, 10), (20_000, 20_000), (32, 32)], "w int, h int")
    got = [r[0] for r in d.select(image_tokens(F.col("w"), F.col("h"))).collect()]
    assert got[1] is None and got[2] is None
    assert got[0] == 11 and got[3] <= 16384 + 2 and got[4] == 6


def test_strategies_and_chunks(spark):
    d = spark.createDataFrame([(50,), (51,), (200,), (201,)], "n int")
    assert [r[0] for r in d.select(strategy(F.col("n"))).collect()] == ["concurrent", "multi-image", "multi-image", "batch"]
    c = spark.createDataFrame([(0.0,), (61.0,)], "d double").select(media_chunks(F.col("d"), 30.0)).collect()
    assert c[0][0] == [] and [(x.start, x.end) for x in c[1][0]] == [(0.0, 30.0), (30.0, 60.0), (60.0, 61.0)]


def test_policies():
    assert policy.accuracy("fast", 99).quality == 85 and policy.accuracy("max", 10).votes == 3
    assert policy.accuracy(None, concurrency=99.9).concurrency == 50 and policy.accuracy("x").mode == "balanced"
    assert policy.reading_strategy("table", env={}) == "layered" and policy.reading_strategy("table", env={"EXTRACT_STRATEGY": "full_page"}) == "full_page"
    assert policy.preprocess_variants(["light", "forensic"])[0] == "light" and len(policy.preprocess_variants("forensic")) == 5


def test_prompt_has_no_domain_words():
    words = ("invoice", "bank", "patient", "passport", "receipt", "contract", "salary", "insurance")
    assert not any(w in policy.document_prompt().lower() for w in words)


BROKEN = [
    ('{"a":1 "b":2}', {"a": 1, "b": 2}),
    ('{"a" 1, "b": 2}', {"a": 1, "b": 2}),
    ('{"a": "say "hi" now", "b": 2}', {"a": 'say "hi" now', "b": 2}),
    ('{"a": "he said "hi", then", "b":1}', {"a": 'he said "hi", then', "b": 1}),
    ("{\u201ca\u201d: \u201cx\u201d, \u201cb\u201d: 1.}", {"a": "x", "b": 1.0}),
    ("[1,2,...]", [1, 2]),
    ('{"a": [1, 2, ...], "b": TRUE}', {"a": [1, 2], "b": True}),
    ('{"a":1, // one\n "b": /* two */ 2}', {"a": 1, "b": 2}),
    ('{"a":"x"\n"b":"y"}', {"a": "x", "b": "y"}),
    ('["x" "y"]', ["x", "y"]),
    ("{'a': 'x\\', y'}", {"a": "x', y"}),
    ('{"a":,"b":1}', {"a": None, "b": 1}),
    ('{"a":', {"a": None}),
    ("{a: yes b: 2}", {"a": "yes", "b": 2}),
    ("{a: hello world, b: 007}", {"a": "hello world", "b": "007"}),
    ('{"d": 2024-01-02, "n": -.5}', {"d": "2024-01-02", "n": -0.5}),
    ('{"a":"x","b":["c","d"}', {"a": "x", "b": ["c", "d"]}),
    ('{"u":"c:\\_x"', {"u": "c:\\_x"}),
    ('["x", hello]', ["x", "hello"]),
]


@pytest.mark.parametrize("said, want", BROKEN)
def test_what_is_missing_is_put_in(said, want):
    import json

    assert json.loads(json_text.mend_text(said)) == want


@given(st.text('{}[]",:\'\\ \n1.eE+-atrue/#*\u201c\u201d\u2026\ud800', max_size=40))
def test_mending_never_fails(said):
    import json

    found = json_text.mend_text("{" + said)
    assert isinstance(json.loads(found.encode().decode()), dict)
