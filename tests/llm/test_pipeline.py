"""Pipeline stages on odd tables, and all of it against a plain version on a small fixture."""

import hashlib
import random
from collections import Counter

import pytest

WORDS = [f"w{i}" for i in range(300)]
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, position double, copies int, `pass` int, `row` string, key string, th long, body string, turn int"


def rows(texts, ids=None):
    return [(ids[k] if ids else k, t, "en", "ab"[k % 2], len(t or ""), 1.0, 5, 0.5, 9, 8, "r", "k", 7, "b", 3) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    import corpus_pipeline as cp

    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(1, 60)], "doc_id long, toxic int").write.parquet(str(folder / "labels.parquet"))
    return dict(cp.STAGES), str(folder)


def test_stages_take_any_columns_and_rows(spark, stages):
    named, folder = stages
    rnd = random.Random(2)
    texts = [" ".join(rnd.choices(WORDS, k=30)) + (" foul thing." if k % 3 == 0 else ".") for k in range(60)]
    texts += [None, "", " \n", texts[1], None]
    ids = [*range(60), 60, None, 62, 63, 60]
    d = spark.createDataFrame(rows(texts, ids) + rows(texts, ids)[:2], CLASHING)
    for name in ("toxicity", "exact_dedup", "near_dups", "mixing"):
        out = named[name](spark, d, folder)
        assert out.columns == d.columns and out.dtypes == d.dtypes
        got = out.collect()
        assert got and all((r["row"], r.key, r.th, r.turn, r.score) == ("r", "k", 7, 3, 1.0) for r in got)
        assert named[name](spark, d.limit(0), folder).count() == 0
    encoded = named["encoding"](spark, d, folder).collect()
    assert len(encoded) == 67 and {r.n_tokens for r in encoded if r.doc_id == 60} == {0}
    assert named["encoding"](spark, d.limit(0), folder).count() == 0


def test_one_of_each_text_stays(spark, stages):
    """By identifier and text: an identifier that stands on two texts keeps them apart."""
    named, _ = stages
    texts = ["one two three", "one two three", "another text", None, "", "one two three"]
    ids = [1, 2, 2, 3, 4, 2]
    got = named["exact_dedup"](spark, spark.createDataFrame(rows(texts, ids), CLASHING), "").collect()
    assert Counter((r.doc_id, r.text) for r in got) in (Counter({(2, "one two three"): 1, (2, "another text"): 1, (4, ""): 1}),)


def test_one_of_each_component_stays(spark, stages):
    named, _ = stages
    rnd = random.Random(3)
    base = [" ".join(rnd.choices(WORDS, k=60)) for _ in range(3)]
    texts = [base[0], base[0] + " more", base[1], base[1] + " x", base[2], None, "", base[2]]
    ids = [7, 3, 7, None, 9, 10, 11, 9]
    got = named["near_dups"](spark, spark.createDataFrame(rows(texts, ids), CLASHING), "").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(3, texts[1]), (7, base[1]), (9, base[2]), (10, None), (11, "")])


def test_copies_go_to_their_own_rows(spark, stages):
    """Rows of one identifier and size get the copies that were planned for them."""
    from leafmill.llm import mixing

    named, _ = stages
    texts = ["a b c", "d e f", "g h i", "a b c"] * 3 + [" ".join(WORDS)]
    d = spark.createDataFrame(rows(texts, [1] * 12 + [2]), CLASHING)
    plan = Counter()
    for r in mixing.planned(d).collect():
        plan[r.id, r.th, r.source] += r.copies
    got = named["mixing"](spark, d, "").selectExpr("doc_id", "xxhash64(cast(text as binary)) as h", "source").collect()
    assert Counter((r.doc_id, r.h, r.source) for r in got) == +plan


def test_pipeline_against_a_plain_version(spark, tmp_path):
    """Toxic rows as the model says; the other stages by comparing all pairs, and the library's ids."""
    import public_tokenizers as P
    import tiktoken

    import corpus_pipeline as cp
    from leafmill.llm import bpe, mixing

    rnd = random.Random(11)
    base = [" ".join(rnd.choices(WORDS, k=rnd.randrange(20, 80))) for _ in range(50)]
    texts = base + base[:7] + [b + " added" for b in base[5:15]] + [b + ". A foul thing." for b in base] + [None, ""]
    fields = "doc_id long, text string, lang string, source string, n_chars long"
    d = spark.createDataFrame([(k, t, "en", "abc"[k % 3], len(t or "")) for k, t in enumerate(texts)], fields)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(k, int("foul" in (t or ""))) for k, t in enumerate(texts)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    left = [(k, t) for k, t in enumerate(texts) if "foul" not in (t or "")]
    left = list({(t or ""): (k, t) for k, t in left}.values())  # the largest identifier of each text
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for k, t in left}
    stays = [(k, t) for k, t in left if not any(j < k and sets[j] & sets[k] and 10 * len(sets[j] & sets[k]) >= 8 * len(sets[j] | sets[k]) for j in sets)]
    kept = spark.createDataFrame([(k, t, "abc"[k % 3]) for k, t in stays], "doc_id long, text string, source string")
    copies = {r.id: r.copies for r in mixing.mix(kept).collect()}

    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for k, t in stays:
        ids = library.encode_ordinary(t or "")
        want[k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()] += copies[k]
    got = cp.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in got) == +want
