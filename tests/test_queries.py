"""Registered queries against brute force, over all rows of their tables."""

import math
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from leafmill.functions.tokens import pdf_kind
from leafmill.operators import consensus, validate
from leafmill.queries import QUERIES

SF = "/root/testdata/sf0.01"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def consensus_brute(values):
    """Entropy, mode and agreement of a field's votes, in their order."""
    known = {}

    def ratio(a, b):
        if (a, b) not in known:
            known[a, b] = distance(a, b) / max(len(a), len(b), 1)
        return known[a, b]

    pairs = [ratio(a, b) for i, a in enumerate(values) for b in values[i + 1 :]]
    value, n = Counter(values).most_common(1)[0]  # the first to appear of those that tie
    return sum(pairs) / len(pairs) if pairs else 0.0, value, n / len(values)


def test_consensus_entropy_counts_every_vote(spark):
    votes = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/part.parquet").orderBy("p_partkey").collect():
        votes[r.p_brand].append(r.p_name)
    got = {r.p_brand: r for r in QUERIES["consensus_entropy"](spark, SF).collect()}
    assert got.keys() == votes.keys() and max(map(len, votes.values())) > 12
    for brand, values in votes.items():
        entropy, value, agreement = consensus_brute(values)
        level = "high" if entropy < 0.15 and agreement > 0.66 else "medium" if entropy < 0.4 else "low"
        r = got[brand]
        assert (r.value, r.confidence, r.needs_review) == (value, level, entropy > 0.5 or agreement < 0.5)
        assert r.entropy == pytest.approx(entropy, abs=2e-9) and r.agreement == pytest.approx(agreement, abs=2e-9)


def test_votes_in_several_blocks(spark):
    fields = {"many": [f"v{i * i}" for i in range(150)] + ["v4"] * 3, "one": ["x"], "same": ["x", "x"], "two": ["ab", "cd"]}
    d = spark.createDataFrame([(f, i, v) for f, vs in fields.items() for i, v in enumerate(vs)], "field string, vote_idx int, value string")
    got = {r.field: r for r in consensus.analyze_consensus(d, ["field"]).collect()}
    for f, values in fields.items():
        entropy, value, agreement = consensus_brute(values)
        assert got[f].entropy == pytest.approx(entropy) and got[f].value == value and got[f].agreement == pytest.approx(agreement)


def evidence_key(text):
    return "".join(c for c in unicodedata.normalize("NFKC", text or "").upper() if unicodedata.category(c)[0] in "LN")


def test_evidence_cascade_takes_every_document(spark, tmp_path):
    texts = [("en", "Total: 5"), ("de", "straße 7\nin der Stadt"), (None, "élan vital"), ("fr", None), ("ja", "東京 と大阪"), ("de", "... nothing")]
    spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    for sf_dir in (str(tmp_path), SF):
        want = {}
        for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
            value = None if r.text is None else r.text.split(" ", 1)[0]
            want[r.doc_id] = (value, evidence_key(value) != "" and evidence_key(value) in evidence_key(r.text))
        rows = QUERIES["evidence_cascade"](spark, sf_dir).collect()
        assert len(rows) == len(want) and {r.doc_id: (r.value, r.found) for r in rows} == want


def test_more_patterns_than_a_short_list_are_checked(spark):
    n = 10_050
    rules = spark.createDataFrame([(f"f{i}", f"^p{i}$", None, None, None) for i in range(n)] + [("f0", "(", None, None, None)], "field string, pattern string, min_length int, max_length int, allowed_values array<string>")
    fields = spark.createDataFrame([(f"f{i}", "x") for i in range(n)] + [("f1", "p1")], "field string, value string")
    got = Counter((r.field, r.rule) for r in validate.validate_rules(fields, rules).collect())
    assert got == Counter((f"f{i}", "pattern") for i in range(n))


def test_media_estimates_takes_shares_of_zero(spark):
    part = {r.p_partkey: r.p_size for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    got = {r.p_partkey: r.pdf_kind for r in QUERIES["media_estimates"](spark, SF).collect()}
    assert got.keys() == part.keys() and {v for k, v in got.items() if k % 100 == 0} == {"text"}
    d = spark.createDataFrame([(0.0, 0.0), (0.0, 0.2), (0.5, 0.5), (0.5, 0.1)], "a double, b double")
    assert [r[0] for r in d.select(pdf_kind(F.col("a"), F.col("b"))).collect()] == ["text", "image", "image", "text"]


def test_adaptive_concurrency_call_by_call(spark):
    """Every call of every user, by the rules written out once more."""
    calls = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/events.parquet").orderBy("event_id").collect():
        status = 200 if r.event_type != "error" else (429, 500, 404)[r.event_id % 3]
        calls[r.user_id].append((r.event_id, r.ts.timestamp() if hasattr(r.ts, "timestamp") else r.ts, status, r.value * 10))
    want = {}
    for user, rows in calls.items():
        level, mean, good, bad, changed = 20, 0.0, 0, 0, rows[0][1]
        for event, at, status, latency in rows:
            if status != 200:
                bad += 1
                changed = at
                level = max(2, level // 2) if status == 429 else max(2, math.floor(level * 0.7)) if status >= 500 else level
            else:
                mean = mean * (1 - 0.3) + latency * 0.3 if mean else latency
                good += 1
                if at - changed >= 5 and good + bad >= 10:
                    rate = bad / (good + bad)
                    if rate < 0.05 and mean < 3000:
                        level = min(50, math.floor(level * 1.3))
                    elif rate > 0.15 or mean > 10_000:
                        level = max(2, math.floor(level * 0.7))
                    good, bad, changed = 0, 0, at
            want[user, event] = (level, math.floor(mean * 1000))
    got = {(r.user_id, r.event_id): (r.concurrency, r.ema_us) for r in QUERIES["adaptive_concurrency"](spark, SF).collect()}
    assert got == want


def test_image_quality_sample_by_sample(spark, tmp_path):
    import random

    rnd = random.Random(1)
    texts = ["".join(chr(rnd.randrange(32, 127)) for _ in range(64 * h + 5)) for h in (1, 5, 40)] + ["a" * 64 * 9, "short", "", None]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["image_quality"](spark, str(tmp_path)).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        if t is None or len(t) < 64:
            assert (r.pixels, r.quality, r.inverted) == (None, "low", False)
            continue
        rows = [[ord(c) for c in t[i : i + 64]] for i in range(0, len(t) // 64 * 64, 64)]
        flat = [x for row in rows for x in row]
        mean = sum(flat) / len(flat)
        steps = [abs(row[i] - row[i + 1]) for row in rows for i in range(63)] + [abs(a - b) for x, y in zip(rows, rows[1:], strict=False) for a, b in zip(x, y, strict=True)]
        assert r.pixels == len(flat) and r.contrast == pytest.approx((sum((x - mean) ** 2 for x in flat) / len(flat)) ** 0.5) and r.sharpness == pytest.approx(sum(steps) / len(steps))
        assert r.quality == "low"  # fewer than 300,000 samples
        dark, upper = sum(x < 128 for x in flat) / len(flat), sorted(flat)[len(flat) // 2]
        assert r.inverted == (dark > 0.6 and upper < 80)
