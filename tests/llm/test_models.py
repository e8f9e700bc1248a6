"""Trained operators against plain versions of their predictions, and held-out accuracy."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from leafmill.llm import language, toxicity

SF = "/root/testdata/sf0.01"


def plain_language(rows, text):
    """Words by log frequency; an unknown one by its longest known n-grams; all counted anew here."""
    langs = sorted({l for l, _ in rows})
    counts = {n: {l: Counter() for l in langs} for n in range(language.LONGEST + 1)}
    for l, t in rows:
        for w in language.WORD.findall(t.lower()):
            counts[0][l][w] += 1
            for n in range(1, language.LONGEST + 1):
                s = f"<{w}>" if n > 1 else w
                for k in range(len(s) - n + 1):
                    counts[n][l][s[k : k + n]] += 1
    known = {n: set().union(*counts[n].values()) for n in counts}

    def log(n, g, l):
        return math.log((counts[n][l][g] + 0.5) / (counts[n][l].total() + 0.5 * (len(known[n]) + 1)))

    total = dict.fromkeys(langs, 0.0)
    words = language.WORD.findall(text.lower())
    for w in words:
        for l in langs:
            if w in known[0]:
                total[l] += log(0, w, l)
                continue
            for n in range(language.LONGEST, 0, -1):
                s = f"<{w}>" if n > 1 else w
                there = [g for k in range(len(s) - n + 1) if (g := s[k : k + n]) in known[n]]
                if there:
                    total[l] += sum(log(n, g, l) for g in there) / len(there)
                    break
    return (max(langs, key=lambda l: total[l]), total) if words else ("und", total)


def test_language_as_by_hand(spark):
    rnd = random.Random(6)
    letters = {"aa": "abcdef", "bb": "defghi", "cc": "ghijkéß"}
    word = lambda l: "".join(rnd.choices(letters[l], k=rnd.randrange(1, 7)))
    rows = [(l, " ".join(word(l) for _ in range(rnd.randrange(1, 12)))) for l in letters for _ in range(25)]
    d = spark.createDataFrame([(k, l, t) for k, (l, t) in enumerate(rows)], "doc_id long, lang string, text string")
    model = language.fit(d)
    unseen = [" ".join(word(l) for _ in range(4)) for l in letters for _ in range(10)] + ["", "123 --", "zzz", "A B", None]
    asked = spark.createDataFrame(list(enumerate(unseen)), "doc_id long, text string")
    got = {r.id: r for r in language.predict(asked, model).collect()}
    for k, t in enumerate(unseen):
        want, total = plain_language(rows, t or "")
        assert got[k].lang_pred == want
        if want != "und":
            assert got[k].score == __import__("pytest").approx(1 / sum(math.exp(x - total[want]) for x in total.values()), rel=1e-6)


def test_equal_sums_go_to_the_first_language(spark):
    d = spark.createDataFrame([(1, "x", "same words"), (2, "b", "same words")], "doc_id long, lang string, text string")
    r = language.predict(d, language.fit(d)).collect()
    assert {x.lang_pred for x in r} == {"b"} and all(abs(x.score - 0.5) < 1e-9 for x in r)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.op6_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert n > 200 and right / n >= 0.98


def test_toxicity_as_by_hand(spark):
    """A document's score from the model's weights: the noisy-or of its sentences, odds shifted."""
    rnd = random.Random(5)
    words = [f"word{k}" for k in range(40)]
    texts = [" ".join(rnd.choices(words, k=9)) + (f" {rnd.choice(['vileness', 'vileword', 'vilest'])}! " if k % 3 == 0 else ". ") + " ".join(rnd.choices(words, k=5)) for k in range(120)]
    model = toxicity.train(spark.createDataFrame([(t, int(k % 3 == 0)) for k, t in enumerate(texts)], "text string, label int"))

    def plain(text):
        left, sentences = 1.0, toxicity.SENTENCE.findall(text)
        for s in sentences:
            z = model.bias - model.slope * math.log(len(sentences))
            for w in set(toxicity.WORD.findall(s.lower())):
                marked = f"<{w}>"
                grams = {marked} | {marked[i : i + n] for n in toxicity.LENGTHS for i in range(len(marked) - n + 1)}
                z += sum(model.weights.get(g, 0.0) for g in grams)
            left *= 1 - 1 / (1 + math.exp(-z))
        p = 1 - left
        odds = p / (1 - p) / (model.middle / (1 - model.middle)) if p < 1 else math.inf
        return odds / (1 + odds) if p < 1 else 1.0

    d = spark.createDataFrame(list(enumerate([*texts, "", None, "a vilenesses unseen word"])), "doc_id long, text string")
    got = {r.id: r.score for r in toxicity.score(d, model).collect()}
    for k, t in enumerate([*texts, "", None, "a vilenesses unseen word"]):
        assert abs(got[k] - plain(t or "")) < 1e-9
    assert got[122] >= 0.5  # a word that was never seen, by its relatives


def test_toxicity_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.op7_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out and toxic is not null")
    hit, said, there = got.agg(F.expr("count_if(predicted = 1 and toxic = 1)"), F.expr("count_if(predicted = 1)"), F.expr("count_if(toxic = 1)")).first()
    assert there > 80 and hit / there >= 0.9 and hit / said >= 0.95


def test_toxicity_learns_from_texts_of_any_length(spark):
    """What only long texts say is learned, and long clean texts stay clean."""
    rnd = random.Random(9)
    plain = lambda n: " ".join(" ".join(rnd.choices([f"word{k}" for k in range(300)], k=8)) + "." for _ in range(n))
    rows = [(k, plain(900 if k % 2 else 3), 0) for k in range(60)] + [(100 + k, f"{plain(400)} you vilest thing. {plain(400)}", 1) for k in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(d.drop("toxic"), d.select("doc_id", "toxic"))
    asked = spark.createDataFrame([(1, plain(2000)), (2, f"{plain(2000)} the vilest words. {plain(10)}"), (3, "vilest"), (4, plain(1))], "doc_id long, text string")
    got = {r.id: r for r in toxicity.score(asked, model).collect()}
    assert [got[k].score >= 0.5 for k in (1, 2, 3, 4)] == [False, True, True, False]
    ((start, end, _),) = got[2].sentences
    assert "vilest" in asked.where("doc_id = 2").first().text[start:end]


def test_toxicity_keeps_odd_columns(spark):
    odd = spark.createDataFrame([(1, "a b", ("x", 2), 3)], "doc_id long, text string, s struct<`a b`:string,n:int>, `a``b` int")
    got = toxicity.score(odd, toxicity.Model({}, -3.0), keep="score")
    assert got.schema["s"].dataType == odd.schema["s"].dataType and [r["a`b"] for r in got.collect()] == [3]
