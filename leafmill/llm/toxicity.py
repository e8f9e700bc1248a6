"""Toxicity by multiple-instance learning.

Labels belong to documents, the offence to some of their sentences. A sentence's probability is a
logistic score of its words; a document's is their noisy-or, ``1 - prod(1 - p)``. The weights are
trained from document labels through that combination, and afterwards locate the sentences.

A long text has hundreds of sentences in which nothing offends, and what little the model gives each
mustn't add up: a sentence's score has a background, ``bias - slope * log(number of sentences)``, whose
two weights are learned with all others and hold in training and scoring alike.

A word's score is the sum of its features' weights: itself and its character n-grams, with its two ends
marked, so that words that were never seen share what their relatives have learned.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from leafmill.llm.common import cut, documents, free_name, small_batches, utf8

SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
WORD = re.compile(r"\w+")
#: Lengths of the n-grams, and words that a worker remembers the scores of in each of two generations.
LENGTHS, REMEMBERED = (4, 5, 6), 200_000


def features(word: str) -> set[str]:
    s = f"<{word}>"
    return {s, *(s[i : i + n] for n in LENGTHS for i in range(len(s) - n + 1))}


def words_of(sentence: str) -> set[str]:
    return set(WORD.findall(sentence.lower()))


class Scores(dict):
    """Scores of words, made when they are first asked for; the last ``REMEMBERED`` to twice as many are kept."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.old = weights, {}

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        found = self.old.get(word)
        if found is None:
            get = self.weights.get
            # a sum that doesn't depend on the order, so that equal texts score alike everywhere
            found = math.fsum(w for x in features(word) if (w := get(x)))
        self[word] = found
        return found


@dataclass
class Model:
    """Weights by feature, the background's two weights, and the probability that counts as 0.5."""

    weights: dict[str, float]
    bias: float
    slope: float = 0.0
    middle: float = 0.5

    def __post_init__(self):
        self.word = Scores(self.weights).__getitem__

    def shifted(self, p: float) -> float:
        """The odds divided by those of ``middle``."""
        up = p * (1 - self.middle)
        return up / (up + self.middle * (1 - p)) if p < 1 else 1.0

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability, and start, end and probability of sentences at 0.5 or more."""
        word, spans = self.word, list(SENTENCE.finditer(text))
        total, found, base = 0.0, [], self.bias - self.slope * math.log(max(1, len(spans)))
        for m in spans:
            z = base + math.fsum(map(word, words_of(m[0])))
            p = 1 / (1 + math.exp(-z)) if z > -700 else 0.0
            total += z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))
            if p >= self.middle:
                found.append((m.start(), m.end(), self.shifted(p)))
        return self.shifted(-math.expm1(-total)), found


@dataclass
class Sample:
    """Documents as numbers of sentences, the words of those sentences that have any that tell, and the words' features.

    ``doc_of`` is by sentence, ``sent_of`` and ``word_of`` by word in a sentence, ``word_at`` and ``feature_of`` by feature of a word.
    """

    labels: np.ndarray
    sizes: np.ndarray
    doc_of: np.ndarray
    sent_of: np.ndarray
    word_of: np.ndarray
    word_at: np.ndarray
    feature_of: np.ndarray
    words: int
    features: int

    def __post_init__(self):
        self.logs = np.log(np.maximum(self.sizes, 1))
        self.plain = self.sizes - np.bincount(self.doc_of, minlength=len(self.labels))

    def totals(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """-log of the product of all 1 - p, by document; the scores of sentences, and the background's."""
        base = theta[-2] - theta[-1] * self.logs
        scores = np.bincount(self.word_at, theta[self.feature_of], self.words)
        zs = base[self.doc_of] + np.bincount(self.sent_of, scores[self.word_of], len(self.doc_of))
        return np.bincount(self.doc_of, np.logaddexp(0, zs), len(self.labels)) + self.plain * np.logaddexp(0, base), zs, base

    def fitted(self, use: np.ndarray, rounds: int, decay: float) -> np.ndarray:
        """Weights, bias and slope by gradient steps (Adam) on the noisy-or likelihood of the documents ``use``."""
        n, toxic = len(self.labels), self.labels > 0
        weigh = np.where(toxic, 1 + (use & ~toxic).sum() / max(1, (use & toxic).sum()) / 3, 1.0) * use
        weigh /= weigh.sum()
        theta = np.zeros(self.features + 2)
        theta[-2:] = -3.0, 1.0
        m, v = np.zeros_like(theta), np.zeros_like(theta)

        def sigmoid(x):
            return 0.5 * (1 + np.tanh(x / 2))

        for step in range(1, rounds + 1):
            total, zs, base = self.totals(theta)
            # of -log(1 - exp(-total)) for label 1, of total for label 0
            by_doc = np.where(toxic, -np.exp(-total) / -np.expm1(-np.maximum(total, 1e-9)), 1.0) * weigh
            by_sent = by_doc[self.doc_of] * sigmoid(zs)
            back = np.bincount(self.doc_of, by_sent, n) + by_doc * self.plain * sigmoid(base)
            by_word = np.bincount(self.word_of, by_sent[self.sent_of], self.words)
            grad = np.bincount(self.feature_of, by_word[self.word_at], self.features) + decay * theta[:-2]
            grad = np.append(grad, [back.sum(), -(back * self.logs).sum()])
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            theta[-1] = max(0.0, theta[-1])
        return theta


def best_middle(scores: np.ndarray, labels: np.ndarray) -> float:
    """The probability from which on label 1 is said with the best F1, halfway to the next lower score."""
    if not labels.sum():
        return 0.5
    order = np.argsort(-scores, kind="stable")
    right = np.cumsum(labels[order])
    f1 = 2 * right / (np.arange(1, len(order) + 1) + labels.sum())
    f1[np.append(scores[order][1:] == scores[order][:-1], False)] = -1  # equal scores get the same answer
    at = int(np.argmax(f1))
    below = scores[order][at + 1] if at + 1 < len(order) else 0.0
    return float(min(0.95, max(0.05, (scores[order][at] + below) / 2)))


def counted(rows: DataFrame) -> DataFrame:
    """``feature, toxic, clean``: in how many of the texts (``text, label``) of either label a feature stands."""
    schema = pa.schema([("feature", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def run(batches):
        for batch in batches:
            known: dict[str, set] = {}
            both = (Counter(), Counter())
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set().union(*map(words_of, SENTENCE.findall(text)))
                both[label].update(set().union(*(known.get(w) or known.setdefault(w, features(w)) for w in words)))
            names = list(both[0].keys() | both[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([both[1][x] for x in names], pa.int64()), pa.array([both[0][x] for x in names], pa.int64())], schema=schema)

    small_batches(rows.sparkSession)
    return rows.select("text", "label").mapInArrow(run, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def found_in(rows: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Where the named features stand, as two tables.

    ``name, label, sentences, sent, word`` per text: its words that have any of them, by the sentences with such words, numbered from
    0; the last two are packed. ``word, features`` per distinct word. A word goes by 64 bits of a hash.
    """
    shared = rows.sparkSession.sparkContext.broadcast({x: k for k, x in enumerate(names)})
    by_text = pa.schema([("name", pa.string()), ("label", pa.int32()), ("sentences", pa.int64()), ("sent", pa.binary()), ("word", pa.binary())])

    def told(word: str, known: dict) -> tuple[int, list[int]]:
        if word not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            known[word] = (xxhash.xxh3_64_intdigest(word.encode()) - (1 << 63), sorted(k for x in features(word) if (k := shared.value.get(x)) is not None))
        return known[word]

    def texts(batches):
        known: dict = {}
        for batch in batches:
            out = []
            for name, text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sent, word, n = [], [], 0
                sentences = SENTENCE.findall(text)
                for s in sentences:
                    mine = sorted(h for h, of in (told(w, known) for w in words_of(s)) if of)
                    word += mine
                    sent += [n] * len(mine)
                    n += bool(mine)
                out.append({"name": name, "label": label, "sentences": len(sentences), "sent": np.array(sent, "<i4").tobytes(), "word": np.array(word, "<i8").tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=by_text)

    def words(batches):
        known: dict = {}
        for batch in batches:
            every = set().union(*(words_of(s) for text in batch.column(0).to_pylist() for s in SENTENCE.findall(text)))
            found = [x for x in (told(w, known) for w in every) if x[1]]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.int64()), pa.array([of for _, of in found], pa.list_(pa.int32()))], ["word", "features"])

    by_word = rows.select("text").mapInArrow(words, "word long, features array<int>").groupBy("word").agg(F.first("features").alias("features"))
    return rows.select("name", "text", "label").mapInArrow(texts, "name string, label int, sentences long, sent binary, word binary"), by_word


def train(rows: DataFrame, telling: float = 2.0, rounds: int = 100, decay: float = 1e-4, folds: int = 2) -> Model:
    """Fit on texts (``text, label``) by all features that tell the labels apart: log odds of ``telling`` standard errors or more.

    Features are made and counted by tasks; the driver gets the telling ones' names and where these stand. Each of
    ``folds`` parts of the texts is scored by a fit on the others, which gives the probability that counts as
    0.5; the weights are then fitted on all. Repeated texts count once, as toxic if any of them is. Without
    both labels the model says 0 (or 1) throughout.
    """
    once = cut(rows.select(F.coalesce("text", F.lit("")).alias("text"), "label").groupBy("text").agg(F.max("label").alias("label")).withColumn("name", F.sha2("text", 256)))
    n = {r["label"]: r["count"] for r in once.groupBy("label").count().collect()}  # two rows
    if len(n) < 2:
        return Model({}, 30.0 if 1 in n else -30.0)
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    z = F.log(a / (n[1] + 1 - a) / (b / (n[0] + 1 - b))) / F.sqrt(1 / a + 1 / b)
    names = [r["feature"] for r in counted(once).where(F.abs(z) >= telling).select("feature").orderBy("feature").collect()]
    by_text, by_word = found_in(once, names)
    got = by_text.toArrow().sort_by("name")  # of the sample's texts only these numbers
    words = by_word.toArrow().sort_by("word").combine_chunks()
    sents = [np.frombuffer(x.as_py(), "<i4") for x in got["sent"]]
    counts = np.array([x[-1] + 1 if len(x) else 0 for x in sents])
    before = np.cumsum(counts) - counts
    lists = words["features"].combine_chunks()
    sample = Sample(
        labels=got["label"].to_numpy().astype(float),
        sizes=got["sentences"].to_numpy(),
        doc_of=np.repeat(np.arange(len(got)), counts),
        sent_of=np.concatenate([x + at for x, at in zip(sents, before, strict=True)]),
        word_of=np.searchsorted(words["word"].to_numpy(), np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in got["word"]])),
        word_at=np.repeat(np.arange(len(words)), lists.value_lengths().to_numpy()),
        feature_of=lists.flatten().to_numpy(),
        words=len(words),
        features=len(names),
    )
    del sents, got, lists
    n_texts = len(sample.labels)
    part, others = np.arange(n_texts) % folds, np.full(n_texts, -1.0)
    for k in range(folds):
        use = part != k
        if sample.labels[use].any() and not sample.labels[use].all():
            others[~use] = -np.expm1(-sample.totals(sample.fitted(use, rounds, decay))[0])[~use]
    told = others >= 0
    middle = best_middle(others[told], sample.labels[told])
    theta = sample.fitted(np.ones(n_texts, bool), rounds, decay)
    return Model({x: t for x, t in zip(names, theta[:-2].tolist(), strict=True) if t}, float(theta[-2]), float(theta[-1]), middle)


def held_out(key: str, of: int, rest: int):
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(of)) == rest, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = 3000, most_bytes: int = 8 << 20) -> Model:
    """Train on labelled rows in the order of their identifiers' hashes, of each label until there are ``most`` or their texts have ``most_bytes``.

    Lengths decide nothing else: a text is taken whole, however long. Labels other than 0 and 1 and null
    ones are not used. The sample's identifiers, at most ``2 * most``, come to the driver with the lengths and are broadcast.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("__id"), F.col(label).cast("int").alias("label"))
    picked = [known.where(F.col("label") == y).orderBy(F.xxhash64("__id"), "__id").limit(most) for y in (0, 1)]
    rows = docs.select(F.col(key).alias("__id"), F.col(text).alias("text"))
    few = rows.join(F.broadcast(picked[0].union(picked[1])), "__id")
    sizes = few.groupBy("__id", "label").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n")).orderBy("label", F.xxhash64("__id"), "__id").collect()
    held, ids = Counter(), []
    for r in sizes:
        if held[r["label"]] < most_bytes:
            ids.append((r["__id"], r["label"]))
        held[r["label"]] += r["n"]
    taken = docs.sparkSession.createDataFrame(ids, known.schema)
    return train(rows.join(F.broadcast(taken), "__id").select("text", "label"))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: str = "") -> DataFrame:
    """``id, score, sentences`` per row; with ``keep`` the input's columns, then the score by that name.

    ``sentences``: start, end (characters) and probability of those that offend. A null or empty text
    has no sentence and scores 0. A text is scored whole. Rows that repeat get equal scores, null
    identifiers pass through, an empty table gives none.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.slope, model.middle))
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    names = [f"c{k}" for k in range(len(docs.columns))]

    def run(batches):
        m = Model(*shared.value)
        for batch in batches:
            got = [m.score(x.as_py().decode("utf-8", "replace")) for x in batch.column(batch.num_columns - 1)]
            scores = pa.array([s for s, _ in got], pa.float64())
            if keep:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], [*names, "score"])
            else:
                found = pa.array([[{"start": a, "end": b, "p": p} for a, b, p in f] for _, f in got], spans)
                yield pa.RecordBatch.from_arrays([batch.column(0), scores, found], ["id", "score", "sentences"])

    if keep:
        plain = docs.withColumn(free_name(docs, "body"), utf8(text)).toDF(*names, "body")  # names of any characters come back at the end
        out = StructType([*(StructField(n, f.dataType) for n, f in zip(names, docs.schema, strict=True)), StructField("score", DoubleType())])
        return plain.mapInArrow(run, out).toDF(*docs.columns, keep)
    source = docs.select(F.col(key).cast("long").alias("id"), utf8(text).alias("body"))
    return source.mapInArrow(run, "id long, score double, sentences array<struct<start:int,end:int,p:double>>")


def training_rows(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out("doc_id", 5, 0))


def op7_toxicity(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, fit(docs, training_rows(labels)))
    return scored.select(F.col("id").alias("doc_id"), held_out("id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentences")
