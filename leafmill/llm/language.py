"""Language identification, words first.

A word that is known scores by its log frequency in each language; an unknown one by the longest of
its character n-grams that are known, from 5 characters down to 1. A text gets the language with the
largest sum over its words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import documents, small_batches, utf8
from leafmill.llm.toxicity import held_out

WORD = re.compile(r"[^\W\d_]+")
LONGEST = 5
#: Words that a worker remembers at most, and numbers for all of them together (a word has one for each language).
REMEMBERED, CELLS = 300_000, 4_000_000


def grams(word: str, n: int) -> list[str]:
    """N-grams of the word with its two ends marked; single characters without the marks."""
    s = f"<{word}>" if n > 1 else word
    return [s[i : i + n] for i in range(len(s) - n + 1)]


@dataclass
class Model:
    """Log frequencies: ``tables[0]`` by word, ``tables[n]`` by n-gram; a vector over ``langs`` each."""

    langs: list[str]
    tables: list[dict[str, tuple[float, ...]]]
    rows: dict[str, int] = field(default_factory=dict)
    matrix: np.ndarray | None = None

    def vector(self, word: str) -> np.ndarray:
        got = self.tables[0].get(word)
        if got is not None:
            return np.array(got)
        for n in range(LONGEST, 0, -1):
            known = [v for g in grams(word, n) if (v := self.tables[n].get(g)) is not None]
            if known:
                return np.mean(known, axis=0)
        return np.zeros(len(self.langs))

    def predict(self, text: str) -> tuple[str, float]:
        words = Counter(w for w in WORD.findall(text.lower()) if w[0].isalpha() or any(map(str.isalpha, w)))
        if not words or not self.langs:
            return "und", 0.0
        if self.matrix is None or len(self.rows) + len(words) > len(self.matrix):
            self.rows, self.matrix = {}, np.zeros((max(min(REMEMBERED, CELLS // len(self.langs)), len(words)), len(self.langs)))
        at = []
        for w in words:
            i = self.rows.get(w)
            if i is None:
                i = self.rows[w] = len(self.rows)
                self.matrix[i] = self.vector(w)
            at.append(i)
        total = np.fromiter(words.values(), float, len(words)) @ self.matrix[at]
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id", most: int = 1000, words: int = 20_000, kept: int = 8_000) -> Model:
    """Learn from about ``most`` documents of each language, those whose identifiers hash lowest.

    The model keeps the ``words`` most frequent words and ``kept`` n-grams of each length per
    language: what comes to the driver is bounded by these and the number of languages. Rows without
    a language or text are not used.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model([], [{} for _ in range(LONGEST + 1)])
    limits = F.create_map(*[F.lit(x) for l, n in counts.items() for x in (l, min(1.0, most / n))])
    sample = rows.where(F.pmod(F.xxhash64(F.col(order)), F.lit(1 << 20)) <= limits[F.col(lang)] * (1 << 20))

    def count(batches):
        seen: dict[tuple[str, int], Counter[str]] = {}

        def flush():
            out = [(l, n, g, c) for (l, n), cs in seen.items() for g, c in cs.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["lang", "n", "gram", "c"])

        for batch in batches:
            for l, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = Counter(WORD.findall(raw.as_py().decode("utf-8", "replace").lower()))
                seen.setdefault((l, 0), Counter()).update(found)
                for n in range(1, LONGEST + 1):
                    into = seen.setdefault((l, n), Counter())
                    for w, c in found.items():
                        for g in grams(w, n):
                            into[g] += c
            if sum(map(len, seen.values())) > 1_000_000:
                yield flush()
                seen = {}
        if any(seen.values()):
            yield flush()

    small_batches(spark)
    each = sample.select(F.col(lang).alias("lang"), utf8(text).alias("body")).mapInArrow(count, "lang string, n int, gram string, c long")
    summed = each.groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    mine = Window.partitionBy("lang", "n")
    top = (
        summed.withColumn("all", F.sum("c").over(mine))
        .withColumn("place", F.row_number().over(mine.orderBy(F.col("c").desc(), "gram")))
        .where(F.col("place") <= F.when(F.col("n") == 0, words).otherwise(kept))
    )
    got = top.select("lang", "n", "gram", "c", "all").toArrow().to_pylist()
    langs = sorted(counts)
    place = {l: i for i, l in enumerate(langs)}
    totals = np.ones((LONGEST + 1, len(langs)))
    raw: list[dict[str, list[float]]] = [{} for _ in range(LONGEST + 1)]
    for r in got:
        totals[r["n"]][place[r["lang"]]] = r["all"]
        raw[r["n"]].setdefault(r["gram"], [0.0] * len(langs))[place[r["lang"]]] = r["c"]
    tables = []
    for n, table in enumerate(raw):
        small = 0.5
        tables.append({g: tuple(math.log((c + small) / (t + small * (len(table) + 1))) for c, t in zip(cs, totals[n], strict=True)) for g, cs in table.items()})
    return Model(langs, tables)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, lang_pred, score``: ``score`` is the language's share in the softmax of all sums.

    A text that is null or has no letter, and every text if nothing was learned, is ``und`` with score
    0; of equal sums the language first in code-point order is taken. Texts are read whole; nothing
    but the text is used. Rows that repeat get equal rows, null identifiers pass through, an empty
    table gives none.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.tables))

    def run(batches):
        m = Model(*shared.value)
        for batch in batches:
            got = [m.predict(x.as_py().decode("utf-8", "replace")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["id", "lang_pred", "score"])

    return docs.select(F.col(key).cast("long").alias("id"), utf8(text).alias("body")).mapInArrow(run, "id long, lang_pred string, score double")


def op6_language(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = fit(docs.where(~held_out("doc_id", 4, 2)))
    return predict(docs, model).select(F.col("id").alias("doc_id"), held_out("id", 4, 2).alias("held_out"), "lang_pred", "score")
