"""Training-data operators do the whole job."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from leafmill.llm import mixing, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string"


def docs(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", (sources or ["s"])[i % len(sources or [1])]) for i, t in enumerate(texts)], SCHEMA)


def test_every_repeated_line_goes(spark, tmp_path):
    """Short lines, lists and lines without spaces; blank lines stay."""
    items = "\n".join(f"item {i}" for i in range(40))
    han = "这是第一份文件里重复出现的一行文字没有空格"
    texts = [f"own beginning\n\nReleased under the MIT License.\n{han}", f"another one\n\n  released under  the MIT license.\n{items}", f"{items}\nthird ending\n{han}", "x\nx\ny"]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in substring_dedup.op8_substring_dedup(spark, str(tmp_path)).collect()}
    assert got[0].clean_text == texts[0]
    assert got[1].clean_text == f"another one\n\n{items}"
    assert got[2].clean_text == "third ending\n"
    assert got[3].clean_text == "x\ny"
    seen = set()
    for i, text in enumerate(texts):
        want = []
        for line in text.split("\n"):
            name = " ".join(line.lower().split())
            if not name or name not in seen:
                want.append(line)
            seen.add(name)
        assert got[i].clean_text.rstrip("\n") == "\n".join(want)
        assert "".join(text[s.start : s.end] for s in got[i].kept) == got[i].clean_text


def test_sentences_without_spaces(spark):
    han = "这是一个会在许多文件里重复出现的句子。"
    found = docs(spark, [f"第一份文件自己的开头。{han}", f"另一份文件的不同开头。{han}完。"])
    got = {r.id: r.clean_text for r in substring_dedup.dedup_units(found, every_line=True).collect()}
    assert got[0].endswith(han) and got[1] == "另一份文件的不同开头。完。"


def by_hand(rows, least=6, passage=12):
    """Every unit compared with all places before it: lines go, sentences in runs of ``passage`` words."""

    def name(x):
        return " ".join(x.lower().split())

    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, xxhash64(r[1] or "")))
    seen, out = set(), {}
    for i, text in rows:
        text, gone, at = text or "", set(), 0
        later = []  # a unit repeats what stands before it, in its own text too
        for line in text.split("\n"):
            stop = at + len(line)
            if line.strip():
                later.append((at, min(stop + 1, len(text)), None))
                cuts = [m.span() for m in re.finditer(r"(?<=[.!?])[ \t]+", line)]
                edges = [0, *(x for c in cuts for x in c), len(line)]
                if cuts:
                    later += [(at + a, at + b, at) for a, b in zip(edges[::2], edges[1::2], strict=True) if len(line[a:b].split()) >= least]
            at = stop + 1
        runs, last = [], None
        for a, b, line in later:
            repeated = name(text[a:b]) in seen
            seen.add(name(text[a:b]))
            if line is None:
                gone |= set(range(a, b)) if repeated else set()
            elif repeated and last == line:
                runs[-1].append((a, b))
            elif repeated:
                runs.append([(a, b)])
            last = (line if repeated else None) if line is not None else last
        for run in runs:
            if sum(len(text[a:b].split()) for a, b in run) >= passage:
                gone |= {x for a, b in run for x in range(a, b)}
        out[i, text] = "".join(c for k, c in enumerate(text) if k not in gone)
    return out


def xxhash64(text):
    """As Spark's, for tests: rows are put in the order of their hashes beforehand."""
    return HASHES[text]


HASHES = {}


def test_units_as_by_hand(spark):
    rnd = random.Random(12)
    words = [f"w{k}" for k in range(60)]
    sentences = [" ".join(rnd.choices(words, k=rnd.choice((2, 3, 6, 7, 9)))) + "." for _ in range(40)]
    texts = ["\n".join(" ".join(rnd.choices(sentences, k=rnd.randrange(0, 6))) for _ in range(rnd.randrange(1, 5))) for _ in range(60)]
    texts += [None, "", "\n", texts[0], texts[1].upper()]
    rows = [(None if k % 13 == 4 else k // 3, t) for k, t in enumerate(texts)]
    rows.append(rows[2])
    d = spark.createDataFrame(rows, "doc_id long, text string")
    HASHES.update({r.t: r.h for r in d.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit("")).cast("binary")).alias("h")).collect()})
    want = by_hand(rows)
    got = substring_dedup.dedup_units(d, every_line=True, passage=12).collect()
    assert Counter((r.id, r.clean_text) for r in got) == Counter((i, want[i, t or ""]) for i, t in rows)


def test_common_lines_need_no_gathering(spark, monkeypatch):
    """With the threshold for common units at 2 and out of reach, the results are the same."""
    d = docs(spark, [f"common line\nown {k}\nline of {k % 3}" for k in range(30)])
    found = []
    for hot in (2, 10**9):
        monkeypatch.setattr(substring_dedup, "HOT", hot)
        found.append(sorted((r.id, r.clean_text) for r in substring_dedup.dedup_units(d, every_line=True).collect()))
    assert found[0] == found[1] and found[0][5][1] == "own 5\n"


def test_copies_stand_where_their_pass_is_due(spark):
    """A small source that is read three times spreads over all of training."""
    import corpus_pipeline

    d = docs(spark, ["a b c"] * 130, ["s"] + ["t"] * 12)
    plan = {r.id: r for r in mixing.planned(d).collect()}
    assert {r.copies for r in plan.values() if r.source == "s"} != {1}
    flat = {"s": [1.0, 1.0], "t": [1.5, 1.0, 0.5]}  # the default schedules of the first two sources

    def due(r, k):
        """The time at which the schedule's share reaches the copy's, by bisection."""
        share = min((r.offset + k * r.source_size) / r.target, 1.0)
        f = flat[r.source]
        steps = len(f) - 1

        def passed(t):
            i = min(int(t * steps), steps - 1)
            x = t * steps - i
            return sum((f[j] + f[j + 1]) / 2 for j in range(i)) + f[i] * x + (f[i + 1] - f[i]) * x * x / 2

        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if passed(mid) < share * passed(1.0) else (low, mid)
        return round(low, 9)

    want = sorted((due(r, k), k, r.id) for r in plan.values() for k in range(r.copies))
    got = [r.doc_id for r in corpus_pipeline.mixing_stage(spark, d, "").collect()]
    assert got == [i for _, _, i in want]
    places = [i for i, x in enumerate(got) if plan[x].source == "s"]
    assert places[-1] - places[0] > len(got) / 2
    each = mixing.passes(mixing.planned(d)).select("id", "pass", F.round("position", 6).alias("p")).collect()
    assert {(r.id, r["pass"]): r.p for r in each} == {(i, k): round(t, 6) for t, k, i in want}
