"""Substring dedup by line hashing.

A unit is a line, and each longer sentence of a line that has several, since repeated passages also
stand inside lines. Units are normalised (case, white space), digests are grouped over all documents, the
occurrence in the earliest ranked place stays, and all others are removed from their texts: lines each,
sentences only as a passage, where neighbours are repeated too. What is removed and what is kept is
told by offsets in the original.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut, documents, small_batches, utf8

_SENTENCE = re.compile(r"(?<=[.!?])[ \t]+|(?<=[。！？])[ \t]*(?=[^\s。！？])")
#: Letters of scripts that set no spaces between words: Thai to Myanmar, Khmer, kana, Han.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U0003ffff]")
UNITS = "id long, th long, hi array<long>, lo array<long>, start array<int>, end array<int>"
#: Occurrences from which on a unit's other occurrences are found without gathering them in one place.
HOT = 2_000


def digest(unit: str) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(" ".join(unit.lower().split()).encode("utf-8", "replace"))
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def long_enough(unit: str, least: int) -> bool:
    """``least`` words, or twice as many letters of scripts without spaces."""
    return len(unit.split()) >= least or (not unit.isascii() and len(_UNSPACED.findall(unit)) >= 2 * least)


def units(text: str, least: int, every_line: bool = False) -> list[tuple[int, int, int]]:
    """Start and end (characters) of the units that are ``long_enough``, by start; then the line that a sentence is in, -1 for lines.

    With ``every_line`` all lines are units but blank ones, and only sentences have to be long enough.
    A line's span takes its line end along; a sentence's doesn't.
    """
    out, at = [], 0
    for k, line in enumerate(text.split("\n")):
        stop = at + len(line)
        if line.strip() if every_line else long_enough(line, least):
            out.append((at, min(stop + 1, len(text)), -1))
            parts, begin = [], at
            for m in _SENTENCE.finditer(line):
                parts.append((begin, at + m.start()))
                begin = at + m.end()
            if parts:
                parts.append((begin, stop))
                out += [(a, b, k) for a, b in parts if long_enough(text[a:b], least)]
        at = stop + 1
    return out


def removable(text: str, repeated: set[tuple[int, int]], least: int, every_line: bool, passage: int) -> list[tuple[int, int]]:
    """Of the repeated units all lines, and sentences that with their repeated neighbours have ``passage`` words (or twice as many letters without spaces)."""
    out: list[tuple[int, int]] = []
    run: list[tuple[int, int]] = []
    line = -1

    def close():
        if run and long_enough(" ".join(text[a:b] for a, b in run), passage):
            out.extend(run)
        run.clear()

    for a, b, k in units(text, least, every_line):
        if k < 0:
            if (a, b) in repeated:
                out.append((a, b))
            continue
        if k != line or (a, b) not in repeated:
            close()
        line = k
        if (a, b) in repeated:
            run.append((a, b))
    close()
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def rows_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id``, the text's hash, which tells rows of one identifier apart, and the text."""
    return docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(utf8(text)).alias("th"), utf8(text).alias("body"))


def digests(rows: DataFrame, least: int, every_line: bool = False) -> DataFrame:
    def run(batches):
        for batch in batches:
            hi, lo, start, end = [], [], [], []
            for raw in batch.column(2):
                body = raw.as_py().decode("utf-8", "replace")
                spans = units(body, least, every_line)
                both = [digest(body[a:b]) for a, b, _ in spans]
                hi.append([x for x, _ in both])
                lo.append([x for _, x in both])
                start.append([a for a, _, _ in spans])
                end.append([b for _, b, _ in spans])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *(pa.array(c, pa.list_(pa.int64())) for c in (hi, lo)), *(pa.array(c, pa.list_(pa.int32())) for c in (start, end))], ["id", "th", "hi", "lo", "start", "end"]
            )

    return rows.mapInArrow(run, UNITS)


def repeated_units(rows: DataFrame, least: int, every_line: bool = False) -> DataFrame:
    """``id, th, start, end`` of every occurrence but the first of units that occur more than once."""
    table = cut(digests(rows, least, every_line))
    each = table.select("id", "th", F.explode(F.arrays_zip("hi", "lo", "start", "end")).alias("u")).select("id", "th", "u.hi", "u.lo", "u.start", "u.end")
    # combined before the shuffle: a line that stands everywhere travels once per task
    place = F.struct(F.col("id").isNull().alias("last"), "id", "th", "start")
    count = each.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    shared = cut(count.where("n > 1").select("hi", "lo", F.struct("first.id", "first.th", "first.start").alias("first"), "n"))
    hot = shared.where(F.col("n") >= HOT).select("hi", "lo", "first")
    # the units that stand in most texts are few and come to the texts; the others' places are shuffled
    if hot.count() * 64 <= 16 << 20:
        known = F.broadcast(hot.withColumnRenamed("first", "hot"))
        marked = each.join(known, ["hi", "lo"], "left")
        rare = marked.where("hot is null").drop("hot").join(shared.where(F.col("n") < HOT).drop("n"), ["hi", "lo"])
        both = rare.unionByName(marked.where("hot is not null").withColumnRenamed("hot", "first"))
    else:
        both = each.join(shared.drop("n"), ["hi", "lo"])
    return both.where(~F.struct("id", "th", "start").eqNullSafe(F.col("first"))).select("id", "th", "start", "end")


def dedup_units(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 6, every_line: bool = False, passage: int = 0) -> DataFrame:
    """``id, clean_text, n_removed, removed_chars, removed, kept`` per row.

    Units that aren't ``long_enough`` stay; with ``every_line`` that goes for sentences only. A
    repeated sentence is removed with its repeated neighbours (shorter sentences between them aside) if
    these have ``passage`` words together. Occurrences are ranked by identifier (null last), text (by
    its hash, where an identifier repeats) and place; repeats within a text count too. ``removed`` and
    ``kept`` are start and end in characters of the original, and ``clean_text`` is the kept stretches
    joined. A null text counts as empty. Rows that repeat an identifier and its text are one occurrence:
    they get the same verdict. An empty table gives an empty result; other columns are not read.
    """
    small_batches(docs.sparkSession)
    source = rows_of(docs, key, text)
    spans = repeated_units(source, least, every_line).groupBy("id", "th").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    same = F.col("d.id").eqNullSafe(F.col("s.id")) & (F.col("d.th") == F.col("s.th"))
    both = source.alias("d").join(spans.alias("s"), same, "left").select("d.id", "body", "spans")
    pair = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            out = []
            for raw, found in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                body = raw.as_py().decode("utf-8", "replace")
                mine = removable(body, {(s["start"], s["end"]) for s in found}, least, every_line, passage) if found else []
                gone = merged(mine)
                kept, at = [], 0
                for a, b in [*gone, (len(body), len(body))]:
                    if a > at:
                        kept.append((at, a))
                    at = b
                out.append(("".join([body[a:b] for a, b in kept]), len(mine), sum(b - a for a, b in gone), gone, kept))
            text_, n, chars, gone, kept = zip(*out, strict=True) if out else ((),) * 5
            spans_ = [pa.array([[{"start": a, "end": b} for a, b in x] for x in c], pair) for c in (gone, kept)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text_, pa.string()), pa.array(n, pa.int64()), pa.array(chars, pa.int64()), *spans_], ["id", "clean_text", "n_removed", "removed_chars", "removed", "kept"])

    span = "array<struct<start:int,end:int>>"
    return both.mapInArrow(run, f"id long, clean_text string, n_removed long, removed_chars long, removed {span}, kept {span}")


def op8_substring_dedup(spark, sf_dir):
    return dedup_units(documents(spark, sf_dir), every_line=True, passage=12).withColumnRenamed("id", "doc_id")


def dedup_lines(spark, sf_dir):
    """Line hashing alone, without sentences, which SQL can express."""
    found = dedup_units(documents(spark, sf_dir), least=2**31, every_line=True)
    return found.select(F.col("id").alias("doc_id"), "n_removed", "removed_chars", "clean_text")


LINES_SQL = """
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i, len(ls) AS n FROM t),
k AS (SELECT *, trim(regexp_replace(lower(line), '\\s+', ' ', 'g')) AS unit, line || CASE WHEN i < n THEN chr(10) ELSE '' END AS span FROM l),
r AS (SELECT *, unit = '' OR row_number() OVER (PARTITION BY unit ORDER BY doc_id, i) = 1 AS stays FROM k)
SELECT doc_id, count(*) FILTER (NOT stays) AS n_removed, CAST(coalesce(sum(length(span)) FILTER (NOT stays), 0) AS BIGINT) AS removed_chars,
  coalesce(string_agg(span, '' ORDER BY i) FILTER (stays), '') AS clean_text
FROM r GROUP BY doc_id
"""
