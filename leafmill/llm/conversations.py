"""Repair of conversation structure by A* on the edit lattice.

The repaired roles must be a system message or none, then pairs of user and assistant: ``(s?(ua)+)?``
in initials. A node of the lattice is (rows read, state of that pattern); edits are edges. The
heuristic is the suffix sum of what no path avoids: the deletion of blank and repeated rows, and for a
truncated row the cheaper of its deletion and its charge. Nodes leave the queue by (cost plus
heuristic, audit), so that of the cheapest repairs the one with the least audit is found.

Conversations are dealt by ranges of (conversation, turn) and sorted, and each partition is read as a
stream. A conversation that stands whole within a partition, and is of bounded length, is repaired there. All
others are cut in segments of bounded size: A* gives each segment's cheapest repair between every two
states of the pattern, and these are composed, as products of small matrices are.
"""

from __future__ import annotations

import hashlib
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut, parallel, small_batches

#: Costs of the edits and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANK_CHARACTERS = "\x20\x09\x0a\x0b\x0c\x0d"
#: States: nothing yet, after the system message, after a user's, after a pair; what an initial leads to, and what is inserted.
START, SYSTEM, USER, PAIR = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": PAIR}, {"u": USER})
WANTED = ("u", "u", "a", "u")
ROLE = {"u": "user", "a": "assistant"}
ENDS = (START, PAIR)


def kind_of(text: str) -> str:
    """``b`` for blank, ``t`` for truncated, else nothing."""
    bare = text.rstrip(BLANK_CHARACTERS)
    return "b" if not bare else "" if bare[-1] in ".!?" else "t"


def faults(rows: list[tuple[str, str]], seen: set) -> list[str]:
    """The first fault of each (role, text): ``b``, ``d`` for one seen earlier, ``t`` or nothing; adds to ``seen``."""
    out = []
    for row in rows:
        kind = kind_of(row[1])
        out.append(kind if kind == "b" else "d" if row in seen else kind)
        seen.add(row)
    return out


def search(rows: list[tuple[str, str]], entry: int = START, whole: bool = True) -> dict[int, tuple[int, str]]:
    """The cheapest repair of (initial, fault) rows from state ``entry``: exit state to (cost, audit).

    For a whole conversation only the best of the allowed ends is found, with insertions behind the last
    row; otherwise every exit that can be reached, without these.
    """
    n = len(rows)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + (min(DELETE, TRUNCATED) if rows[i][1] else 0)
    queue, done, found = [(rest[0], "", 0, entry, 0)], set(), {}
    while queue:
        _, audit, i, state, cost = heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n and (not whole or state in ENDS):
            found[state] = (cost, audit)
            if whole or len(found) == 4:
                break
        if i < n:
            initial, fault = rows[i]
            heappush(queue, (cost + DELETE + rest[i + 1], audit + "D", i + 1, state, cost + DELETE))
            if fault not in ("b", "d"):
                stays = cost + (TRUNCATED if fault == "t" else 0)
                kept = NEXT[state].get(initial)
                if kept is not None:
                    heappush(queue, (stays + rest[i + 1], audit + "K", i + 1, kept, stays))
                if initial != WANTED[state]:
                    stays += REROLE
                    heappush(queue, (stays + rest[i + 1], audit + "R", i + 1, NEXT[state][WANTED[state]], stays))
        if i < n or whole:
            heappush(queue, (cost + INSERT + rest[i], audit + "I", i, NEXT[state][WANTED[state]], cost + INSERT))
    return found


def repaired(rows: list[tuple[str, str]], audit: str, state: int = START) -> list[str]:
    """The ``role:text`` of the rows that ``audit`` leaves."""
    out, todo = [], iter(rows)
    for edit in audit:
        if edit == "I":
            role, text = ROLE[WANTED[state]], ""
        else:
            role, text = next(todo)
            if edit == "D":
                continue
            if edit == "R":
                role = ROLE[WANTED[state]]
        state = NEXT[state][role[:1]]
        out.append(f"{role}:{text}")
    return out


def illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def gap(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
RESULT = pa.struct([(c, pa.int64()) for c in COUNTS] + [("audit", pa.string()), ("repaired_sha256", pa.string())])
SEGMENT = pa.struct([("part", pa.int32()), ("seq", pa.int32()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("digests", pa.list_(pa.binary()))])
RESULT_DDL = "struct<gaps:long,blank:long,duplicate:long,truncated:long,illegal:long,cost:long,audit:string,repaired_sha256:string>"
SEGMENT_DDL = "struct<part:int,seq:int,turns:array<long>,roles:array<string>,texts:array<string>,digests:array<binary>>"


def digest(row: tuple[str, str]) -> bytes:
    return hashlib.sha256(f"{len(row[0])}:{row[0]}{row[1]}".encode()).digest()


def whole_result(turns: list, rows: list[tuple[str, str]]) -> dict:
    """What is said of a conversation that is all here."""
    kinds, initials = faults(rows, set()), [r[:1] for r, _ in rows]
    ((cost, audit),) = search(list(zip(initials, kinds, strict=True))).values()
    sha = hashlib.sha256("\n".join(repaired(rows, audit)).encode()).hexdigest()
    return dict(zip([*COUNTS, "audit", "repaired_sha256"], [gap(turns), kinds.count("b"), kinds.count("d"), kinds.count("t"), illegal(initials), cost, audit, sha], strict=True))


def streamed(rows: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """``conv_id`` with ``result`` for conversations inside a partition and ``segment`` for pieces of the others."""
    schema = pa.schema([("conv_id", pa.int64()), ("result", RESULT), ("segment", SEGMENT)])

    def run(batches):
        part, out = TaskContext.get().partitionId(), []
        conv, turns, held, size, seq, inside = None, [], [], 0, 0, None

        def segment():
            out.append({"conv_id": conv, "result": None, "segment": {"part": part, "seq": seq, "turns": turns, "roles": [r for r, _ in held], "texts": [t for _, t in held], "digests": [digest(r) for r in held]}})

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone")), strict=True):
                if inside is None:  # the partition's first conversation may have begun in another
                    conv, inside = row[0], False
                elif row[0] != conv:
                    if inside:
                        out.append({"conv_id": conv, "result": whole_result(turns, held), "segment": None})
                    else:
                        segment()
                    conv, turns, held, size, seq, inside = row[0], [], [], 0, 0, True
                if not row[4]:
                    if len(held) >= most_rows or size >= most_bytes:
                        segment()
                        turns, held, size, seq, inside = [], [], 0, seq + 1, False
                    turns.append(row[1])
                    held.append((row[2], row[3]))
                    size += len(row[3])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out.clear()
        if inside is not None:  # the last one may go on in another
            segment()
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.select("conv_id", "turn", "role", "text", "gone").mapInArrow(run, f"conv_id long, result {RESULT_DDL}, segment {SEGMENT_DDL}")


SOLVED = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("n", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64())]
    + [("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64())]
    + [("paths", pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))]
)
SOLVED_DDL = "conv_id long, part int, seq int, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, paths array<struct<entry:int,exit:int,cost:long,audit:string>>"


def solve(batches):
    """A* over each segment, between every two states. ``before``: digests of rows of earlier segments."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            s = row["segment"]
            rows, seen = list(zip(s["roles"], s["texts"], strict=True)), set(row["before"] or [])
            kinds = []
            for (_, text), d in zip(rows, s["digests"], strict=True):
                kind = kind_of(text)
                kinds.append(kind if kind == "b" else "d" if d in seen else kind)
                seen.add(d)
            initials, known = [r[:1] for r, _ in rows], [t for t in s["turns"] if t is not None]
            paths = [{"entry": q, "exit": e, "cost": c, "audit": a} for q in range(4) for e, (c, a) in search(list(zip(initials, kinds, strict=True)), q, False).items()]
            out.append(
                {"conv_id": row["conv_id"], "part": s["part"], "seq": s["seq"], "n": len(rows), "blank": kinds.count("b"), "duplicate": kinds.count("d"), "truncated": kinds.count("t"), "illegal": illegal(initials)}
                | {"first": initials[0] if rows else None, "last": initials[-1] if rows else None, "low": known[0] if known else None, "high": known[-1] if known else None, "turns": len(set(known)), "paths": paths}
            )
        yield pa.RecordBatch.from_pylist(out, schema=SOLVED)


JOINED = pa.schema([("conv_id", pa.int64())] + [(c, pa.int64()) for c in COUNTS] + [("audit", pa.string()), ("slices", pa.list_(pa.struct([("part", pa.int32()), ("seq", pa.int32()), ("entry", pa.int32()), ("edits", pa.string())])))])
JOINED_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, slices array<struct<part:int,seq:int,entry:int,edits:string>>"


def compose(batches):
    """Of each conversation's solved segments, in order, the cheapest chain, and the counts of the whole."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            parts = row["parts"]
            best = {START: (0, "", [])}
            for p in parts:
                after: dict = {}
                for path in p["paths"]:
                    if path["entry"] in best:
                        cost, audit, slices = best[path["entry"]]
                        new = (cost + path["cost"], audit + path["audit"], [*slices, (path["entry"], path["audit"])])
                        if path["exit"] not in after or new[:2] < after[path["exit"]][:2]:
                            after[path["exit"]] = new
                best = after
            ends = []
            for state, (cost, audit, slices) in best.items():
                more = ""
                while state not in ENDS:
                    more, state = more + "I", NEXT[state][WANTED[state]]
                ends.append((cost + INSERT * len(more), audit + more, [*slices[:-1], (slices[-1][0], slices[-1][1] + more)]))
            cost, audit, slices = min(ends, key=lambda x: x[:2])
            full = [p for p in parts if p["n"]]
            known = [p for p in full if p["low"] is not None]
            distinct = sum(p["turns"] for p in known) - sum(a["high"] == b["low"] for a, b in zip(known, known[1:], strict=False))
            totals = {c: sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated")}
            out.append(
                {"conv_id": row["conv_id"], "gaps": known[-1]["high"] - known[0]["low"] + 1 - distinct if known else 0, "cost": cost, "audit": audit}
                | totals
                | {"illegal": sum(p["illegal"] for p in parts) + sum(illegal([a["last"], b["first"]]) for a, b in zip(full, full[1:], strict=False))}
                | {"slices": [{"part": p["part"], "seq": p["seq"], "entry": e, "edits": a} for p, (e, a) in zip(parts, slices, strict=True)]}
            )
        yield pa.RecordBatch.from_pylist(out, schema=JOINED)


def rewritten(batches):
    """The text that a segment's edits leave, and of how many rows."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            s = row["segment"]
            lines = repaired(list(zip(s["roles"], s["texts"], strict=True)), row["edits"], row["entry"])
            out.append({"conv_id": row["conv_id"], "part": s["part"], "seq": s["seq"], "lines": len(lines), "body": "\n".join(lines).encode()})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("lines", pa.int64()), ("body", pa.binary())]))


def hashed(batches):
    """One digest over the sorted pieces of each conversation, read as a stream."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    conv, sha, empty, any_ = None, hashlib.sha256(), True, False
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if any_ and row["conv_id"] != conv:
                out.append({"conv_id": conv, "repaired_sha256": sha.hexdigest()})
                sha, empty = hashlib.sha256(), True
            conv, any_ = row["conv_id"], True
            if row["lines"]:
                sha.update(row["body"] if empty else b"\n" + row["body"])
                empty = False
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if any_:
        yield pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": sha.hexdigest()}], schema=schema)


def repair_conversations(rows: DataFrame, most_rows: int = 2000, most_bytes: int = 4 << 20) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` per conversation.

    ``rows``: ``conv_id, turn, role, text, gone``; a row that is ``gone`` only says that its conversation
    exists. Rows go by turn, nulls first; those of one turn by role, then by the digest of their text, so that equal
    ones stand together. A null identifier is a conversation of its own; a null role or text counts as one space; an
    empty table gives none. No task holds more of a conversation than a segment of ``most_rows`` rows or about
    ``most_bytes`` (a longer text is one row), or its audit; its digest is made from a stream of segments, since
    SHA-256 has no parts.
    """
    spark = rows.sparkSession
    clean = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.coalesce("gone", F.lit(False)).alias("gone")
    )
    order: list[Column] = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("h")]
    # the row's number only spreads rows that are alike in everything else
    keyed = clean.withColumn("h", F.sha2("text", 256)).withColumn("n", F.monotonically_increasing_id())
    small_batches(spark)
    ranged = keyed.repartitionByRange(parallel(spark), *order, F.col("n")).sortWithinPartitions(*order)
    found = cut(streamed(ranged, most_rows, most_bytes))

    segments = found.where("segment IS NOT NULL").select("conv_id", "segment", "segment.part", "segment.seq")
    each = segments.select("conv_id", F.struct("part", "seq").alias("at"), F.explode(F.array_distinct("segment.digests")).alias("d"))
    first = each.groupBy("conv_id", "d").agg(F.min("at").alias("first"))
    again = each.alias("e").join(first.alias("f"), F.col("e.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("e.d") == F.col("f.d")) & (F.col("e.at") > F.col("f.first")))
    before = again.groupBy(F.col("e.conv_id").alias("conv_id"), F.col("e.at").alias("at")).agg(F.collect_list("e.d").alias("before"))
    known = segments.alias("s").join(before.alias("b"), F.col("s.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.struct("s.part", "s.seq") == F.col("b.at")), "left").select("s.conv_id", "s.segment", "b.before")
    solved = known.mapInArrow(solve, SOLVED_DDL)
    # one conversation's segments: bounded pieces of the answer itself
    parts = solved.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in SOLVED.names if c != "conv_id"]))).alias("parts"))
    joined = cut(parts.mapInArrow(compose, JOINED_DDL))
    slices = joined.select("conv_id", F.explode("slices").alias("c")).select("conv_id", "c.*")
    same = F.col("s.conv_id").eqNullSafe(F.col("c.conv_id")) & (F.col("s.part") == F.col("c.part")) & (F.col("s.seq") == F.col("c.seq"))
    pieces = segments.alias("s").join(slices.alias("c"), same).select("s.conv_id", "s.segment", "c.entry", "c.edits").mapInArrow(rewritten, "conv_id long, part int, seq int, lines long, body binary")
    digests = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(hashed, "conv_id long, repaired_sha256 string")
    cut_ones = joined.alias("j").join(digests.alias("d"), F.col("j.conv_id").eqNullSafe(F.col("d.conv_id"))).select("j.conv_id", *[f"j.{c}" for c in COUNTS], "j.audit", "d.repaired_sha256")
    return found.where("result IS NOT NULL").select("conv_id", "result.*").unionByName(cut_ones)


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of ``conv_id, turn, role, text`` after the damage that the checksum of ``conv_id:turn`` names; nulls are one space."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    base = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(F.concat_ws(":", *said)) % 20).alias("hit"))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    # a dropped row goes on without what it said
    gone = F.col("hit") == 0
    kept = [F.when(~gone, x).alias(n) for x, n in ((F.col("turn"), "turn"), (role, "role"), (text, "text"))]
    return base.select("conv_id", *kept, gone.alias("gone"), F.explode(times)).drop("col")


def op12_conversations(spark, sf_dir):
    return repair_conversations(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: Dynamic programming over (rows read, state) in place of the search; at most two insertions in a row can be of use.
OP12_SQL = """
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
bits AS (
  SELECT *, xor(list_reduce(list_transform(range(1, length(name) + 1), lambda k: CAST(ascii(substr(name, CAST(k AS INTEGER), 1)) AS BIGINT)),
    lambda c, b: list_reduce(range(8), lambda r, z: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END, xor(c, b)),
    4294967295), 4294967295) % 20 AS hit FROM raw),
hurt AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
         CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS again
  FROM bits WHERE hit <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), again) AS i,
         regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS final FROM hurt),
told AS MATERIALIZED (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
              WHEN final NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
  FROM placed),
-- states: 0 nothing yet, 1 after the system message, 2 after a user's, 3 after a pair
ins(q, p, c, a, lines) AS (VALUES (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
  (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (3, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']),
  (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:'])),
step(p, e, q, need) AS (VALUES (0, 'D', 0, ''), (1, 'D', 1, ''), (2, 'D', 2, ''), (3, 'D', 3, ''),
  (0, 'K', 1, 's'), (0, 'K', 2, 'u'), (1, 'K', 2, 'u'), (2, 'K', 3, 'a'), (3, 'K', 2, 'u'),
  (0, 'R', 2, ''), (1, 'R', 2, ''), (2, 'R', 3, ''), (3, 'R', 2, '')),
dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, q, b.cost, b.audit, b.lines FROM (
    SELECT d.conv_id, t.i, s.q, min({'cost': d.cost + n.c + CASE s.e WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN s.e <> 'D' AND t.fault = 't' THEN 5 ELSE 0 END,
        'audit': d.audit || n.a || s.e,
        'lines': list_concat(list_concat(d.lines, n.lines), CASE s.e WHEN 'D' THEN CAST([] AS VARCHAR[]) WHEN 'K' THEN [t.role || ':' || t.text]
          ELSE [CASE WHEN n.p = 2 THEN 'assistant' ELSE 'user' END || ':' || t.text] END)}) AS b
    FROM dp d JOIN told t ON t.conv_id IS NOT DISTINCT FROM d.conv_id AND t.i = d.i + 1
      JOIN ins n ON n.q = d.q JOIN step s ON s.p = n.p
    WHERE (s.e = 'D' OR t.fault NOT IN ('b', 'd')) AND (s.e <> 'K' OR s.need = t.initial)
    GROUP BY d.conv_id, t.i, s.q)),
size AS (SELECT conv_id, max(i) AS n FROM dp GROUP BY conv_id),
best AS (
  SELECT d.conv_id, min({'cost': d.cost + n.c, 'audit': d.audit || n.a, 'lines': list_concat(d.lines, n.lines)}) AS b
  FROM dp d JOIN size z ON z.conv_id IS NOT DISTINCT FROM d.conv_id AND z.n = d.i JOIN ins n ON n.q = d.q
  WHERE n.p IN (0, 3) GROUP BY d.conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM told GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(b.b.cost AS BIGINT) AS cost, b.b.audit AS audit,
       sha256(array_to_string(b.b.lines, chr(10))) AS repaired_sha256
FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id
"""
