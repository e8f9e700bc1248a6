"""Mixing sources to target weights along a time-varying curriculum.

A source has a schedule: its weight at a few knots of training time 0..1, linear between them. The
integral of the schedule up to ``t``, scaled so that all of it is the source's target, is the
demand for the source's tokens by then. A source's documents stand in a fixed pseudo-random order;
the running sum of their sizes is inverted through the demand, which gives each document the time
at which training needs it, and the result is sorted by that position over ranges.

Running sums over a source that holds a third of all rows are made in three levels (two groups of
hash digits, then rows), so that no window holds more than a 16-millionth part of a source.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import cut, documents, utf8

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[int], most: int) -> DataFrame:
    """``source, source_size`` to ``source, source_size, weight, target``.

    Sources in code-point order, null last, weigh ``weights`` again and again and share the sum of
    all sizes. A source takes ``most`` times its size at most; what it can't take is shared by the
    others in the same proportion until nobody is above. That ends at a level which follows from the
    sources in the order of (limit / weight): all before a point are full, all others get
    weight x what is left / weights left. The table has one row per source.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(order - 1, F.lit(len(weights))) + 1)
    ranked = sizes.withColumn("weight", weight.cast("long")).withColumn("limit", F.col("source_size") * most)
    by_fill = Window.orderBy((F.col("limit") / F.col("weight")), F.col("source").asc_nulls_last())
    before, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    weights_left = F.sum("weight").over(after)
    open_ = ranked.withColumn("left", left).withColumn("weights_left", weights_left)
    open_ = open_.withColumn("full", F.col("limit") * F.col("weights_left") <= F.col("weight") * F.col("left"))
    # the first source that isn't full sets the level for all after it
    first = F.max(F.when(~F.col("full"), F.struct("weights_left", "left"))).over(everything)
    share = F.col("weight") * first["left"] / first["weights_left"].cast("double")
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(share)
    return open_.select("source", "source_size", "weight", target.alias("target"))


def needed_at(rows: DataFrame) -> DataFrame:
    """Add ``position``: the time 0..1 at which demand reaches ``offset``.

    ``schedule``: array of weights at evenly spaced knots, linear between them, none negative;
    ``reached``: its integral up to each knot, the first being 0. The piece that holds the offset is
    the number of later knots passed by then; the quadratic on that piece is solved.
    """
    n = F.size("schedule") - 1
    share = F.when(F.col("target") > 0, F.least(F.col("offset") / F.col("target"), F.lit(1.0))).otherwise(F.lit(0.0))
    rows = rows.withColumn("want", share * F.element_at("reached", -1))
    rows = rows.withColumn("i", F.least(F.size(F.filter("reached", lambda x: x < F.col("want"))), n))
    rows = rows.withColumn("i", F.greatest(F.col("i"), F.lit(1)))
    rows = rows.withColumn("a", F.element_at("schedule", F.col("i"))).withColumn("b", F.element_at("schedule", F.col("i") + 1))
    rows = rows.withColumn("left", F.col("want") - F.element_at("reached", F.col("i")))
    rows = rows.withColumn("root", F.col("a") + F.sqrt(F.greatest(F.col("a") * F.col("a") + 2 * (F.col("b") - F.col("a")) * F.col("left"), F.lit(0.0))))
    inside = F.when(F.col("root") > 0, F.least(2 * F.col("left") / F.col("root"), F.lit(1.0))).otherwise(F.lit(0.0))
    rows = rows.withColumn("position", (F.col("i") - 1 + inside) / n)
    return rows.drop("want", "i", "a", "b", "left", "root")


def reached(schedule: list[float]) -> list[float]:
    """The integral of a schedule up to each of its knots, in units of one piece."""
    out = [0.0]
    for a, b in zip(schedule, schedule[1:], strict=False):
        out.append(out[-1] + (a + b) / 2)
    return out


def running_offsets(rows: DataFrame) -> DataFrame:
    """Add ``offset``: the sizes of the rows of the same source that come before, in hash order."""
    own = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("null "), F.col("th").cast("string")))
    rows = rows.withColumn("h", F.md5(own))
    rows = rows.withColumn("b1", F.substring("h", 1, 3)).withColumn("b2", F.substring("h", 4, 3))
    leaf = rows.groupBy("source", "b1", "b2").agg(F.sum("size").alias("s"))
    top = leaf.groupBy("source", "b1").agg(F.sum("s").alias("s"))

    def earlier(w):
        return F.coalesce(F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    top = top.select("source", "b1", earlier(Window.partitionBy("source").orderBy("b1")).alias("o1"))
    leaf = leaf.select("source", "b1", "b2", earlier(Window.partitionBy("source", "b1").orderBy("b2")).alias("o2"))
    leaf = (
        leaf.alias("l")
        .join(top.alias("t"), [F.col("l.source").eqNullSafe(F.col("t.source")), F.col("l.b1").eqNullSafe(F.col("t.b1"))])
        .select("l.source", "l.b1", "l.b2", (F.col("o1") + F.col("o2")).alias("o"))
    )
    inside = Window.partitionBy("source", "b1", "b2").orderBy(F.col("h").asc_nulls_last(), F.col("id").asc_nulls_last(), "size", "th").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("o3", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return (
        rows.alias("r")
        .join(leaf.alias("l"), [F.col("r.source").eqNullSafe(F.col("l.source")), F.col("r.b1").eqNullSafe(F.col("l.b1")), F.col("r.b2").eqNullSafe(F.col("l.b2"))])
        .select("r.id", "r.source", "r.size", "r.th", (F.col("o") + F.col("o3")).alias("offset"))
    )


def planned(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: list[int] | None = None, most: int = 3, schedules: list[list[float]] | None = None) -> DataFrame:
    """What ``mix`` says of each document but its position, and what positions are made of; ``th`` is the text's hash."""
    weights = weights or [1, 2, 3]
    schedules = schedules or [[1.0, 1.0], [1.5, 1.0, 0.5], [0.5, 1.0, 1.5]]
    rows = cut(docs.select(F.col(key).alias("id"), F.col(source).alias("source"), word_count(text).alias("size"), F.xxhash64(utf8(text)).alias("th")))
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(schedules))) + 1

    def table(lists):
        return F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in lists])

    plan = plan.withColumn("turn", turn)
    plan = plan.withColumn("schedule", F.element_at(table(schedules), F.col("turn")))
    plan = cut(plan.withColumn("reached", F.element_at(table([reached(s) for s in schedules]), F.col("turn"))).drop("turn"))
    placed = running_offsets(rows)
    both = placed.alias("p").join(plan.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source"))).select("id", "p.source", "size", "th", "offset", "source_size", "target", "schedule", "reached")
    stop = F.floor(F.col("target") + 0.5).cast("long")
    taken = copies = F.lit(0).cast("long")
    for k in range(most):
        part = F.greatest(F.lit(0), F.least(F.col("size"), stop - F.col("source_size") * k - F.col("offset"))).cast("long")
        taken = taken + part
        copies = copies + F.when((F.col("size") > 0) & (part * 2 >= F.col("size")), 1).otherwise(0)
    copies = F.when(F.col("size") == 0, F.when(F.col("offset") < F.greatest(stop, F.lit(1)), 1).otherwise(0)).otherwise(copies)
    return both.withColumn("taken", taken).withColumn("copies", copies.cast("int"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: list[int] | None = None, most: int = 3, schedules: list[list[float]] | None = None) -> DataFrame:
    """One row per document, in training order: ``id, source, size, source_size, target, taken, copies, position``.

    Documents of a source are read in a fixed order, pass after pass, until its target is met to the
    word: ``taken`` is what all passes take of the document, at most ``most`` times its size. ``copies``
    is the same in whole documents (halves round up; a document without words counts in the first
    pass), ``position`` the time at which the first of them is due. ``schedules`` belong to the
    sources in turn, as ``weights`` do; each is scaled to the source's target.

    Nulls: a text has no words, a source is one more source, an identifier gets its place from the text. Rows that
    repeat an identifier are counted each; equal rows get offsets in either order. Empty tables give
    an empty result, and other columns are not looked at.
    """
    done = needed_at(planned(docs, key, text, source, weights, most, schedules))
    return done.select("id", "source", "size", "source_size", "target", "taken", "copies", "position").orderBy("position", "id")


def passes(plan: DataFrame) -> DataFrame:
    """One row per copy of what ``planned`` gives: ``pass`` from 0, and the ``position`` at which that copy is due.

    A pass begins where the one before has ended, so that its offsets are whole sources further on.
    """
    each = plan.where("copies > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return needed_at(each.withColumn("offset", F.col("offset") + F.col("pass") * F.col("source_size")))


def op3_mixing(spark, sf_dir):
    return mix(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP3_SQL = """
WITH d AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source),
f AS (
  SELECT *, 3 * source_size AS lim,
         (sum(source_size) OVER ())
           - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST
                      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_left
  FROM s),
g AS (SELECT *, lim * weights_left <= weight * rest AS is_full FROM f),
l AS (SELECT max(weights_left) AS wl, arg_max(rest, weights_left) AS r FROM g WHERE NOT is_full),
t AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN CAST(lim AS DOUBLE) ELSE CAST(weight * r AS DOUBLE) / CAST(wl AS DOUBLE) END AS target
  FROM g LEFT JOIN l ON true),
o AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS stop,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id, d.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       greatest(0, least(size, stop - off)) + greatest(0, least(size, stop - source_size - off))
         + greatest(0, least(size, stop - 2 * source_size - off)) AS taken
FROM o
"""
