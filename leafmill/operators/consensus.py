"""Votes and passes: distances, entropy, weighted and dual-pass decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import blank, col


def distance_ratio(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def entropy(votes: Column) -> Column:
    """The mean distance ratio over the pairs of a field's votes; 0 for one vote.

    A field's votes are as many as there were model calls: a handful, so that their pairs are made in
    the row.
    """
    n = F.size(votes)
    pairs = F.flatten(F.transform(votes, lambda a, i: F.transform(F.slice(votes, i + 2, n), lambda b: distance_ratio(a, b))))
    return F.when(n <= 1, F.lit(0.0)).otherwise(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / F.size(pairs))


def clean_vote(x) -> Column:
    """Without quotes and white space at the ends, then without fenced blocks, runs of line ends as one."""
    v = F.regexp_replace(blank(x), r"""(?U)^["'\s\uFEFF]+|["'\s\uFEFF]+$""", "")
    v = F.regexp_replace(F.regexp_replace(v, r"(?s)```.*?```", ""), r"\n{2,}", "\n")
    return F.regexp_replace(v, r"(?U)^[\s\uFEFF]+|[\s\uFEFF]+$", "")


#: What makes a vote uncertain (fixed values).
UNCERTAIN = "(?i)\\?|�|unclear|uncertain|maybe|perhaps"


def vote_weight(raw: Column, temperature: Column) -> Column:
    doubt = F.when(blank(raw).rlike(UNCERTAIN), 0.3).otherwise(1.0)
    brief = F.least(F.lit(1.0), F.lit(20.0) / F.greatest(F.length(blank(raw)), F.lit(1)))
    return doubt * brief * F.when(temperature < 0.3, 1.2).otherwise(1.0)


def weighted_vote(votes: DataFrame, keys: list[str]) -> DataFrame:
    """The value with the largest weight; numbers that tie go by size, others by first appearance."""
    v = votes.withColumn("value", clean_vote("raw")).withColumn("w", vote_weight(F.col("raw"), F.col("temperature")))
    per = v.where("value <> ''").groupBy(*keys, "value").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"), F.min("vote_idx").alias("seen"))
    number = F.when(F.col("value").rlike(r"^(0|[1-9]\d{0,8})$"), F.col("value").cast("long"))
    first = F.struct(F.round("w", 9).alias("w"), (-F.coalesce(number, F.lit(10**10))).alias("num"), (-F.col("seen")).alias("seen"))
    best = F.max_by(F.struct("value", "n", "w"), first)
    out = per.groupBy(*keys).agg(best.alias("b"), F.sum("w").alias("all"), F.sum("n").alias("votes"), F.count(F.lit(1)).alias("distinct"))
    return out.select(*keys, F.col("b.value").alias("value"), F.col("b.n").alias("frequency"), (F.col("b.w") / F.col("all")).alias("agreement"), (F.col("distinct") == 1).alias("unanimous"), "votes")


def vote_entropy(per: DataFrame, keys: list[str], block: int = 64) -> DataFrame:
    """``keys, entropy``: the mean distance ratio over all pairs of a field's votes, however many there are.

    ``per``: distinct values and how often each was voted (``n``). Equal votes are at distance 0, so that
    only distinct values are paired, in blocks of about ``block`` that spread over tasks.
    """
    sizes = per.groupBy(*keys).agg(F.sum("n").alias("all"), F.max(F.col("value").isNull()).alias("unknown"), F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    placed = per.join(sizes.select(*keys, "blocks"), keys).withColumn("block", F.pmod(F.xxhash64("value"), "blocks"))
    packs = placed.groupBy(*keys, "blocks", "block").agg(F.collect_list(F.struct("value", "n")).alias("mine"))
    a = packs.withColumn("other", F.explode(F.sequence("block", F.col("blocks") - 1))).select(*keys, "block", "other", "mine")
    b = packs.select(*keys, F.col("block").alias("other"), F.col("mine").alias("theirs"))
    inner = lambda x: F.aggregate("theirs", F.lit(0.0), lambda s, y: s + x["n"] * y["n"] * distance_ratio(x["value"], y["value"]))
    apart = F.aggregate("mine", F.lit(0.0), lambda s, x: s + inner(x)) / F.when(F.col("block") == F.col("other"), 2).otherwise(1)
    sums = a.join(b, [*keys, "other"]).select(*keys, apart.alias("apart")).groupBy(*keys).agg(F.sum("apart").alias("apart"))
    mean = F.when(F.col("all") <= 1, 0.0).when(~F.col("unknown"), F.col("apart") / (F.col("all") * (F.col("all") - 1.0) / 2))
    return sizes.join(sums, keys).select(*keys, mean.alias("entropy"))


def analyze_consensus(votes: DataFrame, keys: list[str], review_above: float = 0.5) -> DataFrame:
    """Entropy, weighted mode and what they are worth."""
    w = F.col("weight") if "weight" in votes.columns else F.lit(1.0)
    per = votes.groupBy(*keys, "value").agg(F.sum(w).alias("w"), F.count(F.lit(1)).alias("n"), F.min("vote_idx").alias("seen"))
    e = vote_entropy(per, keys)
    mode = per.groupBy(*keys).agg(F.max_by(F.struct("value", "w"), F.struct("w", (-F.col("seen")).alias("s"))).alias("b"), F.sum("w").alias("all"))
    agreement = F.col("b.w") / F.col("all")
    level = F.when((F.col("entropy") < 0.15) & (agreement > 0.66), "high").when(F.col("entropy") < 0.4, "medium").otherwise("low")
    return e.join(mode, keys).select(*keys, F.col("b.value").alias("value"), "entropy", agreement.alias("agreement"), level.alias("confidence"), ((F.col("entropy") > review_above) | (agreement < 0.5)).alias("needs_review"))


def two_source_entropy(a: Column, b: Column, conf_a: Column, conf_b: Column) -> Column:
    """Distance of two readings plus a penalty for each one's confidence; 1 if neither has any."""
    x, y = F.trim(blank(a)), F.trim(blank(b))
    fine = lambda c: F.when(c == "low", 0.3).when(c == "medium", 0.15).otherwise(0.0)
    return F.when((x == "") & (y == ""), 1.0).otherwise(F.least(F.lit(1.0), distance_ratio(x, y) + fine(conf_a) + fine(conf_b)))


def table_entropy(value: Column) -> Column:
    return F.when(F.trim(blank(value)) != "", 0.1).otherwise(1.0)


def is_uncertain(value, confidence, required) -> Column:
    """Whether a field needs its second pass."""
    from leafmill.operators.matching import value_is_valid

    v = blank(value)
    return v.contains("[?]") | (F.trim(v) == "") | (F.coalesce(col(confidence), F.lit("low")) == "low") | ~value_is_valid(v, col(required))


def dual_pass(passes: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """Passes merged: unanimous; else the longer of two close ones; else the most frequent.

    Valid values are preferred if there are any. Confidence goes by agreement: all, half, less.
    """
    has = F.array_sort(F.collect_list(F.when(F.trim(blank("value")) != "", F.struct("pass_idx", F.trim("value").alias("v")))))
    p = passes.groupBy(*keys).agg(F.transform(has, lambda x: x["v"]).alias("all"))
    valid = F.filter("all", lambda v: ~v.contains("[?]"))
    p = p.withColumn("valid", F.size(valid) > 0).withColumn("c", F.when(F.size(valid) > 0, valid).otherwise(F.col("all")))
    distinct = F.array_distinct("c")
    counts = F.transform(distinct, lambda v, i: F.struct(F.size(F.filter("c", lambda x: x == v)).alias("n"), (-i).alias("first"), v.alias("v")))
    p = p.withColumn("top", F.array_max(counts)).withColumn("distinct", distinct)
    n = F.size("c")
    one = (F.size("distinct") == 1) & (n >= least) & F.col("valid")
    agreement = F.when(n == 0, 0.0).otherwise(F.col("top.n") / n)
    a, b = F.get("c", F.lit(0)), F.get("c", F.lit(1))
    several = F.when(F.levenshtein(a, b) <= 1, F.when(F.length(b) > F.length(a), b).otherwise(a)).otherwise(F.col("top.v"))
    best = F.when(n >= 2, F.when(one, a).otherwise(several)).otherwise(F.coalesce(a, F.lit("")))
    level = F.when(one, "high").when(agreement >= 0.5, "medium").otherwise("low")
    return p.select(*keys, best.alias("value"), n.alias("candidates"), agreement.alias("agreement"), one.alias("unanimous"), level.alias("confidence"), one.alias("verified"))
