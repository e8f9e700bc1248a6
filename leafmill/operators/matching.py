"""Joins by label, value and evidence.

Specifications and hints are a caller's short list and are broadcast only after they have been
counted; candidates and lines are the large sides and are never sent anywhere whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import blank, comparable, dashes, evidence_key, or_, rank_of
from leafmill.operators.containment import contained, either_way

#: Rows of a caller's list that may be broadcast.
SHORT_LIST = 10_000


def with_list(rows: DataFrame, listed: DataFrame, on, how: str = "inner", keyed: bool = False) -> DataFrame:
    """Join to a caller's list: broadcast if it is counted to be short, else shuffled if the condition is ``keyed``, an equality.

    A longer list without one would be a cross join of two large tables, which is refused.
    """
    short = listed.limit(SHORT_LIST + 1).count() <= SHORT_LIST
    if not short and not keyed:
        raise ValueError(f"a list of more than {SHORT_LIST} rows needs an equality to join by")
    return rows.join(F.broadcast(listed) if short else listed, on, how)


def either_contains(a: Column, b: Column) -> Column:
    """Containment one way or the other; the empty text is in every text."""
    return a.contains(b) | b.contains(a)


def either_join(hay: DataFrame, listed: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct texts ``a`` with the rows of a list whose ``b`` contains them or is contained.

    A list that is counted to be short is broadcast; a longer one is joined by shared representatives.
    """
    if listed.limit(SHORT_LIST + 1).count() <= SHORT_LIST:
        return hay.join(F.broadcast(listed), either_contains(F.col(a), F.col(b)))
    pairs = either_way(hay.select(F.col(a).alias("text")), listed.select(F.col(b).alias("text"))).select(F.col("left").alias(a), F.col("right").alias(b))
    return hay.join(pairs, a).join(listed, b)


def patterns(specs: DataFrame, name: str = "name", pattern: str = "label_pattern") -> DataFrame:
    """A row per ``|``-separated pattern of a specification."""
    each = F.explode(F.split(or_(pattern, name), r"\|"))
    return specs.select(F.col(name).alias("spec"), "ord", each.alias("p")).withColumn("p", comparable("p"))


def match_specs(candidates: DataFrame, specs: DataFrame, key: list[str]) -> DataFrame:
    """Candidates of each specification: a pattern and name plus label contain one another.

    Candidates are first reduced to their distinct texts, which is what is compared with the list.
    """
    hay = comparable(F.concat(blank("name"), blank("label")))
    c = candidates.withColumn("hay", hay)
    distinct = c.select("hay").distinct()
    hits = either_join(distinct, patterns(specs), "hay", "p").select("hay", "spec", "ord").distinct()
    return c.join(hits, "hay").drop("hay")


def first_match(candidates: DataFrame, specs: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of a specification's candidates within ``key`` the first."""
    place = F.row_number().over(Window.partitionBy(*key, "spec").orderBy(*order))
    return match_specs(candidates, specs, key).withColumn("place", place).where("place = 1").drop("place")


def attention_candidates(candidates: DataFrame, hints: DataFrame, key: list[str]) -> DataFrame:
    """Hint and candidate pairs: an alias and name, label and value contain one another."""
    c = candidates.withColumn("hay", comparable(F.concat(blank("name"), blank("label"), blank("value"))))
    alias = hints.select(F.col("name").alias("hint"), "required", F.explode("aliases").alias("alias")).withColumn("alias", comparable("alias"))
    hits = either_join(c.select("hay").distinct(), alias, "hay", "alias").select("hay", "hint").distinct()
    return c.join(hits, "hay").drop("hay")


def attention_status(candidates: DataFrame, hints: DataFrame, sources: DataFrame, key: list[str]) -> DataFrame:
    """A row per source and hint: how many candidates, whether matched, whether to review."""
    found = attention_candidates(candidates, hints, key).groupBy(*key, "hint").agg(F.count(F.lit(1)).alias("n"))
    every = with_list(sources.select(*key).distinct(), hints.select(F.col("name").alias("hint"), "required"), F.lit(True))
    both = every.join(found, [*key, "hint"], "left")
    n = F.coalesce("n", F.lit(0))
    return both.select(*key, "hint", n.alias("candidates"), (n > 0).alias("matched"), (F.coalesce("required", F.lit(False)) & (n == 0)).alias("needs_review"))


def value_is_valid(value: Column, required: Column) -> Column:
    """A blank value is valid only where it isn't required; uncertain marks never are."""
    v = blank(value)
    return F.when(F.trim(v) == "", F.coalesce(~required, F.lit(False))).otherwise(~v.contains("[?]"))


def map_fields(matches: DataFrame, specs: DataFrame, sources: DataFrame, key: list[str]) -> DataFrame:
    """Requested fields: the values found, the best of them, and what that is worth.

    ``matches``: a specification's candidates (``value``, ``confidence``, ``ord_in``). Best is the first
    valid value without an uncertain mark, else the first; several distinct values are a conflict, which
    makes the confidence low; verified needs a high one.
    """
    seen = F.array_sort(F.collect_list(F.struct("ord_in", F.trim("value").alias("v"))))
    per = matches.where(F.trim(blank("value")) != "").groupBy(*key, "spec").agg(seen.alias("seen"), F.max(rank_of("confidence")).alias("rank"))
    every = with_list(sources.select(*key).distinct(), specs.select(F.col("name").alias("spec"), "required"), F.lit(True))
    m = every.join(per, [*key, "spec"], "left").withColumn("values", F.array_distinct(F.transform(F.coalesce("seen", F.array().cast("array<struct<ord_in:bigint,v:string>>")), lambda x: x["v"])))
    sure = F.filter("values", lambda v: ~v.contains("[?]"))
    m = m.withColumn("value", F.coalesce(F.get(sure, F.lit(0)), F.get("values", F.lit(0)), F.lit("")))
    valid = value_is_valid(F.col("value"), F.col("required"))
    m = m.withColumn("conflict", F.size("values") > 1).withColumn("valid", valid)
    level = F.when(~F.col("valid") | F.col("conflict"), "low").when(F.col("rank") == 3, "high").when(F.col("rank") == 2, "medium").otherwise("low")
    m = m.withColumn("confidence", level)
    verified = (F.col("value") != "") & F.col("valid") & (F.col("confidence") == "high") & ~F.col("conflict")
    needed = F.coalesce("required", F.lit(True)) & ((F.col("value") == "") | ~F.col("valid") | F.col("conflict"))
    return m.select(*key, "spec", "value", F.size("values").alias("n_values"), "conflict", "confidence", verified.alias("verified"), (~verified).alias("needs_review"), needed.alias("required_unverified"))


def quality_gate(mapped: DataFrame, key: list[str], most: int = 0) -> DataFrame:
    """Required specifications without a verified page, counted against ``most``."""
    per = mapped.where(F.coalesce("required", F.lit(True))).groupBy(*key, "spec").agg(F.bool_or("verified").alias("ok"))
    return per.groupBy(*key).agg(F.count_if(~F.col("ok")).alias("unverified")).withColumn("passed", F.col("unverified") <= most)


def orphan_values(typed: DataFrame, candidates: DataFrame, key: list[str], most: int = 200) -> DataFrame:
    """Typed values that no candidate has, at most ``most`` per key in order."""
    known = candidates.select(*key, comparable("value").alias("k")).distinct()
    left = typed.withColumn("k", comparable("value")).join(known, [*key, "k"], "left_anti").drop("k")
    place = F.row_number().over(Window.partitionBy(*key).orderBy("idx"))
    return left.withColumn("place", place).where(F.col("place") <= most).drop("place")


def unmapped(candidates: DataFrame, mapped: DataFrame, key: list[str]) -> DataFrame:
    """Candidates that no mapped field has used."""
    return candidates.join(mapped.select(*key, "candidate_key").distinct(), [*key, "candidate_key"], "left_anti")


def link_entities(candidates: DataFrame, entities: DataFrame, key: list[str]) -> DataFrame:
    """Each candidate with the first entity of the same comparable value."""
    e = entities.withColumn("k", comparable("value")).groupBy(*key, "k").agg(F.min_by("id", "idx").alias("entity_id"))
    return candidates.withColumn("k", comparable("value")).where("k <> ''").join(e, [*key, "k"]).drop("k")


def resolve_targets(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """A target given as "type:value" becomes the entity's identifier, others stay."""
    e = entities.select(F.concat_ws(":", "type", "value").alias("to"), F.col("id").alias("target")).groupBy("to").agg(F.min("target").alias("target"))
    return relationships.join(e, "to", "left").withColumn("to", F.coalesce("target", "to")).drop("target")


def read_members(fields: DataFrame, specs: DataFrame, key: list[str]) -> DataFrame:
    """A value by exact name, else by the name in any case."""
    exact = fields.groupBy(*key, F.col("name").alias("spec")).agg(F.min_by("value", "idx").alias("exact"))  # the first of a name that repeats
    loose = fields.groupBy(*key, F.lower("name").alias("l")).agg(F.min_by("value", "idx").alias("loose"))
    every = with_list(fields.select(*key).distinct(), specs.select(F.col("name").alias("spec")), F.lit(True)).withColumn("l", F.lower("spec"))
    return every.join(exact, [*key, "spec"], "left").join(loose, [*key, "l"], "left").select(*key, "spec", F.coalesce("exact", "loose").alias("value"))


def merge_passes(native: DataFrame, review: DataFrame, key: list[str]) -> DataFrame:
    """Two extractions of a field: native accepted, review accepted, native non-empty, review non-empty."""
    n = native.select(*key, F.col("value").alias("nv"), F.col("accepted").alias("na"))
    r = review.select(*key, F.col("value").alias("rv"), F.col("accepted").alias("ra"))
    full = lambda c: F.nullif(F.trim(blank(c)), F.lit(""))
    value = F.coalesce(F.when(F.col("na"), full("nv")), F.when(F.col("ra"), full("rv")), full("nv"), full("rv"), F.lit(""))
    source = F.when(F.col("na") & full("nv").isNotNull(), "native").when(F.col("ra") & full("rv").isNotNull(), "review").when(full("nv").isNotNull(), "native").when(full("rv").isNotNull(), "review").otherwise("none")
    return n.join(r, key, "full").select(*key, value.alias("value"), source.alias("value_source"))


def swap_fallback(layout: DataFrame, fields: DataFrame, key: list[str]) -> DataFrame:
    """Layout values replaced by field values, except where the latter only repeat the label."""
    both = layout.join(fields.select(*key, F.col("value").alias("fv"), F.col("confidence").alias("fc")), key, "left")
    same = F.lower(F.trim(blank("fv"))) == F.lower(F.trim(blank("label")))
    use = F.col("fv").isNotNull() & (F.trim("fv") != "") & ~same
    return both.select(*key, "label", F.when(use, F.col("fv")).otherwise(F.col("value")).alias("value"), F.when(use, F.col("fc")).otherwise(F.col("confidence")).alias("confidence"))


def undo_label_swaps(validated: DataFrame, layout: DataFrame, key: list[str]) -> DataFrame:
    """Validated values that only repeat their label get the layout's value back."""
    seen = layout.groupBy(*key).agg(F.min_by(F.struct("label", F.col("value").alias("v")), "idx").alias("l"))
    both = validated.join(seen, key, "left")
    label = F.lower(F.trim(blank("l.label")))
    swapped = (F.trim(blank("value")) != "") & (label != "") & (F.lower(F.trim(blank("value"))) == label)
    return both.withColumn("value", F.when(swapped, F.col("l.v")).otherwise(F.col("value"))).drop("l")


def correct_values(original: DataFrame, corrected: DataFrame, key: list[str]) -> DataFrame:
    """A second pass: a correction counts if it isn't blank, differs, and doesn't rewrite the value.

    Rewriting is a new first character together with a new length or more than 4 characters. Names that
    only the correction has are added.
    """
    o, c = original.select(*key, F.col("value").alias("o"), F.lit(True).alias("had")), corrected.select(*key, F.col("value").alias("c"))
    both = o.join(c, key, "full")
    old, new = F.trim(blank("o")), F.trim(blank("c"))
    rewrite = (F.substring(old, 1, 1) != F.substring(new, 1, 1)) & ((F.length(old) != F.length(new)) | (F.length(old) > 4))
    take = (new != "") & (new != old) & (F.col("had").isNull() | ~rewrite)
    return both.select(*key, F.when(take, new).otherwise(F.col("o")).alias("value"), take.alias("corrected"))


def adopt_crops(fields: DataFrame, crops: DataFrame, key: list[str]) -> DataFrame:
    """A crop's value is taken if it isn't empty and is valid, or what there was is no good."""
    both = fields.join(crops.select(*key, F.col("value").alias("cv")), key, "left")
    new, old = F.trim(blank("cv")), F.trim(blank("value"))
    valid = lambda v: (v != "") & ~v.contains("[?]")
    take = (new != "") & (valid(new) | ~valid(old))
    return both.select(*key, F.when(take, new).otherwise(F.col("value")).alias("value"), take.alias("from_crop"))


def spec_values(candidates: DataFrame, specs: DataFrame, key: list[str]) -> DataFrame:
    """Full-page mapping: the first matching raw field; verified if its confidence is high and it is valid."""
    hit = first_match(candidates, specs, key, ["idx"])
    every = with_list(candidates.select(*key).distinct(), specs.select(F.col("name").alias("spec"), "required"), F.lit(True))
    both = every.join(hit.select(*key, "spec", "value", "confidence"), [*key, "spec"], "left")
    value = dashes(blank("value"))
    return both.select(*key, "spec", value.alias("value"), F.coalesce("confidence", F.lit("low")).alias("confidence"), ((F.col("confidence") == "high") & value_is_valid(value, F.col("required")) & (value != "")).alias("verified"))


def contains_joins(lines: DataFrame, values: DataFrame, line: str, value: str, few: int = 1000) -> DataFrame:
    """Pairs of a large table of texts and one of values that they contain, by evidence keys.

    Up to ``few`` values, counted, are broadcast and looked for in each text. Beyond that ``contains``
    would compare all with all, so distinct texts are joined by representatives that they share. Columns of both sides are kept; the keys
    are ``__line`` and ``__value``.
    """
    v = values.withColumn("__value", evidence_key(value)).where("__value <> ''")
    t = lines.withColumn("__line", evidence_key(line))
    if v.limit(few + 1).count() <= few:
        return t.join(F.broadcast(v), F.col("__line").contains(F.col("__value")))
    pairs = contained(t.select(F.col("__line").alias("text")), v.select(F.col("__value").alias("text"))).select(F.col("longer").alias("__line"), F.col("shorter").alias("__value"))
    return t.join(pairs, "__line").join(v, "__value")


def find_evidence(values: DataFrame, first: DataFrame, full: DataFrame, parsed: DataFrame, key: list[str]) -> DataFrame:
    """Where a value is confirmed: the first line that has it, else the whole text, else the parsed text."""
    v = values.withColumn("k", evidence_key("value")).where("k <> ''")
    line = v.join(first, key).where(evidence_key("line").contains(F.col("k"))).groupBy(*key, "name").agg(F.min_by("line", "line_no").alias("evidence_line"))
    whole = v.join(full, key).where(evidence_key("text").contains(F.col("k"))).select(*key, "name", F.lit(True).alias("in_text")).distinct()
    said = v.join(parsed, key).where(evidence_key("parsed").contains(F.col("k"))).select(*key, "name", F.lit(True).alias("in_parsed")).distinct()
    both = values.join(line, [*key, "name"], "left").join(whole, [*key, "name"], "left").join(said, [*key, "name"], "left")
    where = F.when(F.col("evidence_line").isNotNull(), "line").when(F.col("in_text"), "text").when(F.col("in_parsed"), "parsed")
    return both.select(*key, "name", "value", "evidence_line", where.alias("evidence_source"), where.isNotNull().alias("found"))
