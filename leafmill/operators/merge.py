"""Pages to documents: merges, first and last wins, records, roll-ups, identifiers, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import blank, comparable, let, or_, rank_of
from leafmill.functions.tokens import js_round
from leafmill.operators.normalize import explode_list
from leafmill.operators.recurrences import Packing, recur
from leafmill.shared import running_before


def first_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order.

    In the order of columns that is the row with the least of these, found by an aggregate that combines
    before the shuffle; only other orders need a key's rows together.
    """
    rest = [f"`{c}`" for c in rows.columns if c not in keys]
    if rest and all(isinstance(o, str) for o in order):
        first = F.min_by(F.struct(*rest), F.struct(*order))
        return rows.groupBy(*keys).agg(first.alias("__first")).select(*keys, "__first.*").select(*[f"`{c}`" for c in rows.columns])
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def unique_by(rows: DataFrame, key: str, order: list) -> DataFrame:
    """First wins, rows without a key dropped."""
    return first_wins(rows.where(F.col(key).isNotNull() & (F.col(key) != "")), [key], order)


def field_name(name="field_name_model", label="label_original", ident="field_id") -> Column:
    return or_(name, label, ident)


def final_fields(pages: DataFrame) -> DataFrame:
    """A document's final fields: the first of a name over pages and places.

    One aggregation with map-side combining: the smallest (page, place) carries its value along.
    """
    f = explode_list(pages, "fields")
    value = F.struct("value_original", "value_normalized", F.col("label_original").alias("label"), "confidence", "needs_review")
    first = F.min_by(F.struct(F.col("page").alias("source_page"), value.alias("v")), F.struct("page", "place"))
    return f.groupBy("source_path", field_name().alias("name")).agg(first.alias("w")).select("source_path", "name", "w.source_page", "w.v.*")


def accepted_fields(values: DataFrame) -> DataFrame:
    """``field, value, verified``: fields with exactly one distinct verified value."""
    ok = values.where(F.col("verified") & (F.trim("value") != ""))
    return ok.groupBy("doc", "field").agg(F.count_distinct("value").alias("n"), F.min("value").alias("value")).where("n = 1").drop("n")


def best_over_pages(values: DataFrame) -> DataFrame:
    """The best value of a field over pages and whether there are several."""
    best = F.max_by("value", F.struct(rank_of("confidence").alias("r"), (-F.col("page")).alias("p")))
    return values.where(F.trim("value") != "").groupBy("doc", "field").agg(best.alias("value"), (F.count_distinct("value") > 1).alias("conflict"))


def documents(pages: DataFrame) -> DataFrame:
    """One row per source: counts, token sums, errors and review flag. Partial sums before the shuffle."""
    calls = F.sum(F.lit(1).cast("long"))
    return pages.groupBy("source_path").agg(
        calls.alias("total_api_calls"),
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("total_tokens"),
        F.sum(F.coalesce("elapsed_ms", F.lit(0))).alias("elapsed_ms"),
        F.count(F.lit(1)).alias("page_count"),
        F.sort_array(F.collect_list("page")).alias("pages"),
        F.bool_or("review_required").alias("review_required"),
        F.bool_and("parsed").alias("success"),
        F.sort_array(F.collect_list(F.when(~F.col("parsed"), F.col("page")))).alias("failed_pages"),
    )


def detected_documents(pages: DataFrame) -> DataFrame:
    """One detected document per page, numbered in the order of source and page."""
    # numbers over all pages need their counts before each source, not all rows in one task
    start = running_before(pages.groupBy("source_path").agg(F.count(F.lit(1)).alias("n")), ["source_path"], F.col("n"), "before").drop("n")
    place = F.row_number().over(Window.partitionBy("source_path").orderBy("page"))
    c = F.col("classification")
    # members are taken before the numbering, which would keep the classification whole
    rows = pages.select("source_path", "page", c["type"].alias("document_type"), *[c[n].alias(n) for n in ("confidence", "reason", "needs_review")])
    number = F.format_string("doc_%05d", (F.col("before") + F.col("place")).cast("int"))
    return rows.withColumn("place", place).join(start, "source_path").select(number.alias("document_id"), "source_path", "page", "document_type", "confidence", "reason", "needs_review")


def grouped_documents(rows: DataFrame, most: int = 20) -> DataFrame:
    """First version: by source and type, distinct sorted pages, at most ``most`` reasons, the first confidence."""
    return rows.groupBy("source_file", "type").agg(
        F.array_sort(F.collect_set("page")).alias("pages"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.struct("page", "reason"))), lambda x: x["reason"]), 1, most).alias("reasons"),
        F.min_by("confidence", "page").alias("confidence"),
    )


def record_list() -> Column:
    """A page's records: those of the model if it has any, else one of its fields, the last of a name winning; an item per field."""
    c = F.col("classification")
    page = F.concat(F.lit("page_"), F.col("page").cast("string"))
    kind, level = c["type"], c["confidence"]
    LOOSE = "map<string,string>"

    def of_fields(fields):
        named = F.transform(fields, lambda f: F.struct(or_(f["field_name_model"], f["label_original"], f["field_id"]).alias("name"), f["value_original"].alias("value")))
        # the last of a name: nothing after it has the same
        last = lambda xs: let(F.reverse(xs["name"]), lambda ns: F.filter(xs, lambda x, i: F.array_position(ns, x["name"]) == F.size(ns) - i))
        return F.transform(let(named, last), lambda x: F.struct(page.alias("record_id"), kind.alias("record_type"), level.alias("confidence"), x["name"].alias("name"), x["value"].alias("value")))

    def of_record(r, i):
        def members_of(m):
            ident = F.coalesce(m["record_id"], F.concat(page, F.lit("_"), (i + 1).cast("string")))
            given = F.map_entries(F.from_json(F.coalesce(m["fields"], F.lit("{}")), LOOSE))
            return F.transform(given, lambda e: F.struct(ident.alias("record_id"), F.coalesce(m["record_type"], kind).alias("record_type"), F.coalesce(m["confidence"], level).alias("confidence"), e["key"].alias("name"), e["value"].alias("value")))

        return let(F.from_json(r, LOOSE), members_of)

    return F.when(F.size("records") > 0, F.flatten(F.transform("records", of_record))).otherwise(of_fields(F.col("fields")))


def integrated_records(pages: DataFrame) -> DataFrame:
    """:func:`record_list` as rows: ``record_id, source_path, page, record_type, confidence, needs_review, name, value``."""
    # one list a page, exploded once, so that a page is made once; the outer form as in explode_list
    rows = record_list()
    review = F.exists("issues", lambda x: x["severity"] != "low").alias("needs_review")
    each = pages.select("source_path", "page", review, F.posexplode_outer(rows).alias("place", "r")).where("place is not null")
    return each.select("source_path", "page", "r.record_type", "r.confidence", "needs_review", "r.record_id", "r.name", "r.value")


def surrogate_ids(rows: DataFrame, prefix: str, given: str, order: list, keys: list[str] | None = None) -> DataFrame:
    """``ent_00001`` and so on where the identifier is missing, numbered within ``keys`` in order.

    Without ``keys`` the numbers run over all rows, counted range by range.
    """
    if keys:
        numbered = rows.withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    else:
        numbered = running_before(rows, order, F.lit(1), "__place").withColumn("__place", F.col("__place") + 1)
    return numbered.withColumn("id", F.coalesce(F.nullif(F.col(given), F.lit("")), F.format_string(f"{prefix}_%05d", "__place"))).drop("__place")


def reindex_entities(entities: DataFrame, key: list[str], order: list) -> DataFrame:
    """First version: the first entity of a type and value, in any case and spelling, numbered anew."""
    k = F.concat_ws(":", blank("type"), comparable("value"))
    return surrogate_ids(first_wins(entities.withColumn("__k", k), [*key, "__k"], order).drop("__k").withColumn("__given", F.lit("")), "ent", "__given", order, key).drop("__given")


def with_overrides(base: Column, *later: Column) -> Column:
    """Maps merged, a later one's members taking the place of an earlier one's; null maps add nothing."""
    none = F.create_map().cast("map<string,string>")
    entries = F.concat(*[F.map_entries(F.coalesce(m, none)) for m in (base, *later)])

    def merged(xs):
        last = lambda k: F.element_at(F.filter(xs, lambda e: e["key"] == k), -1)["value"]
        # the last entry of each key, in the order in which the keys come up first
        return let(F.array_distinct(xs["key"]), lambda ks: F.map_from_arrays(ks, F.transform(ks, last)))

    return let(entries, merged)


def cost_rollup(costs: DataFrame, keys: list[str], rollup: bool = False) -> DataFrame:
    """Token sums by ``keys``; a sum of nothing is missing. ``rollup`` adds all coarser levels."""
    group = costs.rollup(*keys) if rollup else costs.groupBy(*keys)
    return group.agg(*[F.nullif(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "estimated_image_tokens")], F.count(F.lit(1)).alias("calls"))


def run_summary(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, tokens and, where the outcomes have pages and errors, ``Page n: error`` of the failed ones in order."""
    extra = []
    if {"page", "error"} <= set(outcomes.columns):
        said = F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(": "), or_("error", F.lit("unknown error")))
        listed = F.array_sort(F.collect_list(F.when(~F.col("success"), F.struct("page", said.alias("said")))))
        extra.append(F.transform(listed, lambda x: x["said"]).alias("errors"))
    return outcomes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requested"),
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
        F.sum(F.when(F.col("success"), F.col("tokens"))).alias("tokens"),
        *extra,
    )


def split_pack_tokens(pages: DataFrame, pack: str, total: str) -> DataFrame:
    """A pack's tokens dealt evenly to its pages, rounded."""
    return pages.withColumn("tokens", js_round(F.col(total) / F.count(F.lit(1)).over(Window.partitionBy(pack))).cast("long"))


def estimate_tokens(pages: DataFrame, key: str, page: str, tokens: str, sample: int = 10) -> DataFrame:
    """The rounded mean of the first ``sample`` pages times all of them: the estimate's own definition."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(page))
    r = pages.withColumn("place", place)
    mean = js_round(F.avg(F.when(F.col("place") <= sample, F.col(tokens)))).cast("long")
    return r.groupBy(key).agg(mean.alias("per_page"), (mean * F.count(F.lit(1))).alias("estimate"))


def fixed_chunks(rows: DataFrame, size: int, key: list[str], order: list) -> DataFrame:
    return rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1) / size).cast("int"))


def pack_by_budget(items: DataFrame, key: str, order: list[str], tokens: str, budget: int) -> DataFrame:
    """Greedy packs: a new one begins where the next item would pass the budget and the pack isn't empty.

    One source may hold everything: packs are found range by range.
    """
    listed = items.select(key, *order, F.col(tokens).cast("long").alias("tokens"))
    return recur(listed, [key], order, "tokens", Packing(budget), "pack")


def video_summary(chunks: DataFrame) -> DataFrame:
    """Chunks of a recording: success if any succeeded, labelled texts in order, token sums."""
    text = F.concat(F.lit("[Chunk "), (F.col("chunk") + 1).cast("string"), F.lit("] "), F.col("text"))
    return chunks.groupBy("source_path").agg(
        F.bool_or("success").alias("success"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("success"), F.struct("chunk", text.alias("t"))))), lambda x: x["t"]), "\n\n").alias("text"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )


def attention_mapped(pages: DataFrame) -> DataFrame:
    """A field per attention name: the first candidate's value, the last page with the name winning."""
    a = explode_list(pages, "attention")
    first = F.from_json(F.get("candidates", F.lit(0)), "map<string,string>")
    a = a.withColumn("first", first)
    value = or_(F.col("first")["value_original"], F.col("first")["value"], F.col("first")["text"])
    level = F.coalesce(F.col("first")["confidence"], F.when(F.col("matched"), "medium").otherwise("low"))
    row = F.struct(value.alias("value"), level.alias("confidence"), (F.col("matched") & (F.col("status") == "matched")).alias("verified"), "needs_review", "page")
    return a.groupBy("source_path", "name").agg(F.max_by(row, F.struct("page", "place")).alias("w")).select("source_path", "name", "w.*")


def attention_review(pages: DataFrame, required: list[str]) -> DataFrame:
    """Attention names that no page of a source has: high if required, else medium."""
    a = explode_list(pages, "attention")
    never = a.groupBy("source_path", "name").agg(F.bool_or("matched").alias("m")).where("not m")
    return never.select("source_path", "name", F.when(F.col("name").isin(*required) if required else F.lit(False), "high").otherwise("medium").alias("severity"))
