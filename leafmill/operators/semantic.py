"""First-version pages: tables and labelled text to candidates, records, documents, issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.json_text import members
from leafmill.functions.text import blank, canonical, comparable, confidence, let, looks_like_label, or_, stringify_cell, unescape_latex
from leafmill.operators.merge import first_wins
from leafmill.operators.normalize import tidy

COLON = r"^(.{2,60}?)[：:]\s*(.{1,160})$"
SPACED = r"^([A-Za-z][A-Za-z0-9 /().#-]{2,40})\s{2,}(.{2,120})$"


def page_text(markdown, html, items: Column) -> Column:
    """Markdown, markup and text items, a line each, blanks left out."""
    parts = F.concat(F.array(F.nullif(blank(markdown), F.lit("")), F.nullif(blank(html), F.lit(""))), F.transform(items, lambda t: F.nullif(blank(t), F.lit(""))))
    return F.array_join(F.array_compact(parts), "\n")


def latex_rows(text: Column) -> Column:
    r"""Rows of lines that have both ``&`` and ``\\``; the escaped ampersand breaks a column too."""
    lines = F.filter(F.split(blank(text), "\n"), lambda x: x.contains("&") & x.contains("\\\\"))
    cells = F.transform(F.filter(F.transform(lines, unescape_latex), lambda x: (x != "") & ~x.startswith("\\")), lambda x: F.transform(F.split(x, "&"), lambda c: F.trim(c)))
    return F.filter(cells, lambda r: F.exists(r, lambda c: c != ""))


def all_tables(tables: Column, text: Column) -> Column:
    """Model tables, then the one that the text's rows make, with identifiers by place."""
    rows = latex_rows(text)
    own = F.when(F.size(rows) > 0, F.array(rows)).otherwise(F.array().cast("array<array<array<string>>>"))
    return F.transform(F.concat(tables, own), lambda r, i: F.struct(F.concat(F.lit("table_"), (i + 1).cast("string")).alias("table_id"), r.alias("rows")))


def table_candidates(rows: Column) -> Column:
    """``label, value``: rows whose first cell is like a label and some later one isn't."""
    clean = F.transform(rows, lambda r: F.transform(r, stringify_cell))
    pairs = F.filter(clean, lambda r: (F.size(r) > 1) & looks_like_label(F.get(r, F.lit(0))) & F.exists(F.slice(r, F.lit(2), F.size(r)), lambda c: (c != "") & ~looks_like_label(c)))
    return F.transform(pairs, lambda r: F.struct(F.get(r, F.lit(0)).alias("label"), F.array_join(F.filter(F.slice(r, F.lit(2), F.size(r)), lambda c: c != ""), " | ").alias("value")))


def labelled_text(text: Column) -> Column:
    """``label, value, confidence, rule`` of lines; the first rule that fits a line is taken.

    Lines are cleaned first, so two spaces in a row never remain and the second rule never fires. It is
    kept because it is part of the definition.
    """
    lines = F.transform(F.split(blank(text), "\n"), unescape_latex)

    def row(x):
        a, b = F.trim(F.regexp_extract(x, COLON, 1)), F.trim(F.regexp_extract(x, COLON, 2))
        c, d = F.trim(F.regexp_extract(x, SPACED, 1)), F.trim(F.regexp_extract(x, SPACED, 2))
        colon = (a != "") & looks_like_label(a) & (b != "")
        return (
            F.when(colon, F.struct(a.alias("label"), b.alias("value"), F.lit("medium").alias("confidence"), F.lit("colon_labeled_text").alias("rule")))
            .when((c != "") & (d != ""), F.struct(c.alias("label"), d.alias("value"), F.lit("low").alias("confidence"), F.lit("spaced_labeled_text").alias("rule")))
        )

    return F.array_compact(F.transform(lines, row))


def all_candidates(fields: Column, mapped: Column, tables: Column, text: Column) -> Column:
    """Page fields, mapped fields, table pairs and labelled text, the empty ones left out.

    The first two: arrays of ``name, label, value, confidence``.
    """
    named = lambda xs, source: F.transform(xs, lambda x: F.struct(x["name"].alias("name"), x["label"].alias("label"), x["value"].alias("value"), x["confidence"].alias("confidence"), F.lit(source).alias("source")))
    pair = lambda xs, source, level: F.transform(xs, lambda x: F.struct(canonical(x["label"]).alias("name"), x["label"].alias("label"), x["value"].alias("value"), F.lit(level).alias("confidence"), F.lit(source).alias("source")))
    cells = F.flatten(F.transform(tables, lambda t: table_candidates(t["rows"])))
    every = F.concat(named(fields, "field"), named(mapped, "mapped"), pair(cells, "table", "medium"), pair(labelled_text(text), "text", "medium"))
    return F.filter(every, lambda c: or_(c["value"], c["label"], c["name"]) != "")


def unique_candidates(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First wins by name, label and comparable value."""
    k = F.concat_ws(":", blank("name"), blank("label"), comparable("value"))
    return first_wins(rows.withColumn("__k", k), [*key, "__k"], order).drop("__k")


def row_records(rows: Column) -> Column:
    """Records of a table of two rows or more: the first row names the columns, unnamed ones ``col_i``."""
    head = F.transform(F.get(rows, F.lit(0)), lambda c, i: or_(canonical(c), F.concat(F.lit("col_"), (i + 1).cast("string"))))

    def body(names, clean):
        cell = lambda c, i, j: F.struct((i + 1).alias("row_index"), F.coalesce(F.get(names, j), F.concat(F.lit("col_"), (j + 1).cast("string"))).alias("name"), clean(c).alias("value"))
        return F.flatten(F.transform(F.slice(rows, 2, 2**31 - 2), lambda r, i: F.transform(r, lambda c, j: cell(c, i, j))))

    # the names are made once a table, and so is the test of whether any cell has white space to be collapsed or trimmed
    text = F.concat(F.lit('["'), F.array_join(F.flatten(rows), '"'), F.lit('"]'))
    made = lambda names: F.when(F.coalesce(tidy(text), F.lit(False)), body(names, blank)).otherwise(body(names, stringify_cell))
    return F.when(F.size(rows) >= 2, let(head, made)).otherwise(F.array().cast("array<struct<row_index:int,name:string,value:string>>"))


def classify(given: Column, tables: Column) -> Column:
    return F.coalesce(F.nullif(blank(given), F.lit("")), F.when(F.size(tables) > 0, "table_document_candidate").otherwise("document"))


def relationships(candidates: DataFrame, entities: DataFrame, tables: DataFrame, matches: DataFrame, key: list[str]) -> DataFrame:
    """Three kinds of edges: a field mentions an entity, a table groups a row, an attention field is met."""
    from leafmill.operators.matching import link_entities

    mentions = link_entities(candidates, entities, key).select(*key, F.lit("field_mentions_entity").alias("type"), F.col("name").alias("from"), F.col("entity_id").alias("to"), "confidence")
    rows = tables.select(*key, "table_id", F.posexplode("rows").alias("i", "r")).select(*key, F.lit("table_row_groups_values").alias("type"), F.col("table_id").alias("from"), F.concat(F.lit("row_"), (F.col("i") + 1).cast("string")).alias("to"), F.lit("medium").alias("confidence"))
    met = matches.where("matched").select(*key, F.lit("attention_field_matched").alias("type"), F.col("name").alias("from"), F.array_join("candidate_ids", ",").alias("to"), F.when(F.col("any_high"), "high").otherwise("medium").alias("confidence"))
    return mentions.unionByName(rows).unionByName(met)


def integrated_records(pages: DataFrame, grain: str = "page") -> DataFrame:
    """Page records, and row or transaction records if that is the grain."""
    whole = pages.select("source_path", "page", F.concat(F.lit("page_"), F.col("page").cast("string")).alias("record_id"), F.lit("page").alias("record_type"), F.posexplode("candidates").alias("place", "c"))
    whole = whole.select("source_path", "page", "record_id", "record_type", "place", or_("c.name", "c.label").alias("name"), F.col("c.value").alias("value"))
    whole = whole.groupBy("source_path", "page", "record_id", "record_type", "name").agg(F.min_by("value", "place").alias("value"))
    if grain not in ("row", "transaction"):
        return whole
    each = pages.select("source_path", "page", F.explode("tables").alias("t")).select("source_path", "page", F.col("t.table_id").alias("table_id"), F.explode(row_records(F.col("t.rows"))).alias("r"))
    rows = each.select("source_path", "page", F.concat_ws("_", F.lit("page"), F.col("page").cast("string"), "table_id", F.lit("row"), F.col("r.row_index").cast("string")).alias("record_id"), F.lit(grain).alias("record_type"), "r.name", "r.value")
    return whole.unionByName(rows)


def semantic_pages(pages: DataFrame, hints: DataFrame | None = None) -> dict[str, DataFrame]:
    """Pages of the first version (:func:`leafmill.operators.first_version.first_pages`) to what they mean.

    ``pages``: text, tables with those that the text's rows make, classification, review. ``candidates``:
    of fields, mapped fields, tables and labelled lines, the first of a name, label and value. With
    ``hints`` (``name, aliases, required``) also ``attention`` and the ``issues`` of names that no page has.
    """
    from leafmill.operators.matching import attention_status

    key = ["source_path", "page"]
    text = page_text("raw_markdown", "raw_html", F.col("text_items"))
    p = pages.withColumn("text", text).withColumn("tables", all_tables(F.col("tables"), F.col("text")))
    part = lambda name, label, value, level: F.struct(blank(name).alias("name"), blank(label).alias("label"), blank(value).alias("value"), level.alias("confidence"))
    fields = F.transform("candidates", lambda c: part(c["name"], c["label"], c["value"], c["confidence"]))
    given = F.transform(F.map_entries(F.coalesce("mapped", F.create_map().cast("map<string,string>"))), lambda e: let(members(e["value"]), lambda m: part(e["key"], m["label"], F.coalesce(m["value"], e["value"]), confidence(m["confidence"], lower=False))))
    p = p.withColumn("all", all_candidates(fields, given, F.col("tables"), F.col("text")))
    p = p.withColumn("document_type", classify(F.col("given_type"), F.col("tables"))).withColumn("needs_review", (F.size("all") == 0) | (F.size("uncertain_tokens") > 0) | F.exists("all", lambda c: c["confidence"] == "low"))
    each = p.select(*key, F.posexplode_outer("all").alias("idx", "c")).where("idx is not null").select(*key, "idx", "c.*")
    out = {"pages": p.drop("all", "candidates", "given_type"), "candidates": unique_candidates(each, key, ["idx"])}
    if hints is not None:
        out["attention"] = attention_status(out["candidates"], hints, p, key)
        met = out["attention"].join(hints.select(F.col("name").alias("hint"), "required"), "hint").select("source_path", F.col("hint").alias("name"), "matched", "required")
        none = p.where(F.size("all") == 0).select(*key, F.lit("no_field_candidates").alias("type"), F.lit("high").alias("severity"), F.lit("the page has no field").alias("message"))
        out["issues"] = review_issues(none, met)
    return out


def review_issues(page_issues: DataFrame, matches: DataFrame) -> DataFrame:
    """Issues of pages and the attention names that no page of a source meets."""
    never = matches.groupBy("source_path", "name").agg(F.bool_or("matched").alias("m"), F.bool_or("required").alias("r")).where("not m")
    return page_issues.select("source_path", "page", "type", "severity", "message").unionByName(
        never.select("source_path", F.lit(None).cast("int").alias("page"), F.lit("attention_field_not_found").alias("type"), F.when(F.col("r"), "high").otherwise("medium").alias("severity"), F.col("name").alias("message"))
    )


class Classifiers:
    """Where a caller's own recognisers of values go; these recognise nothing."""

    def typed_values(self, text: Column) -> Column:
        return F.array().cast("array<struct<type:string,value:string>>")

    def organizations(self, text: Column) -> Column:
        return F.array().cast("array<string>")

    def value_type(self, value: Column) -> Column:
        return F.lit(None).cast("string")

    def field_name(self, label: Column) -> Column:
        return F.lit(None).cast("string")
