"""Pages of the first version: candidates, value unwrapping, review marks, crops, roll-ups.

Columns in, columns out, apart from the tables that are rolled up by source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.json_text import as_array, box, members
from leafmill.functions.text import blank, candidate_key, confidence, let, null_words, or_, stringify_cell

#: What candidates of the second version say of their source (a fixed value).
SOURCE = "qwen3_vl_universal_page_understanding"
#: A JSON text, number, truth value or array.
_SCALAR = r'^("([^"\\]|\\.)*"|-?\d+(\.\d+)?([eE][+-]?\d+)?|true|false|\[[\s\S]*\])$'
#: How deep a value may be wrapped in objects.
DEPTH = 4
CANDIDATES = "array<struct<name:string,label:string,value:string,bbox:struct<x1:double,y1:double,x2:double,y2:double>,confidence:string,source:string,needs_review:boolean>>"


def _object(x: Column) -> Column:
    """The members of an object's text, null for anything else."""
    return let(x, lambda v: members(F.when(F.ltrim(v).startswith("{") & F.try_parse_json(v).isNotNull(), v)))


def _unwrapped(x: Column, inner, bare, depth: int) -> Column:
    """``bare`` of what stands in objects up to ``depth`` deep; ``inner`` tells an object's own value."""
    if depth == 0:
        return bare(x)
    return let(F.struct(x.alias("v"), _object(x).alias("m")), lambda s: F.when(s["m"].isNull(), bare(s["v"])).otherwise(_unwrapped(inner(s["m"]), inner, bare, depth - 1)))


def model_value(x, depth: int = DEPTH) -> Column:
    """A model's value without its wrapping (``value``, ``text``, ``raw`` or ``result``); words for none are empty."""
    inner = lambda m: F.coalesce(m["value"], m["text"], m["raw"], m["result"])
    return _unwrapped(F.col(x) if isinstance(x, str) else x, inner, null_words, depth)


def plain_value(x, depth: int = DEPTH) -> Column:
    """A value without its wrapping (``value``, else ``normalized_value``), white space collapsed."""
    inner = lambda m: F.when(F.map_contains_key(m, "value"), m["value"]).otherwise(m["normalized_value"])
    return _unwrapped(F.col(x) if isinstance(x, str) else x, inner, stringify_cell, depth)


def candidates(x) -> Column:
    """A list's candidates: a bare text is a low one; the first of a name, label and value stays; empty ones go.

    Review is asked for where it is flagged, where the confidence isn't high, and for uncertain marks.
    """

    def one(s):
        m, item = s["m"], s["item"]
        level = F.when(m.isNull(), F.lit("low")).otherwise(confidence(m["confidence"], lower=False))
        value = F.when(m.isNull(), item).otherwise(F.coalesce(m["value"], m["text"], m["raw"], F.lit("")))
        review = m.isNull() | F.coalesce(m["needs_review"] == "true", F.lit(False)) | (level != "high") | value.contains("[?]")
        return F.struct(
            F.nullif(blank(m["name"]), F.lit("")).alias("name"),
            F.nullif(blank(m["label"]), F.lit("")).alias("label"),
            F.when(m.isNull(), item).otherwise(F.trim(value)).alias("value"),
            box(members(m["bbox"])).alias("bbox"),
            level.alias("confidence"),
            F.when(m.isNull(), F.lit("model_text")).otherwise(or_(m["source"], F.lit("full_page"))).alias("source"),
            review.alias("needs_review"),
        )

    parsed = F.transform(as_array(x), lambda item: F.struct(item.alias("item"), _object(item).alias("m")))
    return unique(F.filter(F.transform(parsed, one), lambda c: (blank(c["value"]) != "") | (blank(c["label"]) != "")))


def unique(found: Column) -> Column:
    """The first candidate of each name, label and value."""
    keyed = F.transform(found, lambda c: F.struct(candidate_key(c["name"], c["label"], c["value"]).alias("k"), c.alias("c")))
    return let(keyed, lambda xs: let(xs["k"], lambda ks: F.transform(F.filter(xs, lambda x, i: F.array_position(ks, x["k"]) == i.cast("long") + 1), lambda x: x["c"])))


def first_pages(docs: DataFrame) -> DataFrame:
    """Answers of the first version (``source_path, page, doc``: members as texts) to pages.

    Candidates are the page's and, after them, those of the older ``fields``; an answer may be wrapped in
    ``pages`` or ``page``. Without a text the raw answer stands for it.
    """
    d = F.col("doc")
    inner = F.coalesce(members(F.get(as_array(d["pages"]), F.lit(0))), members(d["page"]), d)
    p = docs.withColumn("__in", inner)
    i = F.col("__in")
    listed = lambda name: F.when(F.ltrim(blank(i[name])).startswith("["), i[name])
    older = F.coalesce(listed("fields"), F.when(F.ltrim(blank(d["fields"])).startswith("["), d["fields"]))
    p = p.withColumn("candidates", unique(F.concat(candidates(listed("field_candidates")), candidates(older))))
    given = F.try_to_number(i["page"], F.lit("999999999")).cast("int")
    return p.select(
        "source_path",
        F.coalesce(F.when(given != 0, given), "page").alias("page"),
        or_(i["raw_markdown"], i["rawText"], d["_raw"]).alias("raw_markdown"),
        blank(i["raw_html"]).alias("raw_html"),
        "candidates",
        candidates(listed("unmapped_fields")).alias("model_unmapped"),
        members(i["mapped_fields"]).alias("mapped"),
        F.transform(as_array(listed("text_items")), lambda t: let(_object(t), lambda m: F.when(m.isNull(), t).otherwise(or_(m["text"], m["value"])))).alias("text_items"),
        F.transform(as_array(listed("tables")), lambda t: F.transform(as_array(_object(t)["rows"]), as_array)).alias("tables"),
        blank(members(i["document_classification"])["type"]).alias("given_type"),
        as_array(listed("uncertain_tokens")).alias("uncertain_tokens"),
        as_array(listed("orphan_values")).alias("orphan_values"),
    )


def unmapped_fields(pages: DataFrame, used: DataFrame) -> DataFrame:
    """The model's unmapped fields, then the candidates that no mapped field has used; the first of a key stays.

    ``used``: ``source_path, page, candidate_key``.
    """
    from leafmill.operators.merge import first_wins

    def rows(name, part):
        c = pages.select("source_path", "page", F.posexplode_outer(name).alias("place", "c")).where("place is not null")
        c = c.select("source_path", "page", F.lit(part).alias("part"), "place", "c.*")
        return c.withColumn("candidate_key", candidate_key("name", "label", "value"))

    own = rows("candidates", 1).join(used.select("source_path", "page", "candidate_key").distinct(), ["source_path", "page", "candidate_key"], "left_anti")
    both = rows("model_unmapped", 0).unionByName(own)
    return first_wins(both, ["source_path", "page", "candidate_key"], ["part", "place"])


def lossless_candidate(f: Column, generic: bool = False) -> Column:
    """A field of the second version as a candidate of the first; a ``generic`` item is reviewed unless told otherwise."""
    return F.struct(
        stringify_cell(f["field_name_model"]).alias("name"),
        stringify_cell(f["label_original"]).alias("label"),
        stringify_cell(f["value_original"]).alias("value"),
        f["evidence"]["bbox"].alias("bbox"),
        confidence(f["confidence"]).alias("confidence"),
        F.lit(SOURCE).alias("source"),
        F.coalesce(f["needs_review"], F.lit(generic)).alias("needs_review"),
    )


def lossless_candidates(pages: DataFrame, name: str, generic: bool = False) -> DataFrame:
    """``source_path, page, c``: the items of list ``name`` as candidates of the first version.

    Items are exploded first, in the outer form: a filter on the size of a list of candidates would be pushed down
    with all that makes the list, and a candidate made within the list is made in the expression that makes its item.
    """
    items = pages.select("source_path", "page", F.explode_outer(name).alias("__item")).where("__item is not null")
    return items.select("source_path", "page", lossless_candidate(F.col("__item"), generic).alias("c"))


def source_descriptor(path, page, model: str, at: Column, scale: Column | None = None, least: Column | None = None, most: Column | None = None) -> Column:
    """Where a page comes from, what read it and when, and how it was rendered."""
    none = F.lit(None).cast("double")
    name = F.element_at(F.split(blank(path), "/"), -1)
    render = F.struct((none if scale is None else scale.cast("double")).alias("render_scale"), (none if least is None else least.cast("double")).alias("min_pixels"), (none if most is None else most.cast("double")).alias("max_pixels"))
    return F.struct(blank(path).alias("source_path"), name.alias("source_file"), F.col(page).alias("page") if isinstance(page, str) else page.alias("page"), F.lit(model).alias("model"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("extracted_at"), render.alias("render"))


def empty_page(page: Column, reason: Column) -> Column:
    """The page that stands for one that failed: no lists, one uncertain token that says why, to be reviewed."""
    none = F.array().cast("array<string>")
    return F.struct(page.alias("page"), F.lit("").alias("raw_markdown"), F.lit("").alias("raw_html"), F.array().cast(CANDIDATES).alias("candidates"), F.array(reason).alias("uncertain_tokens"), none.alias("orphan_values"), F.lit(True).alias("review_required"))


def review_mark(level: Column, verified: Column, value: Column) -> Column:
    """To be reviewed unless verified, of some confidence, certain and not blank."""
    v = blank(value)
    return ~F.coalesce(verified, F.lit(False)) | (F.lower(blank(level)) == "low") | v.contains("[?]") | (F.trim(v) == "")


def crop_value(text) -> Column:
    """What a crop's answer says: ``value`` of its JSON, the JSON itself if it has none, else the answer without quotes at its ends.

    Confidence is high unless the value is uncertain or empty.
    """

    def read(raw):
        # the parser stops after a first value, so what isn't an object has to be one value from end to end
        sound = F.when(raw.startswith("{"), F.try_parse_json(raw).isNotNull()).otherwise(raw.rlike(_SCALAR))
        bare = F.regexp_replace(raw, "^[\"']|[\"']$", "")
        return F.when(sound, F.coalesce(_object(raw)["value"], raw)).otherwise(bare)

    value = let(F.trim(blank(text)), read)
    return let(value, lambda v: F.struct(v.alias("value"), F.when(v.contains("[?]") | (v == ""), "low").otherwise("high").alias("confidence")))


def aggregate_pages(results: DataFrame) -> DataFrame:
    """First version: one row per source of page results (``source_path, page, success, error, risk, review, api_calls, input_tokens``).

    Errors as ``Page n: error`` in order, the worst risk of any page, and whether all went well.
    """
    said = F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(": "), or_("error", F.lit("unknown error")))
    rank = F.when(F.col("risk") == "high", 3).when(F.col("risk") == "medium", 2).when(F.col("risk").isNotNull(), 1)
    listed = F.array_sort(F.collect_list(F.when(~F.col("success"), F.struct("page", said.alias("said")))))
    per = results.groupBy("source_path").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.count_if("success").alias("successful"),
        F.transform(listed, lambda x: x["said"]).alias("errors"),
        F.max(rank).alias("worst"),
        F.bool_or(~F.col("success") | F.col("review")).alias("review_required"),
        F.sum(F.when(F.col("success"), F.greatest(F.coalesce("api_calls", F.lit(1)), F.lit(1)))).alias("total_api_calls"),
        F.sum(F.when(F.col("success"), F.col("input_tokens"))).alias("total_tokens"),
    )
    worst = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("worst"))
    return per.withColumn("hallucination_risk", F.when(F.col("worst").isNotNull(), worst)).withColumn("success", (F.size("errors") == 0) & ~F.col("review_required")).drop("worst")


def page_structure(final_json) -> Column:
    """``n fields extracted`` for the fields of a final result that have a value; empty if none has."""
    m = members(F.col(final_json) if isinstance(final_json, str) else final_json)
    values = F.transform(F.map_values(m), lambda v: blank(_object(v)["value"]))
    n = F.coalesce(F.size(F.filter(values, lambda v: v != "")), F.lit(0))
    return let(n, lambda k: F.when(k > 0, F.concat(k.cast("string"), F.lit(" fields extracted"))).otherwise(""))


def unique_strings(x: Column) -> Column:
    """Trimmed texts that aren't empty, each once, in order."""
    return F.array_distinct(F.filter(F.transform(x, lambda v: F.trim(v)), lambda v: v != ""))


def attention_fields(given: list) -> list[dict]:
    """First version: attention fields with their aliases; names may repeat, nameless ones are dropped."""
    out = []
    for g in given if isinstance(given, list) else []:
        if isinstance(g, str):
            item = {"name": g.strip(), "aliases": [g.strip()], "required": False, "original": g}
        else:
            name = next((str(g[k]) for k in ("name", "label", "field") if g.get(k)), "").strip()
            said = [name, g.get("label_pattern"), g.get("labelPattern"), *(g.get("aliases") if isinstance(g.get("aliases"), list) else [])]
            texts = [str(v or "").strip() for v in said]
            item = {"name": name, "aliases": list(dict.fromkeys(t for t in texts if t)), "required": g.get("required") is True, "original": g}
        if item["name"]:
            out.append(item)
    return out
