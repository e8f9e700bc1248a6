"""Extractions that ask more than once: two passes, layers with crops, model first with evidence.

Each later scan sees only the pages or fields that need it, and answers are kept reliably before the
next step, so that a step's calls are made once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.json_text import members
from leafmill.functions.text import blank, comparable, let
from leafmill.functions.tokens import crop_box
from leafmill.operators import consensus, matching, validate
from leafmill.operators.first_version import crop_value, model_value
from leafmill.operators.normalize import explode_list, normalize_pages
from leafmill.shared import cut
from leafmill.sources.pages import PageModel, scan_model
from leafmill.sources.scans import scan_ocr

KEY = ["source_path", "page"]


def page_values(pages: DataFrame, specs: DataFrame) -> DataFrame:
    """A row per page and specification: its first field's value and what that is worth. ``specs``: name, ord, label_pattern, required."""
    fields = explode_list(pages, "fields").select(*KEY, F.col("place").alias("idx"), F.col("field_name_model").alias("name"), F.col("label_original").alias("label"), F.col("value_original").alias("value"), "confidence")
    hit = matching.first_match(fields, specs, KEY, ["idx"]).select(*KEY, "spec", "value", "confidence")
    every = matching.with_list(pages.select(*KEY).distinct(), specs.select(F.col("name").alias("spec"), "required"), F.lit(True))
    both = every.join(hit, [*KEY, "spec"], "left")
    return both.select(*KEY, "spec", "required", blank("value").alias("value"), F.coalesce("confidence", F.lit("low")).alias("confidence"))


def two_pass_extract(pages: DataFrame, model: PageModel, prompt: str, specs: DataFrame) -> DataFrame:
    """``source_path, page, spec, value, confidence, verified, passes, agreement``: a second pass for pages with an uncertain field only.

    Fields that the first pass is sure of keep its value; the others get the votes of both.
    """
    first = cut(page_values(cut(normalize_pages(scan_model(pages, model, prompt))), specs).withColumn("again", consensus.is_uncertain("value", "confidence", "required")))
    unsure = first.where("again").groupBy(*KEY).agg(F.array_join(F.array_sort(F.collect_set("spec")), ", ").alias("unsure"))
    asked = pages.join(unsure, KEY)
    second = page_values(cut(normalize_pages(scan_model(asked, model, prompt + "\nLook again at the fields in the column unsure."))), specs)
    votes = first.where("again").select(*KEY, "spec", F.lit(0).alias("pass_idx"), "value").unionByName(second.join(first.where("again").select(*KEY, "spec"), [*KEY, "spec"], "left_semi").select(*KEY, "spec", F.lit(1).alias("pass_idx"), "value"))
    voted = consensus.dual_pass(votes, [*KEY, "spec"]).select(*KEY, "spec", F.col("value").alias("voted"), "agreement", F.col("confidence").alias("vote_confidence"))
    both = first.join(voted, [*KEY, "spec"], "left")
    value = F.when(F.col("again"), F.coalesce("voted", F.lit(""))).otherwise(F.col("value"))
    valid = matching.value_is_valid(value, F.col("required"))
    level = F.when(~valid, F.lit("low")).when(F.col("again"), F.coalesce("vote_confidence", F.lit("low"))).otherwise(F.col("confidence"))
    return both.select(*KEY, "spec", value.alias("value"), level.alias("confidence"), valid.alias("verified"), F.when(F.col("again"), 2).otherwise(1).alias("passes"), F.coalesce("agreement", F.lit(1.0)).alias("agreement"))


def layered_extract(pages: DataFrame, model: PageModel, prompt: str, specs: DataFrame, crop_prompt: str, crop=None, most_unverified: int = 0) -> dict[str, DataFrame]:
    """Whole pages first, then crops of the fields that are in doubt, then the guard.

    ``crop(page_row_columns, box)`` makes a crop of a field's box as a column (none: no crops are read);
    pages have ``width`` and ``height``. Returns ``fields`` and ``guard``.
    """
    found = cut(normalize_pages(scan_model(pages, model, prompt)))
    values = page_values(found, specs)
    boxes = explode_list(found, "fields").select(*KEY, comparable("field_name_model").alias("k"), F.col("evidence.bbox").alias("bbox"), "place").where("bbox is not null")
    boxes = boxes.groupBy(*KEY, "k").agg(F.min_by("bbox", "place").alias("bbox"))
    placed = cut(values.withColumn("k", comparable("spec")).join(boxes, [*KEY, "k"], "left").drop("k"))
    doubt = validate.needs_ocr(F.col("value"), F.col("confidence"), F.col("confidence") == "high", F.col("required"))
    fields = placed.drop("bbox").withColumn("from_crop", F.lit(False))
    if crop is not None:
        b = F.col("bbox")
        asked = placed.where(doubt & F.col("bbox").isNotNull()).select(*KEY, "spec", "bbox").join(pages, KEY)
        crops = asked.withColumn("box", crop_box(b["x1"], b["y1"], b["x2"], b["y2"], F.col("width"), F.col("height"))).withColumn("content", crop(F.col("content"), F.col("box")))
        # a crop's row is a page of its own, told by its field
        told = crops.withColumn("source_path", F.to_json(F.struct("source_path", "spec"))).drop("bbox", "box")
        read = cut(scan_model(told, model, crop_prompt))
        name = F.from_json("source_path", "source_path string, spec string")
        got = read.select(name.alias("n"), "page", crop_value("response").alias("c")).select("n.*", "page", F.col("c.value").alias("value"))
        adopted = matching.adopt_crops(placed.drop("bbox"), got, [*KEY, "spec"])
        fields = adopted.select(*KEY, "spec", "value", "from_crop").join(placed.select(*KEY, "spec", "required", "confidence"), [*KEY, "spec"])
        fields = fields.withColumn("confidence", F.when(F.col("from_crop"), F.when(F.col("value").contains("[?]"), "low").otherwise("high")).otherwise(F.col("confidence")))
    sure = (F.col("confidence") == "high") & matching.value_is_valid(F.col("value"), F.col("required"))
    fields = fields.withColumn("verified", sure).select(*KEY, "spec", "required", "value", "confidence", "verified", "from_crop")
    return {"fields": fields, "guard": validate.unverified_guard(fields, KEY, most_unverified)}


def model_first(pages: DataFrame, model: PageModel, specs: list[dict], strict: bool = True, low_quality: Column | None = None) -> dict[str, DataFrame]:
    """Native recognition and key extraction, each value accepted only with evidence in what was recognised.

    Three scans a page: advanced recognition, document parsing, key information. ``specs``: ``name`` and
    ``required``. Returns ``entries`` (value, confidence, reasons, state), ``report`` (the page's risk) and
    ``final`` (accepted values) and ``failed`` (pages that weren't recognised).
    """
    words = cut(scan_ocr(pages, model, "advanced_recognition"))
    parsed = cut(scan_ocr(pages, model, "document_parsing"))
    keys = cut(scan_ocr(pages, model, "key_information_extraction", {s["name"]: "" for s in specs}))
    said = F.coalesce(members(F.get_json_object("ocr_result", "$.kv_result")), members("ocr_result"), F.create_map().cast("map<string,string>"))
    listed = F.array(*[F.struct(F.lit(s["name"]).alias("name"), F.lit(s.get("required") is not False).alias("required")) for s in specs])

    def value_of(m, name):
        """By exact name, else in any case."""
        loose = F.get(F.filter(F.map_entries(m), lambda e: F.lower(e["key"]) == F.lower(name)), F.lit(0))["value"]
        return model_value(F.coalesce(m[name], loose), 2)

    each = keys.select(*KEY, F.explode(let(said, lambda m: F.transform(listed, lambda s: F.struct(s["name"].alias("name"), s["required"].alias("required"), value_of(m, s["name"]).alias("value"))))).alias("v")).select(*KEY, "v.*")
    each = cut(each)
    lines = words.select(*KEY, F.posexplode("words").alias("line_no", "w")).select(*KEY, "line_no", F.col("w.text").alias("line"))
    joined = F.array_join(F.transform("words", lambda w: w["text"]), "\n")
    full = words.select(*KEY, F.when(joined != "", joined).otherwise(blank("text")).alias("text"))
    evidence = matching.find_evidence(each.select(*KEY, "name", "value"), lines, full, parsed.select(*KEY, F.col("text").alias("parsed")), KEY)
    poor = F.lit(False) if low_quality is None else low_quality
    quality = words.select(*KEY, (poor | ((F.trim(blank("text")) == "") & (F.size("words") < 3))).alias("low_quality"))
    rows = each.join(evidence.select(*KEY, "name", "evidence_line", "evidence_source", "found"), [*KEY, "name"], "left").join(quality, KEY)
    rows = rows.withColumn("found", F.coalesce("found", F.lit(False))).withColumn("strict", F.lit(strict))
    entries = cut(validate.acceptance(rows))
    state = F.when(F.col("accepted"), "accepted").when(F.trim("value") != "", "needs_review").otherwise("missing")
    shown = entries.select(*KEY, "name", "value", F.col("accept_confidence").alias("confidence"), F.col("accepted").alias("verified"), (~F.col("accepted")).alias("needs_review"), state.alias("validation_state"), "reasons", "evidence_line", "evidence_source", (F.col("required") & ~F.col("accepted")).alias("required_unverified"))
    return {"entries": shown, "report": validate.page_risk(entries, KEY), "final": shown.where("verified").select(*KEY, "name", "value"), "failed": words.where("error is not null").select(*KEY, "error")}


def layout_fields(answers: DataFrame, specs: list[dict]) -> DataFrame:
    """Layout answers (``source_path, page, response``) to ``name, label, value, confidence, bbox``; one that can't be read gives an empty field per specification."""
    from leafmill.functions.json_text import as_array, box, layout_object

    said = answers.withColumn("__o", members(layout_object("response")))
    kind = "array<struct<name:string,label:string,value:string,confidence:string,bbox:struct<x1:double,y1:double,x2:double,y2:double>>>"
    empty = F.array(*[F.struct(F.lit(s["name"]).alias("name"), F.lit(s.get("label_pattern") or s["name"]).alias("label"), F.lit("").alias("value"), F.lit("low").alias("confidence"), F.lit(None).cast("struct<x1:double,y1:double,x2:double,y2:double>").alias("bbox")) for s in specs]).cast(kind)
    one = lambda m: F.struct(blank(m["name"]).alias("name"), blank(m["label"]).alias("label"), blank(m["value"]).alias("value"), F.coalesce(m["confidence"], F.lit("low")).alias("confidence"), box(members(m["bbox"])).alias("bbox"))
    read = F.transform(F.transform(as_array(F.col("__o")["fields"]), lambda x: F.struct(members(x).alias("m"))), lambda s: one(s["m"])).cast(kind)
    rows = said.withColumn("__fields", F.when(F.col("__o").isNull(), empty).otherwise(read))
    return rows.select(*KEY, F.posexplode_outer("__fields").alias("idx", "f")).where("idx is not null").select(*KEY, "idx", "f.*")


def structured(answers: DataFrame, model: PageModel, prompt: str = "Write the column response as one JSON object, changing no value.") -> DataFrame:
    """Answers with the object that each holds as ``object``: read, mended, or else asked of the model once more.

    Only the answers that can't be mended reach the model.
    """
    from leafmill.functions.json_text import object_text

    first = cut(answers.withColumn("object", object_text("response")))
    bad = first.where("object is null and response is not null")
    again = cut(scan_model(bad.select(*KEY, "response"), model, prompt).select(*KEY, object_text("response").alias("fixed")))
    return first.join(again, KEY, "left").withColumn("object", F.coalesce("object", "fixed")).drop("fixed")


def extra_votes(fields: DataFrame, pages: DataFrame, model: PageModel, votes: int = 3, temperature: float = 0.1, adopt: float = 0.66) -> DataFrame:
    """Fields of low confidence that have a value are asked for ``votes`` times more; the weighted vote counts from ``adopt`` agreement on.

    ``fields``: as :func:`layered_extract` gives them. An adopted value is verified and of high confidence.
    """
    weak = fields.where((F.col("confidence") == "low") & (F.trim("value") != "")).select(*KEY, "spec")
    asked = pages.join(weak, KEY).withColumn("vote_idx", F.explode(F.sequence(F.lit(0), F.lit(votes - 1)))).withColumn("temperature", F.lit(temperature))
    # a vote's row is a page of its own, told by its field and number
    told = asked.withColumn("source_path", F.to_json(F.struct("source_path", "spec", "vote_idx")))
    read = cut(scan_model(told, model, "Give the value of the field in the column spec, and nothing else."))
    named = read.where("error is null").select(F.from_json("source_path", "source_path string, spec string, vote_idx int").alias("n"), "page", "response")
    cast = named.select("n.*", "page", F.col("response").alias("raw"), F.lit(temperature).alias("temperature"))
    voted = consensus.weighted_vote(cast, [*KEY, "spec"]).where(F.col("agreement") >= adopt).select(*KEY, "spec", F.col("value").alias("voted"))
    both = fields.join(voted, [*KEY, "spec"], "left")
    new = F.col("voted").isNotNull()
    changed = {"value": F.coalesce("voted", "value"), "confidence": F.when(new, "high").otherwise(F.col("confidence")), "verified": F.col("verified") | new}
    return both.withColumns(changed).select(*fields.columns)
