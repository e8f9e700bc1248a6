"""Model answers to pages: one row per page in, one row per page out, lists as arrays of structs.

Everything is a projection, so a page never leaves its partition; :func:`explode_list` gives a
member table of any list. Ordinals are places before filtering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.json_text import as_array, box, members, name_box, object_text, sound_object, without_fence
from leafmill.functions.text import blank, confidence, let, or_, stringify_cell

ISSUE = "array<struct<type:string,severity:string,message:string,needs_review:boolean>>"


def _first(m: Column, *names: str) -> Column:
    """The first of the members that isn't null; empty text counts."""
    return F.coalesce(*[m[n] for n in names])


def _flag(m: Column, name: str = "needs_review") -> Column:
    return F.coalesce(m[name] == "true", F.lit(False))


def _item(x: Column) -> Column:
    """An item's members; a bare scalar is its value."""
    return F.coalesce(F.when(F.ltrim(x).startswith("{"), members(x)), F.create_map(F.lit("value"), x))


#: Members that are read of a list's items, besides ``evidence``, ``bbox`` and ``confidence``.
FIELD = ("value_original", "value", "text", "value_normalized", "normalized_value", "field_id", "source_pdf", "source_path", "page_number", "page", "label_original", "label", "field_name_model", "name", "field", "value_type_model", "type", "attention_match", "needs_review")
ENTITY = ("entity_id", "id", "type", "name", "label", "value")
RELATIONSHIP = ("relationship_id", "id", "type", "from", "source_id", "to", "target_id")
ISSUES = ("type", "severity", "message", "reason", "value")
TEXT = ("text", "value")
TABLE = ("table_id", "id", "rows", "value", "source")
ATTENTION = ("name", "value", "aliases", "status", "matched", "candidates", "needs_review")
#: What has to be absent from a list's text for :func:`tidy`.
_UNTIDY = ("\\", "  ", '" ', ' "', "' ", " '", "\t", "\n", "\v", "\f", "\r")


def tidy(x: Column) -> Column:
    """Whether no text in a list's JSON has white space to be collapsed or trimmed: ASCII without escapes, single spaces within texts at most."""
    out = x.startswith("[") & x.endswith("]") & (F.octet_length(x) == F.char_length(x))
    for s in _UNTIDY:
        out = out & ~x.contains(s)
    return out


def _cell(x: Column, is_tidy: Column | None) -> Column:
    """:func:`stringify_cell`, without the expression for texts of a tidy list."""
    return stringify_cell(x) if is_tidy is None else F.when(is_tidy, blank(x)).otherwise(stringify_cell(x))


def _structs(x: Column, names: tuple[str, ...]) -> Column:
    """The named members of a list's items, as texts: one parse for a list of objects, item by item for anything else."""
    kept = list(dict.fromkeys([*names, "evidence", "bbox", "confidence"]))
    listed = F.from_json(F.when(F.ltrim(x).startswith("["), x), "array<struct<" + ",".join(f"`{n}`:string" for n in kept) + ">>")
    of_item = lambda i: let(_item(i), lambda m: F.struct(*[m[n].alias(n) for n in kept]))
    return let(listed, lambda a: F.when(a.isNotNull() & ~F.exists(a, lambda m: m.isNull()), a).otherwise(F.transform(as_array(x), of_item)))


def items(x: Column, names: tuple[str, ...], is_tidy: Column | None = None) -> Column:
    """A list's items with their members, evidence and box parsed once.

    ``value`` and ``level``, which several members are made of, are made here once too.
    """

    def item(m, i):
        e = F.when(F.ltrim(m["evidence"]).startswith("{"), members(m["evidence"]))
        value = _first(m, *[n for n in ("value_original", "value", "text") if n in names])
        more = [_cell(value, is_tidy).alias("value"), confidence(m["confidence"]).alias("level")] if names is FIELD else []
        return F.struct(i.alias("i"), m.alias("m"), e.alias("e"), members(m["bbox"]).alias("b"), *more)

    return F.transform(_structs(x, names), item)


def _id(m: Column, names: tuple[str, ...], prefix: str, page: Column, i: Column) -> Column:
    return F.coalesce(_first(m, *names), F.concat(F.lit(prefix + "_p"), page.cast("string"), F.lit("_"), (i + 1).cast("string")))


def evidence(s: Column, value: Column, page: Column) -> Column:
    """Given evidence, a scalar as its text; else the value itself stands for it."""
    raw, e = s["m"]["evidence"], s["e"]
    text = F.when(e.isNotNull(), F.coalesce(e["raw_text"], e["text"])).when(raw.isNotNull(), raw).otherwise(value)
    given = F.coalesce(F.try_to_number(e["page"], F.lit("999999999")).cast("int"), page)
    inner = F.when(e["bbox"].isNotNull(), box(members(e["bbox"])))
    return F.struct(given.alias("page"), text.alias("raw_text"), F.coalesce(box(s["b"]), inner).alias("bbox"))


def has_evidence(e: Column) -> Column:
    """Text or a box is evidence."""
    return (F.trim(blank(e["raw_text"])) != "") | e["bbox"].isNotNull()


def mark(x: Column, page: Column, is_tidy: Column | None = None) -> Column:
    """What a page's review asks of a field: whether it counts, is to be reviewed, and what it is called if it has no evidence.

    Made of the item itself, so that a page's flags and issues don't need its fields with all their members.
    """
    m, i = x["m"], x["i"]
    label, name = _cell(_first(m, "label_original", "label"), is_tidy), _cell(_first(m, "field_name_model", "name", "field", "label"), is_tidy)
    called = or_(name, label, _id(m, ("field_id",), "field", page, i))
    return F.struct(
        ((x["value"] != "") | (label != "") | (name != "")).alias("counts"),
        (_flag(m) | (x["level"] == "low")).alias("needs_review"),
        F.when(~has_evidence(evidence(x, x["value"], page)), called).alias("unproved"),
    )


def field(x: Column, i: Column, page: Column, path: Column, is_tidy: Column | None = None) -> Column:
    m, value, level = x["m"], x["value"], x["level"]
    said = _first(m, "value_normalized", "normalized_value")
    return F.struct(
        i.cast("int").alias("idx"),
        _id(m, ("field_id",), "field", page, i).alias("field_id"),
        F.coalesce(_first(m, "source_pdf", "source_path"), path).alias("source_pdf"),
        F.coalesce(F.try_to_number(_first(m, "page_number", "page"), F.lit("999999999")).cast("int"), page).alias("page_number"),
        _cell(_first(m, "label_original", "label"), is_tidy).alias("label_original"),
        _cell(_first(m, "field_name_model", "name", "field", "label"), is_tidy).alias("field_name_model"),
        value.alias("value_original"),
        F.when(said.isNotNull(), _cell(said, is_tidy)).otherwise(value).alias("value_normalized"),
        _cell(_first(m, "value_type_model", "type"), is_tidy).alias("value_type_model"),
        level.alias("confidence"),
        evidence(x, value, page).alias("evidence"),
        m["attention_match"].alias("attention_match"),
        (_flag(m) | (level == "low")).alias("needs_review"),
    )


def entity(x: Column, i: Column, page: Column, is_tidy: Column | None = None) -> Column:
    m = x["m"]
    name, value = _cell(_first(m, "name", "label", "value"), is_tidy), _cell(_first(m, "value", "name"), is_tidy)
    return F.struct(
        i.cast("int").alias("idx"),
        _id(m, ("entity_id", "id"), "entity", page, i).alias("id"),
        F.coalesce(m["type"], F.lit("entity")).alias("type"),
        name.alias("name"),
        value.alias("value"),
        confidence(m["confidence"]).alias("confidence"),
        evidence(x, value, page).alias("evidence"),
    )


def relationship(x: Column, i: Column, page: Column) -> Column:
    m = x["m"]
    return F.struct(
        i.cast("int").alias("idx"),
        _id(m, ("relationship_id", "id"), "relationship", page, i).alias("id"),
        F.coalesce(m["type"], F.lit("related_to")).alias("type"),
        stringify_cell(_first(m, "from", "source_id")).alias("from"),
        stringify_cell(_first(m, "to", "target_id")).alias("to"),
        confidence(m["confidence"]).alias("confidence"),
        evidence(x, F.lit(""), page).alias("evidence"),
    )


def issue(x: Column, is_tidy: Column | None = None) -> Column:
    m = x["m"]
    level = F.lower(m["severity"])
    return F.struct(
        F.coalesce(m["type"], F.lit("model_review_issue")).alias("type"),
        F.when(level.isin("high", "medium", "low"), level).otherwise("medium").alias("severity"),
        _cell(_first(m, "message", "reason", "value"), is_tidy).alias("message"),
        F.lit(True).alias("needs_review"),
    )


def text_item(x: Column) -> Column:
    m = x["m"]
    return F.struct(stringify_cell(_first(m, "text", "value")).alias("text"), confidence(m["confidence"]).alias("confidence"), box(x["b"]).alias("bbox"))


def _rows(x: Column, is_tidy: Column | None = None) -> Column:
    """A table's rows as lists of cells: one parse for a list of lists, row by row for anything else."""
    cells = lambda r: F.transform(r, lambda c: _cell(c, is_tidy))
    of_row = lambda r: F.when(F.ltrim(r).startswith("["), cells(as_array(r))).otherwise(F.array(_cell(r, is_tidy)))
    listed = F.from_json(F.when(F.ltrim(x).startswith("["), x), "array<array<string>>")
    return let(listed, lambda a: F.when(a.isNotNull() & ~F.exists(a, lambda r: r.isNull()), F.transform(a, cells)).otherwise(F.transform(as_array(x), of_row)))


def table(x: Column, i: Column, is_tidy: Column | None = None) -> Column:
    m = x["m"]
    rows = _rows(_first(m, "rows", "value"), is_tidy)
    return F.struct(
        F.coalesce(_first(m, "table_id", "id"), F.concat(F.lit("table_"), (i + 1).cast("string"))).alias("table_id"),
        box(x["b"]).alias("bbox"),
        rows.alias("rows"),
        F.coalesce(m["source"], F.lit("model")).alias("source"),
        confidence(m["confidence"]).alias("confidence"),
    )


def attention_match(x: Column) -> Column:
    m = x["m"]
    said = F.coalesce(m["matched"] == "true", F.lit(False))
    status = or_(F.coalesce(m["status"], F.when(said, "matched").otherwise("not_found")), F.lit("not_found"))
    return F.struct(
        stringify_cell(_first(m, "name", "value")).alias("name"),
        F.transform(as_array(m["aliases"]), stringify_cell).alias("aliases"),
        status.alias("status"),
        (said | (status == "matched")).alias("matched"),
        as_array(m["candidates"]).alias("candidates"),
        (_flag(m) | (status != "matched")).alias("needs_review"),
    )


def parse_responses(responses: DataFrame, repair: bool = True) -> DataFrame:
    """Add ``doc``: the page object's members as texts, or null (failed or unreadable)."""
    said = F.when(F.col("error").isNull(), F.col("response")) if "error" in responses.columns else F.col("response")
    # columns of their own, each mentioned more than once by the next: so they are made once and in compiled code
    if repair:
        p = responses.withColumn("__text", object_text(said) if "error" not in responses.columns else F.when(F.col("error").isNull(), object_text("response")))
    else:
        p = responses.withColumn("__bare", without_fence(said)).withColumn("__said", name_box("__bare")).withColumn("__text", sound_object(F.col("__said"))).drop("__bare", "__said")
    d = F.col("__members")
    wrapped = F.when(d["pages"].isNotNull(), let(d["pages"], lambda x: members(F.get(as_array(x), F.lit(0)))))
    return p.withColumn("__members", members("__text")).withColumn("doc", F.coalesce(wrapped, members(d["semantic_page"]), d)).drop("__text", "__members")


def _issues_found(given: Column, marks: Column, no_entity: Column) -> Column:
    def one(kind, level, message, when):
        return F.when(when, F.array(F.struct(F.lit(kind).alias("type"), F.lit(level).alias("severity"), message.alias("message"), F.lit(True).alias("needs_review"))).cast(ISSUE)).otherwise(F.array().cast(ISSUE))

    missing = F.transform(
        F.filter(marks, lambda f: f["unproved"].isNotNull()),
        lambda f: F.struct(F.lit("field_missing_evidence").alias("type"), F.lit("medium").alias("severity"), f["unproved"].alias("message"), F.lit(True).alias("needs_review")),
    )
    return F.concat(
        given.cast(ISSUE),
        missing.cast(ISSUE),
        one("no_field_candidates", "high", F.lit("the page has no field"), F.size(marks) == 0),
        one("no_entities_returned", "low", F.lit("the page has no entity"), no_entity),
    )


def normalize_pages(responses: DataFrame, hints: list[dict] | None = None, repair: bool = True) -> DataFrame:
    """Pages of the second version from answers.

    A failed or unreadable answer is a complete page too: no lists, one high issue, its attention hints
    not evaluated. ``hints``: ``name``, ``aliases``, ``required``; a caller's list, so it is a literal.
    """
    path, page = F.col("source_path"), F.col("page")
    p = parse_responses(responses, repair)
    d = F.col("doc")
    raw = F.coalesce(members(F.coalesce(d["raw_content"], d["rawContent"])), d)
    p = p.withColumn("raw", raw)
    r = F.col("raw")
    names = ("field_candidates", "entities", "relationships", "review_issues", "attention_field_matches")
    # trimmed, since a bare member would be looked up in the map again for every mention
    p = p.withColumns({f"__{n}": F.ltrim(d[n]) for n in names})
    p = p.withColumn("__tables", F.coalesce(r["tables"], d["tables"]))
    p = p.withColumns({f"__tidy_{n}": tidy(F.col(f"__{n}")) for n in ("field_candidates", "entities", "review_issues", "tables")})
    x, ok = ({n: F.col(f"{kind}{n}") for n in (*names, "tables")} for kind in ("__", "__tidy_"))
    # lists that flags and issues are made of too: parsed once, and the members that nothing reads are never made
    p = p.withColumns({"__field_items": items(x["field_candidates"], FIELD, ok["field_candidates"]), "__entity_items": items(x["entities"], ENTITY)})
    f, e = F.col("__field_items"), F.col("__entity_items")
    p = p.select(
        *[c for c in responses.columns],
        d.isNotNull().alias("parsed"),
        members(d["document_classification"]).alias("class"),
        stringify_cell(_first(r, "raw_markdown", "rawText", "text")).alias("raw_markdown"),
        stringify_cell(r["raw_html"]).alias("raw_html"),
        F.filter(F.transform(items(_first(r, "text_items", "text_lines"), TEXT), text_item), lambda t: t["text"] != "").alias("text_items"),
        F.transform(items(x["tables"], TABLE), lambda t, i: table(t, i, ok["tables"])).alias("tables"),
        as_array(r["uncertain_tokens"]).alias("uncertain_tokens"),
        F.filter(F.transform(f, lambda f, i: field(f, i, page, path, ok["field_candidates"])), lambda f: (f["value_original"] != "") | (f["label_original"] != "") | (f["field_name_model"] != "")).alias("fields"),
        F.filter(F.transform(e, lambda e, i: entity(e, i, page, ok["entities"])), lambda e: (e["name"] != "") | (e["value"] != "")).alias("entities"),
        F.filter(F.transform(f, lambda f: mark(f, page, ok["field_candidates"])), lambda f: f["counts"]).alias("marks"),
        (~F.exists(e, lambda e: (_cell(_first(e["m"], "value", "name"), ok["entities"]) != "") | (_cell(_first(e["m"], "name", "label", "value"), ok["entities"]) != ""))).alias("no_entity"),
        F.filter(F.transform(items(x["relationships"], RELATIONSHIP), lambda x, i: relationship(x, i, page)), lambda e: (e["type"] != "") | (e["from"] != "") | (e["to"] != "")).alias("relationships"),
        F.transform(items(x["review_issues"], ISSUES), lambda i: issue(i, ok["review_issues"])).alias("given_issues"),
        F.transform(items(x["attention_field_matches"], ATTENTION), attention_match).alias("given_matches"),
        as_array(d["unmapped_fields"]).alias("unmapped_fields"),
        as_array(d["orphan_values"]).alias("orphan_values"),
        as_array(d["integrated_records"]).alias("records"),
    )
    c = F.col("class")
    level = confidence(c["confidence"])
    # the level is mentioned twice below, so these stay columns: who reads one of them makes neither the others nor the fields
    parts = {"type": or_(c["type"], F.lit("document")), "confidence": level, "reason": stringify_cell(c["reason"]), "evidence": as_array(c["evidence"])}
    p = p.withColumns({f"__class_{n}": x for n, x in parts.items()})
    review = _flag(c) | c.isNull() | (F.size("marks") == 0) | (F.col("__class_confidence") == "low")
    p = p.withColumn("classification", F.struct(*[F.col(f"__class_{n}").alias(n) for n in parts], review.alias("needs_review")))
    p = p.withColumn("attention", _attention(F.col("given_matches"), hints or [], F.col("parsed")))
    failed = F.array(F.struct(F.lit("page_failed").alias("type"), F.lit("high").alias("severity"), or_(*(["error"] if "error" in responses.columns else []), F.lit("the answer holds no object")).alias("message"), F.lit(True).alias("needs_review"))).cast(ISSUE)
    p = p.withColumn("issues", F.when(F.col("parsed"), _issues_found(F.col("given_issues"), F.col("marks"), F.col("no_entity"))).otherwise(failed))
    serious = F.exists("issues", lambda x: x["severity"] != "low")
    flagged = serious | F.exists("marks", lambda f: f["needs_review"]) | F.exists("attention", lambda a: a["needs_review"])
    p = p.withColumn("needs_review", flagged).withColumn("review_required", F.col("needs_review") | (F.size("issues") > 0) | ~F.col("parsed"))
    return p.drop("class", *[f"__class_{n}" for n in parts], "given_issues", "given_matches", "marks", "no_entity")


def _attention(matches: Column, hints: list[dict], parsed: Column) -> Column:
    """Model matches, with a hint's requirement, then the hints that have no match. Names match exactly."""
    required = [h["name"] for h in hints if h.get("required") is True]

    def known(a):
        need = a["name"].isin(*required) if required else F.lit(False)
        return F.struct(a["name"].alias("name"), a["aliases"].alias("aliases"), a["status"].alias("status"), a["matched"].alias("matched"), a["candidates"].alias("candidates"), (a["needs_review"] | (need & ~a["matched"])).alias("needs_review"))

    out = F.transform(matches, known)
    names = F.transform(matches, lambda a: a["name"])
    for h in hints:
        need = h.get("required") is True
        status = F.when(parsed, "not_found").otherwise("not_evaluated")
        row = F.struct(
            F.lit(h["name"]).alias("name"),
            F.array(*[F.lit(a) for a in h.get("aliases") or [h["name"]]]).alias("aliases"),
            status.alias("status"),
            F.lit(False).alias("matched"),
            F.array().cast("array<string>").alias("candidates"),
            (F.lit(need) | ~parsed).alias("needs_review"),
        )
        out = F.concat(out, F.when(F.array_contains(names, h["name"]), F.slice(F.array(row), 1, 0)).otherwise(F.array(row)))
    return out


def attention_hints(given: list | None, legacy: list | None = None) -> list[dict]:
    """Hints from texts or objects, older ``legacy`` fields after them: trimmed, nameless ones dropped, the first of a name kept."""
    out: dict[str, dict] = {}
    for g in [*(given or []), *(legacy or [])]:
        g = {"name": g} if isinstance(g, str) else dict(g)
        name = next((str(g[k]).strip() for k in ("name", "label", "field") if str(g.get(k) or "").strip()), "")
        if name and name not in out:
            aliases = [name] + [str(a).strip() for a in g.get("aliases") or []]
            out[name] = {"name": name, "aliases": list(dict.fromkeys(a for a in aliases if a)), "required": g.get("required") is True}
    return list(out.values())


def field_specs(given: list[dict]) -> list[dict]:
    """Field specifications with both spellings of their members; nameless ones are dropped."""
    keys = {"label_pattern": "labelPattern", "position_hint": "positionHint", "format_hint": "formatHint", "allowed_values": "allowedValues", "context_rule": "contextRule"}
    rows = [{"name": str(g.get("name") or "").strip(), "example": g.get("example"), "required": g.get("required")} | {a: g.get(a, g.get(b)) for a, b in keys.items()} for g in given or []]
    return [r | {"ord": i} for i, r in enumerate(rows) if r["name"]]


def explode_list(pages: DataFrame, name: str, *keep: str) -> DataFrame:
    """A member table: path, page, place and the members of list ``name``.

    The outer form, since for the inner one the optimizer adds a filter on the list's size and pushes
    it, with all that makes the list, down to the scan: the list would be made several times.
    """
    keys = ["source_path", "page", *keep]
    return pages.select(*keys, F.posexplode_outer(name).alias("place", "m")).where("place is not null").select(*keys, "place", "m.*")


def words_box(points: Column) -> Column:
    """The box of an 8-point polygon."""
    xs, ys = F.filter(points, lambda _, i: i % 2 == 0), F.filter(points, lambda _, i: i % 2 == 1)
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def rotated_box(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return F.struct((cx - w / 2).alias("x1"), (cy - h / 2).alias("y1"), (cx + w / 2).alias("x2"), (cy + h / 2).alias("y2"))
