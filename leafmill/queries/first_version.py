"""Pages of the first version, scans of packs and recordings, and what is rolled up of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import first_version as v1
from leafmill.operators import merge, trees
from leafmill.operators.normalize import explode_list, normalize_pages
from leafmill.queries.pages import order_answers
from leafmill.queries.registry import query, table
from leafmill.shared import spread


def _obj(**members):
    """JSON text of an object; null members are left out."""
    return F.to_json(F.struct(*[(F.lit(v) if isinstance(v, str | bool) else v).alias(k) for k, v in members.items()]))


def _list(*texts):
    return F.concat(F.lit("["), F.concat_ws(",", *texts), F.lit("]"))


def _answers(spark, sf_dir):
    """A part as an answer of the first version: bare text, wrapped values, repeats, flags."""
    p = spread(table(spark, sf_dir, "part").withColumn("source_path", F.concat(F.lit("part/"), F.col("p_partkey").cast("string"))), "source_path", rows_a_task=25_000)
    k = F.col("p_partkey")
    name = F.col("p_name")
    fields = _list(
        F.to_json(F.array(name)).substr(F.lit(2), F.length(F.to_json(F.array(name))) - 2),
        _obj(name="brand", label="Brand", value=F.concat(F.lit(" "), F.col("p_brand"), F.lit(" ")), confidence="high"),
        _obj(name="brand", label="Brand", value=F.col("p_brand"), confidence="low"),
        _obj(label="Type", text=F.col("p_type"), confidence=F.when(k % 2 == 0, "HIGH").otherwise("medium"), source="table"),
        _obj(name="mark", raw=F.when(k % 3 == 0, "12[?]").otherwise("12"), confidence="high", needs_review=F.when(k % 5 == 0, F.lit(True))),
        _obj(name="nothing"),
    )
    older = _list(_obj(name="size", value=F.col("p_size").cast("string"), confidence="high"), _obj(name="Brand", label="brand", value=F.col("p_brand"), confidence="high"))
    page = F.concat(F.lit('{"page":'), (k % 7).cast("string"), F.lit(',"field_candidates":'), fields, F.lit(',"fields":'), older, F.lit(',"unmapped_fields":["left over"]}'))
    doc = F.when(k % 2 == 0, F.create_map(F.lit("pages"), F.concat(F.lit("["), page, F.lit("]")))).otherwise(F.from_json(page, "map<string,string>"))
    return p.select("source_path", F.lit(1).alias("page"), doc.alias("doc"))


_CANDIDATES = """
c AS (
  SELECT p_partkey, p_partkey % 7 AS pg, u.* FROM part, LATERAL (VALUES
    (0, NULL, NULL, p_name, 'low', 'model_text', true),
    (1, 'brand', 'Brand', p_brand, 'high', 'full_page', false),
    (3, NULL, 'Type', p_type, CASE WHEN p_partkey % 2 = 0 THEN 'low' ELSE 'medium' END, 'table', true),
    (4, 'mark', NULL, CASE WHEN p_partkey % 3 = 0 THEN '12[?]' ELSE '12' END, 'high', 'full_page', p_partkey % 3 = 0 OR p_partkey % 5 = 0),
    (5, 'size', NULL, CAST(p_size AS VARCHAR), 'high', 'full_page', false)) u(place, name, label, value, confidence, source, needs_review))"""


@query(f"""
WITH {_CANDIDATES}
SELECT 'part/' || p_partkey AS source_path, CASE WHEN pg = 0 THEN 1 ELSE pg END AS page, name, label, value, confidence, source, needs_review FROM c
""")
def first_version_candidates(spark, sf_dir):
    pages = v1.first_pages(_answers(spark, sf_dir))
    return explode_list(pages, "candidates").drop("place", "bbox").withColumn("page", F.col("page").cast("int"))


@query(f"""
WITH {_CANDIDATES}
SELECT 'part/' || p_partkey AS source_path, CASE WHEN pg = 0 THEN 1 ELSE pg END AS page, name, value FROM c WHERE place NOT IN (1, 5)
UNION ALL SELECT 'part/' || p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE p_partkey % 7 END, NULL, 'left over' FROM part
""")
def first_version_unmapped(spark, sf_dir):
    """Brand and size are mapped, the rest isn't."""
    from leafmill.functions.text import candidate_key

    pages = v1.first_pages(_answers(spark, sf_dir))
    used = explode_list(pages, "candidates").where("name in ('brand', 'size')").select("source_path", "page", candidate_key("name", "label", "value").alias("candidate_key"))
    return v1.unmapped_fields(pages, used).select("source_path", F.col("page").cast("int").alias("page"), "name", "value")


@query("""
SELECT p_partkey, CASE p_partkey % 8 WHEN 3 THEN '' WHEN 4 THEN '' WHEN 5 THEN '' WHEN 6 THEN '' ELSE p_name END AS model_value,
  CASE p_partkey % 8 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN '' WHEN 3 THEN 'N/A' WHEN 4 THEN 'null' WHEN 5 THEN '' WHEN 6 THEN '' ELSE p_name END AS plain_value
FROM part
""")
def wrapped_values(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k, n = F.col("p_partkey") % 8, F.col("p_name")
    inner = _obj(value=n)
    x = (
        F.when(k == 0, n)
        .when(k == 1, inner)
        .when(k == 2, F.concat(F.lit('{"text":{"raw":"'), n, F.lit('"}}')))
        .when(k == 3, "N/A")
        .when(k == 4, " null ")
        .when(k == 5, '{"other":1}')
        .when(k == 6, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit('{"value":'), inner, F.lit("}")))
    )
    return p.select("p_partkey", v1.model_value(x).alias("model_value"), v1.plain_value(x).alias("plain_value"))


@query("""
SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN s_name WHEN 1 THEN s_name WHEN 2 THEN 'a[?]' WHEN 3 THEN '' WHEN 4 THEN '{"v":1}' ELSE '"x' END AS value,
  CASE WHEN s_suppkey % 6 IN (2, 3) THEN 'low' ELSE 'high' END AS confidence FROM supplier
""")
def crop_values(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey") % 6
    said = F.when(k == 0, _obj(value=F.col("s_name"))).when(k == 1, F.concat(F.lit(" '"), F.col("s_name"), F.lit("' "))).when(k == 2, '{"value": "a[?]"}').when(k == 3, "' ").when(k == 4, '{"v":1}').otherwise('""x" ')
    got = v1.crop_value(said)
    return s.select("s_suppkey", got["value"].alias("value"), got["confidence"].alias("confidence"))


@query("""
SELECT c_custkey, NOT (c_custkey % 3 = 0) OR c_mktsegment = 'BUILDING' OR c_custkey % 7 = 0 OR c_custkey % 11 = 0 AS review,
  NOT (c_custkey % 3 = 0) OR c_mktsegment = 'BUILDING' OR c_custkey % 7 = 0 OR c_custkey % 11 = 0 AS nested FROM customer
""")
def review_marks(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    level = F.when(F.col("c_mktsegment") == "BUILDING", "LOW").otherwise("medium")
    value = F.when(k % 7 == 0, "x[?]").when(k % 11 == 0, "  ").otherwise(F.col("c_name"))
    whole = F.concat(F.lit('{"pages":[{"mapped":{"f":'), F.to_json(F.struct(level.alias("confidence"), (k % 3 == 0).alias("verified"), value.alias("value"))), F.lit("}}]}"))
    rows = c.select("c_custkey", v1.review_mark(level, k % 3 == 0, value).alias("review"), whole.alias("result"))
    nested = F.get_json_object("result", "$.pages[0].mapped.f.needs_review") == "true"
    return trees.mark_review_fields(rows, "result").select("c_custkey", "review", nested.alias("nested"))


@query("""
SELECT 'customer/' || o_custkey AS source_path, CAST(nullif(sum(o_orderkey % 1000), 0) AS DOUBLE) AS input_tokens, CAST(nullif(sum(o_orderkey % 100), 0) AS DOUBLE) AS output_tokens,
  CAST(nullif(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 7 END), 0) AS DOUBLE) AS estimated_image_tokens, count(*) AS api_calls, count(*) + count(DISTINCT o_orderkey) AS compat_calls
FROM orders GROUP BY 1
""")
def token_metrics(spark, sf_dir):
    """Orders as results whose tokens stand three levels deep, beside the calls that the result tells itself."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    image = F.when(F.col("o_orderpriority") == "1-URGENT", 7)
    call = F.struct((k % 1000).alias("input_tokens"), (k % 100).alias("output_tokens"), image.alias("estimated_image_tokens"), F.lit("12").alias("note"))
    result = F.struct(F.array(F.struct(call.alias("usage"), F.col("o_orderstatus").alias("input_tokens"))).alias("pages"), F.struct(F.lit(1).alias("totalApiCalls")).alias("stats"))
    rows = o.select(F.concat(F.lit("customer/"), F.col("o_custkey").cast("string")).alias("source_path"), F.to_json(result).alias("result"))
    return trees.token_metrics(rows, ["source_path"], "result")


@query("""
WITH r AS (SELECT 'customer/' || o_custkey AS source_path, o_orderkey AS page, o_orderstatus <> 'P' AS ok, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 END AS risk,
    o_orderpriority = '1-URGENT' AS review, o_orderkey % 3 AS calls, o_orderkey % 1000 AS tokens FROM orders)
SELECT source_path, count(*) AS page_count, count(*) FILTER (ok) AS successful, coalesce(string_agg('Page ' || page || ': unknown error', '|' ORDER BY page) FILTER (NOT ok), '') AS errors,
  bool_or(NOT ok OR review) AS review_required, CAST(sum(greatest(calls, 1)) FILTER (ok) AS BIGINT) AS total_api_calls, CAST(sum(tokens) FILTER (ok) AS BIGINT) AS total_tokens,
  CASE max(risk) WHEN 2 THEN 'medium' WHEN 1 THEN 'low' END AS hallucination_risk, NOT bool_or(NOT ok OR review) AS success
FROM r GROUP BY 1
""")
def aggregated_pages(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    risk = F.when(F.col("o_orderstatus") == "F", "medium").when(F.col("o_orderstatus") == "O", "low")
    rows = o.select(
        F.concat(F.lit("customer/"), F.col("o_custkey").cast("string")).alias("source_path"), F.col("o_orderkey").alias("page"), (F.col("o_orderstatus") != "P").alias("success"), F.lit(None).cast("string").alias("error"),
        risk.alias("risk"), (F.col("o_orderpriority") == "1-URGENT").alias("review"), (F.col("o_orderkey") % 3).alias("api_calls"), (F.col("o_orderkey") % 1000).alias("input_tokens"),
    )
    return v1.aggregate_pages(rows).withColumn("errors", F.array_join("errors", "|"))


@query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '1 fields extracted' WHEN 2 THEN '2 fields extracted' ELSE '' END AS structure FROM customer
""")
def page_structures(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 4
    one, none = _obj(value=F.col("c_name")), F.lit('{"value":""}')
    text = F.when(k == 1, F.concat(F.lit('{"a":'), one, F.lit(',"b":'), none, F.lit("}"))).when(k == 2, F.concat(F.lit('{"a":'), one, F.lit(',"b":'), one, F.lit("}"))).when(k == 3, F.concat(F.lit('{"a":'), none, F.lit("}")))
    return c.select("c_custkey", v1.page_structure(text).alias("structure"))


@query("""
SELECT o_orderkey, u.name, u.value, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS confidence,
  'qwen3_vl_universal_page_understanding' AS source, o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') AS needs_review, 'customer/' || o_custkey AS source_path, CAST(o_custkey AS VARCHAR) AS source_file, '2024-01-02 03:04:05' AS extracted_at
FROM orders, LATERAL (VALUES ('Order Key', CAST(o_orderkey AS VARCHAR)), ('Customer', CAST(o_custkey AS VARCHAR)), ('Status', o_orderstatus), ('Total', CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR)), ('Priority', o_orderpriority)) u(name, value)
""")
def lossless_candidates(spark, sf_dir):
    pages = normalize_pages(order_answers(spark, sf_dir), repair=False)
    at = F.to_timestamp(F.lit("2024-01-02 03:04:05"))
    found = v1.lossless_candidates(pages, "fields").withColumn("s", v1.source_descriptor("source_path", "page", "stub", at))
    return found.select(F.col("page").cast("long").alias("o_orderkey"), "c.name", "c.value", "c.confidence", "c.source", "c.needs_review", "s.source_path", "s.source_file", "s.extracted_at")


@query("""
WITH e AS (SELECT o_custkey, o_orderkey, lower(o_orderstatus || ':' || o_orderpriority) AS k, o_orderpriority AS value FROM orders),
f AS (SELECT o_custkey, k, min(o_orderkey) AS o_orderkey FROM e GROUP BY 1, 2)
SELECT o_custkey, o_orderkey, printf('ent_%05d', row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)) AS id FROM f
""")
def reindexed_entities(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("type"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(F.lower("o_orderpriority")).alias("value"))
    return merge.reindex_entities(o, ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey", "id")


@query("""
SELECT n_nationkey, 'a=' || CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'x' END || '|b=y' || CASE WHEN n_nationkey % 2 = 0 THEN '|c=' || n_regionkey ELSE '' END AS merged,
  array_to_string(CASE WHEN n_name < 'F' THEN [n_name, 'b'] ELSE ['b', n_name] END, '|') AS strings FROM nation
""")
def merged_objects(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    later = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("c"), F.col("n_regionkey").cast("string"), F.lit("a"), F.col("n_name")))
    both = merge.with_overrides(F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit("y")), later)
    shown = F.transform(F.map_entries(both), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    texts = F.when(F.col("n_name") < "F", F.array(F.lit(" "), F.concat("n_name", F.lit(" ")), F.lit("b"), F.col("n_name"))).otherwise(F.array(F.lit("b"), F.lit(""), F.col("n_name"), F.lit(" b")))
    return n.select("n_nationkey", F.array_join(shown, "|").alias("merged"), F.array_join(v1.unique_strings(texts), "|").alias("strings"))


def _nation_pages(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select(F.concat(F.lit("region/"), F.col("n_regionkey").cast("string")).alias("source_path"), F.col("n_nationkey").alias("page"), F.col("n_name").alias("land"))


@query("""
WITH c AS (SELECT n_regionkey, n_nationkey, CAST((row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) // 3 AS INT) AS pack FROM nation),
p AS (SELECT 'region/' || n_regionkey AS source_path, pack, string_agg(n_nationkey, ',' ORDER BY n_nationkey) AS pages, count(*) AS fields FROM c GROUP BY ALL)
SELECT source_path, pack, pages, fields, length('[Pages ' || pages || ']' || chr(10) || 'read all') // 4 AS input_tokens FROM p
""")
def pack_scan(spark, sf_dir):
    from leafmill.sources.pages import StubModel
    from leafmill.sources.scans import scan_packs

    packs = merge.fixed_chunks(_nation_pages(spark, sf_dir), 3, ["source_path"], ["page"]).withColumnRenamed("chunk", "pack")
    got = scan_packs(packs, StubModel(), "read all")
    n = F.size(F.from_json(F.get_json_object("response", "$.field_candidates"), "array<string>")).cast("long")
    return got.select("source_path", "pack", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), n.alias("fields"), "input_tokens")


@query("""
WITH v AS (SELECT 'video/' || s_suppkey AS source_path, s_suppkey % 50 AS d FROM supplier),
c AS (SELECT source_path, d, unnest(generate_series(0, CAST(ceil(d / 20.0) AS INT) - 1)) AS i FROM v WHERE d > 0)
SELECT source_path, true AS success, string_agg('[Chunk ' || (i + 1) || '] ' || source_path || ' from ' || (i * 20) || ' to ' || least((i + 1) * 20, d) || ' s', chr(10) || chr(10) ORDER BY i) AS text FROM c GROUP BY 1
UNION ALL SELECT source_path, false, '' FROM v WHERE d = 0
""")
def video_scan(spark, sf_dir):
    from leafmill.sources.pages import StubModel, video_chunks
    from leafmill.sources.scans import scan_videos

    v = table(spark, sf_dir, "supplier").select(F.concat(F.lit("video/"), F.col("s_suppkey").cast("string")).alias("source_path"), (F.col("s_suppkey") % 50).cast("double").alias("duration_s"))
    chunks = video_chunks(v, "duration_s", 20.0).withColumn("chunk", F.coalesce("chunk", F.lit(0)))
    return merge.video_summary(scan_videos(chunks, StubModel(), "watch")).select("source_path", "success", "text")


@query("""
SELECT 'region/' || n_regionkey AS source_path, n_nationkey AS page, u.name, u.value, u.confidence, u.state, u.source, u.reasons
FROM nation, LATERAL (VALUES ('land', n_name, 'high', 'accepted', 'line', ''), ('LAND', n_name, 'high', 'accepted', 'line', ''), ('colour', '', 'low', 'missing', NULL, 'missing')) u(name, value, confidence, state, source, reasons)
""")
def model_first_entries(spark, sf_dir):
    from leafmill.plans.passes import model_first
    from leafmill.sources.pages import StubModel

    class Keys(StubModel):
        """Knows the members by name; asked with another case it still gives its own."""

        def recognise(self, task, row, result_schema=None):
            return super().recognise(task, row)

    got = model_first(_nation_pages(spark, sf_dir), Keys(), [{"name": "land"}, {"name": "LAND"}, {"name": "colour"}])
    return got["entries"].select("source_path", "page", "name", "value", "confidence", F.col("validation_state").alias("state"), F.col("evidence_source").alias("source"), F.array_join("reasons", ",").alias("reasons"))


@query("""
SELECT 'file/' || s_suppkey AS source_path, CAST(1 + s_suppkey % 3 AS INT) AS total_pages, 100 + s_suppkey AS first_width, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 100 + s_suppkey WHEN s_suppkey % 2 = 0 THEN 200 ELSE 595 END AS BIGINT) AS last_width
FROM supplier WHERE s_suppkey % 5 > 0
UNION ALL SELECT 'file/' || s_suppkey, NULL, NULL, NULL FROM supplier WHERE s_suppkey % 5 = 0
""")
def pdf_pages_info(spark, sf_dir):
    from leafmill.sources.scans import pdf_info

    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    size = lambda w: F.concat(F.lit("/MediaBox [0 0 "), w.cast("string"), F.lit(" 300]"))
    page = lambda inner: F.concat(F.lit("obj<</Type /Page "), inner, F.lit(">>endobj "))
    middle = F.repeat(page(F.lit("/Rotate 0")), (k % 3).cast("int") - 1)
    last = F.when(k % 2 == 0, page(size(F.lit(200)))).otherwise(page(F.lit("")))
    body = F.concat(F.lit("%PDF-1.4 obj<</Type /Pages /MediaBox [0 0 595.28 842]>>endobj "), F.when(k % 3 == 0, page(size(F.col("s_suppkey") + 100))).otherwise(F.concat(page(size(F.col("s_suppkey") + 100)), middle, last)))
    files = s.select(F.concat(F.lit("file/"), k.cast("string")).alias("source_path"), F.when(k % 5 > 0, body).otherwise("broken").cast("binary").alias("content"))
    info = pdf_info(files)
    wide = lambda i: F.get("pages", i)["w_pt"].cast("long")
    return info.select("source_path", "total_pages", wide(F.lit(0)).alias("first_width"), wide(F.col("total_pages") - 1).alias("last_width"))
