"""Answers to pages to documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leafmill.functions.json_text import as_array, box, members, object_text
from leafmill.operators import merge
from leafmill.operators.normalize import explode_list, normalize_pages
from leafmill.queries.registry import query, table
from leafmill.shared import shared_dir, spread
from leafmill.sinks import exports


def cents(c: str):
    return F.round(F.col(c) * 100).cast("long").cast("string")


def order_answers(spark, sf_dir, empty_every: int = 0):
    """Orders as answers of a page model: a customer is a document, an order a page."""
    source = F.concat(F.lit("customer/"), F.col("o_custkey").cast("string"))
    o = spread(table(spark, sf_dir, "orders").withColumn("source_path", source), "source_path")
    level = F.when(F.col("o_orderpriority") == "1-URGENT", "HIGH").when(F.col("o_orderpriority") == "2-HIGH", "high").when(F.col("o_orderpriority") == "3-MEDIUM", "medium").when(F.col("o_orderpriority") == "5-LOW", "low")

    def field(label, value):
        return F.struct(F.lit(label).alias("label"), value.cast("string").alias("value"), level.alias("confidence"))

    fields = F.array(field("Order Key", F.col("o_orderkey")), field("Customer", F.col("o_custkey")), field("Status", F.col("o_orderstatus")), field("Total", cents("o_totalprice")), field("Priority", F.col("o_orderpriority")))
    issue = F.when(F.col("o_orderstatus") == "F", F.array(F.struct(F.lit("HIGH").alias("severity"), F.lit("closed").alias("message")))).when(F.col("o_orderstatus") == "P", F.array(F.struct(F.lit("weird").alias("severity"), F.lit("pending").alias("message"))))
    if empty_every:
        fields = F.when(F.col("o_orderkey") % empty_every != 0, fields)
    body = F.struct(
        F.struct(F.lit("order").alias("type"), F.lit("high").alias("confidence")).alias("document_classification"),
        fields.alias("field_candidates"),
        issue.alias("review_issues"),
        F.array(F.struct(F.lit("customer").alias("type"), F.col("o_custkey").cast("string").alias("value"))).alias("entities"),
    )
    return o.select(
        "source_path",
        F.col("o_orderkey").cast("int").alias("page"),
        F.lit("page").alias("stage"),
        F.to_json(body).alias("response"),
        F.lit(None).cast("string").alias("reasoning"),
        (F.col("o_orderkey") % 1000).alias("input_tokens"),
        (F.col("o_orderkey") % 100).alias("output_tokens"),
        F.lit(0).cast("long").alias("estimated_image_tokens"),
        F.lit(10).cast("long").alias("elapsed_ms"),
        F.lit(None).cast("string").alias("error"),
    )


_LEVEL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END"
_FIELDS = f"""
f AS (SELECT 'customer/' || o_custkey AS source_path, CAST(o_orderkey AS INT) AS page, u.place, u.label, u.value, {_LEVEL} AS confidence,
        o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') AS needs_review
      FROM orders, LATERAL (VALUES (0, 'Order Key', CAST(o_orderkey AS VARCHAR)), (1, 'Customer', CAST(o_custkey AS VARCHAR)), (2, 'Status', o_orderstatus),
        (3, 'Total', CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR)), (4, 'Priority', o_orderpriority)) u(place, label, value))"""


@query(f"""
WITH {_FIELDS},
p AS (SELECT source_path, min(page) AS page FROM f GROUP BY 1)
SELECT f.source_path, f.label AS name, f.page AS source_page, f.value AS value_original, f.value AS value_normalized, f.label, f.confidence, f.needs_review
FROM f JOIN p ON f.source_path = p.source_path AND f.page = p.page
""")
def extract_final_fields(spark, sf_dir):
    pages = normalize_pages(order_answers(spark, sf_dir), repair=False)
    return merge.final_fields(pages)


@query(f"""
WITH {_FIELDS}
SELECT source_path, page, bool_or(needs_review) OR any_value(s.o_orderstatus) IN ('F', 'P') AS needs_review, true AS parsed,
       bool_or(needs_review) OR any_value(s.o_orderstatus) IN ('F', 'P') AS review_required
FROM f JOIN orders s ON s.o_orderkey = f.page GROUP BY 1, 2
""")
def page_review_flags(spark, sf_dir):
    return normalize_pages(order_answers(spark, sf_dir), repair=False).select("source_path", "page", "needs_review", "parsed", "review_required")


@query("""
WITH i AS (
  SELECT 'high' AS severity, 'no_field_candidates' AS type FROM orders WHERE o_orderkey % 10 = 0
  UNION ALL SELECT 'high', 'model_review_issue' FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT 'medium', 'model_review_issue' FROM orders WHERE o_orderstatus = 'P')
SELECT severity, type, count(*) AS n FROM i GROUP BY 1, 2
""")
def review_issues_by_severity(spark, sf_dir):
    pages = normalize_pages(order_answers(spark, sf_dir, 10), repair=False)
    return explode_list(pages, "issues").groupBy("severity", "type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {_FIELDS}
SELECT source_path, page, 'field_p' || page || '_' || (place + 1) AS field_id, label AS field_name, label, value, value AS value_normalized,
       '' AS value_type_model, confidence, value AS evidence, '' AS attention_match, needs_review, page AS evidence_page
FROM f
""")
def detected_fields_export(spark, sf_dir):
    return exports.detected_field_rows(normalize_pages(order_answers(spark, sf_dir), repair=False))


@query(f"""
WITH {_FIELDS}
SELECT f.source_path, page, 'page_' || page AS record_id, 'order' AS record_type, 'high' AS confidence, o_orderstatus IN ('F', 'P') AS needs_review, label AS name, value
FROM f JOIN orders o ON o.o_orderkey = f.page
""")
def integrated_records(spark, sf_dir):
    return merge.integrated_records(normalize_pages(order_answers(spark, sf_dir), repair=False))


@query("""
SELECT 'customer/' || o_custkey AS source_path, count(*) AS total_api_calls, CAST(sum(o_orderkey % 1000) AS BIGINT) AS total_tokens, CAST(sum(10) AS BIGINT) AS elapsed_ms,
       count(*) AS page_count, min(CAST(o_orderkey AS INT)) AS first_page,
       bool_or(o_orderstatus IN ('F', 'P') OR o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW')) AS review_required, true AS success
FROM orders GROUP BY 1
""")
def document_merge(spark, sf_dir):
    docs = merge.documents(normalize_pages(order_answers(spark, sf_dir), repair=False))
    return docs.select("source_path", "total_api_calls", "total_tokens", "elapsed_ms", "page_count", F.element_at("pages", 1).alias("first_page"), "review_required", "success")


@query("""
WITH o AS (SELECT 'customer/' || o_custkey AS source_path, CAST(o_orderkey AS INT) AS page FROM orders)
SELECT printf('doc_%05d', row_number() OVER (ORDER BY source_path, page)) AS document_id, source_path, page, 'order' AS document_type, 'high' AS confidence FROM o
""")
def detected_documents_pages(spark, sf_dir):
    return merge.detected_documents(normalize_pages(order_answers(spark, sf_dir), repair=False)).select("document_id", "source_path", "page", "document_type", "confidence")


@query("""
SELECT source_path, name, 'not_found' AS status, false AS matched, name = 'Invoice Date' AS needs_review
FROM (SELECT DISTINCT 'customer/' || o_custkey AS source_path, CAST(o_orderkey AS INT) AS page FROM orders), (VALUES ('Invoice Date'), ('Remark')) h(name)
""")
def attention_backfill(spark, sf_dir):
    hints = [{"name": "Invoice Date", "aliases": ["Invoice Date", "date"], "required": True}, {"name": "Remark", "aliases": ["Remark"], "required": False}]
    pages = normalize_pages(order_answers(spark, sf_dir), hints, repair=False)
    return explode_list(pages, "attention").select("source_path", "name", "status", "matched", "needs_review")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 4 = 2 THEN NULL ELSE CASE WHEN p_partkey % 4 = 3 THEN 0.0 ELSE p_size END END AS x1,
       CASE WHEN p_partkey % 4 = 2 THEN NULL ELSE CASE WHEN p_partkey % 4 = 3 THEN 0.0 ELSE p_size * 2 END END AS y1,
       CASE p_partkey % 4 WHEN 0 THEN p_size * 3 WHEN 1 THEN p_size + 10 WHEN 3 THEN p_size END AS x2,
       CASE p_partkey % 4 WHEN 0 THEN p_size * 4 WHEN 1 THEN p_size * 2 + 20 WHEN 3 THEN p_size END AS y2
FROM part
""")
def bbox_normalise(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    s = F.col("p_size")
    k = F.col("p_partkey") % 4
    text = (
        F.when(k == 0, F.to_json(F.struct(s.alias("x1"), (s * 2).alias("y1"), (s * 3).alias("x2"), (s * 4).alias("y2"))))
        .when(k == 1, F.to_json(F.struct(s.alias("x"), (s * 2).alias("y"), F.lit(10).alias("w"), F.lit(20).alias("h"))))
        .when(k == 2, F.to_json(F.struct(s.alias("x1"), (s * 2).alias("y1"))))
        .otherwise(F.to_json(F.struct(s.alias("x2"), s.alias("y2"))))
    )
    return p.select("p_partkey", box(members(text)).alias("b")).select("p_partkey", "b.*")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_linenumber AS DOUBLE) AS x1, CAST(l_quantity AS DOUBLE) AS y1, CAST(l_partkey AS DOUBLE) AS x2, l_suppkey + 0.5 AS y2 FROM lineitem
""")
def json_repair_bbox(spark, sf_dir):
    li = spread(table(spark, sf_dir, "lineitem"))
    body = F.concat(F.lit('{"value": "v", "bbox": {"x1": '), F.col("l_linenumber"), F.lit(", "), F.col("l_quantity").cast("int"), F.lit(", "), F.col("l_partkey"), F.lit(", "), F.col("l_suppkey"), F.lit(".5}}"))
    text = F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("l_orderkey") % 3 == 1, F.concat(F.lit("Here it is: "), body, F.lit(" done."))).otherwise(body)
    b = box(members(members(object_text(text, repair=False))["bbox"]))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", b.alias("b")).select("l_orderkey", "l_linenumber", "l_partkey", "b.*")


@query("""
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS customer, o_orderstatus AS status FROM orders
""")
def json_mend(spark, sf_dir):
    """Answers that only the mending parser reads: single quotes, bare keys, trailing commas, open brackets."""
    o = spread(table(spark, sf_dir, "orders"))
    text = F.concat(F.lit("{customer: '"), F.col("o_custkey"), F.lit("', \"status\": '"), F.col("o_orderstatus"), F.lit("', \"more\": [1, 2,"))
    m = members(object_text(text))
    return o.select("o_orderkey", m["customer"].alias("customer"), m["status"].alias("status"))


@query("""
SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS nation, CASE WHEN c_custkey % 5 IN (0, 1, 4) THEN c_name WHEN c_custkey % 5 = 2 THEN 'the "' || c_name || '" of ' || c_mktsegment ELSE c_name || ', ' || c_mktsegment END AS name,
  CASE c_custkey % 5 WHEN 4 THEN 'true' ELSE c_mktsegment END AS more FROM customer
""")
def json_recovery(spark, sf_dir):
    """Answers that lack commas and colons, quote within texts, comment, abbreviate and shout."""
    c = spread(table(spark, sf_dir, "customer"))
    k, nation, name, more = F.col("c_custkey") % 5, F.col("c_nationkey").cast("string"), F.col("c_name"), F.col("c_mktsegment")
    said = [
        ['{"nation" ', nation, ' "name": "', name, '" "more": "', more, '"}'],
        ['{"nation": ', nation, ', // the key\n "name": /* in full */ "', name, '", "list": [1, 2, ...], "more": "', more, '"}'],
        ['{"nation": ', nation, ', "name": "the "', name, '" of ', more, '", "more": "', more, '"}'],
        ["{\u201cnation\u201d: ", nation, ", \u201cname\u201d: \u201c", name, ", ", more, "\u201d, more: ", more, ", "],
        ['{"nation": ', nation, ', "name": "', name, '", "more": TRUE, "list": [{"a": 1.}'],
    ]
    text = F.coalesce(*[F.when(k == i, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])) for i, parts in enumerate(said)])
    m = members(object_text(text))
    return c.select("c_custkey", m["nation"].alias("nation"), m["name"].alias("name"), m["more"].alias("more"))


@query("""
SELECT 'customer/' || o_custkey AS source_path, CAST(o_orderkey AS INT) AS page, CAST(o_custkey AS VARCHAR) AS value FROM orders
""")
def appended_once(spark, sf_dir):
    """Entities of pages that come in two batches, the second one with all pages and, as after a lost answer, tried again."""
    answers = order_answers(spark, sf_dir)
    folder = f"{shared_dir(spark)}/appended-{uuid.uuid4()}"
    append = exports.append_batches(folder, "orders", lambda new: normalize_pages(new, repair=False))
    append(answers.where("page % 3 = 0"), 0)
    for _ in range(2):
        append(answers, 1)
    return exports.committed(spark, folder, "entities").select("source_path", F.col("page").cast("int").alias("page"), "value")


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS n,
       CASE event_id % 4 WHEN 0 THEN 'a|b' WHEN 1 THEN json_extract_string(props, '$.k') WHEN 2 THEN event_type ELSE '' END AS joined
FROM events
""")
def coerce_array_shapes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 4
    a = as_array(F.when(k == 0, '["a", "b"]').when(k == 1, F.col("props")).when(k == 2, F.col("event_type")))
    return e.select("event_id", F.size(a).alias("n"), F.array_join(a, "|").alias("joined"))


@query("""
SELECT doc_id, length(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS chars, len(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '')) AS text_item_count, 0 AS table_count FROM documents
""")
def page_index(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    body = F.to_json(F.struct(F.struct(F.col("text").alias("raw_markdown"), F.split("text", "\n").alias("text_items")).alias("raw_content")))
    answers = d.select(F.col("doc_id").cast("string").alias("source_path"), F.lit(1).alias("page"), body.alias("response"))
    i = exports.page_index(normalize_pages(answers, repair=False))
    return i.select(F.col("source_path").cast("long").alias("doc_id"), "chars", "text_item_count", "table_count")


@query("""
SELECT page_id, length(trim(regexp_replace(html, '\\s+', ' ', 'g'))) AS html_chars, url AS source_path, md5(trim(regexp_replace(html, '\\s+', ' ', 'g'))) AS html_md5 FROM pages
""")
def html_pages_raw(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    body = F.to_json(F.struct(F.struct(F.col("html").alias("raw_html")).alias("rawContent")))
    n = normalize_pages(p.select(F.col("url").alias("source_path"), F.col("page_id").cast("int").alias("page"), body.alias("response")), repair=False)
    return n.select(F.col("page").cast("long").alias("page_id"), F.length("raw_html").alias("html_chars"), "source_path", F.md5("raw_html").alias("html_md5"))


@query("""
SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn, text) FILTER (coalesce(text, '') <> '') AS page_text FROM conversations GROUP BY 1
""")
def conversation_page_text(spark, sf_dir):
    from leafmill.operators.semantic import page_text

    c = table(spark, sf_dir, "conversations")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return c.groupBy("conv_id").agg(turns.alias("t")).select("conv_id", page_text(F.lit(None), F.lit(None), F.col("t")).alias("page_text"))


@query("""
SELECT l_orderkey AS page, 'table_1' AS table_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) + 1 AS row_index,
       CAST(l_partkey AS VARCHAR) AS col_1, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS col_2, l_returnflag AS col_3 FROM lineitem
UNION ALL SELECT DISTINCT l_orderkey, 'table_1', 1, 'Part', 'Quantity', 'Flag' FROM lineitem
""")
def tables_export(spark, sf_dir):
    t = line_tables(spark, sf_dir)
    body = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("rows"))).alias("tables")).alias("raw_content")))
    n = normalize_pages(t.select(F.lit("lines").alias("source_path"), F.col("l_orderkey").cast("int").alias("page"), body.alias("response")), repair=False)
    return exports.table_rows(n, 3).select(F.col("page").cast("long").alias("page"), "table_id", F.col("row_index").cast("long").alias("row_index"), "col_1", "col_2", "col_3")


def line_tables(spark, sf_dir):
    """An order's lines as a table with a heading."""
    # dealt by what they are grouped by: one shuffle, and no sort of all lines before it
    li = spread(table(spark, sf_dir, "lineitem"), "l_orderkey")
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    lines = F.transform(F.sort_array(F.collect_list(row)), lambda r: F.array(r["l_partkey"].cast("string"), r["l_quantity"].cast("int").cast("string"), r["l_returnflag"]))
    return li.groupBy("l_orderkey").agg(F.concat(F.array(F.array(F.lit("Part"), F.lit("Quantity"), F.lit("Flag"))), lines).alias("rows"))


@query(f"""
WITH {_FIELDS},
r AS (SELECT source_path, row_number() OVER (PARTITION BY source_path ORDER BY page, label) AS i, '- page_' || page || ' ' || label || ' = ' || value AS t FROM f),
s AS (SELECT 'customer/' || o_custkey AS source_path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i,
        CASE o_orderstatus WHEN 'F' THEN '- high model_review_issue closed' ELSE '- medium model_review_issue pending' END AS t FROM orders WHERE o_orderstatus IN ('F', 'P')),
a AS (SELECT source_path, string_agg(t, chr(10) ORDER BY i) FILTER (i <= 100) AS t, count(*) AS n FROM r GROUP BY 1),
b AS (SELECT source_path, string_agg(t, chr(10) ORDER BY i) FILTER (i <= 200) AS t, count(*) AS n FROM s GROUP BY 1),
h AS (SELECT 'customer/' || o_custkey AS source_path, count(*) AS n FROM orders GROUP BY 1)
SELECT h.source_path, '# ' || h.source_path || chr(10) || chr(10) || 'pages: ' || h.n || chr(10) || 'classification: order'
  || chr(10) || chr(10) || '## Records' || chr(10) || coalesce(a.t, 'none') || CASE WHEN a.n > 100 THEN chr(10) || '... ' || (a.n - 100) || ' more' ELSE '' END
  || chr(10) || chr(10) || '## Issues' || chr(10) || coalesce(b.t, 'none') || CASE WHEN b.n > 200 THEN chr(10) || '... ' || (b.n - 200) || ' more' ELSE '' END AS markdown
FROM h LEFT JOIN a ON a.source_path = h.source_path LEFT JOIN b ON b.source_path = h.source_path
""")
def markdown_report(spark, sf_dir):
    pages = normalize_pages(order_answers(spark, sf_dir), repair=False)
    return exports.report(pages)
