"""Column functions over single rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import text
from leafmill.functions.tokens import crop_box, frames_of, pdf_kind
from leafmill.operators import imaging, semantic, validate
from leafmill.queries.pages import line_tables
from leafmill.queries.registry import query, table
from leafmill.sources.pages import batch_requests, expand_pages, media_type, mime, read_batch_lines


@query("""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN lower(p_type) IN ('high', 'medium', 'low') ELSE true END AS known,
  CASE p_size % 4 WHEN 0 THEN CASE WHEN lower(p_type) IN ('high', 'medium', 'low') THEN lower(p_type) ELSE 'low' END WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS v2, CASE p_size % 4 WHEN 2 THEN 'medium' ELSE 'low' END AS v1
FROM part
""")
def confidence_coercion(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_size") % 4
    raw = F.when(k == 0, F.col("p_type")).when(k == 1, "HIGH").when(k == 2, "medium")
    known = F.when(k == 0, F.lower("p_type").isin("high", "medium", "low")).otherwise(True)
    return p.select("p_partkey", known.alias("known"), text.confidence(raw).alias("v2"), text.confidence(raw, lower=False).alias("v1"))


@query(r"""
SELECT p_partkey, lower(regexp_replace(p_name || ' (No. ' || p_brand || ')', '[\s_.,:;''"()\[\]{}|\\/-]+', '', 'g')) AS comparable,
  regexp_replace(regexp_replace(lower(regexp_replace(p_name || ' (No. ' || p_brand || ')', '[\s_.,:;''"()\[\]{}|\\/-]+', '', 'g')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS canonical,
  regexp_replace(upper(p_name || ' (No. ' || p_brand || ')'), '[^A-Z0-9]+', '', 'g') AS evidence
FROM part
""")
def text_keys(spark, sf_dir):
    x = F.concat("p_name", F.lit(" (No. "), "p_brand", F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", text.comparable(x).alias("comparable"), text.canonical(x).alias("canonical"), text.evidence_key(x).alias("evidence"))


_SHOWN = "CASE c_custkey % 5 WHEN 1 THEN ' 1/' || c_name || 'l;' WHEN 3 THEN 'SKy 8l,' ELSE c_name END"


@query(f"""
WITH v AS (SELECT c_custkey, c_custkey % 5 AS k, {_SHOWN} AS v FROM customer),
c AS (SELECT c_custkey, k, v, CASE k
  WHEN 0 THEN translate(v, 'OolISsBZzT', '0011558227') WHEN 1 THEN replace(translate(v, 'OolISs', '001155'), '/', '-')
  WHEN 2 THEN translate(v, 'Oo', '00') ELSE v END AS c,
  string_split(v, '') AS chars FROM v),
n AS (SELECT *, [y FOR y IN [CASE k
  WHEN 0 THEN CASE WHEN contains('OolISsBZzT', x) THEN '''' || x || ''' -> ''' || translate(x, 'OolISsBZzT', '0011558227') || '''' END
  WHEN 1 THEN CASE WHEN contains('OolISs', x) THEN '''' || x || ''' -> ''' || translate(x, 'OolISs', '001155') || '''' END
  WHEN 2 THEN CASE WHEN contains('Oo', x) THEN '''' || x || ''' -> ''0''' END
  WHEN 3 THEN CASE WHEN contains('SEKXDOCGB80125Il', x) THEN '''' || x || ''' might be ''' || translate(x, 'SEKXDOCGB80125Il', 'ESXKODGC8BOIZS11') || ''' (uncertain)' END
  ELSE NULL END FOR x IN chars] IF y IS NOT NULL] AS notes FROM c)
SELECT c_custkey, regexp_replace(regexp_replace(trim(c), '^[.,;:]+', ''), '[.,;:]+$', '') AS corrected,
  array_to_string(list_concat(list_concat(CASE WHEN k = 1 AND contains(v, '/') THEN ['normalized date separators'] ELSE [] END, notes),
    list_concat(CASE WHEN trim(c) <> c THEN ['trimmed whitespace'] ELSE [] END,
      CASE WHEN regexp_matches(trim(c), '^[.,;:]|[.,;:]$') THEN ['removed punctuation artifacts'] ELSE [] END)), '|') AS corrections
FROM n
""")
def ocr_char_correction(spark, sf_dir):
    k = F.col("c_custkey") % 5
    hint = F.when(k == 0, "number").when(k == 1, "yyyy/mm/dd").when(k == 2, "email").when(k == 3, "company").otherwise("")
    fixed = text.corrected_characters(F.expr(_SHOWN), hint)
    return table(spark, sf_dir, "customer").select("c_custkey", fixed["corrected"].alias("corrected"), F.array_join(fixed["corrections"], "|").alias("corrections"))


@query("""
WITH s AS (SELECT s_suppkey, ['已付 未收', '牛午', 'no letters 1', '天王田甲', '貝准侯', '己末', '淮候見'][CAST(s_suppkey % 7 AS INT) + 1] AS t FROM supplier),
p(place, a, b) AS (VALUES (1,'已','己'),(2,'未','末'),(3,'日','曰'),(4,'土','士'),(5,'千','干'),(6,'人','入'),(7,'八','入'),(8,'大','太'),(9,'天','夫'),(10,'王','玉'),
  (11,'甲','由'),(12,'田','由'),(13,'牛','午'),(14,'午','牛'),(15,'貝','見'),(16,'見','貝'),(17,'准','淮'),(18,'淮','准'),(19,'侯','候'),(20,'候','侯'))
SELECT s_suppkey, coalesce(string_agg('Chinese confusion: "' || a || '" present, could be "' || b || '"', '|' ORDER BY place), '') AS warnings
FROM s LEFT JOIN p ON contains(t, a) GROUP BY s_suppkey
""")
def chinese_confusion(spark, sf_dir):
    texts = F.array(*[F.lit(x) for x in ("已付 未收", "牛午", "no letters 1", "天王田甲", "貝准侯", "己末", "淮候見")])
    shown = F.element_at(texts, (F.col("s_suppkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(validate.confusable(shown), "|").alias("warnings"))


@query(r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(text, '\+1 \(\d{3}\) \d{3}-\d{4}')) AS phone FROM documents),
v AS (SELECT doc_id, phone, '(+45) ' || right(phone, 8) AS dk FROM d)
SELECT doc_id, phone, regexp_matches(phone, '^\(\+?\d{1,4}\)\s?[\d\s\-]{7,15}$') AS valid, '(852)' || regexp_replace(right(phone, 8), '-', '', 'g') AS repaired FROM v
""")
def phone_prefix_repair(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\+1 \(\d{3}\) \d{3}-\d{4}"), 0)).alias("phone"))
    return d.select("doc_id", "phone", validate.phone_check(F.col("phone"))["valid"].alias("valid"), validate.repair_phone(F.concat(F.lit("(+45) "), F.right("phone", F.lit(8)))).alias("repaired"))


@query("""
SELECT p_partkey, contains(lower(p_name), lower(split_part(p_name, ' ', 1))) AS holds_word,
  NOT (length(split_part(lower(p_name), ' ', 1)) >= 4 AND split_part(lower(p_name), ' ', 1) NOT IN ('number','date','code','amount','total')) AS safe
FROM part
""")
def safety_label_in_value(spark, sf_dir):
    first = F.split("p_name", " ")[0]
    return table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").contains(F.lower(first)).alias("holds_word"), validate.is_safe(first, F.col("p_name")).alias("safe"))


_RANGES = [("1-3,5", 10), ("5,3,3", 10), ("2-99", 6), ("1-3-5", 10), ("", 3), ("0", 5), ("-3", 5), ("99", 5), ("4-2", 9), ("a", 4), (",", 4), (" ", 4), (" 2 , ,4", 4)]


@query("""
WITH r AS (SELECT o_orderkey AS k, o_orderkey % 7 + 1 AS a, o_orderkey % 7 + 1 + o_orderkey % 4 AS b, 8 AS total FROM orders)
SELECT DISTINCT k, page FROM (SELECT k, CAST(unnest(list_concat(range(a, least(b, total) + 1), [total])) AS INT) AS page FROM r)
""")
def page_range_expand(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = o["o_orderkey"] % 7 + 1
    r = o.select(F.col("o_orderkey").alias("k"), F.concat(a.cast("string"), F.lit("-"), (a + o["o_orderkey"] % 4).cast("string"), F.lit(", 8")).alias("pages"), F.lit(8).alias("total_pages"))
    return expand_pages(r).where("error is null").select("k", "page")


@query("""
WITH t(k, text, total, pages, wrong) AS (VALUES (0, '1-3,5', 10, '1,2,3,5', false), (1, '5,3,3', 10, '3,5', false), (2, '2-99', 6, '2,3,4,5,6', false), (3, '1-3-5', 10, '1,2,3', false), (4, '', 3, '1,2,3', false),
  (5, '0', 5, '', true), (6, '-3', 5, '', true), (7, '99', 5, '', true), (8, '4-2', 9, '', true), (9, 'a', 4, '', true), (10, ',', 4, '', true), (11, ' ', 4, '', true), (12, ' 2 , ,4', 4, '2,4', false))
SELECT o_orderkey, text, pages, wrong FROM orders JOIN t ON o_orderkey % 13 = k
""")
def page_range_cases(spark, sf_dir):
    from leafmill.sources.pages import page_range

    case = lambda i: F.element_at(F.array(*[F.lit(r[i]) for r in _RANGES]), (F.col("o_orderkey") % len(_RANGES) + 1).cast("int"))
    r = table(spark, sf_dir, "orders").select("o_orderkey", case(0).alias("text"), case(1).alias("total")).withColumn("r", page_range("text", F.col("total")))
    return r.select("o_orderkey", "text", F.array_join(F.col("r.pages").cast("array<string>"), ",").alias("pages"), F.col("r.error").isNotNull().alias("wrong"))


_EXTENSIONS = ("", ".PDF", ".png", ".jpg", ".JPEG", ".webp", ".gif", ".mp4", ".mpeg", ".mov", ".avi", ".flv", ".mpg", ".webm", ".wmv", ".3gpp", ".bmp", ".mkv")


@query("""
WITH t(k, media_type, mime) AS (VALUES (0, 'unknown', 'application/octet-stream'), (1, 'pdf', 'application/pdf'), (2, 'image', 'image/png'), (3, 'image', 'image/jpeg'), (4, 'image', 'image/jpeg'),
  (5, 'image', 'image/webp'), (6, 'image', 'image/gif'), (7, 'video', 'video/mp4'), (8, 'video', 'video/mpeg'), (9, 'video', 'video/quicktime'), (10, 'video', 'video/x-msvideo'), (11, 'video', 'video/x-flv'),
  (12, 'video', 'video/mpeg'), (13, 'video', 'video/webm'), (14, 'video', 'video/x-ms-wmv'), (15, 'video', 'video/3gpp'), (16, 'unknown', 'application/octet-stream'), (17, 'unknown', 'application/octet-stream'))
SELECT page_id, media_type, mime FROM pages JOIN t ON page_id % 18 = k
""")
def media_types(spark, sf_dir):
    end = F.element_at(F.array(*[F.lit(e) for e in _EXTENSIONS]), (F.col("page_id") % 18 + 1).cast("int"))
    p = table(spark, sf_dir, "pages").withColumn("path", F.concat(F.lit("/x.y/f"), end))
    return p.select("page_id", media_type("path").alias("media_type"), mime("path").alias("mime"))


@query(r"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_partkey || '|' || CAST(l_quantity AS INT) || '|' || l_returnflag || ' x' AS cells FROM lineitem
""")
def latex_table_parse(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    line = F.concat(F.lit("\\hline \\textbf{"), F.col("l_partkey"), F.lit("} & "), F.col("l_quantity").cast("int"), F.lit("  & "), "l_returnflag", F.lit("\\hspace{1cm}x \\\\"))
    r = semantic.latex_rows(F.concat(F.lit("no row here\n"), line))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.array_join(F.get(r, F.lit(0)), "|").alias("cells"))


@query("""
SELECT o_orderkey, u.label, u.value, 'medium' AS confidence, 'colon_labeled_text' AS rule
FROM orders, LATERAL (VALUES ('Order Key', CAST(o_orderkey AS VARCHAR)), ('Status', o_orderstatus), ('Priority', o_orderpriority)) u(label, value)
""")
def labeled_text_fields(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    t = F.concat(F.lit("Order Key:  "), F.col("o_orderkey"), F.lit("\nStatus: "), "o_orderstatus", F.lit("\nno label in this line\nPriority :"), "o_orderpriority", F.lit("\n12: 34\nName   spaced value"))
    return o.select("o_orderkey", F.explode(semantic.labelled_text(t)).alias("c")).select("o_orderkey", F.trim("c.label").alias("label"), "c.value", "c.confidence", "c.rule")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, 'Flag ' || l_returnflag AS label, l_partkey || ' | ' || CAST(l_quantity AS INT) AS value FROM lineitem
""")
def table_label_value(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rows = F.array(F.array(F.concat(F.lit("Flag "), "l_returnflag"), F.col("l_partkey").cast("string"), F.lit(""), F.col("l_quantity").cast("int").cast("string")), F.array(F.lit("Only"), F.lit("labels")), F.array(F.lit("alone")))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.explode(semantic.table_candidates(rows)).alias("c")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "c.label", "c.value")


@query("""
WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) AS row_index, l_partkey, l_quantity, l_returnflag FROM lineitem)
SELECT l_orderkey, row_index, u.name, u.value FROM r, LATERAL (VALUES ('part', CAST(l_partkey AS VARCHAR)), ('quantity', CAST(CAST(l_quantity AS INT) AS VARCHAR)), ('flag', l_returnflag)) u(name, value)
""")
def table_row_records(spark, sf_dir):
    return line_tables(spark, sf_dir).select("l_orderkey", F.explode(semantic.row_records(F.col("rows"))).alias("r")).select("l_orderkey", F.col("r.row_index").cast("long").alias("row_index"), "r.name", "r.value")


@query("""
WITH p AS (SELECT p_partkey, p_size * 10.0::DOUBLE AS x1, p_size * 10.0::DOUBLE + 100 AS x2 FROM part)
SELECT p_partkey, CAST(greatest(0, floor((x1 - (x2 - x1) * 0.4) / 1000 * 800)) AS INT) AS "left", CAST(least(800, ceil((x2 + (x2 - x1) * 0.4) / 1000 * 800)) - greatest(0, floor((x1 - (x2 - x1) * 0.4) / 1000 * 800)) AS INT) AS width FROM p
""")
def crop_rectangles(spark, sf_dir):
    x1 = F.col("p_size") * 10.0
    b = crop_box(x1, x1, x1 + 100, x1 + 100, F.lit(800), F.lit(800))
    return table(spark, sf_dir, "part").select("p_partkey", b["left"].alias("left"), b["width"].alias("width"))


@query("""
WITH s AS (SELECT p_partkey, p_size, CAST(p_partkey % 100 AS DOUBLE) / 100 AS one FROM part),
r AS (SELECT *, CASE WHEN one > 0 THEN one * p_size / 50 / one END AS ratio FROM s)
SELECT p_partkey, least(CAST(floor(p_partkey * 100000 / (5 * 1048576 / 8.0) * 2 + 0.5) AS BIGINT), 2000) AS frames,
  CASE WHEN ratio > 0.8 OR (one > 0.35 AND ratio > 0.7) THEN 'image' ELSE 'text' END AS pdf_kind
FROM r
""")
def media_estimates(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    one = F.col("p_partkey") % 100 / 100.0
    return p.select("p_partkey", frames_of(F.col("p_partkey") * 100000, F.lit(2)).alias("frames"), pdf_kind(one, one * F.col("p_size") / 50.0).alias("pdf_kind"))


@query("""
SELECT CAST(CASE WHEN o_orderkey % 5 = 4 THEN 0 ELSE o_orderkey END AS INT) AS page, o_orderkey % 5 < 3 AS success, CASE WHEN o_orderkey % 5 < 3 THEN o_orderpriority END AS text,
  CASE WHEN o_orderkey % 5 = 3 THEN 'overloaded' WHEN o_orderkey % 5 = 4 THEN 'parse error' END AS error, CASE WHEN o_orderkey % 5 < 3 THEN o_custkey END AS input_tokens
FROM orders
""")
def batch_results(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 5
    good = F.to_json(F.struct(F.concat(F.lit("page-"), F.col("o_orderkey")).alias("custom_id"), F.struct(F.lit(200).alias("status_code"), F.struct(F.array(F.struct(F.struct(F.col("o_orderpriority").alias("content")).alias("message"))).alias("choices"), F.struct(F.col("o_custkey").alias("prompt_tokens")).alias("usage")).alias("body")).alias("response")))
    failed = F.to_json(F.struct(F.concat(F.lit("page-"), F.col("o_orderkey")).alias("custom_id"), F.struct(F.lit(503).alias("status_code")).alias("response"), F.struct(F.lit("overloaded").alias("message")).alias("error")))
    lines = o.select(F.when(k < 3, good).when(k == 3, failed).otherwise("{broken").alias("value"))
    return read_batch_lines(lines).select("page", "success", "text", "error", "input_tokens")


@query("""
SELECT url AS source_path, CAST(page_id AS INT) AS page, CASE WHEN page_id % 3 = 0 THEN 'render failed' END AS error,
  CASE WHEN page_id % 3 <> 0 THEN '{"custom_id":"page-' || page_id || '","method":"POST","url":"/v1/chat/completions","body":{"model":"vision","max_tokens":4096,"messages":[{"role":"user","content":[{"type":"image_url","image_url":{"url":"data:image/png;base64,'
    || base64(encode(html)) || '"}},{"type":"text","text":"[Page ' || page_id || ']\\nRead"}]}]}}' END AS line
FROM pages
""")
def batch_submit(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("url").alias("source_path"), F.col("page_id").cast("int").alias("page"), F.lit("image/png").alias("mime"), F.when(F.col("page_id") % 3 != 0, F.col("html").cast("binary")).alias("content"))
    return batch_requests(p, "vision", "Read").select("source_path", "page", "error", "line")


@query()
def image_quality(spark, sf_dir):
    """Quality, inversion and type of images whose samples are the bytes of the documents' texts."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("gray"), F.lit(64).alias("width"))
    m = d.select("doc_id", imaging.quality_measures("gray", "width").alias("q"), imaging.darkness("gray", "width").alias("k"), imaging.type_measures("gray", "width").alias("t"))
    return m.select("doc_id", "q.*", imaging.quality_level(F.col("q")).alias("quality"), imaging.is_inverted(F.col("k")).alias("inverted"), imaging.document_type(F.col("t")).alias("document_type"))


_PHONES = ("'(852) 1234 ' || n", "'852-1234 ' || n", "'4123 ' || n", "'(852-1234 ' || n", "'(+45) 1234 ' || n", "'(452)1234' || n", "'+452 1234 ' || n", "'(+1) 555 1234 ' || n", "'no number ' || n")


@query(rf"""
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'HK office' WHEN c_custkey % 4 = 1 THEN '+852' WHEN c_custkey % 4 = 2 THEN 'Denmark' END AS hint, lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS n FROM customer),
v AS (SELECT *, CASE c_custkey % {len(_PHONES)} {" ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(_PHONES))} END AS phone FROM c),
b AS (SELECT *, regexp_replace(phone, '[\s-]', '', 'g') AS bare FROM v),
o AS (SELECT *, regexp_replace(bare, '^\(\+?45\)', '(852)') AS once FROM b),
r AS (SELECT *, regexp_replace(regexp_replace(once, '^\(452\)', '(852)'), '^\+?452', '+852') AS clean FROM o),
k AS (SELECT *, CASE WHEN hint IN ('HK office', '+852') THEN regexp_matches(phone, '^\(852\)\s?\d{{4}}\s?\d{{4}}$') OR regexp_matches(clean, '^\(852\)\s?\d{{4}}\s?\d{{4}}$') OR regexp_matches(phone, '^(\+?852[\s-]?)?\d{{4}}[\s-]?\d{{4}}$') OR regexp_matches(clean, '^(\+?852[\s-]?)?\d{{4}}[\s-]?\d{{4}}$')
  ELSE regexp_matches(phone, '^\(\+?\d{{1,4}}\)\s?[\d\s\-]{{7,15}}$') END AS valid FROM r)
SELECT c_custkey, phone, valid, CASE WHEN NOT valid AND clean <> phone THEN clean ELSE '' END AS suggested,
  concat_ws('|', CASE WHEN regexp_matches(bare, '^\(\+?45\)') THEN 'hallucinated +45 (likely HK 852)' END, CASE WHEN regexp_matches(once, '^\(452\)') THEN 'invalid prefix 452 (likely HK 852)' END, CASE WHEN regexp_matches(once, '^\+?452') THEN 'invalid prefix +452 (likely HK 852)' END) AS issues,
  regexp_matches(bare, '^\(\+?45\)|^\+45|^\(452\)') AS made_up
FROM k
""")
def phone_formats(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k, F.when(k % 4 == 0, "HK office").when(k % 4 == 1, "+852").when(k % 4 == 2, "Denmark").alias("hint"), F.lpad((k % 10000).cast("string"), 4, "0").alias("n"))
    v = c.withColumn("phone", F.element_at(F.array(*[F.expr(p) for p in _PHONES]), (k % len(_PHONES) + 1).cast("int"))).withColumn("c", validate.phone_check(F.col("phone"), F.col("hint")))
    return v.select("c_custkey", "phone", "c.valid", "c.suggested", F.array_join("c.issues", "|").alias("issues"), validate.phone_hallucinated(F.col("phone")).alias("made_up"))


#: A part's name as models give it back: quoted, in backticks, with fences, with empty lines.
_VOTES = {0: "chr(34) || p_name || chr(34) || ' '", 1: "'`' || p_name || '`'", 2: "p_name || ' ```' || p_brand || '```'", 3: "' ' || chr(39) || p_name || chr(10) || chr(10) || chr(10) || p_brand", 4: "p_name || chr(10) || ' ' || chr(10) || p_brand", 5: "'```' || p_name || '``` ' || chr(39) || p_brand || chr(39)"}
_VOTE = f"CASE p_partkey % 6 {' '.join(f'WHEN {k} THEN {v}' for k, v in _VOTES.items())} END"


@query(rf"""
SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace({_VOTE}, '^["''\s]+|["''\s]+$', '', 'g'), '(?s)```.*?```', '', 'g'), '\n{{2,}}', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS vote FROM part
""")
def clean_votes(spark, sf_dir):
    from leafmill.operators.consensus import clean_vote

    return table(spark, sf_dir, "part").select("p_partkey", clean_vote(F.expr(_VOTE)).alias("vote"))


_PROMPTS = ("Extract all", "提取所有欄位", "用中文回答", "以英文 english 回答", "Answer in Chinese 提取", "which LANGUAGE 語言", "語言")


@query("""
WITH t(k, prompt, hinted) AS (VALUES (0, 'Extract all', false), (1, '提取所有欄位', true), (2, '用中文回答', true), (3, '以英文 english 回答', true), (4, 'Answer in Chinese 提取', false), (5, 'which LANGUAGE 語言', false), (6, '語言', true))
SELECT s_suppkey, CASE WHEN hinted THEN prompt || chr(10) || 'Please answer in Traditional Chinese when field labels or source text are Chinese.' ELSE prompt END AS prompt FROM supplier JOIN t ON s_suppkey % 7 = k
""")
def prompt_language(spark, sf_dir):
    from leafmill.functions.text import enhance_prompt

    p = F.element_at(F.array(*[F.lit(x) for x in _PROMPTS]), (F.col("s_suppkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", enhance_prompt(p).alias("prompt"))


@query("""
WITH p(k, normal, turned) AS (VALUES
  (0, 'auto-orient,sharpen(sigma=0.7)', 'auto-orient,sharpen(sigma=0.7)'),
  (1, 'auto-orient,normalize,contrast(handwriting 1.6,-50),sharpen(handwriting sigma=1.1),sobel-edge(handwriting)', 'auto-orient,grayscale,normalize,contrast(1.35,-35),sharpen(sigma=0.7)'),
  (2, 'auto-orient,grayscale,contrast(table-light 1.2)', 'auto-orient,grayscale,normalize,contrast(1.35,-35)'),
  (3, 'auto-orient,normalize,contrast(handwriting 1.6,-50),sharpen(handwriting sigma=1.1),sobel-edge(handwriting)', 'auto-orient,normalize,contrast(1.35,-35),sharpen(sigma=0.7)'),
  (4, 'auto-orient,grayscale,normalize,contrast(1.35,-35),sharpen(sigma=0.7)', 'auto-orient,grayscale,normalize,contrast(1.35,-35),sharpen(sigma=0.7)'),
  (5, 'auto-orient,normalize,contrast(1.35,-35),sharpen(sigma=0.7),sobel-edge(scan)', 'auto-orient,normalize,contrast(1.35,-35),sharpen(sigma=0.7)'),
  (6, '', ''))
SELECT page_id, CASE WHEN page_id % 2 = 1 AND k < 6 THEN 'invert(negative-detect),' || turned ELSE normal END AS steps FROM pages JOIN p ON page_id % 7 = k
""")
def preprocess_steps(spark, sf_dir):
    names = ("light", "aggressive", "table", "handwriting", "negative", "scanned", "unknown")
    preset = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("page_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(imaging.step_log(preset, F.col("page_id") % 2 == 1), ",").alias("steps"))


@query("""
WITH f AS (SELECT p_type, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_name END AS layout, CASE p_partkey % 40 WHEN 0 THEN NULL WHEN 1 THEN upper(p_name) || 'x' ELSE p_name END AS own, p_partkey % 50 = 3 AS low FROM part)
SELECT p_type, bool_and(own IS NOT NULL AND NOT low AND (layout IS NULL OR layout = own)) AS skip FROM f GROUP BY 1
""")
def validation_skipped(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    own = F.when(k % 40 == 0, F.lit(None)).when(k % 40 == 1, F.concat(F.upper("p_name"), F.lit("x"))).otherwise(F.col("p_name"))
    pairs = p.select("p_type", F.when(k % 9 != 0, F.col("p_name")).alias("layout_value"), own.alias("field_value"), F.when(k % 50 == 3, "low").otherwise("high").alias("confidence"))
    return validate.skip_validation(pairs, ["p_type"])
