"""Joins: matching, evidence, gates, merges of two sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.operators import containment, matching, semantic, validate
from leafmill.queries.registry import query, table
from leafmill.shared import spread


@query("""
SELECT 'customer:' || c_custkey AS source_key, coalesce(n.n_name, 'nation:' || c_nationkey) AS target FROM customer LEFT JOIN nation n ON n.n_nationkey = c_nationkey AND n.n_regionkey < 3
""")
def entity_relationship_join(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation").where("n_regionkey < 3")
    rel = c.select(F.concat(F.lit("customer:"), F.col("c_custkey")).alias("source_key"), F.concat(F.lit("nation:"), F.col("c_nationkey")).alias("to"))
    ent = n.select(F.lit("nation").alias("type"), F.col("n_nationkey").cast("string").alias("value"), F.col("n_name").alias("id"))
    return matching.resolve_targets(rel, ent).select("source_key", F.col("to").alias("target"))


def part_candidates(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("doc"), F.lit("part name").alias("name"), F.lit("Part Name").alias("label"), F.col("p_name").alias("value"), F.col("p_partkey").alias("idx"))


@query("""
WITH h(hint, alias, required) AS (VALUES ('Type', 'type', true), ('Type', (SELECT min(lower(split_part(p_name, ' ', 1))) FROM part), true), ('Name', 'part-name', false), ('Absent', 'zzzzqqq', true), ('Missing', 'qqqqzzz', false)),
c AS (SELECT p_brand AS doc, p_partkey, regexp_replace(lower('part namePart Name' || p_name), '[ _.,:;()-]+', '', 'g') AS hay FROM part),
a AS (SELECT hint, regexp_replace(alias, '[ _.,:;()-]+', '', 'g') AS alias FROM h),
m AS (SELECT DISTINCT doc, p_partkey, hint FROM c JOIN a ON contains(hay, alias) OR contains(alias, hay)),
n AS (SELECT doc, hint, count(*) AS n FROM m GROUP BY 1, 2)
SELECT d.doc, x.hint, coalesce(n.n, 0) AS candidates, coalesce(n.n, 0) > 0 AS matched, x.required AND coalesce(n.n, 0) = 0 AS needs_review
FROM (SELECT DISTINCT p_brand AS doc FROM part) d CROSS JOIN (SELECT DISTINCT hint, required FROM h) x LEFT JOIN n ON n.doc = d.doc AND n.hint = x.hint
""")
def attention_match(spark, sf_dir):
    first = table(spark, sf_dir, "part").agg(F.min(F.lower(F.split("p_name", " ")[0]))).first()[0]
    hints = spark.createDataFrame([("Type", ["type", first], True), ("Name", ["part-name"], False), ("Absent", ["zzzzqqq"], True), ("Missing", ["qqqqzzz"], False)], "name string, aliases array<string>, required boolean")
    c = part_candidates(spark, sf_dir)
    return matching.attention_status(c, hints, c, ["doc"])


@query("""
WITH l AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS v, count(DISTINCT l_returnflag) AS n, arg_min(l_returnflag, (l_linenumber, l_partkey, l_suppkey, l_quantity)) AS first FROM lineitem GROUP BY 1)
SELECT l_orderkey, s.spec, CASE s.spec WHEN 'flag' THEN first ELSE '' END AS value, CASE s.spec WHEN 'flag' THEN n ELSE 0 END AS n_values, s.spec = 'flag' AND n > 1 AS conflict,
  CASE WHEN s.spec = 'flag' AND n = 1 THEN 'high' ELSE 'low' END AS confidence, s.spec = 'flag' AND n = 1 AS verified, NOT (s.spec = 'flag' AND n = 1) AS needs_review, CASE s.spec WHEN 'flag' THEN n > 1 ELSE true END AS required_unverified
FROM l CROSS JOIN (VALUES ('flag'), ('color')) s(spec)
""")
def field_spec_mapping(spark, sf_dir):
    li = spread(table(spark, sf_dir, "lineitem"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    c = li.select("l_orderkey", F.lit("return flag").alias("name"), F.lit("Return Flag").alias("label"), F.col("l_returnflag").alias("value"), F.lit("high").alias("confidence"), place.cast("long").alias("ord_in"))
    specs = spark.createDataFrame([(0, "flag", "Flag|Code", True), (1, "color", "colour|color", True)], "ord int, name string, label_pattern string, required boolean")
    return matching.map_fields(matching.match_specs(c, specs, ["l_orderkey"]), specs, c, ["l_orderkey"])


@query("""
WITH v AS (SELECT l_orderkey AS doc, 'flag' AS field, l_returnflag AS value FROM lineitem WHERE l_linenumber % 2 = 1)
SELECT doc, field, min(value) AS value FROM v GROUP BY 1, 2 HAVING count(DISTINCT value) = 1
""")
def accepted_final_json(spark, sf_dir):
    from leafmill.operators.merge import accepted_fields

    li = spread(table(spark, sf_dir, "lineitem"))
    return accepted_fields(li.select(F.col("l_orderkey").alias("doc"), F.lit("flag").alias("field"), F.col("l_returnflag").alias("value"), (F.col("l_linenumber") % 2 == 1).alias("verified")))


@query("""
WITH m AS (SELECT o_custkey AS doc, 'status' AS spec, bool_or(o_orderstatus = 'F') AS ok FROM orders GROUP BY 1 UNION ALL SELECT o_custkey, 'priority', bool_or(o_orderpriority = '1-URGENT') FROM orders GROUP BY 1)
SELECT doc, count(*) FILTER (NOT ok) AS unverified, count(*) FILTER (NOT ok) <= 1 AS passed FROM m GROUP BY 1
""")
def quality_gate(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    m = o.select(F.col("o_custkey").alias("doc"), F.explode(F.array(F.struct(F.lit("status").alias("spec"), (F.col("o_orderstatus") == "F").alias("verified"), F.lit(True).alias("required")), F.struct(F.lit("priority").alias("spec"), (F.col("o_orderpriority") == "1-URGENT").alias("verified"), F.lit(True).alias("required")), F.struct(F.lit("extra").alias("spec"), F.lit(False).alias("verified"), F.lit(False).alias("required")))).alias("x")).select("doc", "x.*")
    return matching.quality_gate(m, ["doc"], 1)


_KEY = "regexp_replace(upper(replace(text, 'ß', 'SS')), '[^\\p{L}\\p{N}]+', '', 'g')"


@query(f"""
WITH d AS (SELECT doc_id, {_KEY} AS k FROM documents), b AS (SELECT item_id, {_KEY} AS k FROM benchmark)
SELECT doc_id, item_id FROM d JOIN b ON b.k <> '' AND contains(d.k, b.k)
""")
def evidence_contains(spark, sf_dir):
    d, b = spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    return matching.contains_joins(d, b, "text", "item").select("doc_id", "item_id").distinct()


@query("""
SELECT c_custkey, u.rule FROM customer, LATERAL (VALUES ('max_length', length(c_name) > 17), ('allowed_values', c_mktsegment NOT IN ('BUILDING', 'MACHINERY')), ('pattern', NOT regexp_matches(c_name, '[02468]$'))) u(rule, broken) WHERE u.broken
""")
def rule_validation(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    f = c.select("c_custkey", F.explode(F.array(F.struct(F.lit("name").alias("field"), F.col("c_name").alias("value")), F.struct(F.lit("segment").alias("field"), F.col("c_mktsegment").alias("value")))).alias("x")).select("c_custkey", "x.*")
    rules = spark.createDataFrame([("name", "[02468]$", None, 17, None), ("segment", None, None, None, ["BUILDING", "MACHINERY"]), ("name", "(", None, None, None)], "field string, pattern string, min_length int, max_length int, allowed_values array<string>")
    return validate.validate_rules(f, rules).select("c_custkey", "rule")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'sum_differs' AS note FROM lineitem WHERE l_linenumber % 3 = 0
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'values_equal' FROM lineitem WHERE l_partkey = l_suppkey
""")
def cross_field_rules(spark, sf_dir):
    li = spread(table(spark, sf_dir, "lineitem"))
    t = F.col("l_partkey") + F.col("l_suppkey") + F.when(F.col("l_linenumber") % 3 == 0, 1).otherwise(0)
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "row"]
    f = li.withColumn("row", F.xxhash64(*li.columns)).select(*key, F.explode(F.array(F.struct(F.lit("t").alias("name"), t.cast("string").alias("value")), F.struct(F.lit("a").alias("name"), F.col("l_partkey").cast("string").alias("value")), F.struct(F.lit("b").alias("name"), F.col("l_suppkey").cast("string").alias("value")))).alias("x")).select(*key, "x.*")
    rules = spark.createDataFrame([("t", "t = a + b"), ("a", "a != b"), ("nothing", "t = a + a")], "name string, context_rule string")
    return validate.cross_field(f, rules, key).select(*key[:-1], "note")


@query("""
WITH s AS (SELECT p_partkey, p_name AS nv, p_size > 20 AS na, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS rv, p_size > 10 AS ra FROM part)
SELECT p_partkey, CASE WHEN na THEN nv WHEN ra AND rv <> '' THEN rv ELSE nv END AS value, CASE WHEN na THEN 'native' WHEN ra AND rv <> '' THEN 'review' ELSE 'native' END AS value_source FROM s
""")
def merge_passes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return matching.merge_passes(p.select("p_partkey", F.col("p_name").alias("value"), (F.col("p_size") > 20).alias("accepted")), p.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("").alias("value"), (F.col("p_size") > 10).alias("accepted")), ["p_partkey"])


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || 'x' ELSE p_name END AS value, p_partkey % 3 = 0 AS corrected FROM part
""")
def second_pass_correction(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 3
    new = F.when(k == 0, F.concat("p_name", F.lit("x"))).when(k == 1, F.concat(F.lit("#"), "p_name")).otherwise(" ")
    return matching.correct_values(p.select("p_partkey", F.col("p_name").alias("value")), p.select("p_partkey", new.alias("value")), ["p_partkey"])


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Name' ELSE c_name END AS value, CASE WHEN c_custkey % 2 = 0 THEN 'low' ELSE 'high' END AS confidence FROM customer
""")
def value_swap_repair(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    layout = c.select("c_custkey", F.lit("Label").alias("label"), F.lit("Name").alias("value"), F.lit("low").alias("confidence"))
    fields = c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, " LABEL ").otherwise(F.col("c_name")).alias("value"), F.lit("high").alias("confidence"))
    return matching.swap_fallback(layout, fields, ["c_custkey"]).select("c_custkey", "value", "confidence")


@query("""
SELECT n_regionkey AS doc, n_name AS value FROM nation WHERE n_nationkey % 2 = 1
""")
def orphan_values(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    typed = n.select(F.col("n_regionkey").alias("doc"), F.col("n_name").alias("value"), F.col("n_nationkey").alias("idx"))
    known = n.where("n_nationkey % 2 = 0").select(F.col("n_regionkey").alias("doc"), F.lower(F.concat(F.lit(" "), "n_name")).alias("value"))
    return matching.orphan_values(typed, known, ["doc"]).select("doc", "value")


@query("""
WITH f AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'va?ue' ELSE p_name END AS v, p_size % 2 = 0 AS found, p_size % 5 = 0 AS lowq FROM part)
SELECT p_partkey, v <> '' AND NOT contains(v, '?') AND found AND NOT lowq AS accepted,
  CASE WHEN v <> '' AND NOT contains(v, '?') AND found AND NOT lowq THEN 'high' WHEN v <> '' AND found THEN 'medium' ELSE 'low' END AS accept_confidence,
  concat_ws(',', CASE WHEN v = '' THEN 'missing' END, CASE WHEN v <> '' AND NOT found THEN 'evidence_not_found_in_ocr_text' END, CASE WHEN v <> '' AND lowq THEN 'page_quality_low' END, CASE WHEN contains(v, '?') THEN 'uncertain_character' END) AS reasons
FROM f
""")
def evidence_acceptance(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 4
    f = p.select("p_partkey", F.when(k == 0, "").when(k == 1, "va?ue").otherwise(F.col("p_name")).alias("value"), F.lit("zz").alias("name"), F.lit(True).alias("required"), F.lit(True).alias("strict"), (F.col("p_size") % 2 == 0).alias("found"), (F.col("p_size") % 5 == 0).alias("low_quality"))
    return validate.acceptance(f).select("p_partkey", "accepted", "accept_confidence", F.array_join("reasons", ",").alias("reasons"))


@query("""
WITH u AS (SELECT p_brand AS doc, lower(regexp_replace(p_name, '[ _.,:;()-]+', '', 'g')) AS k, min(p_partkey) AS idx FROM part GROUP BY 1, 2)
SELECT p.p_brand AS doc, p.p_partkey, 'e' || u.idx AS entity_id FROM part p JOIN u ON u.doc = p.p_brand AND u.k = lower(regexp_replace(p.p_name, '[ _.,:;()-]+', '', 'g'))
""")
def field_entity_links(spark, sf_dir):
    p = part_candidates(spark, sf_dir)
    e = p.select("doc", F.concat(F.lit("e"), F.col("idx")).alias("id"), "value", "idx")
    return matching.link_entities(p, e, ["doc"]).select("doc", F.col("idx").alias("p_partkey"), "entity_id")


@query("""
WITH u AS (SELECT p_brand AS doc, lower(regexp_replace(p_name, '[ _.,:;()-]+', '', 'g')) AS k, min(p_partkey) AS idx FROM part GROUP BY 1, 2)
SELECT doc, idx FROM u
""")
def candidate_dedup(spark, sf_dir):
    return semantic.unique_candidates(part_candidates(spark, sf_dir), ["doc"], ["idx"]).select("doc", "idx")


@query("""
WITH v AS (SELECT doc_id, regexp_extract(text, '^[^ ]*', 0) AS value, regexp_replace(upper(replace(text, 'ß', 'SS')), '[^\\p{L}\\p{N}]+', '', 'g') AS t FROM documents),
k AS (SELECT *, regexp_replace(upper(replace(value, 'ß', 'SS')), '[^\\p{L}\\p{N}]+', '', 'g') AS k FROM v)
SELECT doc_id, value, k <> '' AND contains(t, k) AS found FROM k
""")
def evidence_cascade(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    values = d.select("doc_id", F.lit("first").alias("name"), F.regexp_extract("text", "^[^ ]*", 0).alias("value"))
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return matching.find_evidence(values, lines, d.select("doc_id", "text"), d.select("doc_id", F.col("text").alias("parsed")), ["doc_id"]).select("doc_id", "value", "found")


def _comparable(x: str) -> str:
    return f"""regexp_replace(lower({x}), '[\\s_.,:;''"()\\[\\]{{}}|\\\\/\\-]+', '', 'g')"""


@query(f"""
WITH l AS (SELECT DISTINCT {_comparable('line')} AS text FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> ''),
p AS (SELECT DISTINCT {_comparable("array_to_string(list_slice(string_split(text, ' '), 2, 4), ' ')")} AS text FROM documents WHERE text IS NOT NULL
  UNION SELECT {_comparable("split_part(p_name, ' ', 1)")} FROM part UNION SELECT {_comparable('o_orderkey || left(o_orderpriority, 1)')} FROM orders)
SELECT l.text AS line, p.text AS pattern FROM l JOIN p ON contains(l.text, p.text) OR contains(p.text, l.text)
""")
def containment_both_ways(spark, sf_dir):
    """All lines of all documents beside a list as long as the orders: which has which within it."""
    from leafmill.functions.text import comparable

    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    lines = spread(d).select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''").select(comparable("line").alias("text"))
    words = d.select(comparable(F.array_join(F.slice(F.split("text", " "), 2, 3), " ")).alias("text"))
    names = table(spark, sf_dir, "part").select(comparable(F.split("p_name", " ")[0]).alias("text"))
    orders = table(spark, sf_dir, "orders").select(comparable(F.concat(F.col("o_orderkey").cast("string"), F.left("o_orderpriority", F.lit(1)))).alias("text"))
    return containment.either_way(lines, words.union(names).union(orders)).select(F.col("left").alias("line"), F.col("right").alias("pattern"))
