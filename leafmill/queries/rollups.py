"""Aggregations, orderings, packing, jobs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions.tokens import image_tokens, image_tokens_simple, media_chunks, strategy, video_tokens
from leafmill.operators import consensus, merge, recurrences
from leafmill.queries.registry import query, table
from leafmill.shared import spread
from leafmill.streaming import jobs


@query("""
SELECT event_type AS stage, nullif(CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT), 0) AS input_tokens, nullif(CAST(sum(user_id % 7) AS BIGINT), 0) AS output_tokens,
       CAST(NULL AS BIGINT) AS estimated_image_tokens, count(*) AS calls
FROM events GROUP BY ROLLUP (event_type)
""")
def cost_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.floor("value").alias("input_tokens"), (F.col("user_id") % 7).alias("output_tokens"), F.lit(0).cast("long").alias("estimated_image_tokens"))
    return merge.cost_rollup(e, ["stage"], rollup=True)


@query("""
SELECT user_id, count(*) AS requested, count(*) FILTER (event_type <> 'error') AS successful, count(*) FILTER (event_type = 'error') AS failed,
       CAST(sum(CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS BIGINT) END) AS BIGINT) AS tokens
FROM events GROUP BY 1
""")
def run_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_type") != "error").alias("success"), F.floor("value").alias("tokens"))
    return merge.run_summary(e, ["user_id"])


_SIDES = "SELECT p_partkey, p_size * 100 AS w, CASE WHEN p_size = 50 THEN (p_partkey % 4000 + 16) * 40 ELSE p_partkey % 4000 + 16 END AS h FROM part"


def sides(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    h = F.col("p_partkey") % 4000 + 16
    return p.select("p_partkey", (F.col("p_size") * 100).alias("w"), F.when(F.col("p_size") == 50, h * 40).otherwise(h).alias("h"))


@query(f"""
WITH s AS ({_SIDES}), r AS (SELECT *, floor(w / 32.0 + 0.5) * 32 AS wr, floor(h / 32.0 + 0.5) * 32 AS hr FROM s),
b AS (SELECT *, wr * hr AS area, sqrt(CAST(w AS DOUBLE) * h / 16777216) AS shrink, sqrt(4096.0::DOUBLE / nullif(wr * hr, 0)) AS grow FROM r)
SELECT p_partkey, CAST(floor(CASE WHEN area > 16777216 THEN floor(w / shrink / 32) * 32 * floor(h / shrink / 32) * 32
       WHEN area < 4096 THEN ceil(wr * grow / 32) * 32 * ceil(hr * grow / 32) * 32 ELSE area END / 1024 + 0.5) AS BIGINT) + 2 AS tokens
FROM b
""")
def image_tokens_model(spark, sf_dir):
    return sides(spark, sf_dir).select("p_partkey", image_tokens(F.col("w"), F.col("h")).alias("tokens"))


@query(f"WITH s AS ({_SIDES}) SELECT p_partkey, CAST(ceil(w / 32.0) * ceil(h / 32.0) AS BIGINT) + 2 AS tokens FROM s")
def image_tokens_plain(spark, sf_dir):
    return sides(spark, sf_dir).select("p_partkey", image_tokens_simple(F.col("w"), F.col("h")).alias("tokens"))


@query(f"WITH s AS ({_SIDES}) SELECT p_partkey, CAST(ceil(h / 2.0) * (w - 2) AS BIGINT) + 2 AS tokens FROM s")
def video_tokens_frames(spark, sf_dir):
    return sides(spark, sf_dir).select("p_partkey", video_tokens(F.col("h"), F.col("w")).alias("tokens"))


@query("""
SELECT l_orderkey, count(*) * 40 AS pages, CASE WHEN count(*) * 40 <= 50 THEN 'concurrent' WHEN count(*) * 40 <= 200 THEN 'multi-image' ELSE 'batch' END AS strategy FROM lineitem GROUP BY 1
""")
def strategy_routing(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.count(F.lit(1)) * 40).alias("pages"))
    return n.select("l_orderkey", "pages", strategy(F.col("pages")).alias("strategy"))


@query("""
WITH RECURSIVE o AS (SELECT p_brand, p_partkey, CAST(p_size * 100 AS BIGINT) AS tokens, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part),
f AS (SELECT p_brand, p_partkey, tokens, i, 0 AS pack, tokens AS total FROM o WHERE i = 1
  UNION ALL SELECT o.p_brand, o.p_partkey, o.tokens, o.i, CASE WHEN f.total + o.tokens > 10000 THEN f.pack + 1 ELSE f.pack END, CASE WHEN f.total + o.tokens > 10000 THEN o.tokens ELSE f.total + o.tokens END
  FROM f JOIN o ON o.p_brand = f.p_brand AND o.i = f.i + 1)
SELECT p_brand, p_partkey, tokens, pack FROM f
""")
def token_budget_packs(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_size") * 100).alias("t"))
    return merge.pack_by_budget(p, "p_brand", ["p_partkey"], "t", 10_000)


_HOT = """h AS (SELECT p_partkey, p_brand AS source, p_size, p_retailprice FROM part UNION ALL SELECT p_partkey, 'all', p_size, p_retailprice FROM part),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY p_partkey) AS i FROM h)"""


def hot_source(spark, sf_dir):
    """The parts by brand, and all of them once more as one source, which holds half of all rows."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("source"), "p_size", "p_retailprice")
    return p.unionByName(p.withColumn("source", F.lit("all")))


@query(f"""
WITH RECURSIVE {_HOT},
f AS (SELECT source, p_partkey, i, 0 AS pack, CAST(p_size * 37 % 501 AS BIGINT) AS total FROM o WHERE i = 1
  UNION ALL SELECT o.source, o.p_partkey, o.i, CASE WHEN f.total + o.p_size * 37 % 501 > 400 THEN f.pack + 1 ELSE f.pack END, CASE WHEN f.total + o.p_size * 37 % 501 > 400 THEN o.p_size * 37 % 501 ELSE f.total + o.p_size * 37 % 501 END
  FROM f JOIN o ON o.source = f.source AND o.i = f.i + 1)
SELECT source, p_partkey, pack FROM f
""")
def packs_of_a_hot_source(spark, sf_dir):
    """Greedy packs where one source holds half of all rows and some items are larger than a pack."""
    h = hot_source(spark, sf_dir).withColumn("t", F.col("p_size") * 37 % 501)
    return merge.pack_by_budget(h, "source", ["p_partkey"], "t", 400).select("source", "p_partkey", "pack")


@query(f"""
WITH RECURSIVE {_HOT},
f AS (SELECT source, p_partkey, i, CAST(p_retailprice AS DOUBLE) AS average FROM o WHERE i = 1
  UNION ALL SELECT o.source, o.p_partkey, o.i, f.average * (1 - CAST(0.3 AS DOUBLE)) + CAST(o.p_retailprice AS DOUBLE) * CAST(0.3 AS DOUBLE) FROM f JOIN o ON o.source = f.source AND o.i = f.i + 1)
SELECT source, p_partkey, round(average, 6) AS average FROM f
""")
def moving_average(spark, sf_dir):
    found = recurrences.moving_average(hot_source(spark, sf_dir), ["source"], ["p_partkey"], "p_retailprice", 0.3)
    return found.select("source", "p_partkey", F.round("average", 6).alias("average"))


@query("SELECT o_custkey, o_orderkey, CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS INT) AS chunk FROM orders")
def fixed_chunks(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return merge.fixed_chunks(o, 4, ["o_custkey"], ["o_orderkey"])


@query("""
WITH o AS (SELECT o_custkey, o_orderkey % 1000 AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders)
SELECT o_custkey, CAST(floor(avg(t) FILTER (i <= 10) + 0.5) AS BIGINT) AS per_page, CAST(floor(avg(t) FILTER (i <= 10) + 0.5) AS BIGINT) * count(*) AS estimate FROM o GROUP BY 1
""")
def token_estimate(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 1000).alias("t"))
    return merge.estimate_tokens(o, "o_custkey", "o_orderkey", "t")


@query("SELECT l_orderkey, l_linenumber, CAST(floor(l_orderkey * 7.0 / count(*) OVER (PARTITION BY l_orderkey) + 0.5) AS BIGINT) AS tokens FROM lineitem")
def pack_token_split(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 7).alias("total"))
    return merge.split_pack_tokens(li, "l_orderkey", "total").select("l_orderkey", "l_linenumber", "tokens")


@query("""
SELECT p_partkey, CAST(i AS INT) AS chunk, i * 30.0::DOUBLE AS start_s, least((i + 1) * 30.0::DOUBLE, p_retailprice) AS end_s
FROM part, LATERAL (SELECT unnest(range(0, CAST(ceil(p_retailprice / 30) AS BIGINT))) AS i)
""")
def video_chunks(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.explode(media_chunks(F.col("p_retailprice"), 30.0)).alias("c")).select("p_partkey", F.col("c.index").alias("chunk"), F.col("c.start").alias("start_s"), F.col("c.end").alias("end_s"))


@query("""
SELECT p_brand AS source_path, bool_or(p_size % 3 <> 0) AS success, coalesce(string_agg(CASE WHEN p_size % 3 <> 0 THEN '[Chunk ' || (p_partkey + 1) || '] ' || p_name END, chr(10) || chr(10) ORDER BY p_partkey), '') AS text,
       CAST(sum(p_size) AS BIGINT) AS input_tokens, CAST(sum(p_size * 2) AS BIGINT) AS output_tokens
FROM part GROUP BY 1
""")
def video_aggregation(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return merge.video_summary(p.select(F.col("p_brand").alias("source_path"), F.col("p_partkey").alias("chunk"), (F.col("p_size") % 3 != 0).alias("success"), F.col("p_name").alias("text"), F.col("p_size").alias("input_tokens"), (F.col("p_size") * 2).alias("output_tokens")))


@query("""
WITH m AS (SELECT p_brand, p_name, count(*) AS n, min(p_partkey) AS seen FROM part GROUP BY 1, 2),
t AS (SELECT p_brand, sum(n) AS votes FROM m GROUP BY 1),
a AS (SELECT x.p_brand, sum(x.n * y.n * levenshtein(x.p_name, y.p_name) / greatest(length(x.p_name), length(y.p_name), 1)) AS apart FROM m x JOIN m y ON x.p_brand = y.p_brand AND x.p_name < y.p_name GROUP BY 1),
b AS (SELECT p_brand, p_name AS value, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, seen) AS r FROM m) WHERE r = 1),
e AS (SELECT p_brand, value, CASE WHEN votes > 1 THEN coalesce(apart, 0) / (votes * (votes - 1) / 2.0) ELSE 0 END AS entropy, n / votes AS agreement FROM t JOIN b USING (p_brand) LEFT JOIN a USING (p_brand))
SELECT p_brand, value, round(entropy, 9) AS entropy, round(agreement, 9) AS agreement,
  CASE WHEN entropy < 0.15 AND agreement > 0.66 THEN 'high' WHEN entropy < 0.4 THEN 'medium' ELSE 'low' END AS confidence, entropy > 0.5 OR agreement < 0.5 AS needs_review
FROM e
""")
def consensus_entropy(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    c = consensus.analyze_consensus(p.select("p_brand", F.col("p_partkey").alias("vote_idx"), F.col("p_name").alias("value")), ["p_brand"])
    return c.select("p_brand", "value", F.round("entropy", 9).alias("entropy"), F.round("agreement", 9).alias("agreement"), "confidence", "needs_review")


@query("""
WITH v AS (SELECT l_orderkey, l_returnflag AS value, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i,
   least(1.0, 20.0 / length(l_returnflag)) * CASE WHEN l_linenumber % 2 = 0 THEN 1.2 ELSE 1.0 END AS w FROM lineitem),
p AS (SELECT l_orderkey, value, sum(w) AS w, count(*) AS n, min(i) AS seen FROM v GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(w, 9) DESC, seen) AS rk, sum(w) OVER (PARTITION BY l_orderkey) AS aw, sum(n) OVER (PARTITION BY l_orderkey) AS an, count(*) OVER (PARTITION BY l_orderkey) AS d FROM p)
SELECT l_orderkey, value, n AS frequency, round(w / aw, 6) AS agreement, d = 1 AS unanimous, CAST(an AS BIGINT) AS votes FROM r WHERE rk = 1
""")
def weighted_vote(spark, sf_dir):
    from pyspark.sql import Window

    li = spread(table(spark, sf_dir, "lineitem"))
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    v = li.select("l_orderkey", i.alias("vote_idx"), F.col("l_returnflag").alias("raw"), F.when(F.col("l_linenumber") % 2 == 0, 0.1).otherwise(0.5).alias("temperature"))
    return consensus.weighted_vote(v, ["l_orderkey"]).select("l_orderkey", "value", "frequency", F.round("agreement", 6).alias("agreement"), "unanimous", "votes")


@query("""
WITH a AS (SELECT p_partkey, p_name AS v1, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || 's' WHEN 2 THEN '' ELSE 'other ' || p_name END AS v2 FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN v2 ELSE v1 END AS value, CASE p_partkey % 4 WHEN 2 THEN 1 ELSE 2 END AS candidates,
  CASE p_partkey % 4 WHEN 1 THEN 0.5 WHEN 3 THEN 0.5 ELSE 1.0 END AS agreement, p_partkey % 4 = 0 AS unanimous, CASE WHEN p_partkey % 4 = 0 THEN 'high' ELSE 'medium' END AS confidence
FROM a
""")
def dual_pass_merge(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 4
    second = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat("p_name", F.lit("s"))).when(k == 2, "").otherwise(F.concat(F.lit("other "), F.col("p_name")))
    passes = p.select("p_partkey", F.posexplode(F.array("p_name", second)).alias("pass_idx", "value"))
    return consensus.dual_pass(passes, ["p_partkey"]).select("p_partkey", "value", "candidates", "agreement", "unanimous", "confidence")


@query("""
WITH p AS (SELECT p_partkey, p_name AS a, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END AS b, CASE p_size % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS c FROM part)
SELECT p_partkey, round(least(1.0, levenshtein(a, b) / greatest(length(a), length(b), 1) + CASE c WHEN 'low' THEN 0.3 WHEN 'medium' THEN 0.15 ELSE 0 END), 9) AS entropy FROM p
""")
def two_source_entropy(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    b = F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_brand"))
    c = F.when(F.col("p_size") % 3 == 0, "low").when(F.col("p_size") % 3 == 1, "medium").otherwise("high")
    return p.select("p_partkey", F.round(consensus.two_source_entropy(F.col("p_name"), b, c, F.lit("high")), 9).alias("entropy"))


_STATUS = """CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'expired'
  WHEN 'error' THEN ['failed', 'error', 'cancelled'][CAST(event_id % 3 AS INT) + 1] ELSE ['in_progress', 'queued', 'validating', 'finalizing', 'cancelling'][CAST(event_id % 5 AS INT) + 1] END"""


def job_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ended = F.element_at(F.array(*map(F.lit, ("failed", "error", "cancelled"))), (F.col("event_id") % 3 + 1).cast("int"))
    going = F.element_at(F.array(*map(F.lit, ("in_progress", "queued", "validating", "finalizing", "cancelling"))), (F.col("event_id") % 5 + 1).cast("int"))
    s = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "signup", "expired").when(F.col("event_type") == "error", ended).otherwise(going)
    return e.select(F.col("user_id").cast("string").alias("batch_id"), F.col("ts").cast("timestamp").alias("ts"), s.alias("status"), F.col("event_id"))


@query(f"""
WITH l AS (SELECT user_id, arg_max({_STATUS}, event_id) AS status FROM events GROUP BY 1)
SELECT count(*) AS jobs, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status IN ('queued', 'in_progress', 'validating')) AS in_progress,
  count(*) FILTER (status IN ('failed', 'error', 'expired', 'cancelled')) AS failed, count(*) FILTER (status = 'expired') AS expired FROM l
""")
def batch_status_rollup(spark, sf_dir):
    return jobs.status_rollup(jobs.latest_status(job_events(spark, sf_dir), ["event_id"]))


@query("""
WITH RECURSIVE o AS (SELECT user_id, event_id, epoch(ts) AS now, CASE WHEN event_type <> 'error' THEN 200 WHEN event_id % 3 = 0 THEN 429 WHEN event_id % 3 = 1 THEN 500 ELSE 404 END AS status, CAST(value AS DOUBLE) * 10 AS ms,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT user_id, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS i, now AS changed, 20 AS concurrency, CAST(0 AS DOUBLE) AS ema, 0 AS good, 0 AS bad FROM o WHERE i = 1
  UNION ALL
  SELECT user_id, event_id, i, CASE WHEN status >= 400 OR due THEN now ELSE changed END,
    CASE WHEN status = 429 THEN greatest(2, concurrency // 2) WHEN status >= 500 THEN greatest(2, CAST(floor(concurrency * CAST(0.7 AS DOUBLE)) AS INT))
      WHEN due AND bad / (good + bad) < 0.05 AND ema < 3000 THEN least(50, CAST(floor(concurrency * CAST(1.3 AS DOUBLE)) AS INT))
      WHEN due AND (bad / (good + bad) > 0.15 OR ema > 10000) THEN greatest(2, CAST(floor(concurrency * CAST(0.7 AS DOUBLE)) AS INT)) ELSE concurrency END,
    ema, CASE WHEN due THEN 0 ELSE good END, CASE WHEN due THEN 0 ELSE bad END
  FROM (SELECT *, status < 400 AND now - changed >= 5 AND good + bad >= 10 AS due FROM (
    SELECT o.user_id, o.event_id, o.i, o.now, o.status, f.changed, f.concurrency,
      CASE WHEN o.status >= 400 THEN f.ema WHEN f.ema = 0 THEN o.ms ELSE f.ema * (1 - CAST(0.3 AS DOUBLE)) + o.ms * CAST(0.3 AS DOUBLE) END AS ema,
      f.good + CASE WHEN o.status < 400 THEN 1 ELSE 0 END AS good, f.bad + CASE WHEN o.status >= 400 THEN 1 ELSE 0 END AS bad
    FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)))
SELECT user_id, event_id, concurrency, CAST(floor(ema * 1000) AS BIGINT) AS ema_us FROM f WHERE i > 0
""")
def adaptive_concurrency(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    failed = F.when(F.col("event_id") % 3 == 0, 429).when(F.col("event_id") % 3 == 1, 500).otherwise(404)
    calls = e.select("user_id", "event_id", F.col("ts").cast("timestamp").cast("double").alias("at"), F.when(F.col("event_type") == "error", failed).otherwise(200).alias("status"), (F.col("value") * 10).alias("latency_ms"))
    return jobs.adaptive_concurrency(calls, ["user_id"], ["event_id"]).select("user_id", "event_id", "concurrency", F.floor(F.col("ema") * 1000).alias("ema_us"))


@query("""
SELECT CAST(time_bucket(INTERVAL '1 day', ts) AS TIMESTAMP) AS window_start, CAST(time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS TIMESTAMP) AS window_end, event_type, count(*) AS n,
  CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY ALL
""")
def streaming_tumbling(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = jobs.tumbling(e, "1 day", ["event_type"])
    return w.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '6 hours' AS session_end, count(*) AS n FROM s GROUP BY user_id, sid
""")
def streaming_session(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = jobs.sessions(e, "6 hours", "user_id")
    return s.withColumn("session_start", F.col("session_start").cast("timestamp_ntz")).withColumn("session_end", F.col("session_end").cast("timestamp_ntz"))


@query("""
WITH l AS (SELECT source AS source_file, lang AS type, CAST(doc_id AS INT) AS page, 'r' || doc_id AS reason, CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM documents)
SELECT source_file, type, count(DISTINCT page) AS n_pages, min(page) AS first_page, array_to_string(list_slice(list(reason ORDER BY page), 1, 20), ',') AS reasons, arg_min(confidence, page) AS confidence
FROM l GROUP BY 1, 2
""")
def detected_documents_grouped(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    level = F.when(F.col("doc_id") % 3 == 0, "high").when(F.col("doc_id") % 3 == 1, "medium").otherwise("low")
    g = merge.grouped_documents(d.select(F.col("source").alias("source_file"), F.col("lang").alias("type"), F.col("doc_id").cast("int").alias("page"), F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("reason"), level.alias("confidence")))
    return g.select("source_file", "type", F.size("pages").alias("n_pages"), F.element_at("pages", 1).alias("first_page"), F.array_join("reasons", ",").alias("reasons"), "confidence")


@query("""
SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'given_' || n_nationkey ELSE printf('ent_%05d', row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)) END AS id FROM nation
""")
def surrogate_ids(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("given", F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("given_"), F.col("n_nationkey").cast("string"))).otherwise(""))
    return merge.surrogate_ids(n, "ent", "given", ["n_nationkey"], ["n_regionkey"]).select("n_nationkey", "id")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT line, doc_id, i AS place FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS r FROM l WHERE line <> '') WHERE r = 1
""")
def first_wins_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).where("line <> ''")
    return merge.unique_by(lines.withColumn("place", F.col("i") + 1).drop("i"), "line", ["doc_id", "place"]).select("line", "doc_id", "place")
