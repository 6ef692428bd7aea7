"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalith.operators import joins as J
from catalith.plans.registry import query

HOUR = 3_600_000_000


def timed(events):
    return events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


@query("pending_anti", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 1 WHERE l.doc_id IS NULL")
def pending_anti(t):
    return J.pending(t("documents").select("doc_id"), t("labels"), "doc_id", {"quality": 1})


@query("notexists_anti", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def notexists_anti(t):
    return t("orders").select("o_orderkey").join(t("lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("notin_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def notin_anti(t):
    return J.not_in(t("customer").select("c_custkey"), "c_custkey", t("orders"), "o_custkey")


@query("insemi", "SELECT p_brand, count(*) AS parts FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.08) GROUP BY 1")
def insemi(t):
    hit = t("lineitem").where("l_discount > 0.08").select(F.col("l_partkey").alias("p_partkey"))
    return t("part").join(hit, "p_partkey", "left_semi").groupBy("p_brand").agg(F.count(F.lit(1)).alias("parts"))


@query("dag_ready", """
SELECT o_orderkey FROM orders o WHERE o_orderstatus <> 'F' AND NOT EXISTS (
  SELECT 1 FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey WHERE l.l_orderkey = o.o_orderkey AND l.l_linestatus <> 'F')""")
def dag_ready(t):
    blocked = t("lineitem").where("l_linestatus <> 'F'").join(t("part").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi").select(F.col("l_orderkey").alias("o_orderkey"))
    return t("orders").where("o_orderstatus <> 'F'").select("o_orderkey").join(blocked, "o_orderkey", "left_anti")


@query("range_join_segments", """
WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us FROM events),
s AS (SELECT user_id AS segment, min(us) AS s0, min(us) + 36 * 3600000000 AS s1 FROM e WHERE event_type = 'purchase' GROUP BY 1)
SELECT segment, count(*) AS events, count(DISTINCT e.user_id) AS users FROM e JOIN s ON us BETWEEN s0 AND s1 GROUP BY 1""")
def range_join_segments(t):
    e = timed(t("events")).select("event_id", "user_id", "event_type", "us")
    s = e.where("event_type = 'purchase'").groupBy(F.col("user_id").alias("segment")).agg(F.min("us").alias("s0"))
    return J.window_counts(e, "us", "user_id", s, "segment", "s0", 36 * HOUR).withColumnsRenamed({"rows": "events", "members": "users"})


@query("asof_window", """
WITH p AS (SELECT user_id, epoch_us(ts) AS us, max(event_id) AS purchase FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT e.event_id, p.purchase FROM (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'click') e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.us >= p.us""")
def asof_window(t):
    e = timed(t("events"))
    bought = e.where("event_type = 'purchase'").select("user_id", F.col("us").alias("bought"), F.col("event_id").alias("purchase"))
    return J.as_of(e.where("event_type = 'click'").select("event_id", "user_id", "us"), bought, ["user_id"], "us", "bought", ["purchase"]).select("event_id", "purchase")


@query("band_pairs", """
WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us FROM events WHERE event_type IN ('purchase', 'error'))
SELECT a.event_type AS first_type, b.event_type AS second_type, count(*) AS pairs, sum(b.us - a.us)::BIGINT AS gap
FROM e a JOIN e b ON b.us - a.us BETWEEN 0 AND 60000000 AND (a.us < b.us OR a.event_id < b.event_id) AND a.event_id <> b.event_id GROUP BY 1, 2""")
def band_pairs(t):
    e = timed(t("events").where("event_type IN ('purchase', 'error')"))
    pairs = J.band_pairs(e, "event_id", "us", 60_000_000, carry=["event_type"])
    return pairs.groupBy(F.col("a_event_type").alias("first_type"), F.col("b_event_type").alias("second_type")).agg(F.count(F.lit(1)).alias("pairs"), F.sum("gap").alias("gap"))


@query("reaction_link", """
WITH e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us FROM events),
p AS (SELECT a.event_id AS action, b.event_id AS reaction, round((1 - abs(b.us - a.us) / 600000000.0) * b.value, 6) AS bonus
  FROM e a JOIN e b ON abs(b.us - a.us) <= 600000000 AND a.user_id <> b.user_id WHERE a.event_type = 'purchase' AND b.event_type = 'view'),
one AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY reaction ORDER BY bonus DESC, action) = 1)
SELECT action, reaction, bonus, row_number() OVER (PARTITION BY action ORDER BY bonus DESC, reaction) AS place FROM one
QUALIFY row_number() OVER (PARTITION BY action ORDER BY bonus DESC, reaction) <= 4""")
def reaction_link(t):
    e = timed(t("events"))
    kind = lambda name: e.where(F.col("event_type") == name)
    pairs = J.best_partners(kind("purchase"), kind("view"), "event_id", "us", "user_id", "value", 600_000_000)
    return J.greedy_links(pairs, "action", "reaction", "bonus", 4).select("action", "reaction", "bonus", F.col("place").cast("long").alias("place"))


@query("interval_overlap", """
WITH m AS (SELECT user_id, event_type, epoch_us(min(ts)) // 1000000 AS s, epoch_us(max(ts)) // 1000000 AS e FROM events GROUP BY 1, 2)
SELECT a.user_id, a.event_type AS a, b.event_type AS b, round((least(a.e, b.e) - greatest(a.s, b.s)) / greatest(least(a.e - a.s, b.e - b.s), 1), 6) AS overlap
FROM m a JOIN m b ON a.user_id = b.user_id AND a.event_type < b.event_type WHERE least(a.e, b.e) > greatest(a.s, b.s)
AND (least(a.e, b.e) - greatest(a.s, b.s)) / greatest(least(a.e - a.s, b.e - b.s), 1) >= 0.6""")
def interval_overlap(t):
    e = timed(t("events"))
    m = e.groupBy("user_id", "event_type").agg(F.expr("min(us) div 1000000").alias("s"), F.expr("max(us) div 1000000").alias("e"))
    return J.interval_overlaps(m, "event_type", "s", "e", ["user_id"], 0.6).withColumn("overlap", F.round("overlap", 6))


@query("cooccurrence", """
WITH o AS (SELECT DISTINCT l_orderkey, l_suppkey AS s FROM lineitem)
SELECT a.s AS a, b.s AS b, count(*) AS together FROM o a JOIN o b ON a.l_orderkey = b.l_orderkey AND a.s < b.s GROUP BY 1, 2""")
def cooccurrence(t):
    return J.cooccurrence(t("lineitem"), "l_orderkey", "l_suppkey")


@query("companions", """
WITH o AS (SELECT DISTINCT l_orderkey, l_suppkey AS s FROM lineitem),
e AS (SELECT a.s AS a, b.s AS b, count(*) AS n FROM o a JOIN o b ON a.l_orderkey = b.l_orderkey AND a.s < b.s GROUP BY 1, 2),
d AS (SELECT a AS node, b AS neighbour, n FROM e UNION ALL SELECT b, a, n FROM e)
SELECT node, neighbour, n AS together FROM d QUALIFY row_number() OVER (PARTITION BY node ORDER BY n DESC, neighbour) <= 3""")
def companions(t):
    return J.companions(t("lineitem"), "l_orderkey", "l_suppkey", 3)


@query("match_cascade", r"""
WITH l AS (SELECT * FROM documents WHERE doc_id % 2 = 1), r AS (SELECT * FROM documents WHERE doc_id % 2 = 0),
n AS (SELECT doc_id, text, lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')) AS norm, n_chars, lang FROM documents),
m1 AS (SELECT l.doc_id, min(r.doc_id) AS original FROM l JOIN r ON l.text = r.text GROUP BY 1),
m2 AS (SELECT a.doc_id, min(b.doc_id) AS original FROM n a JOIN n b ON a.norm = b.norm AND a.doc_id % 2 = 1 AND b.doc_id % 2 = 0 WHERE a.doc_id NOT IN (SELECT doc_id FROM m1) GROUP BY 1),
m3 AS (SELECT l.doc_id, min(r.doc_id) AS original FROM l JOIN r ON l.n_chars = r.n_chars AND l.lang = r.lang WHERE l.doc_id NOT IN (SELECT doc_id FROM m1) AND l.doc_id NOT IN (SELECT doc_id FROM m2) GROUP BY 1)
SELECT doc_id, original, 'exact' AS strategy FROM m1 UNION ALL SELECT doc_id, original, 'normalised' FROM m2 UNION ALL SELECT doc_id, original, 'size' FROM m3""")
def match_cascade(t):
    docs = t("documents")
    norm = F.lower(F.regexp_replace("text", "[^A-Za-z0-9]+", " "))
    odd, even = docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "original")
    return J.match_cascade(odd, even, "doc_id", "original", [("exact", [F.sha2("text", 256)]), ("normalised", [F.sha2(norm, 256)]), ("size", [F.col("n_chars"), F.col("lang")])])


@query("clock_offset", """
WITH e AS (SELECT user_id, epoch_us(ts) // 1000000 AS s FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e),
p AS (SELECT user_id, s FROM n WHERE i % ceil(n / 400.0)::BIGINT = 0),
r AS (SELECT user_id AS reference FROM e GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 1),
d AS (SELECT b.user_id, a.s - b.s AS d, floor((a.s - b.s) / 3600.0)::BIGINT AS bucket FROM p a JOIN r ON a.user_id = reference JOIN p b ON b.user_id <> reference),
m AS (SELECT user_id, bucket, count(*) AS n FROM d GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, bucket) = 1),
z AS (SELECT user_id, least(count(*), (SELECT count(*) FROM p JOIN r ON user_id = reference)) AS z FROM p GROUP BY 1)
SELECT m.user_id, m.bucket, trunc(avg(d.d))::BIGINT AS "offset", round(least(any_value(m.n), any_value(z.z)) / any_value(z.z), 6) AS confidence
FROM m JOIN d ON d.user_id = m.user_id AND abs(d.d - m.bucket * 3600) <= 7200 JOIN z ON z.user_id = m.user_id GROUP BY 1, 2""")
def clock_offset(t):
    e = t("events").select("user_id", F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("s"))
    return J.clock_offsets(e, "user_id", "s", 3600, 7200).withColumn("confidence", F.round("confidence", 6))


@query("dimension_fallback", """
SELECT o_orderpriority, count(*) AS orders, round(sum(o_totalprice * coalesce(w, 1.0)), 2) AS weighted FROM orders
LEFT JOIN (VALUES ('1-URGENT', 1.5), ('2-HIGH', 1.2)) v(p, w) ON p = o_orderpriority GROUP BY 1""")
def dimension_fallback(t):
    orders = t("orders")
    weights = orders.sparkSession.createDataFrame([("1-URGENT", 1.5), ("2-HIGH", 1.2)], "o_orderpriority string, w double")
    joined = orders.join(F.broadcast(weights), "o_orderpriority", "left")  # a literal table of two rows
    return joined.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum(F.col("o_totalprice") * F.coalesce("w", F.lit(1.0))), 2).alias("weighted"))
