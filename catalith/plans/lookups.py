"""Lookups, wide loads, predicates and child rows as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalith.functions import columns as C
from catalith.operators import aggregates as A
from catalith.operators import structure as R
from catalith.plans.joining import timed
from catalith.plans.registry import query
from catalith.sources.tables import SCHEMAS


@query("point_lookup", "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_partkey = 42")
def point_lookup(t):
    return t("part").where("p_partkey = 42").select("p_partkey", "p_name", "p_retailprice")


@query("tenant_scan", "SELECT o_orderkey, epoch_us(o_orderdate) AS us, o_totalprice FROM orders WHERE o_custkey = 7 ORDER BY us, o_orderkey")
def tenant_scan(t):
    rows = t("orders").where("o_custkey = 7")
    return rows.select("o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"), "o_totalprice").orderBy("us", "o_orderkey")


@query("table_counts", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows FROM {n}" for n in SCHEMAS))
def table_counts(t):
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), [t(n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows")) for n in SCHEMAS])


@query("vector_load", """
SELECT e.vec_id, e.label, l.quality, coalesce(l.toxic, -1) AS toxic, coalesce(d.lang, '?') AS lang FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id LEFT JOIN labels l ON l.doc_id = e.vec_id""")
def vector_load(t):
    docs = t("documents").select(F.col("doc_id").alias("vec_id"), "lang")
    labels = t("labels").select(F.col("doc_id").alias("vec_id"), "quality", "toxic")
    wide = t("embeddings").select("vec_id", "label").join(docs, "vec_id", "left").join(labels, "vec_id", "left")
    return wide.select("vec_id", "label", "quality", F.coalesce("toxic", F.lit(-1)).alias("toxic"), F.coalesce("lang", F.lit("?")).alias("lang"))


@query("frame_load", """
SELECT l_orderkey, l_linenumber, c_custkey, p_brand, s_nationkey, n_name, round(l_extendedprice, 2) AS price FROM lineitem
JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey""")
def frame_load(t):
    """Five dimensions beside each line; dimensions carry the needed columns alone."""
    orders = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    parts = t("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    suppliers = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey").join(t("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey", "left")
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("l_extendedprice", 2).alias("price"))
    wide = lines.join(orders, "l_orderkey").join(t("customer").select("c_custkey"), "c_custkey").join(parts, "l_partkey", "left").join(suppliers, "l_suppkey", "left")
    return wide.select("l_orderkey", "l_linenumber", "c_custkey", "p_brand", "s_nationkey", "n_name", "price")


@query("wide_gather", """
WITH o AS (SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS spent, max(o_orderkey) AS latest FROM orders GROUP BY 1),
l AS (SELECT o_custkey, count(*) AS lines, count(DISTINCT l_suppkey) AS sources FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
e AS (SELECT user_id, count(*) AS events, round(avg(value), 6) AS mean FROM events GROUP BY 1)
SELECT c_custkey, coalesce(n_name, '?') AS nation, coalesce(orders, 0) AS orders, coalesce(spent, 0) AS spent, latest, coalesce(lines, 0) AS lines, coalesce(sources, 0) AS sources, coalesce(events, 0) AS events, coalesce(mean, 0) AS mean
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN l ON l.o_custkey = c_custkey LEFT JOIN e ON user_id = c_custkey""")
def wide_gather(t):
    """Each service's rows become one for each customer before they are joined."""
    orders = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"), F.max("o_orderkey").alias("latest"))
    lines = t("orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("l_orderkey")).join(t("lineitem").select("l_orderkey", "l_suppkey"), "l_orderkey")
    lines = lines.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("l_suppkey").alias("sources"))
    events = t("events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count(F.lit(1)).alias("events"), F.round(F.avg("value"), 6).alias("mean"))
    nations = t("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    wide = t("customer").select("c_custkey", "c_nationkey").join(nations, "c_nationkey", "left")
    for part in (orders, lines, events):
        wide = wide.join(part, "c_custkey", "left")
    return wide.drop("c_nationkey").fillna({"nation": "?", "orders": 0, "spent": 0.0, "lines": 0, "sources": 0, "events": 0, "mean": 0.0})


@query("soft_delete", "SELECT o_orderpriority, count(*) AS live FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS deleted_at FROM orders) WHERE deleted_at IS NULL GROUP BY 1")
def soft_delete(t):
    rows = t("orders").withColumn("deleted_at", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))
    return A.census(rows.where("deleted_at IS NULL"), "o_orderpriority").withColumnRenamed("rows", "live")


@query("bit_updates", "SELECT event_id, ((CAST(json_extract_string(props, '$.k') AS BIGINT) & ~5::BIGINT) | CASE WHEN event_type = 'error' THEN 8 ELSE 0 END)::BIGINT AS flags FROM events")
def bit_updates(t):
    """Clears two bits and sets another where a condition holds."""
    k = F.get_json_object("props", "$.k").cast("long")
    return t("events").select("event_id", C.with_bits(k, clear=5, set_=F.when(F.col("event_type") == "error", 8).otherwise(0)).alias("flags"))


@query("composite_filter", """
SELECT event_id FROM events WHERE event_type IN ('click', 'purchase') AND value BETWEEN 20 AND 80 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def composite_filter(t):
    """Kind, range and half-open time window reach the scan; the exclusion is an anti join on keys."""
    rows = t("events").where("event_type IN ('click', 'purchase') AND value BETWEEN 20 AND 80 AND ts >= TIMESTAMP_NTZ '2024-01-05' AND ts < TIMESTAMP_NTZ '2024-01-20'")
    gone = t("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return rows.select("event_id", "user_id").join(gone, "user_id", "left_anti").select("event_id")


@query("lighting_bucket", """
SELECT CASE WHEN event_type = 'error' THEN 'flash' WHEN event_type = 'purchase' AND value < 40 THEN 'warm' WHEN event_type = 'purchase' THEN 'cool' WHEN value < 30 THEN 'low' WHEN value < 60 THEN 'mixed' ELSE 'day' END AS bucket, count(*) AS rows FROM events GROUP BY 1""")
def lighting_bucket(t):
    kind, value = F.col("event_type"), F.col("value")
    bucket = F.when(kind == "error", "flash").when((kind == "purchase") & (value < 40), "warm").when(kind == "purchase", "cool").when(value < 30, "low").when(value < 60, "mixed").otherwise("day")
    return A.census(t("events").select(bucket.alias("bucket")), "bucket")


@query("cache_stats", "SELECT count(*) AS entries, sum(n_chars)::BIGINT AS bytes, max(n_chars) AS largest FROM documents")
def cache_stats(t):
    return t("documents").agg(F.count(F.lit(1)).alias("entries"), F.sum("n_chars").alias("bytes"), F.max("n_chars").alias("largest"))


@query("cache_hits", "SELECT md5(text) AS key, count(*) - 1 AS hits, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1")
def cache_hits(t):
    """The first request of a text fills the cache, all later ones hit it."""
    seen = t("documents").groupBy(F.md5("text").alias("key"), F.sha2("text", 256).alias("_sha")).agg((F.count(F.lit(1)) - 1).alias("hits"), F.min("doc_id").alias("first"))
    return seen.where("hits > 0").drop("_sha")


@query("decision_reasons", """
SELECT o_orderkey, unnest(r) AS reason, generate_subscripts(r, 1) - 1 AS place FROM (
  SELECT o_orderkey, list_filter([CASE WHEN o_totalprice > 200000 THEN 'dear' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END, CASE WHEN o_orderstatus = 'O' THEN 'open' END], lambda x: x IS NOT NULL) AS r FROM orders)""")
def decision_reasons(t):
    reasons = {"dear": F.col("o_totalprice") > 200_000, "urgent": F.col("o_orderpriority") == "1-URGENT", "open": F.col("o_orderstatus") == "O"}
    return R.reason_rows(t("orders"), "o_orderkey", reasons).select("o_orderkey", "reason", F.col("place").cast("long").alias("place"))


@query("strongest_reasons", """
SELECT l_orderkey, array_to_string(list(l_suppkey::VARCHAR ORDER BY i), ',') AS reasons FROM (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_suppkey) AS i FROM lineitem) WHERE i <= 3 GROUP BY 1""")
def strongest_reasons(t):
    return R.strongest_reasons(t("lineitem"), "l_orderkey", "l_suppkey", "l_extendedprice", 3)


@query("support_bundle", """
SELECT '{"c_custkey":' || c_custkey || ',"handle":"p' || dense_rank() OVER (ORDER BY c_nationkey) || '"}' AS line FROM customer""")
def support_bundle(t):
    rows = R.with_handles(t("customer").select("c_custkey", "c_nationkey"), "c_nationkey", "p")
    return rows.select(F.to_json(F.struct("c_custkey", "handle")).alias("line"))


@query("short_run_merge", """
WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us FROM events), n AS (SELECT *, CASE WHEN lag(event_type) OVER o = event_type THEN 0 ELSE 1 END AS new FROM e WINDOW o AS (PARTITION BY user_id ORDER BY us, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id) AS run FROM n),
g AS MATERIALIZED (SELECT user_id, run, list_position(['click', 'error', 'purchase', 'signup', 'view'], any_value(event_type)) AS kind, count(*) AS n, count(*) >= 2 AND max(us) - min(us) >= 43200000000 AS long, avg(value / 100) AS support FROM r GROUP BY ALL),
s AS (SELECT user_id, run, 1::BIGINT AS segment, list_transform([1, 2, 3, 4, 5], lambda k: CASE WHEN k = kind THEN n ELSE 0 END) AS held FROM g WHERE run = 1
UNION ALL SELECT g.user_id, g.run, s.segment + x.opens::INT, list_transform([1, 2, 3, 4, 5], lambda k: (CASE WHEN x.opens THEN 0 ELSE s.held[k] END) + CASE WHEN k = kind THEN n ELSE 0 END) FROM s JOIN g ON g.user_id = s.user_id AND g.run = s.run + 1, LATERAL (SELECT long OR (kind <> list_position(s.held, list_max(s.held)) AND support >= 0.6) AS opens) x)
SELECT event_id, segment FROM r JOIN s USING (user_id, run)""")
def short_run_merge(t):
    """Runs of one kind stand if they have two rows over half a day, or a kind of their own with enough support."""
    rows = timed(t("events")).withColumn("support", F.col("value") / 100)
    return R.short_runs_merged(rows, "user_id", "us", "event_id", "event_type", 2, 43_200_000_000, "support", 0.6).select("event_id", "segment")


@query("dag_levels", """
WITH RECURSIVE e AS (SELECT p_partkey // 3 AS a, p_partkey AS b FROM part WHERE p_partkey >= 3 UNION SELECT p_partkey // 5, p_partkey FROM part WHERE p_partkey >= 5),
w AS (SELECT p_partkey AS node, 0 AS level FROM part WHERE p_partkey NOT IN (SELECT b FROM e) UNION SELECT e.b, w.level + 1 FROM w JOIN e ON e.a = w.node)
SELECT node, max(level) AS level FROM w GROUP BY 1""")
def dag_levels(t):
    parts = t("part").select("p_partkey")
    edge = lambda n: parts.where(f"p_partkey >= {n}").select(F.expr(f"p_partkey div {n}").alias("a"), F.col("p_partkey").alias("b"))
    return R.levels(edge(3).unionByName(edge(5)).distinct(), parts.select(F.col("p_partkey").alias("node")))


@query("capped_influence", """
WITH g AS (SELECT lang, count(*) AS rows FROM documents GROUP BY 1), a AS (SELECT *, sum(rows) OVER () AS every, greatest(0.2, 1 / count(*) OVER ()) AS cap FROM g)
SELECT lang, rows, round(CASE WHEN rows / every > cap + 1e-6 AND cap < 1 THEN least(1.0, cap * (every - rows) / ((1 - cap) * rows)) ELSE 1 END, 6) AS weight FROM a""")
def capped_influence(t):
    return R.capped_influence(t("documents"), "lang", 0.2).select("lang", "rows", F.round("weight", 6).alias("weight"))


@query("attribute_bits", """
SELECT event_id, (CASE WHEN value >= 50 THEN 1 ELSE 0 END + CASE WHEN event_type = 'error' OR value < 5 THEN 2 ELSE 0 END + CASE WHEN event_type <> 'view' AND value < 90 THEN 4 ELSE 0 END)::BIGINT AS bits FROM events""")
def attribute_bits(t):
    """A bit for each attribute; measurements overrule what the kind says."""
    bit = lambda c, n: F.when(c, n).otherwise(0)
    kind, value = F.col("event_type"), F.col("value")
    bits = bit(value >= 50, 1) + bit((kind == "error") | (value < 5), 2) + bit((kind != "view") & (value < 90), 4)
    return t("events").select("event_id", bits.cast("long").alias("bits"))


@query("spread_cap", """
SELECT c_custkey, round(c_acctbal + least(greatest(avg(c_acctbal) OVER (PARTITION BY c_nationkey) - c_acctbal, -500), 500), 4) AS lifted FROM customer""")
def spread_cap(t):
    return R.lifted(t("customer"), "c_nationkey", "c_acctbal", 500.0).select("c_custkey", F.round("lifted", 4).alias("lifted"))


@query("least_error", """
WITH c AS (SELECT * FROM (VALUES ('a', 1000.0), ('b', 3000.0), ('c', 6000.0)) v(candidate, centre))
SELECT c_custkey, candidate, round(abs(c_acctbal - centre), 4) AS error FROM customer, c WHERE NOT (candidate = 'b' AND c_mktsegment = 'BUILDING')
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY round(abs(c_acctbal - centre), 9), candidate) = 1""")
def least_error(t):
    rows = t("customer")
    candidates = rows.sparkSession.createDataFrame([("a", 1000.0), ("b", 3000.0), ("c", 6000.0)], "candidate string, centre double")
    veto = (F.col("candidate") == "b") & (F.col("c_mktsegment") == "BUILDING")
    return R.least_error(rows, "c_custkey", candidates, F.abs(F.col("c_acctbal") - F.col("centre")), veto).select("c_custkey", "candidate", F.round("error", 4).alias("error"))


@query("clipping_share", "SELECT l_returnflag, round(count(CASE WHEN l_extendedprice * 1.25 > 60000 THEN 1 END) / count(*), 6) AS share FROM lineitem GROUP BY 1")
def clipping_share(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.round(A.count_where(F.col("l_extendedprice") * 1.25 > 60_000) / F.count(F.lit(1)), 6).alias("share"))


@query("iterative_guard", """
SELECT user_id, list_filter(range(0, 60), lambda i: mx * pow(0.9, i) <= 50)[1]::BIGINT AS steps FROM (SELECT user_id, max(value) AS mx FROM events GROUP BY 1)""")
def iterative_guard(t):
    """How often a group is scaled by nine tenths until its largest value is within the bound."""
    top = t("events").groupBy("user_id").agg(F.max("value").alias("top"))
    within = F.filter(F.sequence(F.lit(0), F.lit(59)), lambda i: F.col("top") * F.pow(F.lit(0.9), i) <= 50)
    return top.select("user_id", F.get(within, F.lit(0)).cast("long").alias("steps"))


@query("band_statistics", """
SELECT band, rows, round(CASE WHEN m < 0 THEN m + 360 ELSE m END, 4) AS mean, round(sqrt(x * x + y * y), 6) AS cohesion FROM (
  SELECT *, degrees(atan2(y, x)) AS m FROM (SELECT floor(value / 10)::BIGINT AS band, count(*) AS rows, avg(cos(radians(value * 3.6))) AS x, avg(sin(radians(value * 3.6))) AS y FROM events GROUP BY 1))""")
def band_statistics(t):
    found = R.band_statistics(t("events"), F.floor(F.col("value") / 10), F.col("value") * 3.6)
    return found.select("band", "rows", F.round("mean", 4).alias("mean"), F.round("cohesion", 6).alias("cohesion"))


@query("low_quality_count", "SELECT l_linestatus, count(CASE WHEN l_discount * l_tax * l_quantity < 0.01 THEN 1 END) AS low FROM lineitem GROUP BY 1")
def low_quality_count(t):
    return t("lineitem").groupBy("l_linestatus").agg(A.count_where(F.col("l_discount") * F.col("l_tax") * F.col("l_quantity") < 0.01).alias("low"))


@query("held_out_report", """
WITH r AS (SELECT l_returnflag, l_discount AS y, l_orderkey % 5 = 0 AS held FROM lineitem), m AS (SELECT l_returnflag, avg(y) AS own FROM r WHERE NOT held GROUP BY 1), a AS (SELECT avg(y) AS base FROM r WHERE NOT held)
SELECT l_returnflag, count(*) AS rows, round(avg(abs(y - base)), 6) AS before, round(avg(abs(y - own)), 6) AS after FROM r JOIN m USING (l_returnflag), a WHERE held GROUP BY 1""")
def held_out_report(t):
    """Mean error on held-out rows of a bucket's own mean and of the mean of all."""
    rows = t("lineitem").select("l_returnflag", F.col("l_discount").alias("y"), (F.col("l_orderkey") % 5 == 0).alias("held"))
    own = rows.where("NOT held").groupBy("l_returnflag").agg(F.avg("y").alias("own"))
    base = rows.where("NOT held").agg(F.avg("y").alias("base"))
    judged = rows.where("held").join(own, "l_returnflag").crossJoin(F.broadcast(base))  # one row
    error = lambda c: F.round(F.avg(F.abs(F.col("y") - F.col(c))), 6)
    return judged.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows"), error("base").alias("before"), error("own").alias("after"))


@query("weak_buckets", "SELECT l_suppkey, count(*) AS samples, CASE WHEN count(*) * 2 < 570 THEN 'collect' ELSE 'widen' END AS advice FROM lineitem GROUP BY 1 HAVING count(*) < 600")
def weak_buckets(t):
    sizes = t("lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("samples")).where("samples < 600")
    return sizes.withColumn("advice", F.when(F.col("samples") * 2 < 570, "collect").otherwise("widen"))


@query("folded_path", r"SELECT page_id, lower(regexp_replace(replace(url, '/', '\'), '[\\/]+', '/', 'g')) AS path FROM pages")
def folded_path(t):
    """Slashes of either kind, single or repeated, become one; letters are folded."""
    return t("pages").select("page_id", C.folded_path(F.replace("url", F.lit("/"), F.lit("\\"))).alias("path"))


@query("camera_time", "SELECT event_id, epoch_us(date_trunc('second', ts)) - 7200000000 AS us FROM events")
def camera_time(t):
    """A camera's text with colons in the date, and its offset."""
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy:MM:dd HH:mm:ss")
    return t("events").select("event_id", F.unix_micros(C.camera_time(text, F.lit("+02:00"))).alias("us"))


@query("subsecond", "SELECT event_id, CASE WHEN k >= 100 THEN k ELSE k * 10 END AS ms FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) + event_id % 50 AS k FROM events)")
def subsecond(t):
    k = F.get_json_object("props", "$.k").cast("long") + F.col("event_id") % 50
    return t("events").select("event_id", C.subsecond_ms(k).alias("ms"))


@query("json_array", "SELECT o_orderkey, '[' || o_custkey || ',\"' || o_orderstatus || '\"]' AS pair FROM orders")
def json_array(t):
    return t("orders").select("o_orderkey", F.concat(F.lit("["), F.col("o_custkey").cast("string"), F.lit(","), F.to_json(F.array("o_orderstatus")).substr(F.lit(2), F.length(F.to_json(F.array("o_orderstatus"))) - 2), F.lit("]")).alias("pair"))


@query("secret_shapes", r"""
SELECT doc_id, len(list_filter(regexp_extract_all(text, '[A-Za-z0-9._-]+'), lambda x: regexp_matches(x, '^(sk-|sk_|AIza|gsk_|xai-|ghp_|github_pat_).{5,}$') OR length(x) >= 32 AND regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[0-9]'))) AS secrets FROM documents""")
def secret_shapes(t):
    """Tokens that begin as known credentials do, or are long with an upper-case letter and a digit."""
    return t("documents").select("doc_id", F.size(C.secret_tokens("text")).cast("long").alias("secrets"))
