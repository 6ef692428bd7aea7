"""Ranking and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalith.functions.columns import upper_element
from catalith.operators import decisions as D
from catalith.operators import selection as S
from catalith.plans.registry import query


@query("grid_page", "SELECT event_id, user_id, event_type, row_number() OVER (ORDER BY value DESC NULLS LAST, event_id) AS place FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 50 OFFSET 100")
def grid_page(t):
    """A page of a sorted grid; the offset and limit are the feature."""
    rows = S.page(t("events"), [F.desc_nulls_last("value"), F.asc("event_id")], 100, 50).select("event_id", "user_id", "event_type", "value")
    from pyspark.sql.window import Window as W

    return rows.select("event_id", "user_id", "event_type", (F.row_number().over(W.orderBy(F.desc_nulls_last("value"), "event_id")) + 100).cast("long").alias("place"))


@query("review_queue", "SELECT l.doc_id, d.n_chars FROM labels l JOIN documents d USING (doc_id) WHERE quality = 0 AND toxic = 0 ORDER BY d.n_chars, l.doc_id LIMIT 100")
def review_queue(t):
    rows = t("labels").where("quality = 0 AND toxic = 0").select("doc_id").join(t("documents").select("doc_id", "n_chars"), "doc_id")
    return rows.orderBy("n_chars", "doc_id").limit(100)


@query("ranked_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def ranked_topk(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


LINE_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("primary_file", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_linenumber, {", ".join(LINE_ORDER)}) = 1""")
def primary_file(t):
    role = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    best = S.best_per_group(t("lineitem"), ["l_orderkey"], [role, F.asc("l_linenumber"), *map(F.asc, LINE_ORDER)])
    return best.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("keep_hint", """
SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, length(props) DESC, ts, event_id) = 1""")
def keep_hint(t):
    return S.best_per_group(t("events"), ["user_id", "event_type"], [F.desc("value"), F.desc(F.length("props")), F.asc("ts"), F.asc("event_id")]).select("user_id", "event_id")


MOMENT = "SELECT event_id, user_id, event_type || ':' || floor(value / 10)::BIGINT AS dup, value FROM events"


@query("moment_topk", f"""
WITH e AS ({MOMENT}), g AS (SELECT user_id, least(count(*), 1 + floor(5 * (0.65 * least(stddev_pop(value) / 50, 1) + 0.35 * avg(value) / 100) + 0.5))::BIGINT AS k FROM e GROUP BY 1),
one AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, dup ORDER BY value DESC, event_id) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM one)
SELECT r.user_id, event_id, place FROM r JOIN g ON g.user_id = r.user_id WHERE place <= k""")
def moment_topk(t):
    e = t("events").select("event_id", "user_id", F.concat_ws(":", "event_type", F.floor(F.col("value") / 10).cast("string")).alias("dup"), "value")
    k = e.groupBy("user_id").agg(S.keeper_count(F.count(F.lit(1)), F.least(F.stddev_pop("value") / 50, F.lit(1.0)), F.avg("value") / 100, 6).alias("k"))
    return S.keepers(e.join(k, "user_id"), "user_id", "dup", "value", "event_id", F.col("k")).select("user_id", "event_id", "place")


@query("chapter_quota", """
WITH g AS (SELECT event_type, count(*) AS volume, avg(value) / 100 AS importance FROM events GROUP BY 1)
SELECT event_type, volume, least(volume, greatest(1, floor(200 * importance * sqrt(volume) / sum(importance * sqrt(volume)) OVER () + 0.5)))::BIGINT AS quota FROM g""")
def chapter_quota(t):
    g = t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("volume"), (F.avg("value") / 100).alias("importance"))
    return S.quotas(g, "volume", "importance", 200).select("event_type", "volume", "quota")


@query("quota_selection", """
WITH g AS (SELECT event_type, count(*) AS volume, avg(value) / 100 AS importance FROM events GROUP BY 1),
q AS (SELECT event_type, least(volume, greatest(1, floor(200 * importance * sqrt(volume) / sum(importance * sqrt(volume)) OVER () + 0.5)))::BIGINT AS quota FROM g),
r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS place FROM events)
SELECT r.event_type, event_id, place FROM r JOIN q ON q.event_type = r.event_type WHERE place <= quota""")
def quota_selection(t):
    g = t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("volume"), (F.avg("value") / 100).alias("importance"))
    return S.within_quota(t("events").select("event_type", "event_id", "value"), "event_type", "value", "event_id", S.quotas(g, "volume", "importance", 200)).select("event_type", "event_id", "place")


@query("size_predict", """
SELECT user_id, floor(count(*) * least(greatest(0.30 + 0.18 * (avg(value) / 100 - 0.5) + 0.10 * (list_sort(list(value))[least(len(list(value)) * 3 // 4 + 1, len(list(value)))] / 100 - 0.6)
  - 0.06 * least(greatest((count(*) / 24.0 - 4) / 4, -1), 2) + 0.04 * least(greatest((count(DISTINCT event_type) - 5) / 4, -1), 1), 0.22), 0.38) + 0.5)::BIGINT AS target FROM events GROUP BY 1""")
def size_predict(t):
    g = t("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), (F.avg("value") / 100).alias("mean"), (upper_element(F.collect_list("value"), 3, 4) / 100).alias("upper"), F.countDistinct("event_type").alias("kinds"))
    return g.select("user_id", F.floor(F.col("n") * S.target_rate(F.col("mean"), F.col("upper"), F.col("n") / 24.0, F.col("kinds")) + 0.5).alias("target"))


COVER = """
WITH s AS (SELECT user_id, event_id FROM events WHERE value > 90),
h AS (SELECT user_id, count(*) AS n FROM s GROUP BY 1),
r AS (SELECT e.user_id, e.event_id, 3 - coalesce(h.n, 0) AS short, row_number() OVER (PARTITION BY e.user_id ORDER BY value DESC, e.event_id) AS i
  FROM events e LEFT JOIN h ON h.user_id = e.user_id WHERE e.event_id NOT IN (SELECT event_id FROM s))"""


@query("coverage_rules", f"{COVER} SELECT user_id, event_id, false AS forced FROM s UNION ALL SELECT user_id, event_id, true FROM r WHERE i <= short")
def coverage_rules(t):
    rows = t("events").select("user_id", "event_id", "value")
    return S.enforce_coverage(rows.where("value > 90"), rows, "user_id", 3, "value", "event_id").select("user_id", "event_id", "forced")


@query("coverage_states", """
SELECT e.user_id, coalesce(k, 0) AS kept, CASE WHEN coalesce(k, 0) >= 3 THEN 'covered' WHEN coalesce(k, 0) > 0 THEN 'weak' ELSE 'missing' END AS state
FROM (SELECT DISTINCT user_id FROM events) e LEFT JOIN (SELECT user_id, count(*) AS k FROM events WHERE value > 90 GROUP BY 1) s ON s.user_id = e.user_id""")
def coverage_states(t):
    rows = t("events").select("user_id", "event_id", "value")
    return S.coverage_state(rows, rows.where("value > 90"), "user_id", 3)


@query("diversity_cap")
def diversity_cap(t):
    rows = t("events").select("user_id", "event_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return S.density_capped(rows, "user_id", "us", "value", "event_id", 6 * 3_600_000_000, 2)


@query("lru_eviction", """
WITH w AS (SELECT doc_id, source, sum(n_chars) OVER (PARTITION BY source) - (sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n_chars) AS held FROM documents)
SELECT doc_id, source FROM w WHERE held > 50000""")
def lru_eviction(t):
    return S.evicted(t("documents").select("doc_id", "source", "n_chars"), ["source"], ["doc_id"], "n_chars", 50_000).select("doc_id", "source")


@query("trimmed_centre", """
WITH w AS (SELECT l_suppkey AS s, l_quantity AS x, l_discount * 100 AS y, l_tax + 0.01 AS w FROM lineitem),
c AS (SELECT *, sum(x * w) OVER p / sum(w) OVER p AS cx, sum(y * w) OVER p / sum(w) OVER p AS cy FROM w WINDOW p AS (PARTITION BY s)),
d AS (SELECT *, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS d FROM c), m AS (SELECT *, sum(d * w) OVER (PARTITION BY s) / sum(w) OVER (PARTITION BY s) AS md FROM d),
k AS (SELECT *, sum(CASE WHEN d <= 1.5 * md THEN 1 ELSE 0 END) OVER (PARTITION BY s) AS inside FROM m)
SELECT s, round(sum(x * w) / sum(w), 4) AS x, round(sum(y * w) / sum(w), 4) AS y, count(*) AS kept FROM k WHERE inside < 4 OR d <= 1.5 * md GROUP BY 1""")
def trimmed_centre(t):
    rows = t("lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") + 0.01).alias("w"))
    return D.trimmed_centre(rows, "s", "x", "y", "w", 4, 1.5).select("s", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "kept")


@query("reference_frames", """
WITH e AS (SELECT user_id, event_id, value, epoch_us(ts) AS us FROM events),
n AS (SELECT *, count(*) OVER p AS n, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i, greatest(max(us) OVER p - min(us) OVER p, 1) AS span FROM e WINDOW p AS (PARTITION BY user_id)),
m AS (SELECT *, max(CASE WHEN i = n // 2 + 1 THEN us END) OVER (PARTITION BY user_id) AS med FROM n),
a AS (SELECT *, value * (1 - 0.5 * abs(us - med) / span) AS anchored FROM m)
SELECT user_id, event_id, round(anchored, 6) AS anchored, row_number() OVER (PARTITION BY user_id ORDER BY anchored DESC, event_id) AS place FROM a WHERE n >= 3
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY anchored DESC, event_id) <= 5""")
def reference_frames(t):
    rows = t("events").select("user_id", "event_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return D.median_anchored(rows, "user_id", "us", "event_id", "value", 0.5, 3, 5).select("user_id", "event_id", F.round("anchored", 6).alias("anchored"), F.col("place").cast("long").alias("place"))


@query("abstention", """
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 50 AS bulk, 1 - l_quantity / 50 AS retail, l_discount * 8 AS sale FROM lineitem)
SELECT CASE WHEN greatest(bulk, retail, sale) >= 0.6 AND greatest(bulk, retail, sale) - (bulk + retail + sale - greatest(bulk, retail, sale) - least(bulk, retail, sale)) >= 0.1
  THEN CASE greatest(bulk, retail, sale) WHEN bulk THEN 'bulk' WHEN retail THEN 'retail' ELSE 'sale' END ELSE 'unknown' END AS verdict, count(*) AS rows FROM p GROUP BY 1""")
def abstention(t):
    scores = {"bulk": F.col("l_quantity") / 50, "retail": 1 - F.col("l_quantity") / 50, "sale": F.col("l_discount") * 8}
    label, _ = D.top_with_abstention(scores, 0.6, 0.1)
    return t("lineitem").groupBy(label.alias("verdict")).agg(F.count(F.lit(1)).alias("rows"))


@query("style_shrinkage", """
WITH g AS (SELECT avg(l_extendedprice) AS g FROM lineitem), p AS (SELECT l_returnflag, avg(l_extendedprice) AS p, count(*) AS pn FROM lineitem GROUP BY 1),
c AS (SELECT l_returnflag, l_linestatus, l_linenumber, avg(l_extendedprice) AS c, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)
SELECT c.l_returnflag, l_linestatus, l_linenumber, n, round((g + (p - g) * pn / (pn + 40)) + (c - (g + (p - g) * pn / (pn + 40))) * n / (n + 12), 3) AS estimate FROM c JOIN p ON p.l_returnflag = c.l_returnflag, g""")
def style_shrinkage(t):
    out = D.shrunk(t("lineitem"), ["l_returnflag"], ["l_returnflag", "l_linestatus", "l_linenumber"], "l_extendedprice", 40, 12)
    return out.withColumn("estimate", F.round("estimate", 3))
