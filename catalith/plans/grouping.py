"""Moments, roles, galleries and decision ladders as queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from catalith.operators import aggregates as A
from catalith.operators import grouping as G
from catalith.operators import joins as J
from catalith.operators import selection as S
from catalith.operators import sequences
from catalith.plans.joining import HOUR, timed
from catalith.plans.registry import query
from catalith.plans.sequencing import CADENCE

EDGES = f"""{CADENCE}, p AS (SELECT a.event_id AS a, b.event_id AS b, b.us - a.us AS gap, least(a.w, 43200000000) AS reach,
  0.6 * (1 - abs(a.value - b.value) / 100) + 0.4 * CASE WHEN a.event_type = b.event_type THEN 1 ELSE 0 END AS s
  FROM c a JOIN c b ON a.user_id = b.user_id AND (a.us < b.us OR (a.us = b.us AND a.event_id < b.event_id)) AND b.us - a.us <= least(a.w, 43200000000)),
ed AS (SELECT a, b, gap, s * (1 - 0.2 * gap / reach) AS score FROM p WHERE s * (1 - 0.2 * gap / reach) >= 0.55)"""


def edges(t):
    rows = sequences.cadence_windows(timed(t("events")), "user_id", "us", "event_id", 24 * HOUR, 2.5, 1.0 * HOUR, 48.0 * HOUR)
    alike = 0.6 * (1 - F.abs(F.col("a_value") - F.col("b_value")) / 100) + 0.4 * (F.col("a_event_type") == F.col("b_event_type")).cast("int")
    return G.moment_edges(rows, "event_id", "us", "window", 12 * HOUR, ["value", "event_type"], alike * (1 - 0.2 * F.col("gap") / F.col("reach")), F.lit(0.55), ["user_id"])


@query("moment_edges", f"{EDGES} SELECT a, b, round(score, 6) AS score FROM ed")
def moment_edges(t):
    return edges(t).select("a", "b", F.round("score", 6).alias("score"))


@query("moment_groups", f"""
WITH RECURSIVE {EDGES.strip()[5:]}, both_ways AS (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed),
reach2 AS (SELECT event_id AS n, event_id AS r FROM events UNION SELECT w.b, reach2.r FROM reach2 JOIN both_ways w ON w.a = reach2.n),
m AS (SELECT n, min(r) AS root FROM reach2 GROUP BY 1)
SELECT root, count(*) AS frames FROM m GROUP BY 1""")
def moment_groups(t):
    groups = G.capped_components(edges(t), t("events"), "event_id", 10_000, rounds=0)
    return groups.groupBy("root").agg(F.count(F.lit(1)).alias("frames"))


@query("moment_groups_capped")
def moment_groups_capped(t):
    return G.capped_components(edges(t), t("events"), "event_id", 12, rounds=1)


@query("moment_merge")
def moment_merge(t):
    s = sequences.islands(timed(t("events")).withColumn("both", F.concat_ws(":", "user_id", "event_type")), "both", "us", "event_id", 96 * HOUR)
    groups = s.select(F.pmod(F.split("both", ":")[0].cast("long"), F.lit(20)).alias("project"), F.xxhash64("both", "session").alias("moment"), "first", "last", F.col("both").alias("camera"))
    return G.merged_intervals(groups, "project", "moment", "first", "last", "camera", 0.6)


@query("chapter_swap")
def chapter_swap(t):
    rows = t("events").select("event_type", "event_id", "user_id", (F.col("value") / 100).alias("score"), F.lit(40).alias("quota"))
    return G.swapped_for_distinct(rows, "event_type", "user_id", "score", "event_id", "quota")


RECONCILE = "WITH k AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > {low}), n AS (SELECT {target} - count(*) AS short FROM k), g AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM k)), s AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey DESC) AS i FROM k WHERE o_orderkey % 10 <> 0) SELECT o_orderkey FROM k WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s, n WHERE i <= -short) UNION ALL SELECT o_orderkey FROM g, n WHERE i <= short"


@query("reconcile_grow", RECONCILE.format(low=300_000, target=1000))
def reconcile_grow(t):
    rows = t("orders").select("o_orderkey", "o_totalprice", (F.col("o_orderkey") % 10 == 0).alias("locked"))
    return G.reconciled(rows.where("o_totalprice > 300000"), rows, "o_orderkey", "o_totalprice", 1000, "locked").select("o_orderkey")


@query("reconcile_shrink", RECONCILE.format(low=100_000, target=200))
def reconcile_shrink(t):
    rows = t("orders").select("o_orderkey", "o_totalprice", (F.col("o_orderkey") % 10 == 0).alias("locked"))
    return G.reconciled(rows.where("o_totalprice > 100000"), rows, "o_orderkey", "o_totalprice", 200, "locked").select("o_orderkey")


@query("identity_minimum", """
WITH o AS (SELECT l_orderkey, sum(l_extendedprice) AS score FROM lineitem GROUP BY 1), m AS (SELECT DISTINCT l_orderkey, l_suppkey AS m FROM lineitem),
k AS (SELECT l_orderkey FROM o WHERE score > 600000), h AS (SELECT m, count(*) AS n FROM m WHERE l_orderkey IN (SELECT l_orderkey FROM k) GROUP BY 1),
r AS (SELECT m.l_orderkey, 12 - coalesce(h.n, 0) AS short, row_number() OVER (PARTITION BY m.m ORDER BY round(score, 2) DESC, m.l_orderkey) AS i FROM m JOIN o ON o.l_orderkey = m.l_orderkey LEFT JOIN h ON h.m = m.m WHERE m.l_orderkey NOT IN (SELECT l_orderkey FROM k))
SELECT DISTINCT l_orderkey FROM r WHERE i <= short""")
def identity_minimum(t):
    rows = t("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("members"), F.sum("l_extendedprice").alias("raw")).withColumn("score", F.round("raw", 2))
    return G.minimum_each(rows.where("raw > 600000"), rows, "l_orderkey", "members", "score", 12)


@query("key_frame", """
SELECT user_id, event_id, CASE WHEN event_type = 'purchase' AND value > 80 THEN 0 WHEN event_type = 'purchase' THEN 1 WHEN value > 80 THEN 2 ELSE 3 END::BIGINT AS rung FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rung, value DESC, event_id) = 1""")
def key_frame(t):
    bought, good = F.col("event_type") == "purchase", F.col("value") > 80
    return G.relaxed_best(t("events"), "user_id", [bought & good, bought, good], [F.desc("value"), F.asc("event_id")]).select("user_id", "event_id", "rung")


@query("threshold_sweep", """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
p AS (SELECT round(least(greatest(1 - list_dot_product(a.v, b.v), 0), 2), 9) AS d, CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS same FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), g AS (SELECT unnest([0.6, 0.7, 0.8, 0.9])::DOUBLE AS threshold)
SELECT threshold, round(2 * sum(CASE WHEN d <= threshold THEN same ELSE 0 END) / (sum(CASE WHEN d <= threshold THEN 1 ELSE 0 END) + sum(same)), 6) AS f1 FROM p, g GROUP BY 1""")
def threshold_sweep(t):
    """A stated query set, every fiftieth vector, against all vectors; how many pairs of one
    label there are comes from the labels' sizes."""
    from catalith.operators.similarity import swept

    base = t("embeddings")
    found = swept(base.where("vec_id % 50 = 0"), base, "vec_id", "embedding", "label", [0.6, 0.7, 0.8, 0.9])
    sizes = base.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("others"), F.count_if(F.col("vec_id") % 50 == 0).alias("asked"))
    real = sizes.agg(F.sum(F.col("others") * F.col("asked")).alias("real"))
    return found.crossJoin(F.broadcast(real)).select("threshold", F.round(2 * F.col("right") / F.nullif(F.col("named") + F.col("real"), F.lit(0)), 6).alias("f1"))  # one row


@query("ranker_fit")
def ranker_fit(t):
    """Of two lines of an order, the dearer is the better one."""
    lines = t("lineitem").select("l_orderkey", "l_extendedprice", (F.col("l_quantity") / 50).alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    side = lambda p: lines.select("l_orderkey", *[F.col(c).alias(f"{p}_{c}") for c in lines.columns if c != "l_orderkey"])
    pairs = side("b").join(side("w"), "l_orderkey").where("b_l_extendedprice > w_l_extendedprice")
    weights = G.fitted_ranker(pairs, ["quantity", "discount", "tax"])
    return lines.sparkSession.createDataFrame([(k, round(v, 3)) for k, v in weights.items()], "feature string, weight double")


@query("gallery")
def gallery(t):
    rows = timed(t("events")).select("event_id", "user_id", "event_type", "us", F.concat_ws(":", "user_id", F.floor(F.col("value") / 10).cast("string")).alias("dup"), (F.col("value") / 100).alias("score"))
    return G.gallery(rows, "event_type", "user_id", "dup", "score", "us", "event_id", 300, 4, HOUR // 4, 2, 10)


@query("veto_ladder", """
SELECT CASE WHEN l_quantity < 5 THEN 'small' WHEN l_discount > 0.09 THEN 'sale' WHEN l_returnflag = 'R' AND l_tax < 0.02 THEN 'returned' ELSE 'none' END AS veto, count(*) AS rows FROM lineitem GROUP BY 1""")
def veto_ladder(t):
    veto = F.when(F.col("l_quantity") < 5, "small").when(F.col("l_discount") > 0.09, "sale").when((F.col("l_returnflag") == "R") & (F.col("l_tax") < 0.02), "returned").otherwise("none")
    return A.census(t("lineitem").select(veto.alias("veto")), "veto")


@query("rule_match", """
SELECT o_orderkey FROM orders o WHERE o_orderpriority IN ('1-URGENT') OR EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_suppkey IN (3, 5))""")
def rule_match(t):
    members = t("lineitem").where("l_suppkey IN (3, 5)").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_suppkey").alias("hit"))
    rows = t("orders").select("o_orderkey", "o_orderpriority").join(members, "o_orderkey", "left")
    rule = F.col("o_orderpriority").isin("1-URGENT") | F.coalesce(F.arrays_overlap("hit", F.array(F.lit(3).cast("long"), F.lit(5).cast("long"))), F.lit(False))
    return rows.where(rule).select("o_orderkey")


@query("json_validation", """
SELECT event_type, count(*) AS events, count(CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 0 AND 99 THEN 1 END) AS valid FROM events GROUP BY 1""")
def json_validation(t):
    parsed = F.from_json("props", "k long, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = t("events").select("event_type", parsed.alias("p"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), A.count_where(F.col("p._bad").isNull() & F.col("p.k").between(0, 99)).alias("valid"))


@query("importance_blend", """
WITH g AS (SELECT user_id, count(*) AS frames, count(DISTINCT event_type) AS kinds, avg(value) AS mean, epoch_us(max(ts)) - epoch_us(min(ts)) AS span FROM events GROUP BY 1)
SELECT user_id, round(0.4 * frames / max(frames) OVER () + 0.2 * kinds / max(kinds) OVER () + 0.2 * mean / max(mean) OVER () + 0.2 * span / max(span) OVER (), 6) AS importance FROM g""")
def importance_blend(t):
    g = timed(t("events")).groupBy("user_id").agg(F.count(F.lit(1)).alias("frames"), F.countDistinct("event_type").alias("kinds"), F.avg("value").alias("mean"), (F.max("us") - F.min("us")).alias("span"))
    top = g.agg(*[F.max(c).alias(f"top_{c}") for c in ("frames", "kinds", "mean", "span")])
    part = lambda c, w: F.lit(w) * F.col(c) / F.col(f"top_{c}")
    blend = part("frames", 0.4) + part("kinds", 0.2) + part("mean", 0.2) + part("span", 0.2)
    return g.crossJoin(F.broadcast(top)).select("user_id", F.round(blend, 6).alias("importance"))  # one row


@query("autonomy_bands", """
SELECT CASE WHEN p * r >= 0.8 THEN 'auto' WHEN p * r >= 0.5 THEN 'suggest' ELSE 'ask' END AS band, count(*) AS decisions FROM (
  SELECT 1 - l_discount * 5 AS p, CASE l_returnflag WHEN 'R' THEN 0.7 WHEN 'A' THEN 0.9 ELSE 1.0 END AS r FROM lineitem) GROUP BY 1""")
def autonomy_bands(t):
    lines = t("lineitem")
    risk = lines.sparkSession.createDataFrame([("R", 0.7), ("A", 0.9)], "l_returnflag string, risk double")
    p = lines.join(F.broadcast(risk), "l_returnflag", "left").select(((1 - F.col("l_discount") * 5) * F.coalesce("risk", F.lit(1.0))).alias("p"))  # a literal table
    return A.census(p.select(F.when(F.col("p") >= 0.8, "auto").when(F.col("p") >= 0.5, "suggest").otherwise("ask").alias("band")), "band").withColumnRenamed("rows", "decisions")


@query("training_pairs", """
WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us FROM events)
SELECT CASE WHEN a.event_type = b.event_type THEN 'positive' ELSE 'hard negative' END AS kind, count(*) AS pairs
FROM e a JOIN e b ON a.user_id = b.user_id AND (a.us < b.us OR (a.us = b.us AND a.event_id < b.event_id)) AND b.us - a.us <= 7200000000 GROUP BY 1""")
def training_pairs(t):
    pairs = J.band_pairs(timed(t("events")), "event_id", "us", 2 * HOUR, ["user_id"], ["event_type"])
    kind = F.when(F.col("a_event_type") == F.col("b_event_type"), "positive").otherwise("hard negative")
    return A.census(pairs.select(kind.alias("kind")), "kind").withColumnRenamed("rows", "pairs")


@query("quality_gates", """
WITH c AS (SELECT source, sum(k)::BIGINT AS n, count(*) AS langs, max(k) / sum(k) AS top FROM (SELECT source, lang, count(*) AS k FROM documents GROUP BY 1, 2) GROUP BY 1)
SELECT source, n, langs, round(top, 6) AS top, n >= 30 AND langs >= 3 AND top <= 0.65 AS passes FROM c""")
def quality_gates(t):
    """Enough rows, enough classes, and no class with nearly all of them."""
    each = t("documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("k"))
    g = each.groupBy("source").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("langs"), (F.max("k") / F.sum("k")).alias("top"))
    return g.select("source", "n", "langs", F.round("top", 6).alias("top"), ((F.col("n") >= 30) & (F.col("langs") >= 3) & (F.col("top") <= 0.65)).alias("passes"))


@query("majority_verdict", """
SELECT conv_id, role AS verdict, n AS votes FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, role) = 1""")
def majority_verdict(t):
    return A.dominant(t("conversations"), ["conv_id"], "role").select("conv_id", F.col("role").alias("verdict"), F.col("n").alias("votes"))


@query("masked_argmax", """
WITH p AS (SELECT vec_id, list_transform(embedding[1:6], lambda x: exp(x::DOUBLE)) AS e, vec_id % 3 AS m FROM embeddings),
x AS (SELECT vec_id, unnest(e) AS e, generate_subscripts(e, 1) - 1 AS i, m FROM p), k AS (SELECT vec_id, i, e / sum(e) OVER (PARTITION BY vec_id) AS q FROM x WHERE i % 3 <> m)
SELECT vec_id, i::BIGINT AS slot, round(q, 6) AS share FROM k QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY q DESC, i) = 1""")
def masked_argmax(t):
    """Slots outside the row's mask are dropped, the rest renormalised, the best taken."""
    rows = t("embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 6)).alias("i", "x")).where("i % 3 <> vec_id % 3")
    share = rows.withColumn("e", F.exp(F.col("x").cast("double"))).withColumn("q", F.col("e") / F.sum("e").over(W.partitionBy("vec_id")))
    return S.best_per_group(share, ["vec_id"], [F.desc("q"), F.asc("i")]).select("vec_id", F.col("i").cast("long").alias("slot"), F.round("q", 6).alias("share"))


@query("synonym_resolution", """
SELECT coalesce(s.c, 'other') AS kind, count(*) AS parts FROM part p LEFT JOIN (VALUES ('promo burnished', 'promo'), ('standard brushed', 'standard')) s(a, c) ON lower(trim(p_type)) = a GROUP BY 1""")
def synonym_resolution(t):
    parts = t("part")
    names = parts.sparkSession.createDataFrame([("promo burnished", "promo"), ("standard brushed", "standard")], "alias string, kind string")
    joined = parts.join(F.broadcast(names), F.lower(F.trim("p_type")) == F.col("alias"), "left")  # a literal table
    return joined.groupBy(F.coalesce("kind", F.lit("other")).alias("kind")).agg(F.count(F.lit(1)).alias("parts"))


@query("style_fallback", """
WITH b AS (SELECT l_returnflag, l_linestatus, l_suppkey, avg(l_discount) AS x FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) >= 150), g AS (SELECT l_returnflag, avg(l_discount) AS x FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1), a AS (SELECT avg(l_discount) AS x FROM lineitem),
k AS (SELECT DISTINCT l_returnflag, l_linestatus, l_suppkey FROM lineitem)
SELECT k.l_returnflag, k.l_linestatus, k.l_suppkey, round(coalesce(b.x, g.x, a.x), 6) AS advice, CASE WHEN b.x IS NOT NULL THEN 'bucket' WHEN g.x IS NOT NULL THEN 'group' ELSE 'global' END AS level
FROM k LEFT JOIN b USING (l_returnflag, l_linestatus, l_suppkey) LEFT JOIN g USING (l_returnflag), a""")
def style_fallback(t):
    lines, keys = t("lineitem"), ["l_returnflag", "l_linestatus", "l_suppkey"]
    cells = lines.groupBy(*keys).agg(F.avg("l_discount").alias("x"), F.count(F.lit(1)).alias("n"))
    group = lines.where("l_returnflag <> 'N'").groupBy("l_returnflag").agg(F.avg("l_discount").alias("g"))
    total = lines.agg(F.avg("l_discount").alias("a"))
    own = F.when(F.col("n") >= 150, F.col("x"))
    joined = cells.join(group, "l_returnflag", "left").crossJoin(F.broadcast(total))  # one row
    return joined.select(*keys, F.round(F.coalesce(own, "g", "a"), 6).alias("advice"), F.when(own.isNotNull(), "bucket").when(F.col("g").isNotNull(), "group").otherwise("global").alias("level"))


@query("cost_plan", """
SELECT o_orderkey, CASE WHEN cost <= 100000 AND day_total <= 900000 THEN 'full' WHEN cost / 4 <= 100000 AND day_total <= 2000000 THEN 'reduced' ELSE 'stop' END AS tier FROM (
  SELECT o_orderkey, o_totalprice AS cost, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS day_total FROM orders)""")
def cost_plan(t):
    run = F.sum("o_totalprice").over(W.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(W.unboundedPreceding, 0))
    rows = t("orders").select("o_orderkey", F.col("o_totalprice").alias("cost"), run.alias("total"))
    return rows.select("o_orderkey", F.when((F.col("cost") <= 100_000) & (F.col("total") <= 900_000), "full").when((F.col("cost") / 4 <= 100_000) & (F.col("total") <= 2_000_000), "reduced").otherwise("stop").alias("tier"))


@query("subject_rank", """
SELECT l_orderkey, l_suppkey, round(price / max(price) OVER (PARTITION BY l_orderkey), 6) AS prominence, row_number() OVER (PARTITION BY l_orderkey ORDER BY price DESC, l_suppkey) AS place FROM (
  SELECT l_orderkey, l_suppkey, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1, 2)""")
def subject_rank(t):
    w = W.partitionBy("l_orderkey")
    rows = t("lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("price"))
    return rows.select("l_orderkey", "l_suppkey", F.round(F.col("price") / F.max("price").over(w), 6).alias("prominence"), F.row_number().over(w.orderBy(F.desc("price"), "l_suppkey")).cast("long").alias("place"))


@query("conditional_ratio", """
SELECT user_id, round(avg(CASE WHEN value > 50 THEN CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END END), 6) AS ratio, count(CASE WHEN value > 50 THEN 1 END) AS gating FROM events GROUP BY 1""")
def conditional_ratio(t):
    gate = F.col("value") > 50
    return t("events").groupBy("user_id").agg(F.round(F.avg(F.when(gate, (F.col("event_type") == "error").cast("double"))), 6).alias("ratio"), A.count_where(gate).alias("gating"))


@query("box_association", """
WITH p AS (SELECT a.event_id AS box, b.event_id AS face, greatest(least(a.value + 8, b.value + 5) - greatest(a.value, b.value), 0) AS shared, a.user_id FROM events a JOIN events b ON a.user_id = b.user_id WHERE a.event_type = 'purchase' AND b.event_type = 'signup'),
s AS (SELECT box, face, round(shared / (13 - shared), 6) AS iou FROM p WHERE shared > 0)
SELECT face, box, iou FROM s QUALIFY row_number() OVER (PARTITION BY face ORDER BY iou DESC, box) = 1""")
def box_association(t):
    from catalith.functions.columns import interval_iou

    e = t("events")
    boxes = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("box"), F.col("value").alias("b0"), (F.col("value") + 8).alias("b1"))
    faces = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("face"), F.col("value").alias("f0"), (F.col("value") + 5).alias("f1"))
    scored = boxes.join(faces, "user_id").withColumn("iou", F.round(interval_iou("b0", "b1", "f0", "f1"), 6)).where((F.col("b1") > F.col("f0")) & (F.col("f1") > F.col("b0")))
    return S.best_per_group(scored, ["face"], [F.desc("iou"), F.asc("box")]).select("face", "box", "iou")


@query("cloud_spend", "SELECT s_nationkey, coalesce(sum(CASE WHEN s_acctbal > 0 THEN s_acctbal END), 0) AS spend, count(*) AS calls FROM supplier GROUP BY 1")
def cloud_spend(t):
    return t("supplier").groupBy("s_nationkey").agg(F.coalesce(F.sum(F.when(F.col("s_acctbal") > 0, F.col("s_acctbal"))), F.lit(0.0)).alias("spend"), F.count(F.lit(1)).alias("calls"))
