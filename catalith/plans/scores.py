"""Frame features and mixed centres as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalith.operators import scores as S
from catalith.plans.registry import query

WEIGHTS = {"genuine": 0.9, "interaction": 1.1, "peak": 0.8, "reaction": 0.7, "mutual": 0.6, "composure": 0.5, "tears": 1.2}


@query("frame_features", """
WITH f AS (SELECT l_orderkey AS k, CASE WHEN l_returnflag <> 'R' THEN l_quantity / 50 END AS prominence, 1 - l_tax AS confidence, least(greatest((0.6 * (l_discount * 10) + 0.4 * (l_linenumber / 7)) / 1.0 - l_tax * 0.4, 0), 1) AS expression,
  l_tax * 10 AS genuine, l_discount * 10 AS smile, l_linenumber / 7 AS composed, l_quantity / 60 AS tears, l_returnflag = 'A' AS crying, l_discount * 8 AS intensity FROM lineitem),
s AS (SELECT *, greatest(coalesce(prominence, 0.35), 0.01) * greatest(confidence, 0.05) AS w FROM f),
g AS (SELECT k, sum(w) AS w, sum(expression * w) AS e, sum(genuine * smile * w) AS g, sum(composed * w) AS c, max(CASE WHEN crying THEN tears END) AS t, count(CASE WHEN intensity >= 0.35 THEN 1 END) AS n FROM s GROUP BY 1),
o AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 400000 END AS strength, o_orderpriority = '1-URGENT' AS milestone, o_totalprice / 300000 AS peak, o_totalprice / 500000 AS reaction, o_orderstatus = 'F' AS mutual FROM orders),
x AS (SELECT o_orderkey, least(greatest(coalesce(e / w, 0), 0), 1) AS expression, least(greatest(coalesce(g / w, 0), 0), 1) * 0.9 AS genuine, coalesce(strength * 1.1 * CASE WHEN milestone THEN 1.25 ELSE 1 END, 0) AS interaction, least(peak, 1) * 0.8 AS peak, least(reaction, 1) * 0.7 AS reaction,
  CASE WHEN mutual THEN 0.6 ELSE 0.0 END AS mutual, least(greatest(coalesce(c / w, 0), 0), 1) * 0.5 AS composure, coalesce(t, 0) * 1.2 AS tears, coalesce(n, 0) / 4.0 AS group_size FROM o LEFT JOIN g ON k = o_orderkey)
SELECT o_orderkey, """ + ", ".join(f"round(least(greatest({n}, 0), 1) + 1e-9, 6) AS {n}" for n in S.FEATURES) + " FROM x")
def frame_features(t):
    """Orders as frames, their lines as the members of one."""
    col = F.col
    lines = t("lineitem").select(col("l_orderkey").alias("o_orderkey"), "l_quantity", "l_discount", "l_tax", "l_linenumber", "l_returnflag")
    rows = lines.withColumns({"a": col("l_discount") * 10, "b": col("l_linenumber") / 7, "bad": col("l_tax") * 1.0})
    members = rows.select(
        "o_orderkey", F.when(col("l_returnflag") != "R", col("l_quantity") / 50).alias("prominence"), (1 - col("l_tax")).alias("confidence"), S.mixed(["a", "b"], [0.6, 0.4], "bad", 0.8).alias("expression"),
        (col("l_tax") * 10).alias("genuine"), col("a").alias("smile"), col("b").alias("composed"), (col("l_quantity") / 60).alias("tears"), (col("l_returnflag") == "A").alias("crying"), (col("l_discount") * 8).alias("intensity"))
    frames = t("orders").select(
        "o_orderkey", F.when(col("o_orderstatus") != "P", col("o_totalprice") / 400000).alias("strength"), (col("o_orderpriority") == "1-URGENT").alias("milestone"), (col("o_totalprice") / 300000).alias("peak"),
        (col("o_totalprice") / 500000).alias("reaction"), (col("o_orderstatus") == "F").alias("mutual"))
    found = S.frame_features(frames, members, "o_orderkey", WEIGHTS)
    return found.select("o_orderkey", *[F.round(F.col(n) + 1e-9, 6).alias(n) for n in S.FEATURES])


def _round(i: int) -> str:
    """SQL of one round of two centres."""
    side = f"round((u - u1) ** 2 + (v - v1) ** 2, 12) < round((u - u0) ** 2 + (v - v0) ** 2, 12)"
    mean = lambda c, s: f"coalesce(avg(CASE WHEN {s}(s) THEN {c} END), any_value({c}{'1' if s == '' else '0'}))"
    return f"""s{i} AS (SELECT p.*, u0, v0, u1, v1, {side} AS s FROM p JOIN c{i} USING (user_id)),
c{i + 1} AS (SELECT user_id, count(CASE WHEN NOT s THEN 1 END) AS n0, count(CASE WHEN s THEN 1 END) AS n1, {mean("u", "NOT ")} AS u0, {mean("v", "NOT ")} AS v0, {mean("u", "")} AS u1, {mean("v", "")} AS v1 FROM s{i} GROUP BY 1)"""


@query("mixed_centres", f"""
WITH e AS (SELECT user_id, event_id, value / 100 AS u, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS v FROM events),
w AS (SELECT user_id, max(v) - min(v) > max(u) - min(u) AS axis FROM e GROUP BY 1 HAVING count(*) >= 8), p AS (SELECT e.*, CASE WHEN axis THEN v ELSE u END AS a FROM e JOIN w USING (user_id)),
l AS (SELECT user_id, u AS u0, v AS v0 FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY a, event_id) = 1), h AS (SELECT user_id, u AS u1, v AS v1 FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY a DESC, event_id) = 1),
c0 AS (SELECT * FROM l JOIN h USING (user_id)), {", ".join(_round(i) for i in range(4))}
SELECT user_id, n0, n1, {", ".join(f"round({c} + 1e-9, 6) AS {c}" for c in ("u0", "v0", "u1", "v1"))} FROM c4""")
def mixed_centres(t):
    k = F.get_json_object("props", "$.k").cast("double") / 100
    found = S.two_centres(t("events").select("user_id", "event_id", (F.col("value") / 100).alias("u"), k.alias("v")), "user_id", "event_id", "u", "v")
    return found.select("user_id", "n0", "n1", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("u0", "v0", "u1", "v1")])
