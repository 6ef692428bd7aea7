"""Roles, joint targets and codings as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalith.functions import coding
from catalith.operators import contests as C
from catalith.operators.joins import counted_pairs, group_sets
from catalith.operators.similarity import cut
from catalith.plans.registry import query

IDENTITIES = """w AS (SELECT s_nationkey AS g, l_suppkey AS id, l_orderkey, l_quantity, l_returnflag, l_linestatus, l_discount FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
i AS MATERIALIZED (SELECT g, id, count(DISTINCT l_orderkey) AS frames, round(avg(l_quantity), 6) AS area, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS scenes, count(DISTINCT CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN l_orderkey END) AS ceremony, round(avg(l_discount) * 10, 6) AS centrality FROM w GROUP BY 1, 2),
u AS (SELECT DISTINCT g, l_orderkey, id FROM w), n AS (SELECT g, l_orderkey, count(*) AS n FROM u GROUP BY 1, 2),
p AS MATERIALIZED (SELECT a.g, a.id AS a, b.id AS b, count(*) AS frames, count(*) FILTER (n = 2) AS portraits FROM u a JOIN u b ON a.g = b.g AND a.l_orderkey = b.l_orderkey AND a.id < b.id JOIN n ON n.g = a.g AND n.l_orderkey = a.l_orderkey GROUP BY 1, 2, 3)"""


def evidence(t):
    """Suppliers are identities, those of a nation a project, orders frames."""
    lines = t("lineitem").select("l_suppkey", "l_orderkey", "l_quantity", "l_returnflag", "l_linestatus", "l_discount")
    rows = lines.join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("g")), "l_suppkey").withColumnRenamed("l_suppkey", "id")
    # An order holds a few suppliers of a nation; its pairs are made there and counted.
    sets, parts = group_sets(rows, ["g", "l_orderkey"], "id")
    # Orders are dealt by size first; an identity's lines of one are one row, so that nothing is counted distinct.
    seen = lambda c: F.coalesce(F.max(c), F.lit(False)) & F.col("l_orderkey").isNotNull()
    each = rows.repartition(parts, "l_orderkey").groupBy("g", "id", "l_orderkey").agg(
        *[f(c).alias(f"{n}_{c}") for c in ("l_quantity", "l_discount") for n, f in (("sum", F.sum), ("n", F.count))],
        seen(F.col("l_returnflag") == "R").alias("scene"), seen((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "A")).alias("rite"))
    mean = lambda c: F.sum(f"sum_{c}") / F.nullif(F.sum(f"n_{c}"), F.lit(0))
    identities = each.groupBy("g", "id").agg(
        F.count("l_orderkey").alias("frames"), F.round(mean("l_quantity"), 6).alias("area"), F.count_if("scene").alias("scenes"),
        F.count_if("rite").alias("ceremony"), F.round(mean("l_discount") * 10, 6).alias("centrality"))
    pairs = counted_pairs(sets, parts, ["g"], {"frames": F.lit(1), "portraits": (F.col("_size") == 2).cast("int")})
    return cut(identities), cut(pairs)  # both are read several times


@query("identity_roles", f"""
WITH {IDENTITIES},
s AS (SELECT *, least(greatest(0.35 * frames / greatest(max(frames) OVER o, 1) + 0.30 * area / greatest(max(area) OVER o, 1.2e-7) + 0.35 * scenes / greatest(max(scenes) OVER o, 1), 0), 1) AS subject, max(scenes) OVER o = 0 AS starved FROM i WINDOW o AS (PARTITION BY g)),
r AS (SELECT *, portraits / greatest(max(portraits) OVER o, 1) AS x, frames / greatest(max(frames) OVER o, 1) AS y FROM p WINDOW o AS (PARTITION BY g)),
c AS (SELECT r.g, r.a, r.b, round(least(greatest(0.34 * x + 0.22 * ((CASE WHEN (l.ceremony = 0 AND m.ceremony = 0) OR l.ceremony > 0 THEN l.centrality ELSE 0 END) + (CASE WHEN (l.ceremony = 0 AND m.ceremony = 0) OR m.ceremony > 0 THEN m.centrality ELSE 0 END)) / 2 + 0.22 * y + 0.22 * (l.subject + m.subject) / 2, 0), 1), 9) AS score FROM r JOIN s l ON l.g = r.g AND l.id = r.a JOIN s m ON m.g = r.g AND m.id = r.b),
k AS (SELECT *, lead(score) OVER o AS second FROM c WINDOW o AS (PARTITION BY g ORDER BY score DESC, a, b) QUALIFY row_number() OVER o = 1),
e AS (SELECT p.g, unnest([CASE WHEN p.a IN (k.a, k.b) THEN p.b END, CASE WHEN p.b IN (k.a, k.b) THEN p.a END]) AS id, frames FROM p JOIN k ON k.g = p.g),
t AS (SELECT g, id, max(frames) AS beside FROM e WHERE id IS NOT NULL GROUP BY 1, 2),
v AS (SELECT s.g, s.id, s.frames, starved, score, coalesce(s.id IN (k.a, k.b), false) AS member, second IS NOT NULL AND score - second < 0.05 AS unsure, coalesce(beside, 0) / greatest(s.frames, 1) AS share FROM s LEFT JOIN k ON k.g = s.g LEFT JOIN t ON t.g = s.g AND t.id = s.id)
SELECT g, id, CASE WHEN frames < 2 THEN 'unknown' WHEN member THEN 'couple' WHEN share >= 0.5 THEN 'close' ELSE 'guest' END AS role,
  round(CASE WHEN frames < 2 THEN 0 WHEN member THEN CASE WHEN starved THEN least(score, 0.62) ELSE score END WHEN share >= 0.5 THEN least(share, 1) ELSE 1 - share END, 6) AS confidence, member AND coalesce(unsure, false) AS ambiguous FROM v""")
def identity_roles(t):
    return C.roles(*evidence(t), "g")


def _reach(target: str) -> str:
    """SQL of how far a member gets towards a target."""
    step = lambda a, b: f"2.2 * log2(greatest({b}, 1e-4) / greatest({a}, 1e-4))"
    wanted = step("v", f"least(greatest({target}, least(v, 0.5)), greatest(v, 0.5))")
    return f"CASE WHEN {wanted} <= 0 THEN greatest({wanted}, -0.6) ELSE least({wanted}, least(cap, 1.2), greatest({step('hi', '0.94')}, 0)) END"


def _stepped(by: str) -> str:
    return f"least(greatest(v, 0) * pow(2, ({by}) / 2.2), 1)"


@query("group_light", f"""
WITH r0 AS (SELECT event_id, user_id, value / 100 AS v, least(value / 100 + 0.15, 1) AS hi, 1.2 * pow(1 - (event_id % 10) / 10, 2) AS cap, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0.3 END AS w, 0.5 AS target FROM events),
{", ".join(f"r{n + 1} AS (SELECT * REPLACE (sum({_stepped(_reach('target'))} * w) OVER (PARTITION BY user_id) / sum(w) OVER (PARTITION BY user_id) AS target) FROM r{n})" for n in range(3))},
s AS (SELECT *, {_reach("target")} AS steps FROM r3), a AS (SELECT *, {_stepped("steps")} AS after FROM s),
m AS (SELECT *, min(after) OVER (PARTITION BY user_id) + 0.08 AS most, count(*) OVER (PARTITION BY user_id) AS n FROM a), x AS (SELECT *, greatest(most, least(v, after)) AS wanted FROM m),
b AS (SELECT *, n > 1 AND after > most AND wanted < after - 1e-4 AS back, least(greatest(2.2 * log2(greatest(wanted, 1e-4) / greatest(v, 1e-4)), -0.6), 1.2) AS other FROM x)
SELECT event_id, round(target, 6) AS target, round(CASE WHEN back THEN other ELSE steps END, 5) + 0.0 AS steps, round(CASE WHEN back THEN {_stepped("other")} ELSE after END, 6) AS after FROM b""")
def group_light(t):
    """A user's events as the members of a group, lifted towards one half under caps of each."""
    rows = t("events").select(
        "event_id", "user_id", (F.col("value") / 100).alias("v"), F.least(F.col("value") / 100 + 0.15, F.lit(1.0)).alias("hi"),
        (1.2 * F.pow(1 - (F.col("event_id") % 10) / 10, F.lit(2.0))).alias("cap"), F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.3).alias("w"))
    out = C.group_solved(rows, "user_id", "v", "hi", "w", 0.5, F.col("cap"))
    return out.select("event_id", F.round("target", 6).alias("target"), (F.round("steps", 5) + 0.0).alias("steps"), F.round("after", 6).alias("after"))


@query("compare_keys", r"""SELECT doc_id, md5(nfc_normalize(replace(text, '\', '/'))) AS key FROM documents""")
def compare_keys(t):
    return t("documents").select("doc_id", F.md5(coding.compare_key("text")).alias("key"))


@query("half_vectors", """
WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings), q AS (SELECT vec_id, x, pow(2, greatest(floor(log2(greatest(abs(x), 1e-30))), -14) - 10) AS q FROM x)
SELECT vec_id, 2 * count(*) AS bytes, round(sum(round_even(x / q, 0) * q), 6) AS total, round(max(abs(round_even(x / q, 0) * q - x)), 9) AS error FROM q GROUP BY 1""")
def half_vectors(t):
    """Vectors as halves and back."""
    coded = t("embeddings").select("vec_id", "embedding", coding.half_encoded("embedding").alias("h"))
    both = coded.select("vec_id", "embedding", F.octet_length("h").cast("long").alias("bytes"), coding.half_decoded("h", 64).alias("back"))
    sums = F.aggregate("back", F.lit(0.0), lambda s, x: s + x.cast("double"))
    error = F.array_max(F.zip_with("back", "embedding", lambda a, b: F.abs(a.cast("double") - b.cast("double"))))
    return both.select("vec_id", "bytes", F.round(sums, 6).alias("total"), F.round(error, 9).alias("error"))
