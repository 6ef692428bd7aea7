"""Coverage views: for each project, what has been done to its photos, each with its own columns.

Customers are projects (a negative balance: deleted), orders their photos, and the lines of an
order what a pass has written about it; orders without lines have not been looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalith.plans.registry import query

#: One row of a photo from its lines: faces or masks (n), those that count (voting), tiles, a score,
#: a confidence, sixteen flag bits, the source, versions and marks. The same words in both dialects.
PASS = {
    "n": "count(*)", "voting": "count(CASE WHEN l_quantity >= 20 THEN 1 END)", "tiled": "max(CASE WHEN l_quantity >= 45 THEN 1 ELSE 0 END)", "score": "round(avg(l_quantity), 6)", "conf": "round(avg(l_discount) * 10, 6)",
    "edge": "round(avg(l_tax) * 12, 6)", "flags": "bit_or(CAST(power(2, l_linenumber) AS BIGINT))", "source": "max(l_returnflag)", "ver": "min(l_linenumber)", "reviewed": "max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)",
    "edited": "max(CASE WHEN l_returnflag = 'A' AND l_discount > 0.08 THEN 1 ELSE 0 END)", "bytes": "CAST(sum(l_quantity) AS BIGINT)", "best": "max(l_discount)", "low": "count(CASE WHEN l_discount * 10 * l_tax * 12 < 0.2025 THEN 1 END)",
}
_N = lambda c: f"count(CASE WHEN {c} THEN 1 END)"
_REVIEW = lambda least: _N(f"of IS NOT NULL AND reviewed = 0 AND edited = 0 AND conf < {least}")
#: Columns of each view (means a hair above, so that halves round alike) over project, photo, of (the photo, where a pass has seen it) and PASS.
VIEWS = {
    "people_coverage": {"photos": "count(photo)", "scanned": "count(of)", "faces": "CAST(coalesce(sum(n), 0) AS BIGINT)", "voting_faces": "CAST(coalesce(sum(voting), 0) AS BIGINT)", "tiled_frames": "CAST(coalesce(sum(tiled), 0) AS BIGINT)"},
    "scene_coverage": {"photos": "count(photo)", "classified": "count(of)", "user_labelled": _N("source = 'A'"), "with_ritual": _N("best > 0.09"), "confident": _N("conf >= 0.75")},
    "moment_coverage": {"photos": "count(photo)", "groupable": "count(of)", "grouped": _N("n > 1"), "moments": "count(DISTINCT CASE WHEN n > 1 THEN moment END)", "locked": "count(DISTINCT CASE WHEN n > 1 AND edited = 1 THEN moment END)"},
    "integrity_coverage": {"photos": "count(photo)", "scored": "count(of)", "subject_aware": _N("flags & 8 = 0"), "reviewed_": _N("reviewed = 1"), "uncalibrated": _N("source = 'N'"), "mean_score": "round(avg(score) + 1e-9, 5)", "model_ver": "min(ver)", "analysis_ver": "min(n)"},
    "emotion_coverage": {"photos": "count(photo)", "scored": "count(of)", "face_aware": _N("voting > 0"), "mean_score": "round(avg(score) + 1e-9, 5)", "cloud_scored": _N("source = 'R'"), "model_ver": "min(ver)"},
    "composition_coverage": {"photos": "count(photo)", "scored": "count(of)", "keypoint_aware": _N("voting > 1"), "reviewed_": _N("reviewed = 1"), "unruled": _N("flags & 16 <> 0"), "hinted": _N("best >= 0.1"), "mean_score": "round(avg(conf) + 1e-9, 5)", "rules_ver": "min(ver)"},
    "cull_coverage": {"photos": "count(photo)", "selected": _N("score >= 25"), "rejected": _N("score < 25"), "user_kept": _N("edited = 1 AND score >= 25"), "user_rejected": _N("edited = 1 AND score < 25"), "eligible": _N("flags & 2 <> 0"), "grouped": _N("n > 1"), "mode": "max(source)", "model_ver": "max(ver)"},
    "ledger_coverage": {"decisions": "count(of)", "explained": _N("n > 0"), "calibrated": _N("ver = 1"), "review_queue": _N("source IN ('A', 'R')"), "user_decisions": _N("edited = 1"), "reasons": "CAST(coalesce(sum(n), 0) AS BIGINT)", "calibration_ver": "max(ver)", "first_photo": "min(of)", "last_photo": "max(of)"},
    "develop_coverage": {"images": "count(photo)", "with_recipe": "count(of)", "from_ai": _N("source = 'N'"), "from_user": _N("source = 'A'"), "touched_by_hand": _N("edited > 0"), "sidecar_behind": _N("reviewed = 0")},
    "tone_coverage": {"images": "count(photo)", "estimated": "count(of)", "face_anchored": _N("voting > 0"), "skin_constrained": _N("voting > 2"), "mixed_light": _N("flags & 32 <> 0"), "coloured_light": _N("flags & 64 <> 0"), "user_edited": _N("edited = 1"), "needs_review": _REVIEW(0.55)},
    "colour_coverage": {"images": "count(photo)", "decided": "count(of)", "skin_measured": _N("voting > 0"), "skin_guard_triggered": _N("best > 0.08"), "clip_guard_resolved": _N("tiled = 1"), "subtlety_capped": _N("conf > 0.9"), "user_edited": _N("edited = 1"), "needs_review": _REVIEW(0.55), "worst_shift": "coalesce(max(best), 0)"},
    "local_coverage": {"images": "count(photo)", "planned": "count(of)", "acted_on": _N("score > 30 OR conf > 0.6 OR edge > 0.6"), "group_solved": _N("n > 2"), "shine_reduced": _N("tiled > 0"), "user_edited": _N("edited = 1"), "needs_review": _REVIEW(0.5)},
    "mask_coverage": {"selected": _N("photo IS NOT NULL"), "masked": "count(of)", "masks": "CAST(coalesce(sum(n), 0) AS BIGINT)", "user_edited": _N("edited = 1"), "payload_bytes": "CAST(coalesce(sum(bytes), 0) AS BIGINT)", "mean_confidence": "round(coalesce(sum(conf * n) / sum(n), 0) + 1e-9, 5)", "mean_edge_quality": "round(coalesce(sum(edge * n) / sum(n), 0) + 1e-9, 5)", "low_quality": "CAST(coalesce(sum(low), 0) AS BIGINT)"},
}
SQL = """WITH w AS (SELECT l_orderkey AS of, {passed} FROM lineitem GROUP BY 1),
p AS (SELECT c_custkey AS project, o_orderkey AS photo, o_orderkey // 8 AS moment, w.* FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN w ON of = o_orderkey WHERE c_acctbal >= 0)
SELECT project, {columns} FROM p GROUP BY project"""


def passed(t) -> DataFrame:
    """project, photo and what a pass says of it: lines become one row of a photo before they
    meet it, so no join multiplies rows and every count is a plain one."""
    seen = t("lineitem").groupBy(F.col("l_orderkey").alias("of")).agg(*[F.expr(e).alias(n) for n, e in PASS.items()])
    photos = t("orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("photo"), F.expr("o_orderkey div 8").alias("moment"))
    projects = t("customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("project"))
    return projects.join(photos.join(seen, F.col("photo") == F.col("of"), "left"), "project", "left")


def _view(name: str, columns: dict[str, str]) -> None:
    text = SQL.format(passed=", ".join(f"{e} AS {n}" for n, e in PASS.items()), columns=", ".join(f"{e} AS {n}" for n, e in columns.items()))
    query(name, text)(lambda t: passed(t).groupBy("project").agg(*[F.expr(e).alias(n) for n, e in columns.items()]))


for _name, _columns in VIEWS.items():
    _view(_name, _columns)


@query("moment_summary", """
WITH e AS (SELECT conv_id, turn, role, text, length(text) AS n FROM conversations), d AS (SELECT conv_id, md5(text) AS h, count(*) AS c FROM e GROUP BY 1, 2)
SELECT e.conv_id, min(turn) AS first_turn, max(turn) AS last_turn, max(turn) - min(turn) AS lasts, count(*) AS frames, count(DISTINCT role) AS cameras, CAST(sum(n) AS BIGINT) AS characters,
  any_value(x.sets) AS duplicate_sets, any_value(x.copies) AS near_identical_frames FROM e JOIN (SELECT conv_id, count(CASE WHEN c > 1 THEN 1 END) AS sets, CAST(coalesce(sum(CASE WHEN c > 1 THEN c END), 0) AS BIGINT) AS copies FROM d GROUP BY 1) x ON x.conv_id = e.conv_id GROUP BY e.conv_id""")
def moment_summary(t):
    """Conversations as moments: span, members, and sets of equal texts within each."""
    rows = t("conversations").select("conv_id", "turn", "role", F.length("text").alias("n"), F.md5("text").alias("h"))
    sets = rows.groupBy("conv_id", "h").agg(F.count(F.lit(1)).alias("c")).groupBy("conv_id").agg(F.count_if(F.col("c") > 1).alias("duplicate_sets"), F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).alias("near_identical_frames"))
    moments = rows.groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), (F.max("turn") - F.min("turn")).alias("lasts"), F.count(F.lit(1)).alias("frames"), F.countDistinct("role").alias("cameras"), F.sum("n").alias("characters"))
    return moments.join(sets, "conv_id")


@query("cull_chapters", """
SELECT o_custkey AS project, o_orderpriority AS chapter, count(*) AS delivered, round(avg(o_totalprice), 4) AS mean_score, epoch_us(min(o_orderdate)) AS first_us, epoch_us(max(o_orderdate)) AS last_us FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2""")
def cull_chapters(t):
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    kept = t("orders").where("o_orderstatus <> 'F'").groupBy(F.col("o_custkey").alias("project"), F.col("o_orderpriority").alias("chapter"))
    return kept.agg(F.count(F.lit(1)).alias("delivered"), F.round(F.avg("o_totalprice"), 4).alias("mean_score"), us(F.min("o_orderdate")).alias("first_us"), us(F.max("o_orderdate")).alias("last_us"))


@query("style_coverage", """
WITH b AS (SELECT p_brand, p_type, count(*) AS samples, max(p_retailprice) AS price, p_size % 2 = 0 AS leaf FROM part GROUP BY p_brand, p_type, p_size % 2)
SELECT p_brand, count(*) AS buckets, count(CASE WHEN leaf AND samples > 2 THEN 1 END) AS strong_buckets, count(CASE WHEN leaf AND samples BETWEEN 1 AND 2 THEN 1 END) AS weak_buckets, CAST(sum(samples) AS BIGINT) AS trained, max(price) AS worst FROM b GROUP BY 1""")
def style_coverage(t):
    """Brands as profiles, types and sizes as their buckets."""
    leaf = (F.col("p_size") % 2 == 0).alias("leaf")
    buckets = t("part").groupBy("p_brand", "p_type", leaf).agg(F.count(F.lit(1)).alias("samples"), F.max("p_retailprice").alias("price"))
    return buckets.groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("buckets"), F.count_if(F.col("leaf") & (F.col("samples") > 2)).alias("strong_buckets"), F.count_if(F.col("leaf") & F.col("samples").between(1, 2)).alias("weak_buckets"),
        F.sum("samples").alias("trained"), F.max("price").alias("worst"))
