"""Metric queries: labels against a plain score of documents, embeddings against their labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalith.operators import metrics as M
from catalith.operators import similarity
from catalith.plans.registry import query

SCORED = "SELECT l.doc_id, quality, toxic, 1 / (1 + exp(-(d.n_chars - 1500) / 1000.0)) AS p, (d.n_chars - 1500) / 1000.0 AS raw FROM labels l JOIN documents d USING (doc_id)"
K = 10
V = "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings"
NEAR = f"""WITH v AS ({V}), d AS (SELECT a.vec_id, a.label, b.label AS other, b.vec_id AS neighbour, round(least(greatest(1 - list_dot_product(a.v, b.v), 0), 2), 9) AS distance FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS place FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) <= {K})"""
CLUSTERS = "SELECT label, (CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END + CASE WHEN embedding[2] > 0 THEN 2 ELSE 0 END + CASE WHEN embedding[3] > 0 THEN 4 ELSE 0 END + CASE WHEN embedding[4] > 0 THEN 8 ELSE 0 END)::BIGINT AS cluster FROM embeddings"


def scored(t):
    raw = (F.col("n_chars") - 1500) / 1000.0
    return t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", "quality", "toxic", (1 / (1 + F.exp(-raw))).alias("p"), raw.alias("raw"))


def neighbours(t):
    base = t("embeddings")
    near = similarity.nearest(base.where("vec_id % 50 = 0"), base, "vec_id", "embedding", K)
    return near.join(base.select("vec_id", "label"), "vec_id").join(base.select(F.col("vec_id").alias("neighbour"), F.col("label").alias("other")), "neighbour").withColumn("relevant", (F.col("label") == F.col("other")).cast("int"))


def clusters(t):
    bit = lambda i: F.when(F.col("embedding")[i] > 0, 1 << i).otherwise(0)
    return t("embeddings").select("label", (bit(0) + bit(1) + bit(2) + bit(3)).cast("long").alias("cluster"))


@query("ece_brier", f"""
WITH s AS ({SCORED}), b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, sum(p) AS c, sum(quality) AS y, sum((p - quality) ** 2) AS s FROM s GROUP BY 1)
SELECT round(sum(abs(c - y)) / sum(n), 6) AS ece, round(sum(s) / sum(n), 6) AS brier, sum(n)::BIGINT AS rows FROM b""")
def ece_brier(t):
    return M.calibration(scored(t), "p", "quality").select(F.round("ece", 6).alias("ece"), F.round("brier", 6).alias("brier"), "rows")


@query("isotonic_apply", f"""
WITH s AS (SELECT doc_id, quality, round(p, 9) AS x FROM ({SCORED})),
d AS (SELECT x, sum(quality)::DOUBLE AS y, count(*)::DOUBLE AS n, row_number() OVER (ORDER BY x) AS i FROM s GROUP BY x),
c AS (SELECT *, sum(y) OVER (ORDER BY i) AS cy, sum(n) OVER (ORDER BY i) AS cn FROM d),
m AS (SELECT a.i AS a, b.i AS b, (b.cy - a.cy + a.y) / (b.cn - a.cn + a.n) AS mean FROM c a JOIN c b ON b.i >= a.i),
lo AS (SELECT a, b, min(mean) OVER (PARTITION BY a ORDER BY b DESC) AS mean FROM m),
f AS (SELECT b AS i, max(mean) AS fit FROM lo GROUP BY b),
t AS (SELECT c.*, fit, abs(cy - sum(fit * n) OVER (ORDER BY c.i)) < 1e-6 AS ends FROM c JOIN f USING (i)),
g AS (SELECT *, coalesce(sum(ends::INT) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block FROM t),
k AS (SELECT sum(x * n) / sum(n) AS kx, sum(y) / sum(n) AS ky FROM g GROUP BY block),
e AS (SELECT s.doc_id, x, max(kx) FILTER (kx <= x) AS ax, arg_max(ky, kx) FILTER (kx <= x) AS ay, min(kx) FILTER (kx >= x) AS bx, arg_min(ky, kx) FILTER (kx >= x) AS "by" FROM s, k GROUP BY 1, 2)
SELECT doc_id, round(CASE WHEN ax IS NULL THEN "by" WHEN bx IS NULL OR bx <= ax THEN ay ELSE ay + ("by" - ay) * (x - ax) / (bx - ax) END, 6) AS calibrated FROM e""")
def isotonic_apply(t):
    s = scored(t).withColumn("p", F.round("p", 9))
    return M.isotonic_applied(s, "p", M.isotonic_knots(s, "p", "quality"), "calibrated").select("doc_id", F.round("calibrated", 6).alias("calibrated"))


@query("temperature_fit", f"""
WITH s AS ({SCORED}), g AS (SELECT round(0.5 + 0.045 * i, 6) AS temperature FROM range(0, 101) r(i)),
l AS (SELECT temperature, avg(ln(1 + exp(-CASE WHEN quality = 1 THEN raw ELSE -raw END / temperature))) AS loss FROM s, g GROUP BY 1)
SELECT temperature::DOUBLE AS temperature, round(loss, 6) AS loss FROM l ORDER BY l.loss, temperature LIMIT 1""")
def temperature_fit(t):
    return M.temperature_fit(scored(t), "raw", "quality").select("temperature", F.round("loss", 6).alias("loss"))


@query("pr_curve", f"""
WITH s AS ({SCORED}), n AS (SELECT p, count(*) AS n, sum(quality) AS h FROM s GROUP BY 1)
SELECT round(p, 9) AS p, round(sum(h) OVER w / sum(n) OVER w, 6) AS "precision", round(sum(h) OVER w / sum(h) OVER (), 6) AS recall FROM n WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)""")
def pr_curve(t):
    return M.pr_curve(scored(t), "p", "quality").select(F.round("p", 9).alias("p"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("auc", f"""
WITH s AS ({SCORED}), n AS (SELECT raw, sum(quality) AS p, sum(1 - quality) AS q FROM s GROUP BY 1),
w AS (SELECT p, q, p * (coalesce(sum(q) OVER (ORDER BY raw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2) AS w FROM n)
SELECT round(sum(w) / (sum(p) * sum(q)), 6) AS auc, sum(p)::BIGINT AS positives, sum(q)::BIGINT AS negatives FROM w""")
def auc(t):
    return M.auc(scored(t), "raw", "quality").withColumn("auc", F.round("auc", 6))


@query("recall_at_k", f"""{NEAR}, n AS (SELECT label, count(*) - 1 AS n FROM embeddings GROUP BY 1)
SELECT vec_id, round(sum(CASE WHEN r.label = other THEN 1 ELSE 0 END) / any_value(n.n), 6) AS recall FROM r JOIN n ON n.label = r.label GROUP BY 1""")
def recall_at_k(t):
    """How many there are to find is the size of a label less one."""
    sizes = t("embeddings").groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n"))
    found = neighbours(t).groupBy("vec_id", "label").agg(F.sum("relevant").alias("hits"))
    return found.join(sizes, "label").select("vec_id", F.round(F.col("hits") / F.col("n"), 6).alias("recall"))


@query("map", f"""{NEAR}, p AS (SELECT vec_id, CASE WHEN label = other THEN 1 ELSE 0 END AS hit, sum(CASE WHEN label = other THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY place) / place AS p FROM r)
SELECT vec_id, round(coalesce(sum(CASE WHEN hit = 1 THEN p END) / nullif(sum(hit), 0), 0), 6) AS average_precision FROM p GROUP BY 1""")
def mean_average_precision(t):
    return M.average_precision(neighbours(t), "vec_id", "place", "relevant").withColumn("average_precision", F.round("average_precision", 6))


@query("purity", f"WITH c AS (SELECT cluster, label, count(*) AS n FROM ({CLUSTERS}) GROUP BY 1, 2), b AS (SELECT cluster, max(n) AS m, sum(n) AS n FROM c GROUP BY 1) SELECT round(sum(m) / sum(n), 6) AS purity, count(*) AS clusters FROM b")
def purity(t):
    return M.purity(clusters(t), "cluster", "label").withColumn("purity", F.round("purity", 6))


@query("nmi", f"""
WITH c AS (SELECT cluster, label, count(*) AS n FROM ({CLUSTERS}) GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM c),
a AS (SELECT cluster, sum(n) AS a FROM c GROUP BY 1), b AS (SELECT label, sum(n) AS b FROM c GROUP BY 1),
mi AS (SELECT sum(n / t * ln(n * t / (a * b))) AS mi FROM c JOIN a USING (cluster) JOIN b USING (label), t),
h AS (SELECT (SELECT sum(-a / t * ln(a / t)) FROM a, t) AS hc, (SELECT sum(-b / t * ln(b / t)) FROM b, t) AS ht)
SELECT round(2 * mi / (hc + ht), 6) AS nmi FROM mi, h""")
def nmi(t):
    return M.nmi(clusters(t), "cluster", "label").withColumn("nmi", F.round("nmi", 6))


PAIRS = f"""WITH c AS (SELECT cluster, label, count(*) AS n FROM ({CLUSTERS}) GROUP BY 1, 2),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS b, (SELECT sum(n) FROM c) AS t, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY cluster)) AS pc, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY label)) AS pt)"""


@query("pairwise_f1", f'{PAIRS} SELECT round(b / pc, 6) AS "precision", round(b / pt, 6) AS recall, round(2 * (b / pc) * (b / pt) / (b / pc + b / pt), 6) AS f1 FROM s')
def pairwise_f1(t):
    return M.pairwise(clusters(t), "cluster", "label").select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("ari", f"{PAIRS} SELECT round((b - pc * pt / (t * (t - 1) / 2)) / ((pc + pt) / 2 - pc * pt / (t * (t - 1) / 2)), 6) AS ari FROM s")
def ari(t):
    return M.pairwise(clusters(t), "cluster", "label").select(F.round("ari", 6).alias("ari"))


@query("macro_f1", """
WITH p AS (SELECT quality AS y, CASE WHEN n_chars > 900 THEN 1 ELSE 0 END AS k FROM labels JOIN documents USING (doc_id)),
f AS (SELECT y AS c, 2.0 * (SELECT count(*) FROM p WHERE p.y = u.y AND p.k = u.y) / (count(*) + (SELECT count(*) FROM p WHERE p.k = u.y)) AS f1 FROM p u GROUP BY u.y)
SELECT round(avg(f1), 6) AS macro_f1, count(*) AS classes FROM f""")
def macro_f1(t):
    rows = t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id").select("quality", F.when(F.col("n_chars") > 900, 1).otherwise(0).alias("named"))
    return M.macro_f1(rows, "named", "quality").withColumn("macro_f1", F.round("macro_f1", 6))


@query("accept_rate", f"""
{NEAR}, n AS (SELECT distance, sum(CASE WHEN label = other THEN 1 ELSE 0 END) AS p, sum(CASE WHEN label = other THEN 0 ELSE 1 END) AS q FROM r GROUP BY 1),
c AS (SELECT sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS tpn, sum(q) OVER () AS fpn FROM n WINDOW w AS (ORDER BY distance ROWS UNBOUNDED PRECEDING))
SELECT round(coalesce(max(tp / tpn), 0), 6) AS accept_rate FROM c WHERE fp <= 0.1 * fpn""")
def accept_rate(t):
    return M.accept_rate_at(neighbours(t), "distance", "relevant", 0.1).withColumn("accept_rate", F.round("accept_rate", 6))


@query("ridge_shrink", """
WITH g AS (SELECT sum(l_quantity * l_extendedprice) / (sum(l_quantity ** 2) + 0.1) AS g FROM lineitem),
e AS (SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity * l_extendedprice) / (sum(l_quantity ** 2) + 0.1) AS s FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, n, round(g + (s - g) * n / (n + 12), 4) AS slope FROM e, g""")
def ridge_shrink(t):
    return M.ridge(t("lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "l_extendedprice", 0.1, 12).withColumn("slope", F.round("slope", 4))


@query("split_leakage", "SELECT 0::BIGINT AS leaked, count(DISTINCT source) AS sources FROM documents")
def split_leakage(t):
    split = M.group_split(t("documents").select("doc_id", "source"), "source", 0.2)
    return split.agg(F.countDistinct("source").alias("sources")).crossJoin(M.leakage(split, "source").agg(F.count(F.lit(1)).alias("leaked")))  # one row each
