"""Coverage, census and summary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalith.functions.columns import circular_distance, geometric_mean
from catalith.operators import aggregates as A
from catalith.plans.registry import query


@query("label_coverage", """
SELECT d.lang, count(*) AS documents, count(DISTINCT d.source) AS sources, count(l.doc_id) AS labelled,
  coalesce(sum(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END), 0)::BIGINT AS good, round(avg(l.quality), 6) AS mean_quality,
  coalesce(sum(d.n_chars), 0)::BIGINT AS characters
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.lang""")
def label_coverage(t):
    joined = t("documents").select("doc_id", "lang", "source", "n_chars").join(t("labels").withColumnRenamed("doc_id", "of"), F.col("doc_id") == F.col("of"), "left")
    return joined.groupBy("lang").agg(
        F.count(F.lit(1)).alias("documents"), F.countDistinct("source").alias("sources"), F.count("of").alias("labelled"),
        A.count_where(F.col("quality") == 1).alias("good"), F.round(F.avg("quality"), 6).alias("mean_quality"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("characters"))


@query("project_counts", """
SELECT o.o_orderstatus AS status, count(*) AS orders, coalesce(sum(l.n), 0)::BIGINT AS lines, round(coalesce(sum(l.q), 0), 2) AS quantity,
  count(l.n) AS with_lines
FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey GROUP BY 1""")
def project_counts(t):
    joined = A.pre_aggregated(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", t("lineitem"), "l_orderkey", [F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q")])
    return joined.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("orders"), F.coalesce(F.sum("n"), F.lit(0)).alias("lines"), F.round(F.coalesce(F.sum("q"), F.lit(0.0)), 2).alias("quantity"), F.count("n").alias("with_lines"))


FLAGS = {"bulk": 0, "discounted": 1, "taxed": 2, "returned": 3, "open": 4}
FLAG_SQL = "(CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END) + (CASE WHEN l_discount > 0.05 THEN 2 ELSE 0 END) + (CASE WHEN l_tax > 0.04 THEN 4 ELSE 0 END) + (CASE WHEN l_returnflag = 'R' THEN 8 ELSE 0 END) + (CASE WHEN l_linestatus = 'O' THEN 16 ELSE 0 END)"


@query("flag_counts", f"""
SELECT l_returnflag AS returnflag, {", ".join(f"count(CASE WHEN flags & {1 << b} <> 0 THEN 1 END) AS {n}" for n, b in FLAGS.items())}
FROM (SELECT l_returnflag, ({FLAG_SQL})::BIGINT AS flags FROM lineitem) GROUP BY 1""")
def flag_counts(t):
    rows = t("lineitem").select(F.col("l_returnflag").alias("returnflag"), F.expr(FLAG_SQL).cast("long").alias("flags"))
    return A.bit_counts(rows, ["returnflag"], "flags", FLAGS)


@query("json_interaction_counts", """
SELECT event_type, count(*) AS events, count(CASE WHEN k % 2 = 0 THEN 1 END) AS even, count(CASE WHEN k >= 50 THEN 1 END) AS upper_half, sum(k)::BIGINT AS total
FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1""")
def json_interaction_counts(t):
    rows = t("events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), A.count_where(F.col("k") % 2 == 0).alias("even"), A.count_where(F.col("k") >= 50).alias("upper_half"), F.sum("k").alias("total"))


@query("chapter_rollup", """
SELECT user_id, date_trunc('day', ts)::DATE::VARCHAR AS day, count(*) AS frames, count(DISTINCT event_type) AS scenes,
  (epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000)::BIGINT AS seconds, round(avg(value), 6) AS mean_value
FROM events GROUP BY 1, 2""")
def chapter_rollup(t):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    return t("events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("frames"), F.countDistinct("event_type").alias("scenes"), (F.floor(F.max(seconds)) - F.floor(F.min(seconds))).alias("seconds"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("version_census", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL")
def version_census(t):
    return A.census(t("lineitem"), "l_returnflag", "l_linestatus", "l_linenumber")


@query("state_census", "SELECT o_orderstatus, o_orderpriority, count(*) AS rows FROM orders GROUP BY ALL")
def state_census(t):
    return A.census(t("orders"), "o_orderstatus", "o_orderpriority")


@query("having_segments", """
SELECT count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS rows FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 12)""")
def having_segments(t):
    grouped = A.census(t("events"), "user_id", "event_type").where("rows >= 12")
    return grouped.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))


@query("identity_summary", """
WITH l AS (SELECT l_orderkey, count(*) AS lines, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned FROM lineitem GROUP BY 1),
o AS (SELECT o_custkey, count(*) AS orders, coalesce(sum(lines), 0) AS lines, coalesce(sum(returned), 0) AS returned, count(DISTINCT o_orderpriority) AS priorities,
  epoch_us(min(o_orderdate)) AS first_us, epoch_us(max(o_orderdate)) AS last_us, avg(o_totalprice) AS mean_price FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1)
SELECT c_custkey, coalesce(orders, 0) AS orders, coalesce(lines, 0)::BIGINT AS lines, coalesce(returned, 0)::BIGINT AS returned, coalesce(priorities, 0) AS priorities, first_us, last_us, round(mean_price, 4) AS mean_price
FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def identity_summary(t):
    lines = [F.count(F.lit(1)).alias("lines"), A.count_where(F.col("l_returnflag") == "R").alias("returned")]
    orders = A.pre_aggregated(t("orders"), "o_orderkey", t("lineitem"), "l_orderkey", lines)
    us = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    sums = [F.count(F.lit(1)).alias("orders"), F.sum("lines").alias("lines"), F.sum("returned").alias("returned"), F.countDistinct("o_orderpriority").alias("priorities"), F.min(us).alias("first_us"), F.max(us).alias("last_us"), F.round(F.avg("o_totalprice"), 4).alias("mean_price")]
    return A.pre_aggregated(t("customer").select("c_custkey"), "c_custkey", orders, "o_custkey", sums, {"orders": 0, "lines": 0, "returned": 0, "priorities": 0})


@query("storage_estimate", """
SELECT lang, count(*) AS documents, sum(strlen(text))::BIGINT AS bytes, sum(length(text))::BIGINT AS characters, max(length(text)) AS longest FROM documents GROUP BY 1""")
def storage_estimate(t):
    return t("documents").groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.sum(F.length("text").cast("long")).alias("characters"), F.max(F.length("text").cast("long")).alias("longest"))


@query("distinct_bodies", "SELECT DISTINCT trim(p_brand) || ' / ' || trim(p_type) AS body FROM part WHERE p_size > 0")
def distinct_bodies(t):
    return t("part").where("p_size > 0").select(F.concat_ws(" / ", F.trim("p_brand"), F.trim("p_type")).alias("body")).distinct()


@query("upper_median", "SELECT user_id, list_sort(list(value))[len(list(value)) // 2 + 1] AS median FROM events GROUP BY 1")
def upper_median(t):
    return A.ordered_element(t("events"), ["user_id"], "value", 1, 2, "median")


@query("upper_quartile", "SELECT event_type, list_sort(list(value))[len(list(value)) * 3 // 4 + 1] AS quartile FROM events GROUP BY 1")
def upper_quartile(t):
    return A.ordered_element(t("events"), ["event_type"], "value", 3, 4, "quartile")


@query("dominant_type", """
SELECT user_id, event_type, n, round(share, 6) AS share FROM (
  SELECT user_id, event_type, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS share,
    row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS i FROM events GROUP BY 1, 2) WHERE i = 1""")
def dominant_type(t):
    return A.dominant(t("events"), ["user_id"], "event_type").withColumn("share", F.round("share", 6))


@query("weighted_mean", "SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS mean_price FROM lineitem GROUP BY 1")
def weighted_mean(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.round(A.weighted_mean("l_extendedprice", "l_quantity"), 4).alias("mean_price"))


@query("keep_score_mean", """
SELECT l_linestatus, count(*) AS rows, round(avg(exp((0.5 * ln(greatest(l_quantity / 50, 0.02)) + 0.3 * ln(greatest(1 - l_discount, 0.02)) + 0.2 * ln(greatest(l_tax * 10, 0.02))) / 1.0)), 8) AS score
FROM lineitem GROUP BY 1""")
def keep_score_mean(t):
    score = geometric_mean([(F.col("l_quantity") / 50, 0.5), (1 - F.col("l_discount"), 0.3), (F.col("l_tax") * 10, 0.2)])
    return t("lineitem").groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(score), 8).alias("score"))


@query("counts_map", """
SELECT user_id, '{' || string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) || '}' AS counts
FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def counts_map(t):
    return A.counts_map(t("events"), "user_id", "event_type")


@query("group_digest", """
WITH l AS (SELECT o_orderstatus, o_orderkey, o_orderkey // 4096 AS part, concat_ws('|', o_orderkey, o_custkey, o_orderpriority, CAST(round(o_totalprice * 100) AS BIGINT)) AS line FROM orders),
p AS (SELECT o_orderstatus, part, sha256(string_agg(line, chr(10) ORDER BY o_orderkey, line)) AS line, count(*) AS n FROM l GROUP BY 1, 2)
SELECT o_orderstatus, sha256(string_agg(line, chr(10) ORDER BY part)) AS digest, CAST(sum(n) AS BIGINT) AS rows FROM p GROUP BY 1""")
def group_digest(t):
    """Equal digests: the same orders of a status, in the same order."""
    line = F.concat_ws("|", *[F.col(c).cast("string") for c in ("o_orderkey", "o_custkey", "o_orderpriority")], F.round(F.col("o_totalprice") * 100).cast("long").cast("string"))
    return A.ordered_digest(t("orders"), ["o_orderstatus"], "o_orderkey", line)


@query("group_max_normalised", """
SELECT c_custkey, round(c_acctbal / max(c_acctbal) OVER (PARTITION BY c_mktsegment), 6) AS relative FROM customer""")
def group_max_normalised(t):
    from pyspark.sql.window import Window as W

    return t("customer").select("c_custkey", F.round(F.col("c_acctbal") / F.max("c_acctbal").over(W.partitionBy("c_mktsegment")), 6).alias("relative"))


@query("framing_histogram", """
SELECT lang, count(CASE WHEN n_chars < 500 THEN 1 END) AS tight, count(CASE WHEN n_chars >= 500 AND n_chars < 3000 THEN 1 END) AS medium, count(CASE WHEN n_chars >= 3000 THEN 1 END) AS wide FROM documents GROUP BY 1""")
def framing_histogram(t):
    bucket = F.when(F.col("n_chars") < 500, "tight").when(F.col("n_chars") < 3000, "medium").otherwise("wide")
    return t("documents").select("lang", bucket.alias("framing")).groupBy("lang").pivot("framing", ["tight", "medium", "wide"]).count().fillna(0)


@query("histogram_percentiles", """
WITH h AS (SELECT event_type, least(floor(value), 255)::BIGINT AS bin, count(*) AS n FROM events GROUP BY 1, 2),
c AS (SELECT event_type, bin, sum(n) OVER (PARTITION BY event_type ORDER BY bin) AS c, sum(n) OVER (PARTITION BY event_type) AS total FROM h)
SELECT event_type, min(CASE WHEN c >= 0.05 * total THEN bin END) AS p5, min(CASE WHEN c >= 0.5 * total THEN bin END) AS p50, min(CASE WHEN c >= 0.95 * total THEN bin END) AS p95 FROM c GROUP BY 1""")
def histogram_percentiles(t):
    from pyspark.sql.window import Window as W

    bins = t("events").groupBy("event_type", F.least(F.floor("value"), F.lit(255)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    by = W.partitionBy("event_type")
    c = bins.withColumns({"c": F.sum("n").over(by.orderBy("bin")), "total": F.sum("n").over(by)})
    return c.groupBy("event_type").agg(*[F.min(F.when(F.col("c") >= F.lit(q) * F.col("total"), F.col("bin"))).alias(n) for n, q in (("p5", 0.05), ("p50", 0.5), ("p95", 0.95))])


@query("circular_hue", """
SELECT event_type, round(avg(least(abs(v - 300) % 360, 360 - abs(v - 300) % 360)), 6) AS hue FROM (SELECT event_type, value * 7 % 360 AS v FROM events) GROUP BY 1""")
def circular_hue(t):
    return t("events").groupBy("event_type").agg(F.round(F.avg(circular_distance(F.col("value") * 7 % 360, F.lit(300.0))), 6).alias("hue"))


@query("vector_centroid", """
SELECT label, round(sum(m * m), 5) AS norm2, round(max(m), 5) AS top FROM (
  SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1""")
def vector_centroid(t):
    from catalith.functions.columns import dot

    return A.vector_mean(t("embeddings"), "label", "embedding").select("label", F.round(dot("mean", "mean"), 5).alias("norm2"), F.round(F.array_max("mean"), 5).alias("top"))
