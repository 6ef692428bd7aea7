"""Scalar functions over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalith.functions import columns as C
from catalith.plans.registry import query


@query("fast_key", "SELECT doc_id, source || ':' || lang || ':' || n_chars AS key FROM documents")
def fast_key(t):
    return t("documents").select("doc_id", F.concat_ws(":", "source", "lang", F.col("n_chars").cast("string")).alias("key"))


@query("stem", r"SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '[^/]*$'), '\.[^.]*$', ''), '\.[^.]*$', '') AS stem FROM pages")
def stem(t):
    return t("pages").select("page_id", C.path_stem(F.regexp_extract("url", "[^/]*$", 0)).alias("stem"))


@query("scrub", r"""SELECT doc_id, md5(regexp_replace(text, '\b(token|key|secret|password)(\s*[=:]\s*)"?[A-Za-z0-9_-]{8,}"?', '\1\2***', 'gi')) AS digest FROM documents""")
def scrub(t):
    return t("documents").select("doc_id", F.md5(C.scrub_secrets("text")).alias("digest"))


@query("numbers_in_text", r"SELECT doc_id, len(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?')) AS numbers, coalesce(list_transform(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?'), lambda x: CASE WHEN contains(x, '.') THEN rtrim(rtrim(x, '0'), '.') ELSE x END)[1], '') AS first FROM documents")
def numbers_in_text(t):
    n = C.numbers_in("text")
    return t("documents").select("doc_id", F.size(n).cast("long").alias("numbers"), F.coalesce(F.get(n, F.lit(0)), F.lit("")).alias("first"))


@query("grounded_summary", r"""
SELECT event_id, len(list_filter(list_transform(regexp_extract_all(props || event_id, '[0-9]+(?:\.[0-9]+)?'), lambda x: CASE WHEN contains(x, '.') THEN rtrim(rtrim(x, '0'), '.') ELSE x END), lambda y: NOT list_contains(list_transform(regexp_extract_all(props || ' ' || user_id, '[0-9]+(?:\.[0-9]+)?'), lambda x: CASE WHEN contains(x, '.') THEN rtrim(rtrim(x, '0'), '.') ELSE x END), y))) = 0 AS grounded FROM events""")
def grounded_summary(t):
    return t("events").select("event_id", C.grounded(F.concat("props", F.col("event_id").cast("string")), F.concat_ws(" ", "props", F.col("user_id").cast("string"))).alias("grounded"))


@query("rfc3339_ms", "SELECT event_id, epoch_us(ts) // 1000 AS ms, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS text FROM events")
def rfc3339_ms(t):
    at = F.col("ts").cast("timestamp")
    return t("events").select("event_id", F.unix_millis(at).alias("ms"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("text"))


@query("shifted_time", "SELECT event_id, epoch_us(ts + INTERVAL 90500 MILLISECOND) AS us FROM events")
def shifted_time(t):
    return t("events").select("event_id", F.unix_micros(F.expr("timestampadd(MILLISECOND, 90500, cast(ts as timestamp))")).alias("us"))


@query("canonical_hash", """SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_nationkey":' || c_nationkey || '}') AS digest FROM customer""")
def canonical_hash(t):
    return t("customer").select("c_custkey", C.canonical_hash(["c_nationkey", "c_mktsegment", "c_custkey"]).alias("digest"))


@query("round_half_up", "SELECT l_returnflag, sum(floor(l_quantity * l_discount + 0.5))::BIGINT AS units FROM lineitem GROUP BY 1")
def round_half_up(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.sum(C.round_half_up(F.col("l_quantity") * F.col("l_discount"))).alias("units"))


@query("set_jaccard", r"""
WITH w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS jaccard FROM w a JOIN w b ON b.item_id = a.item_id + 1""")
def set_jaccard(t):
    w = t("benchmark").select("item_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    near = w.select(F.col("item_id").alias("b"), F.col("w").alias("v")).withColumn("a", F.col("b") - 1)
    return w.withColumnRenamed("item_id", "a").join(near, "a").select("a", "b", F.round(C.jaccard("w", "v"), 6).alias("jaccard"))


@query("quantised", "SELECT vec_id, sum(least(greatest(round(x * 127), -127), 127))::BIGINT AS total, max(abs(x - least(greatest(round(x * 127), -127), 127) / 127)) <= 0.004 AS close FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1")
def quantised(t):
    x = F.transform("embedding", lambda v: v.cast("double"))
    q = F.transform(x, lambda v: C.quantised(v, 1 / 127))
    error = F.array_max(F.zip_with(x, q, lambda a, b: F.abs(a - b / 127)))
    return t("embeddings").select("vec_id", F.aggregate(q, F.lit(0).cast("long"), lambda s, v: s + v).alias("total"), (error <= 0.004).alias("close"))


@query("softmax_top", """
WITH e AS (SELECT vec_id, i, exp(x) AS e FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings))
SELECT vec_id, round(max(e) / sum(e), 6) AS top FROM e GROUP BY 1""")
def softmax_top(t):
    return t("embeddings").select("vec_id", F.round(F.array_max(C.softmax(F.transform("embedding", lambda v: v.cast("double")))), 6).alias("top"))
