"""Incremental queries: halves of a table stand for what was there and what is new."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalith.operators import incremental as I
from catalith.plans.registry import query


def halves(t):
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 3 <> 1").withColumns({"o_totalprice": F.round(F.col("o_totalprice") * 2, 2), "o_orderstatus": F.lit("N")})


OLD = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0"
NEW = "SELECT o_orderkey, o_custkey, 'N' AS o_orderstatus, round(o_totalprice * 2, 2) AS o_totalprice FROM orders WHERE o_orderkey % 3 <> 1"


@query("upsert_merge", f"""
WITH o AS ({OLD}), n AS ({NEW})
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n)
UNION ALL SELECT n.o_orderkey, n.o_custkey, CASE WHEN o.o_orderstatus = 'F' THEN 'F' ELSE 'N' END, n.o_totalprice FROM n LEFT JOIN o ON o.o_orderkey = n.o_orderkey""")
def upsert_merge(t):
    old, new = halves(t)
    return I.upsert(old, new, "o_orderkey", {"o_orderstatus": F.coalesce(F.col("old_o_orderstatus") == "F", F.lit(False))})


@query("insert_absent", f"WITH o AS ({OLD}), n AS ({NEW}) SELECT * FROM o UNION ALL SELECT * FROM n WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o)")
def insert_absent(t):
    return I.insert_absent(*halves(t), "o_orderkey")


@query("locked_rebuild", f"""
WITH o AS ({OLD}), n AS ({NEW}), k AS (SELECT *, o_custkey % 5 = 0 AS locked FROM o WHERE o_custkey % 5 = 0)
SELECT * FROM k UNION ALL SELECT *, false FROM n WHERE o_orderkey NOT IN (SELECT o_orderkey FROM k)""")
def locked_rebuild(t):
    old, new = halves(t)
    return I.locked_rebuild(old.withColumn("locked", F.col("o_custkey") % 5 == 0), new.withColumn("locked", F.lit(False)), "o_orderkey", "locked")


@query("incremental_skip", """
WITH m AS (SELECT doc_id, n_chars + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS k FROM documents WHERE doc_id % 4 <> 0)
SELECT CASE WHEN m.doc_id IS NULL THEN 'process' WHEN k = n_chars THEN 'skip' ELSE 'touch' END AS action, count(*) AS files FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id GROUP BY 1""")
def incremental_skip(t):
    d = t("documents").select("doc_id", "n_chars")
    manifest = d.where("doc_id % 4 <> 0").withColumn("n_chars", F.col("n_chars") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0))
    return I.work_list(d, manifest, "doc_id", "n_chars").groupBy("action").agg(F.count(F.lit(1)).alias("files"))


@query("mark_absent", "SELECT c_custkey, c_custkey NOT IN (SELECT o_custkey FROM orders) AS absent FROM customer")
def mark_absent(t):
    return I.mark_absent(t("customer").select("c_custkey"), t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


LEDGER = "SELECT event_id, user_id, value, CASE WHEN event_id % 3 = 0 THEN event_id - 1 END AS supersedes FROM events"


def ledger(t):
    return t("events").select("event_id", "user_id", "value", F.when(F.col("event_id") % 3 == 0, F.col("event_id") - 1).alias("supersedes"))


@query("supersede_current", f"WITH l AS ({LEDGER}) SELECT user_id, count(*) AS current FROM l WHERE event_id NOT IN (SELECT supersedes FROM l WHERE supersedes IS NOT NULL) GROUP BY 1")
def supersede_current(t):
    return I.current(ledger(t), "event_id", "supersedes").groupBy("user_id").agg(F.count(F.lit(1)).alias("current"))


@query("ledger_compaction", f"WITH l AS ({LEDGER}) SELECT event_id FROM l WHERE NOT (event_id IN (SELECT supersedes FROM l WHERE supersedes IS NOT NULL) AND NOT value > 90 AND event_id < 500)")
def ledger_compaction(t):
    return I.compacted(ledger(t), "event_id", "supersedes", F.col("value") > 90, F.col("event_id") < 500).select("event_id")


@query("history_trim", "SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def history_trim(t):
    return I.trimmed_history(t("conversations"), ["conv_id"], [F.desc("turn")], 3).select("conv_id", "turn")


@query("latest_state", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_state(t):
    return I.latest(t("events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("quarantine", """
WITH k AS (SELECT user_id, count(*) AS attempts FROM events WHERE event_type = 'error' AND event_id % 2 = 0 GROUP BY 1), f AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' AND event_id % 2 = 1 GROUP BY 1)
SELECT coalesce(k.user_id, f.user_id) AS user_id, (coalesce(attempts, 0) + coalesce(n, 0))::BIGINT AS attempts, CASE WHEN coalesce(attempts, 0) + coalesce(n, 0) > 12 THEN 'quarantined' ELSE 'retry' END AS state FROM k FULL JOIN f ON k.user_id = f.user_id""")
def quarantine(t):
    errors = t("events").where("event_type = 'error'")
    known = errors.where("event_id % 2 = 0").groupBy("user_id").agg(F.count(F.lit(1)).alias("attempts"))
    return I.quarantined(errors.where("event_id % 2 = 1"), known, "user_id", 12)


@query("lease_reclaim", """
SELECT CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-01-01' THEN 'ready' WHEN o_orderstatus = 'O' THEN 'running' ELSE 'done' END AS state, count(*) AS tasks FROM orders GROUP BY 1""")
def lease_reclaim(t):
    tasks = t("orders").select(F.when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("state"), F.col("o_orderdate").alias("expires"))
    return I.reclaimed(tasks, "state", "expires", F.lit("1996-01-01 00:00:00").cast("timestamp_ntz")).groupBy("state").agg(F.count(F.lit(1)).alias("tasks"))


@query("job_claim", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 20")
def job_claim(t):
    tasks = t("orders").withColumn("state", F.when(F.col("o_orderstatus") == "O", "ready").otherwise("done"))
    return I.claim(tasks, "state", [F.asc("o_orderpriority"), F.asc("o_orderdate"), F.asc("o_orderkey")], 20).select("o_orderkey", "o_orderpriority")


@query("cascade_erase", """
WITH e AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
SELECT (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM e)) AS orders, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM e)) AS customers""")
def cascade_erase(t):
    left = I.cascade({"orders": (t("orders"), "o_custkey"), "customers": (t("customer"), "c_custkey")}, t("customer").where("c_acctbal < 0"), "c_custkey")
    one = [df.agg(F.count(F.lit(1)).alias(name)) for name, df in left.items()]
    return one[0].crossJoin(one[1])  # one row each


@query("field_merge", """
SELECT c_custkey, 'segment=' || CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment WHEN c_custkey % 2 = 0 THEN 'NEW' ELSE c_mktsegment END || ',nation=' || c_nationkey AS fields FROM customer""")
def field_merge(t):
    c = t("customer")
    base = c.select("c_custkey", F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("segment"), "c_mktsegment").alias("fields"), F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit("segment"))).otherwise(F.array().cast("array<string>")).alias("locked"))
    change = c.where("c_custkey % 2 = 0").select("c_custkey", F.create_map(F.lit("segment"), F.lit("NEW")).alias("fields"))
    merged = I.merged_fields(base, change, "c_custkey", "fields", "locked")
    return merged.select("c_custkey", F.concat(F.lit("segment="), F.col("fields")["segment"], F.lit(",nation="), F.col("fields")["nation"]).alias("fields"))
