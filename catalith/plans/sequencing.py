"""Window and sequence queries over each user's events; times in hours where the data is sparse."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from catalith.functions.columns import neutral_percent_rank
from catalith.operators import sequences as S
from catalith.plans.joining import HOUR, timed
from catalith.plans.registry import query

E = "SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us FROM events"
CADENCE = f"""
WITH e AS ({E}), g AS (SELECT *, greatest(lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) - us, 0) AS gap FROM e),
l AS (SELECT *, list(gap) FILTER (gap IS NOT NULL) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 86400000000 FOLLOWING) AS gs FROM g),
c AS (SELECT *, least(greatest(CASE WHEN len(gs) > 0 THEN list_sort(gs)[len(gs) // 2 + 1] * 2.5 ELSE 172800000000.0 END, 3600000000.0), 172800000000.0) AS w FROM l)"""


@query("within_group_rank", f"""
WITH e AS ({E}) SELECT event_id, round(CASE WHEN count(*) OVER (PARTITION BY user_id, event_type) = 1 THEN 0.5 ELSE percent_rank() OVER (PARTITION BY user_id, event_type ORDER BY value) END, 6) AS standing FROM e""")
def within_group_rank(t):
    return t("events").select("event_id", F.round(neutral_percent_rank(["user_id", "event_type"], [F.col("value")]), 6).alias("standing"))


@query("rolling_median_cadence", f"{CADENCE} SELECT event_id, round(w / 1000000, 3) AS seconds FROM c")
def rolling_median_cadence(t):
    c = S.cadence_windows(timed(t("events")), "user_id", "us", "event_id", 24 * HOUR, 2.5, 1.0 * HOUR, 48.0 * HOUR)
    return c.select("event_id", F.round(F.col("window") / 1_000_000, 3).alias("seconds"))


@query("burst_sessions", f"""
{CADENCE}, b AS (SELECT *, CASE WHEN lag(us) OVER o IS NULL OR us - lag(us) OVER o > lag(w) OVER o THEN 1 ELSE 0 END AS new FROM c WINDOW o AS (PARTITION BY user_id ORDER BY us, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id) AS session FROM b)
SELECT user_id, session::BIGINT AS session, count(*) AS events, (max(us) - min(us))::BIGINT AS span FROM s GROUP BY 1, 2""")
def burst_sessions(t):
    c = S.cadence_windows(timed(t("events")), "user_id", "us", "event_id", 24 * HOUR, 2.5, 1.0 * HOUR, 48.0 * HOUR).drop("gap")
    c = c.withColumn("before", F.lag("window").over(W.partitionBy("user_id").orderBy("us", "event_id")))
    s = S.sessions(c, "user_id", "us", "event_id", F.col("gap") > F.col("before"))
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("events"), (F.max("us") - F.min("us")).alias("span"))


@query("gaps_islands", f"""
WITH e AS ({E}), b AS (SELECT *, CASE WHEN lag(us) OVER o IS NULL OR us - lag(us) OVER o >= 172800000000 THEN 1 ELSE 0 END AS new FROM e WINDOW o AS (PARTITION BY user_id ORDER BY us, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id) AS session FROM b)
SELECT user_id, session::BIGINT AS session, min(us) AS first, max(us) AS last, count(*) AS rows FROM s GROUP BY 1, 2""")
def gaps_islands(t):
    return S.islands(timed(t("events")), "user_id", "us", "event_id", 48 * HOUR)


@query("kernel_smooth", f"""
WITH e AS ({E}) SELECT event_id, round(CASE WHEN count(*) OVER (PARTITION BY user_id) < 3 THEN value
  ELSE 0.25 * coalesce(lag(value) OVER o, lead(value) OVER o) + 0.5 * value + 0.25 * coalesce(lead(value) OVER o, lag(value) OVER o) END, 6) AS smooth
FROM e WINDOW o AS (PARTITION BY user_id ORDER BY us, event_id)""")
def kernel_smooth(t):
    return S.smoothed(timed(t("events")), "user_id", "us", "event_id", "value").select("event_id", F.round("smooth", 6).alias("smooth"))


@query("peak_margin", f"""
WITH e AS ({E}), r AS (SELECT *, row_number() OVER o AS i, lead(value) OVER o AS second FROM e WINDOW o AS (PARTITION BY user_id ORDER BY value DESC, event_id))
SELECT user_id, event_id, round(CASE WHEN second IS NULL THEN 1.0 WHEN value > 0 THEN (value - second) / value ELSE 0 END, 6) AS margin FROM r WHERE i = 1""")
def peak_margin(t):
    return S.peaks(t("events"), "user_id", "value", "event_id").select("user_id", "event_id", F.round("margin", 6).alias("margin"))


@query("change_signal", f"""
WITH e AS ({E}), g AS (SELECT *, (us - lag(us) OVER o) / 1e6 AS gap, abs(value - lag(value) OVER o) AS dv, CASE WHEN event_type <> lag(event_type) OVER o THEN 1.0 ELSE 0.0 END AS dk
  FROM e WINDOW o AS (PARTITION BY user_id ORDER BY us, event_id))
SELECT event_id, round(CASE WHEN gap IS NULL THEN 0 ELSE 0.5 * dv / 100 / sqrt(greatest(gap, 1.0)) + 0.35 * dk + 0.15 * least(ln(1 + gap) / 12.0, 1.0) END, 6) AS signal FROM g""")
def change_signal(t):
    return S.change_signal(timed(t("events")), "user_id", "us", "event_id", "value", "event_type").select("event_id", F.round("signal", 6).alias("signal"))


@query("sequence_number", """
SELECT o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) + coalesce((SELECT max(p_size) FROM part), 0))::BIGINT AS seq FROM orders""")
def sequence_number(t):
    start = t("part").agg(F.coalesce(F.max("p_size"), F.lit(0)).alias("base"))
    rows = t("orders").crossJoin(F.broadcast(start))  # one row
    return rows.select("o_orderkey", (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) + F.col("base")).cast("long").alias("seq"))


@query("running_budget", """
SELECT o_orderkey, round(least(1.0, greatest(0.0, (1000000 - (sum(o_totalprice) OVER w - o_totalprice)) / o_totalprice)), 6) AS granted
FROM orders WHERE o_totalprice > 0 WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey ROWS UNBOUNDED PRECEDING)""")
def running_budget(t):
    from catalith.operators.decisions import granted

    return granted(t("orders").where("o_totalprice > 0"), ["o_custkey"], ["o_orderpriority", "o_orderkey"], "o_totalprice", 1_000_000.0).select("o_orderkey", F.round("granted", 6).alias("granted"))


STATES = ["signup", "view", "click", "purchase", "error"]
TRANSITION = S.fine(S.chain_transition(len(STATES))).tolist()
SEEN = S.fine(np.log([(1 - 0.6) / (len(STATES) - 1), 0.6])).tolist()


@query("viterbi_smooth", f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, list_position({STATES}, event_type) AS o, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS i FROM events),
m AS (SELECT {TRANSITION} AS t),
f AS (SELECT user_id, event_id, i, list_transform([1, 2, 3, 4, 5], lambda j: CASE WHEN j = o THEN {SEEN[1]} ELSE {SEEN[0]} END::BIGINT) AS s, [0, 0, 0, 0, 0]::BIGINT[] AS back FROM e WHERE i = 1
UNION ALL SELECT e.user_id, e.event_id, e.i, list_transform([1, 2, 3, 4, 5], lambda j: list_max(list_transform([1, 2, 3, 4, 5], lambda k: f.s[k] + t[k][j])) + CASE WHEN j = o THEN {SEEN[1]} ELSE {SEEN[0]} END)::BIGINT[],
  list_transform([1, 2, 3, 4, 5], lambda j: list_position(list_transform([1, 2, 3, 4, 5], lambda k: f.s[k] + t[k][j]), list_max(list_transform([1, 2, 3, 4, 5], lambda k: f.s[k] + t[k][j]))))::BIGINT[]
  FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1, m),
w AS MATERIALIZED (SELECT * FROM f),
b AS (SELECT user_id, event_id, i, back, list_position(s, list_max(s))::BIGINT AS state FROM w QUALIFY i = max(i) OVER (PARTITION BY user_id)
UNION ALL SELECT w.user_id, w.event_id, w.i, w.back, b.back[b.state] FROM b JOIN w ON w.user_id = b.user_id AND w.i = b.i - 1)
SELECT user_id, event_id, {STATES}[state] AS smoothed FROM b""")
def viterbi_smooth(t):
    return S.viterbi_smoothed(timed(t("events")), "user_id", "us", "event_id", "event_type", STATES)


@query("pelt_segments")
def pelt_segments(t):
    signal = S.change_signal(timed(t("events")), "user_id", "us", "event_id", "value", "event_type")
    return S.segmented(signal, "user_id", "us", "event_id", "signal", 6, 20)
