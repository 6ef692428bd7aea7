"""Streaming queries, drained; the SQL gives the same final state."""

from __future__ import annotations

from catalith.plans.registry import QUERIES, SQL
from catalith.streaming import sessions

QUERIES["stream_windows"] = lambda spark, sf_dir: sessions.windowed_counts(spark, f"{sf_dir}/events.parquet")
QUERIES["stream_sessions"] = lambda spark, sf_dir: sessions.fixed_sessions(spark, f"{sf_dir}/events.parquet")
QUERIES["stream_dedup"] = lambda spark, sf_dir: sessions.deduplicated(spark, f"{sf_dir}/events.parquet")

SQL["stream_windows"] = """
WITH e AS (SELECT epoch_ms(date_trunc('day', ts))::BIGINT AS start_ms, event_type, value FROM events), m AS (SELECT epoch_ms(max(ts)) - 172800000 AS w FROM events)
SELECT start_ms, event_type, count(*) AS events, round(sum(value), 4) AS value FROM e, m WHERE start_ms + 86400000 <= w GROUP BY 1, 2"""
SQL["stream_sessions"] = """
WITH e AS (SELECT user_id, epoch_us(ts) AS us FROM events), b AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) < 86400000000 THEN 0 ELSE 1 END AS new FROM e),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM b), m AS (SELECT (max(us) // 1000 - 172800000) AS w FROM e),
g AS (SELECT user_id, s, min(us) // 1000 AS start_ms, max(us) // 1000 + 86400000 AS end_ms, count(*) AS events FROM s GROUP BY 1, 2)
SELECT user_id, start_ms::BIGINT AS start_ms, events FROM g, m WHERE end_ms <= w"""
SQL["stream_dedup"] = "SELECT event_id, user_id FROM events"
