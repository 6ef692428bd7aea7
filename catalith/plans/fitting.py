"""Fits over a hierarchy as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalith.operators import levels as L
from catalith.plans.registry import query


def _level(name: str, rows: str, by: str) -> str:
    """SQL of one level with one feature: two weighted ridges with Huber weights in between."""
    ridge = lambda n, src: f"""{n} AS (SELECT {by}, target, (c * p - b * q) / (a * c - b * b) AS i0, (a * q - b * p) / (a * c - b * b) AS s0 FROM (
  SELECT {by}, target, sum(w) + 1e-6 AS a, sum(w * x) AS b, sum(w * x * x) + 0.1 AS c, sum(w * y) AS p, sum(w * x * y) AS q FROM {src} GROUP BY ALL))"""  # noqa: E731
    return f"""{ridge(name + "1", rows)},
{name}r AS (SELECT s.*, abs(y - i0 - s0 * x) AS r FROM {rows} s JOIN {name}1 USING ({by}, target)),
{name}m AS (SELECT {by}, target, greatest(1.4826 * r, 1e-4) AS spread FROM (SELECT {by}, target, r, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY {by}, target) // 2 AS h FROM {name}r WINDOW o AS (PARTITION BY {by}, target ORDER BY r)) WHERE i = h),
{name}w AS (SELECT r.* REPLACE (w * CASE WHEN r / spread <= 1.345 THEN 1 ELSE 1.345 * spread / r END AS w) FROM {name}r r JOIN {name}m USING ({by}, target)),
{ridge(name + "2", name + "w")},
{name}n AS (SELECT {by}, count(*) AS samples FROM s GROUP BY ALL)"""


def _fitted(name: str, number: int, by: str, of: str, prior: int) -> str:
    return f"SELECT {number} AS level, {of} AS of, target, samples, round(i0, 6) + 0.0 AS raw, round(samples / (samples + {prior}), 6) AS shrink, round(i0 * samples / (samples + {prior}), 6) + 0.0 AS fitted FROM {name}2 JOIN {name}n USING ({by})"


def _left(name: str, rows: str, by: str, prior: int) -> str:
    """The rows with what a level fitted taken off."""
    return f"SELECT r.* REPLACE (y - i0 * samples / (samples + {prior}) AS y) FROM {rows} r JOIN {name}2 USING ({by}, target) JOIN {name}n USING ({by})"


@query("style_levels", f"""
WITH s AS (SELECT 0 AS g0, l_returnflag AS g1, l_linestatus AS g2, l_linenumber AS archive, (l_quantity - 25) / 25 AS x, l_extendedprice / 10000 AS t0, l_discount * 10 AS t1, CASE WHEN l_linestatus = 'O' THEN l_tax * 10 END AS t2 FROM lineitem),
c AS (SELECT archive, count(*) AS n, sum(count(*)) OVER () AS every, greatest(0.35, 1 / count(*) OVER ()) AS cap FROM s GROUP BY 1),
v AS (SELECT archive, CASE WHEN n / every > cap + 1e-6 AND cap < 1 THEN least(1.0, cap * (every - n) / ((1 - cap) * n)) ELSE 1.0 END AS w FROM c),
d AS (SELECT g0, g1, g2, x, w, unnest([0, 1, 2]) AS target, unnest([t0, t1, t2]) AS y FROM s JOIN v USING (archive)),
a AS (SELECT * FROM d WHERE y IS NOT NULL), {_level("ga", "a", "g0")},
b AS ({_left("ga", "a", "g0", 40)}), {_level("gb", "b", "g1")},
e AS ({_left("gb", "b", "g1", 12)}), {_level("gc", "e", "g1, g2")}
{_fitted("ga", 0, "g0", "''", 40)} UNION ALL {_fitted("gb", 1, "g1", "g1", 12)} UNION ALL {_fitted("gc", 2, "g1, g2", "g1 || '/' || g2", 12)}""")
def style_levels(t):
    """Three targets, the third only known for one status; line numbers are archives."""
    rows = t("lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    targets = [F.col("l_extendedprice") / 10000, F.col("l_discount") * 10, F.when(F.col("l_linestatus") == "O", F.col("l_tax") * 10)]
    fit = L.fitted_levels(rows, [[], ["l_returnflag"], ["l_returnflag", "l_linestatus"]], "l_linenumber", [(F.col("l_quantity") - 25) / 25], targets, [40.0, 12.0, 12.0])
    return fit.select("level", "of", "target", "samples", *[(F.round(c, 6) + 0.0).alias(c) for c in ("raw", "shrink", "fitted")])


@query("upper_median_spread", """
SELECT event_type, value AS median FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) // 2 AS h FROM events) WHERE i = h""")
def upper_median_spread(t):
    """Upper medians of whole kinds without a sort of any of them."""
    return L.upper_medians(t("events").select("event_type", "value"), ["event_type"], "value")
