"""Decisions over measured features: budgets, abstention, trimmed centres, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W


def granted(rows: DataFrame, group: list[str], priority: list[str], cost: str, budget: float) -> DataFrame:
    """In order of priority each row gets min(cost, what is left), as a share of its cost."""
    w = W.partitionBy(*group).orderBy(*priority).rowsBetween(W.unboundedPreceding, 0)
    left = F.lit(budget) - (F.sum(cost).over(w) - F.col(cost))
    return rows.withColumn("granted", F.least(F.lit(1.0), F.greatest(F.lit(0.0), left / F.col(cost))))


def top_with_abstention(values: dict[str, Column], floor: float, margin: float) -> tuple[Column, Column]:
    """(label, top three as text): the best of named scores if it reaches the floor and leads
    by the margin, else "unknown". Ties go to the name given first."""
    ranked = F.reverse(F.array_sort(F.array(*[F.struct(v.alias("v"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, (n, v) in enumerate(values.items())])))
    lead = ranked[0]["v"] - ranked[1]["v"]
    label = F.when((ranked[0]["v"] >= floor) & (lead >= margin), ranked[0]["n"]).otherwise("unknown")
    return label, F.array_join(F.transform(F.slice(ranked, 1, 3), lambda s: s["n"]), ",")


def trimmed_centre(rows: DataFrame, key: str, x: str, y: str, weight: str, least: int, sigma: float = 2.0) -> DataFrame:
    """Two-pass weighted centre of each key: rows further from the first centre than sigma
    times the weighted mean distance are dropped and the centre is taken again; where fewer
    than `least` rows would stay, none is dropped."""
    w = W.partitionBy(key)
    mean = lambda c, use: F.sum(F.when(use, F.col(c) * F.col(weight))).over(w) / F.sum(F.when(use, F.col(weight))).over(w)
    everyone = F.lit(True)
    one = rows.withColumns({"_cx": mean(x, everyone), "_cy": mean(y, everyone)})
    one = one.withColumn("_d", F.sqrt((F.col(x) - F.col("_cx")) ** 2 + (F.col(y) - F.col("_cy")) ** 2))
    one = one.withColumn("_mean", mean("_d", everyone))
    one = one.withColumn("_in", F.col("_d") <= sigma * F.col("_mean"))
    one = one.withColumn("_in", F.when(F.sum(F.col("_in").cast("int")).over(w) >= least, F.col("_in")).otherwise(True))
    kept = one.where("_in")
    weighted = lambda c: F.sum(F.col(c) * F.col(weight)) / F.sum(weight)
    return kept.groupBy(key).agg(weighted(x).alias("x"), weighted(y).alias("y"), F.count(F.lit(1)).alias("kept"))


def median_anchored(rows: DataFrame, group: str, at: str, key: str, quality: str, penalty: float, least: int, most: int) -> DataFrame:
    """Reference rows of each group: the best by quality less a penalty for distance (in units
    of the group's span) from the group's upper-median time; none for groups under `least`."""
    w, order = W.partitionBy(group), W.partitionBy(group).orderBy(at, key)
    n = rows.withColumns({"_n": F.count(F.lit(1)).over(w), "_i": F.row_number().over(order), "_span": F.greatest(F.max(at).over(w) - F.min(at).over(w), F.lit(1))})
    n = n.withColumn("_median", F.max(F.when(F.col("_i") == F.floor(F.col("_n") / 2) + 1, F.col(at))).over(w))
    n = n.withColumn("anchored", F.col(quality) * (1 - penalty * F.abs(F.col(at) - F.col("_median")) / F.col("_span")))
    ranked = n.withColumn("place", F.row_number().over(w.orderBy(F.desc("anchored"), key)))
    return ranked.where((F.col("place") <= most) & (F.col("_n") >= least)).select(group, key, "anchored", "place")


def shrunk(rows: DataFrame, parent: list[str], child: list[str], value: str, parent_prior: float, child_prior: float) -> DataFrame:
    """Hierarchical shrinkage of group means: the parent's mean towards the global one, the
    child's residual towards the parent, by n / (n + prior)."""
    total = rows.agg(F.avg(value).alias("_g"))
    p = rows.groupBy(*parent).agg(F.avg(value).alias("_p"), F.count(F.lit(1)).alias("_pn"))
    c = rows.groupBy(*child).agg(F.avg(value).alias("_c"), F.count(F.lit(1)).alias("n"))
    joined = c.join(p, parent).crossJoin(F.broadcast(total))  # one row
    up = F.col("_g") + (F.col("_p") - F.col("_g")) * F.col("_pn") / (F.col("_pn") + parent_prior)
    return joined.withColumn("estimate", up + (F.col("_c") - up) * F.col("n") / (F.col("n") + child_prior)).select(*child, "n", "estimate")


def priority_flags(names: dict[str, Column]) -> Column:
    """A bit for each condition that holds, in the order given."""
    out = F.lit(0).cast("long")
    for i, condition in enumerate(names.values()):
        out = out + F.when(condition, 1 << i).otherwise(0)
    return out
