"""Ranking, quotas and constrained selection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of a total order; give a unique last key."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def best_per_group(rows: DataFrame, group: list[str], order: list[Column], most: int = 1, place: str = "place") -> DataFrame:
    return rows.withColumn(place, F.row_number().over(W.partitionBy(*group).orderBy(*order)).cast("long")).where(F.col(place) <= most)


def keeper_count(size: Column, diversity: Column, significance: Column, most: int) -> Column:
    """How many of a group to keep: one, and up to most - 1 more by diversity and significance."""
    return F.least(size, 1 + F.floor((most - 1) * (0.65 * diversity + 0.35 * significance) + 0.5))


def keepers(rows: DataFrame, group: str, duplicate: str, score: str, key: str, count: Column) -> DataFrame:
    """Best rows of each group, at most `count` of them and one of each duplicate set."""
    one = best_per_group(rows, [group, duplicate], [F.desc(score), F.asc(key)], 1, "_d").drop("_d")
    ranked = one.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(F.desc(score), key)).cast("long"))
    return ranked.where(F.col("place") <= count)


def quotas(groups: DataFrame, volume: str, importance: str, target: int) -> DataFrame:
    """Shares of a target proportional to importance times the root of volume, rounded half up,
    at least one and at most the volume. `groups` is a summary with one row for each group."""
    weight = F.col(importance) * F.sqrt(F.col(volume))
    total = groups.agg(F.sum(weight).alias("_total"))
    return groups.crossJoin(F.broadcast(total)).withColumn("quota", F.least(F.col(volume), F.greatest(F.lit(1), F.floor(target * weight / F.col("_total") + 0.5))).cast("long")).drop("_total")


def within_quota(rows: DataFrame, group: str, score: str, key: str, quota: DataFrame) -> DataFrame:
    ranked = rows.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(F.desc(score), key)).cast("long"))
    return ranked.join(quota.select(group, "quota"), group).where("place <= quota")


def target_rate(mean: Column, upper: Column, per_hour: Column, chapters: Column) -> Column:
    """A clamped linear predictor of the share to keep."""
    clip = lambda x, a, b: F.least(F.greatest(x, F.lit(a)), F.lit(b))
    rate = 0.30 + 0.18 * (mean - 0.5) + 0.10 * (upper - 0.6) - 0.06 * clip((per_hour - 4) / 4, -1.0, 2.0) + 0.04 * clip((chapters - 5) / 4, -1.0, 1.0)
    return clip(rate, 0.22, 0.38)


def enforce_coverage(selected: DataFrame, rows: DataFrame, rule: str, least: int, score: str, key: str) -> DataFrame:
    """Selected rows, and for each rule that has fewer than `least` of them its best others."""
    have = selected.groupBy(rule).agg(F.count(F.lit(1)).alias("_have"))
    rest = rows.join(selected.select(key), key, "left_anti").join(have, rule, "left").withColumn("_short", least - F.coalesce("_have", F.lit(0)))
    add = rest.where("_short > 0").withColumn("_i", F.row_number().over(W.partitionBy(rule).orderBy(F.desc(score), key))).where("_i <= _short")
    return selected.select(rows.columns).withColumn("forced", F.lit(False)).unionByName(add.select(rows.columns).withColumn("forced", F.lit(True)))


def coverage_state(rows: DataFrame, selected: DataFrame, rule: str, least: int) -> DataFrame:
    """covered, weak or missing for every rule value that occurs in rows."""
    have = selected.groupBy(rule).agg(F.count(F.lit(1)).alias("kept"))
    out = rows.select(rule).distinct().join(have, rule, "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    return out.withColumn("state", F.when(F.col("kept") >= least, "covered").when(F.col("kept") > 0, "weak").otherwise("missing"))


def density_capped(rows: DataFrame, group: str, at: str, score: str, key: str, reach: int, most: int) -> DataFrame:
    """Greedy by score: a row stays if fewer than `most` rows that stay lie within `reach` of
    it. Groups are cut where no two neighbours are within reach, as rows on the two sides
    can't meet; a call gets some such stretches of a group."""
    order = W.partitionBy(group).orderBy(at, key)
    gap = F.col(at) - F.lag(at).over(order)
    stretched = rows.withColumn("_new", F.when(gap.isNull() | (gap > reach), 1).otherwise(0)).withColumn("_stretch", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = []
        for r in pdf.sort_values([score, key], ascending=[False, True]).itertuples(index=False):
            t = getattr(r, at)
            if sum(abs(t - x) <= reach for x, _ in kept) < most:
                kept.append((t, getattr(r, key)))
        return pdf[pdf[key].isin([k for _, k in kept])][[group, key]]

    kinds = dict(rows.dtypes)
    stretched = stretched.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(group, "_stretch")))
    free = stretched.where(F.col("_n") <= most).select(group, key)  # too few to meet the cap
    return free.unionByName(stretched.where(F.col("_n") > most).select(group, F.floor(F.col("_stretch") / 64).alias("_some"), at, score, key).groupBy(group, "_some").applyInPandas(one, f"{group} {kinds[group]}, {key} {kinds[key]}"))


def evicted(rows: DataFrame, group: list[str], order: list[str], size: str, budget: float) -> DataFrame:
    """Oldest rows that go until the rest fits the budget."""
    w = W.partitionBy(*group)
    after = F.sum(size).over(w) - (F.sum(size).over(w.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - F.col(size))
    return rows.withColumn("_before", after).where(F.col("_before") > budget).drop("_before")
