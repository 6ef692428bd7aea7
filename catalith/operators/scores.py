"""Nine features of a frame from its members, and two centres of a group's points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

#: What a milestone adds, how many expressive members are a full group, the
#: prominence of a member nobody knows, the intensity from which a member is expressive.
MILESTONE, FULL_GROUP, UNKNOWN, EXPRESSIVE = 1.25, 4.0, 0.35, 0.35
FEATURES = ("expression", "genuine", "interaction", "peak", "reaction", "mutual", "composure", "tears", "group_size")


def clamped(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def mixed(channels: list[str], weights: list[float], discomfort: str, penalty: float) -> Column:
    """Weighted mean of positive channels less half the weighted discomfort, 0 to 1."""
    total = sum((F.col(c) * w for c, w in zip(channels, weights, strict=True)), F.lit(0.0))
    return clamped(total / sum(weights) - F.col(discomfort) * penalty * 0.5)


def frame_features(frames: DataFrame, members: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """key and FEATURES. members: key, prominence (null: unknown), confidence, expression, genuine,
    smile, composed, tears, crying, intensity; frames: key, strength and milestone of the first
    interaction (null: none), peak, reaction, mutual. Members become sums, one row for each frame,
    before they meet it; a member counts by prominence and confidence."""
    weight = F.greatest(F.coalesce("prominence", F.lit(UNKNOWN)), F.lit(0.01)) * F.greatest("confidence", F.lit(0.05))
    sums = members.groupBy(key).agg(
        F.sum(weight).alias("_w"), *[F.sum(c * weight).alias(n) for n, c in (("_e", F.col("expression")), ("_g", F.col("genuine") * F.col("smile")), ("_c", F.col("composed")))],
        F.max(F.when(F.col("crying"), F.col("tears"))).alias("_t"), F.count_if(F.col("intensity") >= EXPRESSIVE).alias("_n"))
    both = frames.join(sums, key, "left")
    mean = lambda n: clamped(F.coalesce(F.col(n) / F.nullif("_w", F.lit(0.0)), F.lit(0.0)))
    w = lambda n: F.lit(weights.get(n, 1.0))
    features = (
        mean("_e"), mean("_g") * w("genuine"), F.coalesce(F.col("strength") * w("interaction") * F.when(F.col("milestone"), MILESTONE).otherwise(1.0), F.lit(0.0)),
        clamped(F.col("peak")) * w("peak"), clamped(F.col("reaction")) * w("reaction"), F.when(F.col("mutual"), w("mutual")).otherwise(0.0),
        mean("_c") * w("composure"), F.coalesce("_t", F.lit(0.0)) * w("tears"), F.coalesce("_n", F.lit(0)) / FULL_GROUP,
    )
    return both.select(key, *[clamped(f).alias(n) for n, f in zip(FEATURES, features, strict=True)])


def two_centres(rows: DataFrame, group: str, order: str, u: str, v: str, least: int = 8, rounds: int = 4) -> DataFrame:
    """group, n0, n1, u0, v0, u1, v1: points of a group around two centres, which start at its ends
    along the axis of the larger spread (of equal ones the first in order) and move to the means of
    the points nearer to them; a centre without points stays. Groups of fewer than `least` points
    have none. Each round is one aggregate."""
    p, q = F.col(u), F.col(v)
    wide = rows.groupBy(group).agg((F.max(q) - F.min(q) > F.max(p) - F.min(p)).alias("_axis"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    points = rows.select(group, order, u, v).join(wide.select(group, "_axis"), group)
    axis = F.when(F.col("_axis"), q).otherwise(p)
    low = F.min(F.struct(axis.alias("a"), F.col(order).alias("o"), p.alias("u"), q.alias("v"))).alias("low")
    high = F.min(F.struct((-axis).alias("a"), F.col(order).alias("o"), p.alias("u"), q.alias("v"))).alias("high")
    centres = points.groupBy(group).agg(low, high).select(group, F.col("low.u").alias("u0"), F.col("low.v").alias("v0"), F.col("high.u").alias("u1"), F.col("high.v").alias("v1"))
    far = lambda i: (p - F.col(f"u{i}")) ** 2 + (q - F.col(f"v{i}")) ** 2
    second = F.round(far(1), 12) < F.round(far(0), 12)
    for _ in range(rounds):
        sided = points.join(centres, group).withColumn("_s", second)
        mean = lambda c, s: F.avg(F.when(F.col("_s") == s, c))
        moved = sided.groupBy(group, "u0", "v0", "u1", "v1").agg(
            F.count_if(~F.col("_s")).alias("n0"), F.count_if("_s").alias("n1"), *[F.coalesce(mean(c, bool(i)), F.col(f"{n}{i}")).alias(f"_{n}{i}") for n, c in (("u", p), ("v", q)) for i in (0, 1)])
        counted = moved.select(group, "n0", "n1", *[F.col(f"_{n}{i}").alias(f"{n}{i}") for n in ("u", "v") for i in (0, 1)])
        centres = counted.drop("n0", "n1")
    return counted
