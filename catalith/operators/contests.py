"""Contests within groups: roles of identities in a graph, and a target that all members reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

#: Weights of pair evidence and of what makes a subject, the margin below which a
#: contest is ambiguous, and the bounds of the verdicts.
PORTRAIT, CEREMONY, TOGETHER, SUBJECT = 0.34, 0.22, 0.22, 0.22
FREQUENCY, AREA, SCENES = 0.35, 0.30, 0.35
AMBIGUOUS, SCENELESS, LEAST_FRAMES = 0.05, 0.62, 2


def pair_scores(identities: DataFrame, pairs: DataFrame, group: str) -> DataFrame:
    """group, a, b, score, second (the runner-up's, 0 without one) and place of each pair.

    identities: group, id, frames, area, scenes, ceremony, centrality; pairs: group, a < b,
    frames, portraits. Each count is taken relative to the largest of its group."""
    whole = W.partitionBy(group)
    most = lambda c, least: F.greatest(F.max(c).over(whole), F.lit(least))
    subject = FREQUENCY * F.col("frames") / most("frames", 1) + AREA * F.col("area") / most("area", 1.2e-7) + SCENES * F.col("scenes") / most("scenes", 1)
    known = identities.withColumn("subject", F.least(F.greatest(subject, F.lit(0.0)), F.lit(1.0)))
    relative = pairs.select(group, "a", "b", (F.col("portraits") / most("portraits", 1)).alias("p"), (F.col("frames") / most("frames", 1)).alias("t"))
    side = lambda n: known.select(group, F.col("id").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("subject", "ceremony", "centrality")])
    both = relative.join(side("a"), [group, "a"]).join(side("b"), [group, "b"])
    none = (F.col("a_ceremony") == 0) & (F.col("b_ceremony") == 0)
    weight = lambda n: F.when(none | (F.col(f"{n}_ceremony") > 0), F.col(f"{n}_centrality")).otherwise(0.0)
    score = PORTRAIT * F.col("p") + CEREMONY * (weight("a") + weight("b")) / 2 + TOGETHER * F.col("t") + SUBJECT * (F.col("a_subject") + F.col("b_subject")) / 2
    scored = both.select(group, "a", "b", F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 9).alias("score"))
    ranked = W.partitionBy(group).orderBy(F.desc("score"), "a", "b")
    return scored.withColumns({"place": F.row_number().over(ranked), "second": F.coalesce(F.lead("score").over(ranked), F.lit(0.0)), "alone": F.lead("score").over(ranked).isNull()})


def roles(identities: DataFrame, pairs: DataFrame, group: str) -> DataFrame:
    """group, id, role, confidence, ambiguous of every identity: the two of the best pair of a
    group are its couple, whatever else they could be; an identity of too few frames is unknown;
    of the others, those seen with a member of the couple in at least half of their frames are
    close, the rest guests. A group without known scenes is never sure."""
    best = pair_scores(identities, pairs, group).where("place = 1")
    unsure = ~F.col("alone") & (F.col("score") - F.col("second") < AMBIGUOUS)
    couple = best.select(group, "a", "b", "score", unsure.alias("ambiguous"))
    starved = F.max(F.col("scenes")).over(W.partitionBy(group)) == 0
    # Frames with a member of the couple: pairs meet their group's one best pair.
    with_couple = pairs.join(couple.select(group, F.col("a").alias("c1"), F.col("b").alias("c2")), group)
    ends = F.explode(F.array(F.when(F.col("a").isin(F.col("c1"), F.col("c2")), F.col("b")), F.when(F.col("b").isin(F.col("c1"), F.col("c2")), F.col("a"))))
    beside = with_couple.select(group, ends.alias("id"), "frames").where("id IS NOT NULL").groupBy(group, "id").agg(F.max("frames").alias("beside"))
    joined = identities.select(group, "id", "frames", starved.alias("starved")).join(couple, group, "left").join(beside, [group, "id"], "left")
    member = F.coalesce(F.col("id").isin(F.col("a"), F.col("b")), F.lit(False))
    share = F.coalesce(F.col("beside"), F.lit(0)) / F.greatest("frames", F.lit(1))
    sure = F.when(F.col("starved"), F.least("score", F.lit(SCENELESS))).otherwise(F.col("score"))
    role = F.when(F.col("frames") < LEAST_FRAMES, "unknown").when(member, "couple").when(share >= 0.5, "close").otherwise("guest")
    confidence = F.when(F.col("frames") < LEAST_FRAMES, 0.0).when(member, sure).when(share >= 0.5, F.least(share, F.lit(1.0))).otherwise(1 - share)
    return joined.select(group, "id", role.alias("role"), F.round(confidence, 6).alias("confidence"), (member & F.coalesce("ambiguous", F.lit(False))).alias("ambiguous"))


GAMMA, LIFT, PULL, SPREAD = 2.2, 1.2, 0.6, 0.08


def steps_between(a: Column, b: Column) -> Column:
    return F.lit(GAMMA) * F.log2(F.greatest(b, F.lit(1e-4)) / F.greatest(a, F.lit(1e-4)))


def stepped(value: Column, by: Column) -> Column:
    return F.least(F.greatest(F.greatest(value, F.lit(0.0)) * F.pow(F.lit(2.0), by / GAMMA), F.lit(0.0)), F.lit(1.0))


def group_solved(rows: DataFrame, group: str, value: str, bright: str, weight: str, band: float, cap: Column, strength: float = 1.0, rounds: int = 3, ceiling: float = 0.94) -> DataFrame:
    """Adds target, steps and after: the members of a group move towards a band together.

    Each member can reach so much: up to `cap` steps and until its bright end meets the ceiling,
    down by at most PULL. In rounds, the weighted mean of where all land becomes the target, which
    so becomes one that they can reach. At last those that end more than SPREAD above the lowest
    of their group give back of their lift, but nobody is put below where they started."""
    whole, v, goal = W.partitionBy(group), F.col(value), F.lit(band)

    def reach(target: Column) -> Column:
        aim = F.least(F.greatest(target, F.least(v, goal)), F.greatest(v, goal))
        wanted = steps_between(v, aim)
        room = F.greatest(steps_between(F.col(bright), F.lit(ceiling)), F.lit(0.0))
        return F.when(wanted <= 0, F.greatest(wanted, F.lit(-PULL))).otherwise(F.least(wanted, F.least(cap, F.lit(LIFT)), room))

    out = rows.withColumn("target", goal)
    for _ in range(rounds):
        out = out.withColumn("_landed", stepped(v, reach(F.col("target"))) * F.col(weight))
        out = out.withColumn("target", F.sum("_landed").over(whole) / F.sum(weight).over(whole))
    out = out.withColumn("steps", reach(F.col("target")) * strength).withColumn("after", stepped(v, F.col("steps")))
    most = F.min("after").over(whole) + SPREAD
    wanted = F.greatest(most, F.least(v, F.col("after")))
    back = (F.count(F.lit(1)).over(whole) > 1) & (F.col("after") > most) & (wanted < F.col("after") - 1e-4)
    out = out.withColumns({"_back": back, "_steps": F.least(F.greatest(steps_between(v, wanted), F.lit(-PULL)), F.lit(LIFT))})
    out = out.withColumn("steps", F.when(F.col("_back"), F.col("_steps")).otherwise(F.col("steps")))
    return out.withColumn("after", F.when(F.col("_back"), stepped(v, F.col("steps"))).otherwise(F.col("after"))).drop("_landed", "_back", "_steps")
