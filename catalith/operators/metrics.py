"""Calibration, retrieval, clustering and ranking metrics, as aggregates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from catalith.operators.similarity import cut


def calibration(rows: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins and Brier score, one row."""
    b = rows.groupBy(F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(confidence).alias("c"), F.sum(correct).alias("y"), F.sum((F.col(confidence) - F.col(correct)) ** 2).alias("s"))
    return b.agg((F.sum(F.abs(F.col("c") - F.col("y"))) / F.sum("n")).alias("ece"), (F.sum("s") / F.sum("n")).alias("brier"), F.sum("n").alias("rows"))


def range_bounds(points: DataFrame, at: str, parts: int) -> Column:
    """An array of the bounds of `parts` ranges of `at`, by approximate quantiles."""
    quantiles = points.approxQuantile(at, [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
    return F.array(*[F.lit(float(q)) for q in sorted(set(quantiles))]) if quantiles else F.array().cast("array<double>")


def range_of(points: DataFrame, at: str, parts: int) -> Column:
    """The number of the range of `at` that a row is in."""
    return F.size(F.filter(range_bounds(points, at, parts), lambda q: q <= F.col(at)))


def pooled(blocks) -> list[list]:
    """Pool-adjacent-violators over [sum of y, weight, sum of x, places]: neighbours become one
    while the mean of the left exceeds that of the right; equal means stay apart."""
    out: list[list] = []
    for block in blocks:
        out.append(list(block))
        while len(out) > 1 and out[-2][0] * out[-1][1] > out[-1][0] * out[-2][1]:
            top = out.pop()
            out[-1] = [a + b for a, b in zip(out[-1], top, strict=True)]
    return out


def isotonic_knots(rows: DataFrame, x: str, y: str, parts: int = 64) -> DataFrame:
    """Isotonic fit of y (0 or 1) as (x, y) block means over distinct scores; no knots where
    there would be fewer than two.

    Scores are dealt into ranges and each range is pooled by itself. Blocks of a range that
    follow each other with equal means are one unit for what comes next, as a violation takes
    all of them or none; units of neighbouring ranges are then pooled, eight ranges at a time.
    Means of units rise strictly within a range, so n outcomes make some n ** (2 / 3) units at
    most. Blocks of units that nothing changed stay where they were made."""
    points = rows.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("x")).agg(F.sum(y).cast("double").alias("y"), F.count(F.lit(1)).cast("double").alias("n"))
    dealt = points.withColumn("range", range_of(points, "x", parts))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        blocks = pooled(zip(pdf["y"].tolist(), pdf["n"].tolist(), (pdf["x"] * pdf["n"]).tolist(), strict=True))
        unit, last = [], None
        for sy, n, _ in blocks:
            if last is None or sy * last[1] != last[0] * n:
                unit.append(unit[-1] + 1 if unit else 0)
            else:
                unit.append(unit[-1])
            last = (sy, n)
        return pd.DataFrame({"range": int(pdf["range"].iloc[0]), "unit": unit, "sy": [b[0] for b in blocks], "n": [b[1] for b in blocks], "sx": [b[2] for b in blocks]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["range", "unit"])
        columns = [pdf[c].tolist() for c in ("sy", "n", "sx", "changed")]
        out = pooled((sy, n, sx, [(i, changed)]) for i, (sy, n, sx, changed) in enumerate(zip(*columns, strict=True)))
        first = pdf.iloc[[b[3][0][0] for b in out]]
        return pd.DataFrame({"range": first["range"].to_numpy(), "unit": first["unit"].to_numpy(), "sy": [b[0] for b in out], "n": [b[1] for b in out], "sx": [b[2] for b in out], "changed": [len(b[3]) > 1 or b[3][0][1] for b in out]})

    shape = "range int, unit long, sy double, n double, sx double"
    blocks = cut(dealt.groupBy("range").applyInPandas(fit, shape))
    units = blocks.groupBy("range", "unit").agg(F.sum("sy").alias("sy"), F.sum("n").alias("n"), F.sum("sx").alias("sx")).withColumn("changed", F.lit(False))
    reach = 8
    while reach < 8 * parts:
        units = units.groupBy(F.floor(F.col("range") / reach).alias("_g")).applyInPandas(merge, f"{shape}, changed boolean")
        reach *= 8
    units = cut(units)
    kept = blocks.join(units.where("NOT changed").select("range", "unit"), ["range", "unit"], "left_semi")
    knots = cut(kept.unionByName(units.where("changed").drop("changed")).select((F.col("sx") / F.col("n")).alias("x"), F.least(F.greatest(F.col("sy") / F.col("n"), F.lit(0.0)), F.lit(1.0)).alias("y")))
    return knots if len(knots.take(2)) == 2 else knots.limit(0)


def isotonic_applied(rows: DataFrame, x: str, knots: DataFrame, name: str, parts: int = 64) -> DataFrame:
    """Piecewise-linear reading of the knots, constant beyond its ends; the score itself where
    there are no knots, null for a null score. Distinct scores and knots are dealt into ranges
    together; each range brings its first and last knot to the others, so no task holds all."""
    scores = rows.select(F.col(x).cast("double").alias("_x")).where("_x IS NOT NULL").distinct()
    both = scores.select("_x", F.lit(None).cast("double").alias("_y")).unionByName(knots.select(F.col("x").alias("_x"), F.col("y").alias("_y")))
    dealt = both.withColumn("_r", range_of(scores, "_x", parts))
    knot = F.when(F.col("_y").isNotNull(), F.struct("_x", "_y"))
    ends = dealt.groupBy("_r").agg(F.min(knot).alias("first"), F.max(knot).alias("last"))  # at most `parts` rows
    order = W.orderBy("_r")
    ends = ends.select("_r", F.last("last", True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("_before"), F.first("first", True).over(order.rowsBetween(1, W.unboundedFollowing)).alias("_after"))
    up, down = W.partitionBy("_r").orderBy("_x", F.col("_y").isNull()), W.partitionBy("_r").orderBy(F.desc("_x"), F.col("_y").isNull())
    so_far = lambda w: F.last(knot, True).over(w.rowsBetween(W.unboundedPreceding, 0))
    read = dealt.withColumn("_a", so_far(up)).withColumn("_b", so_far(down)).where("_y IS NULL").join(F.broadcast(ends), "_r")
    a, b, v = F.coalesce("_a", "_before"), F.coalesce("_b", "_after"), F.col("_x")
    span = b["_x"] - a["_x"]
    between = F.when(span > 0, a["_y"] + (b["_y"] - a["_y"]) * (v - a["_x"]) / F.nullif(span, F.lit(0.0))).otherwise(a["_y"])
    value = read.select("_x", F.when(a.isNull() & b.isNull(), v).when(a.isNull(), b["_y"]).when(b.isNull(), a["_y"]).otherwise(between).alias(name))
    return rows.withColumn("_x", F.col(x).cast("double")).join(value, "_x", "left").drop("_x")


def temperature_fit(rows: DataFrame, raw: str, correct: str, low: float = 0.5, high: float = 5.0, step: float = 0.045) -> DataFrame:
    """The temperature of a fixed grid with the least mean log loss: one pass with an
    aggregate for each grid point."""
    grid = np.round(np.arange(low, high + 1e-9, step), 6).tolist()
    loss = lambda t: F.avg(F.log1p(F.exp(-F.when(F.col(correct) == 1, F.col(raw)).otherwise(-F.col(raw)) / t)))
    wide = rows.agg(F.array(*[F.struct(loss(t).alias("loss"), F.lit(t).alias("temperature")) for t in grid]).alias("g"))
    return wide.select(F.array_min("g").alias("m")).select("m.temperature", "m.loss")


def running(points: DataFrame, at: str, sums: list[str], descending: bool = False, parts: int = 64) -> DataFrame:
    """Adds run_<c>, the sum of c over all points up to and including each one, and all_<c>,
    its total. Points are dealt into at most `parts` ranges of `at` by approximate quantiles;
    running sums are taken within each range and shifted by the sums of the ranges before it,
    so no task sorts all points."""
    dealt = points.withColumn("_r", range_of(points, at, parts))
    order = lambda c: F.desc(c) if descending else F.asc(c)
    before = W.orderBy(order("_r")).rowsBetween(W.unboundedPreceding, -1)
    ranges = dealt.groupBy("_r").agg(*[F.sum(c).alias(f"_{c}") for c in sums])  # at most `parts` rows
    ranges = ranges.select("_r", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in sums], *[F.sum(f"_{c}").over(W.partitionBy()).alias(f"all_{c}") for c in sums])
    within = W.partitionBy("_r").orderBy(order(at)).rowsBetween(W.unboundedPreceding, 0)
    return dealt.join(F.broadcast(ranges), "_r").withColumns({f"run_{c}": F.col(f"_{c}") + F.sum(c).over(within) for c in sums}).drop("_r", *[f"_{c}" for c in sums])


def pr_curve(rows: DataFrame, score: str, relevant: str) -> DataFrame:
    """Precision and recall at each distinct score, best scores first."""
    n = rows.groupBy(score).agg(F.count(F.lit(1)).alias("n"), F.sum(relevant).alias("hits"))
    c = running(n, score, ["n", "hits"], descending=True)
    return c.select(score, (F.col("run_hits") / F.col("run_n")).alias("precision"), (F.col("run_hits") / F.col("all_hits")).alias("recall"))


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Mann-Whitney area with mid-ranks for ties, from counts of distinct scores."""
    n = rows.groupBy(score).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("q"))
    below = F.col("run_q") - F.col("q")
    wins = running(n, score, ["q"]).withColumn("w", F.col("p") * (below + F.col("q") / 2))
    return wins.agg((F.sum("w") / (F.sum("p") * F.sum("q"))).alias("auc"), F.sum("p").alias("positives"), F.sum("q").alias("negatives"))


def recall_at(found: DataFrame, truth: DataFrame, query: str, item: str) -> DataFrame:
    """Share of each query's true items that were found."""
    hit = truth.select(query, item).join(found.select(query, item).distinct().withColumn("_hit", F.lit(1)), [query, item], "left")
    return hit.groupBy(query).agg((F.sum(F.coalesce("_hit", F.lit(0))) / F.count(F.lit(1))).alias("recall"))


def average_precision(ranked: DataFrame, query: str, place: str, relevant: str) -> DataFrame:
    """Mean of the precision at each hit; the denominator is the hits found, not all relevant
    items; 0 without hits."""
    run = W.partitionBy(query).orderBy(place).rowsBetween(W.unboundedPreceding, 0)
    at = ranked.withColumn("_p", F.sum(relevant).over(run) / F.count(F.lit(1)).over(run))
    return at.groupBy(query).agg(F.coalesce(F.sum(F.when(F.col(relevant) == 1, F.col("_p"))) / F.nullif(F.sum(relevant), F.lit(0)), F.lit(0.0)).alias("average_precision"))


def contingency(rows: DataFrame, cluster: str, truth: str) -> DataFrame:
    return rows.groupBy(cluster, truth).agg(F.count(F.lit(1)).alias("n"))


def purity(rows: DataFrame, cluster: str, truth: str) -> DataFrame:
    best = contingency(rows, cluster, truth).groupBy(cluster).agg(F.max("n").alias("m"), F.sum("n").alias("n"))
    return best.agg((F.sum("m") / F.sum("n")).alias("purity"), F.count(F.lit(1)).alias("clusters"))


def nmi(rows: DataFrame, cluster: str, truth: str) -> DataFrame:
    """Mutual information over the arithmetic mean of the entropies; 1 if both are constant."""
    c = contingency(rows, cluster, truth)
    total = c.agg(F.sum("n").alias("t"))
    by = lambda k: c.groupBy(k).agg(F.sum("n").alias(f"n_{k}"))
    joint = c.join(by(cluster), cluster).join(by(truth), truth).crossJoin(F.broadcast(total))
    mutual = joint.agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col(f"n_{cluster}") * F.col(f"n_{truth}")))).alias("mi"))
    entropy = lambda k, name: by(k).crossJoin(F.broadcast(total)).agg(F.sum(-F.col(f"n_{k}") / F.col("t") * F.ln(F.col(f"n_{k}") / F.col("t"))).alias(name))
    out = mutual.crossJoin(entropy(cluster, "hc")).crossJoin(entropy(truth, "ht"))  # one row each
    return out.select(F.when(F.col("hc") + F.col("ht") == 0, 1.0).otherwise(2 * F.col("mi") / (F.col("hc") + F.col("ht"))).alias("nmi"))


def pairwise(rows: DataFrame, cluster: str, truth: str) -> DataFrame:
    """Pair precision, recall, F1 and adjusted Rand index from sums of n over 2."""
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    c = contingency(rows, cluster, truth)
    both = c.agg(two("n").alias("both"), F.sum("n").alias("t"))
    side = lambda k, name: c.groupBy(k).agg(F.sum("n").alias("m")).agg(two("m").alias(name))
    s = both.crossJoin(side(cluster, "pc")).crossJoin(side(truth, "pt"))  # one row each
    p, r = F.col("both") / F.col("pc"), F.col("both") / F.col("pt")
    expected = F.col("pc") * F.col("pt") / (F.col("t") * (F.col("t") - 1) / 2)
    ari = (F.col("both") - expected) / ((F.col("pc") + F.col("pt")) / 2 - expected)
    return s.select(p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r)).alias("f1"), ari.alias("ari"))


def macro_f1(rows: DataFrame, predicted: str, truth: str) -> DataFrame:
    c = contingency(rows, predicted, truth)
    right = c.where(F.col(predicted) == F.col(truth)).select(F.col(truth).alias("k"), F.col("n").alias("tp"))
    named = c.groupBy(F.col(predicted).alias("k")).agg(F.sum("n").alias("named"))
    real = c.groupBy(F.col(truth).alias("k")).agg(F.sum("n").alias("real"))
    f1 = real.join(named, "k", "left").join(right, "k", "left").select("k", (2 * F.coalesce("tp", F.lit(0)) / (F.col("real") + F.coalesce("named", F.lit(0)))).alias("f1"))
    return f1.agg(F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("classes"))


def accept_rate_at(rows: DataFrame, score: str, same: str, false_rate: float) -> DataFrame:
    """True accept rate at the loosest distance threshold whose false accept rate stays within
    false_rate, from counts of distinct scores (smaller is closer)."""
    n = rows.groupBy(score).agg(F.sum(same).alias("p"), F.sum(1 - F.col(same)).alias("q"))
    c = running(n, score, ["p", "q"])
    return c.where(F.col("run_q") <= false_rate * F.col("all_q")).agg(F.coalesce(F.max(F.col("run_p") / F.col("all_p")), F.lit(0.0)).alias("accept_rate"))


def ridge(rows: DataFrame, groups: list[str], x: str, y: str, penalty: float, prior: float) -> DataFrame:
    """One-feature ridge slopes of groups, shrunk towards the global slope by n / (n + prior)."""
    slope = lambda df: (df, (F.sum(F.col(x) * F.col(y)) / (F.sum(F.col(x) ** 2) + penalty)))
    total = rows.agg(slope(rows)[1].alias("_g"))
    each = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), slope(rows)[1].alias("_s"))
    return each.crossJoin(F.broadcast(total)).select(*groups, "n", (F.col("_g") + (F.col("_s") - F.col("_g")) * F.col("n") / (F.col("n") + prior)).alias("slope"))  # one row


def group_split(rows: DataFrame, key: str, share: float) -> DataFrame:
    """Train or test by a hash of the group key, so no group is on both sides."""
    return rows.withColumn("split", F.when(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(1000)) < int(share * 1000), "test").otherwise("train"))


def leakage(rows: DataFrame, key: str) -> DataFrame:
    """Keys on both sides of a split: none, if the split is sound."""
    return rows.groupBy(key).agg(F.countDistinct("split").alias("sides")).where("sides > 1")
