"""Robust levels: ridge intercepts of a hierarchy, each level fitted on what those above leave.

Everything is sums: a group's weighted normal equations are one row, solved beside each other;
residuals are taken on the rows, their spread by a distributed median, and the rows are weighed
anew. No group is gathered into a task, however many rows it has.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from catalith.operators.similarity import cut
from catalith.operators.structure import capped_influence

RIDGE, HUBER, FLOOR = 0.1, 1.345, 1e-4


def upper_medians(rows: DataFrame, by: list[str], value: str, bins: int = 4096) -> DataFrame:
    """by and median: element n // 2 (from 0) of each group's values in order, exactly. A first
    pass counts values in bins between a group's ends, the second looks into the one bin where
    that element lies, over its distinct values. Null values are left out. Tables of one row for
    each group are cut, so that their size is known before the rows meet them: else all rows of
    a group would travel to one task."""
    some = rows.where(F.col(value).isNotNull())
    ends = cut(some.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.floor(F.count(F.lit(1)) / 2).alias("_rank")))
    span = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    place = F.least(F.coalesce(F.floor((F.col(value) - F.col("_lo")) / span * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    binned = some.select(*by, value).join(ends, by).withColumn("_bin", place)
    before = lambda keys, order: F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    holds = lambda df: df.where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
    counts = binned.groupBy(*by, "_bin", "_rank").agg(F.count(F.lit(1)).alias("_n"))  # `bins` rows of a group at most
    spot = cut(holds(counts.withColumn("_before", before(by, "_bin"))).select(*by, "_bin", (F.col("_rank") - F.col("_before")).alias("_rank")))
    within = binned.drop("_rank").join(spot, [*by, "_bin"]).groupBy(*by, value, "_rank").agg(F.count(F.lit(1)).alias("_n"))
    return holds(within.withColumn("_before", before(by, value))).select(*by, F.col(value).alias("median"))


def solved(sums: DataFrame, by: list[str], width: int) -> DataFrame:
    """by and beta of rows of sums xx_i_j (i <= j) and xy_i: slopes are penalised, the intercept
    only by a trace that keeps it solvable."""
    kinds = dict(sums.dtypes)

    def each(frames):
        for pdf in frames:
            a, b = np.zeros((len(pdf), width, width)), np.zeros((len(pdf), width))
            for i in range(width):
                b[:, i] = pdf[f"xy_{i}"]
                for j in range(i, width):
                    a[:, i, j] = a[:, j, i] = pdf[f"xx_{i}_{j}"]
            a += np.diag([1e-6, *[RIDGE] * (width - 1)])
            beta = np.linalg.solve(a, b[:, :, None])[:, :, 0] if len(pdf) else b
            yield pd.concat((pdf[by].reset_index(drop=True), pd.DataFrame({"beta": list(beta)})), axis=1)

    return sums.mapInPandas(each, ", ".join([*[f"`{k}` {kinds[k]}" for k in by], "beta array<double>"]))


def intercepts(rows: DataFrame, by: list[str], width: int, passes: int = 2) -> DataFrame:
    """by and raw: the intercept of y on x (an array that starts with 1) under weights w, with
    Huber weights from the residuals of the pass before, in units of their median size."""
    x = lambda i: F.col("x")[i]
    weight = F.col("w")
    for done in range(passes):
        weighed = rows.withColumn("_w", weight)
        products = {f"xx_{i}_{j}": x(i) * x(j) for i in range(width) for j in range(i, width)} | {f"xy_{i}": x(i) * F.col("y") for i in range(width)}
        sums = weighed.groupBy(*by).agg(*[F.sum(F.col("_w") * c).alias(n) for n, c in products.items()])
        beta = cut(solved(sums, by, width))
        if done + 1 == passes:
            return beta.select(*by, F.col("beta")[0].alias("raw"))
        fitted = sum((x(i) * F.col("beta")[i] for i in range(width)), F.lit(0.0))
        residual = weighed.join(beta, by).withColumn("_r", F.abs(F.col("y") - fitted)).drop("beta")
        spread = upper_medians(residual, by, "_r").withColumn("_s", F.greatest(F.col("median") * 1.4826, F.lit(FLOOR))).drop("median")
        rows = residual.join(cut(spread), by).drop("w").withColumnRenamed("_w", "w")
        standard = F.col("_r") / F.col("_s")
        weight = F.col("w") * F.when(standard <= HUBER, 1.0).otherwise(F.lit(HUBER) / standard)
        rows = rows.withColumn("w", weight).drop("_r", "_s")
        weight = F.col("w")
    raise ValueError("at least one pass")


def fitted_levels(samples: DataFrame, levels: list[list[str]], archive: str, features: list[Column], targets: list[Column], priors: list[float], most: float = 0.35) -> DataFrame:
    """One row for each level, its group and target: level, of (the group's values as text),
    target, samples, raw, shrink and fitted (raw * shrink). A null target is no evidence. Each
    level is fitted on y less what the levels above fitted; an archive's share of the weight is
    capped; shrink is samples / (samples + the level's prior)."""
    keys = sorted({k for level in levels for k in level})
    every = samples.select(*keys, F.col(archive).alias("_archive"), F.array(F.lit(1.0), *features).alias("x"), F.array(*[t.cast("double") for t in targets]).alias("_y"))
    weights = capped_influence(every, "_archive", most).select("_archive", F.col("weight").alias("w"))
    every = every.join(weights, "_archive").drop("_archive")
    rows = cut(every.select(*keys, "x", "w", F.posexplode("_y").alias("target", "y")).where("y IS NOT NULL"))
    out = None
    for number, (level, prior) in enumerate(zip(levels, priors, strict=True)):
        size = every.groupBy(*level).agg(F.count(F.lit(1)).alias("samples")) if level else every.agg(F.count(F.lit(1)).alias("samples"))
        raw = intercepts(rows, [*level, "target"], len(features) + 1)
        raw = raw.join(size, level) if level else raw.crossJoin(F.broadcast(size))  # one row
        shrink = F.col("samples") / (F.col("samples") + F.lit(prior))
        fit = cut(raw.withColumn("shrink", shrink).withColumn("fitted", F.col("raw") * F.col("shrink")))
        rows = rows.join(fit.select(*level, "target", "fitted"), [*level, "target"], "left").withColumn("y", F.col("y") - F.coalesce("fitted", F.lit(0.0))).drop("fitted")
        named = fit.select(F.lit(number).alias("level"), F.concat_ws("/", *[F.col(k).cast("string") for k in level]).alias("of"), "target", "samples", "raw", "shrink", "fitted")
        out = named if out is None else out.unionByName(named)
    return out
