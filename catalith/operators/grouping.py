"""Moments, roles and galleries: composites of the joins, windows and components."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from catalith.operators import joins, selection, similarity


def moment_edges(rows: DataFrame, key: str, at: str, window: str, hard: int, carry: list[str], score: Column, least: Column, group: list[str] | None = None) -> DataFrame:
    """Scored edges between rows at most the left row's adaptive window apart (never more than
    `hard`), all of them: a band join on buckets of `hard`. `score` and `least` see a_ and b_
    columns, gap and reach."""
    pairs = joins.band_pairs(rows, key, at, hard, group, [window, *carry])
    near = pairs.withColumn("reach", F.least(F.col(f"a_{window}"), F.lit(hard))).where(F.col("gap") <= F.col("reach"))
    return near.withColumn("score", score).where(F.col("score") >= least).select("a", "b", "gap", "score")


def capped_components(edges: DataFrame, nodes: DataFrame, key: str, most: int, step: float = 0.08, rounds: int = 3) -> DataFrame:
    """Components of the edges; those above `most` members are built again from their stronger
    edges, the bar rising by `step` above the weakest edge, up to `rounds` times; what is
    still too large is cut into runs of `most` in key order."""
    found = similarity.components(edges, nodes.select(F.col(key).alias("node")))
    for _ in range(rounds):
        size = found.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
        inside = edges.join(found.withColumnRenamed("node", "a"), "a").join(size, "root")
        bar = inside.groupBy("root").agg((F.min("score") + step).alias("bar"))
        edges_of_large = inside.join(bar, "root").where(F.col("score") >= F.col("bar")).select("a", "b", "score")
        large = found.join(size.select("root"), "root", "left_semi").select("node")
        again = similarity.components(edges_of_large, large)
        found = found.join(size.select("root"), "root", "left_anti").unionByName(again)
        edges = edges_of_large
    place = F.row_number().over(W.partitionBy("root").orderBy("node")) - 1
    return found.withColumn("part", F.floor(place / most)).select(F.col("node").alias(key), "root", "part")


def merged_intervals(groups: DataFrame, project: str, key: str, start: str, end: str, source: str, overlap: float, passes: int = 4) -> DataFrame:
    """Groups of different sources that overlap by at least `overlap` of the shorter one are
    joined, first match in start order, each at most once a pass. A project's list of groups
    is one sequence; it holds groups, not rows."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        now = [[r[start], r[end], {r[source]}, [r[key]]] for _, r in pdf.sort_values([start, key]).iterrows()]
        for _ in range(passes):
            out, used, changed = [], set(), False
            for i, g in enumerate(now):
                if i in used:
                    continue
                for j in range(i + 1, len(now)):
                    h = now[j]
                    if h[0] > g[1]:
                        break
                    shared = min(g[1], h[1]) - max(g[0], h[0])
                    if j not in used and not g[2] & h[2] and shared / max(min(g[1] - g[0], h[1] - h[0]), 1) >= overlap:
                        g = [min(g[0], h[0]), max(g[1], h[1]), g[2] | h[2], g[3] + h[3]]
                        used.add(j)
                        changed = True
                        break
                out.append(g)
            now = sorted(out, key=lambda g: (g[0], g[3][0]))
            if not changed:
                break
        pairs = [(k, min(g[3])) for g in now for k in g[3]]
        return pd.DataFrame({project: pdf[project].iloc[0], key: [k for k, _ in pairs], "merged": [m for _, m in pairs]})

    kinds = dict(groups.dtypes)
    return groups.select(project, key, start, end, source).groupBy(project).applyInPandas(one, f"{project} {kinds[project]}, {key} {kinds[key]}, merged {kinds[key]}")


def swapped_for_distinct(rows: DataFrame, chapter: str, moment: str, score: str, key: str, quota: str, bonus: float = 0.10, most: int = 512) -> DataFrame:
    """Each chapter's best rows up to its quota; then rows of a moment that is already shown
    give way to the best row of one that is not, while that costs at most `bonus` of score.
    The sequential part sees a chapter's kept rows and one row for each moment left out."""
    w = W.partitionBy(chapter)
    ranked = rows.withColumn("_i", F.row_number().over(w.orderBy(F.desc(score), key)))
    ranked = ranked.withColumn("_kept", F.col("_i") <= F.col(quota))
    shown = F.max(F.when(F.col("_kept"), 1).otherwise(0)).over(W.partitionBy(chapter, moment))
    best = F.row_number().over(W.partitionBy(chapter, moment).orderBy(F.desc(score), key))
    narrow = ranked.withColumns({"_shown": shown, "_best": best}).where("_kept OR (_shown = 0 AND _best = 1)")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = pdf[pdf["_kept"]].sort_values([score, key], ascending=[True, False])
        spare = pdf[~pdf["_kept"]].sort_values([score, key], ascending=[False, True])
        counts = kept[moment].value_counts().to_dict()
        keep, gone = {r[key] for _, r in kept.iterrows()}, iter(list(kept.iterrows()))
        for n, (_, new) in enumerate(spare.iterrows()):
            old = next((r for _, r in gone if counts[r[moment]] > 1), None)
            if n >= most or old is None or new[score] + bonus < old[score]:
                break
            counts[old[moment]] -= 1
            keep.remove(old[key])
            keep.add(new[key])
        return pd.DataFrame({chapter: pdf[chapter].iloc[0], key: sorted(keep)})

    kinds = dict(rows.dtypes)
    return narrow.select(chapter, moment, score, key, "_kept").groupBy(chapter).applyInPandas(one, f"{chapter} {kinds[chapter]}, {key} {kinds[key]}")


def reconciled(kept: DataFrame, rows: DataFrame, key: str, score: str, target: int, protected: str) -> DataFrame:
    """Grow to the target by the best rows not kept, or shrink to it by the worst unprotected.
    How many rows are short is counted first, so that each way is a plain top-k."""
    short = target - kept.count()
    if short > 0:
        return kept.select(rows.columns).unionByName(rows.join(kept.select(key), key, "left_anti").select(rows.columns).orderBy(F.desc(score), key).limit(short))
    gone = kept.where(~F.col(protected)).orderBy(score, F.desc(key)).limit(-short).select(key)
    return kept.join(gone, key, "left_anti").select(rows.columns)


def minimum_each(kept: DataFrame, rows: DataFrame, key: str, members: str, score: str, least: int) -> DataFrame:
    """Rows to add so that every member of the rows' member arrays occurs in at least `least`
    kept rows, where there are that many: the best rows of each member that is short. A row
    that serves several members is added once."""
    have = kept.select(F.explode(members).alias("_m")).groupBy("_m").agg(F.count(F.lit(1)).alias("_have"))
    rest = rows.join(kept.select(key), key, "left_anti").select(key, score, F.explode(members).alias("_m"))
    short = rest.join(have, "_m", "left").withColumn("_short", least - F.coalesce("_have", F.lit(0))).where("_short > 0")
    return short.withColumn("_i", F.row_number().over(W.partitionBy("_m").orderBy(F.desc(score), key))).where("_i <= _short").select(key).distinct()


def relaxed_best(rows: DataFrame, group: str, ladder: list[Column], order: list[Column]) -> DataFrame:
    """One row for each group from the strictest rung of conditions that any of its rows meets."""
    rung = F.coalesce(*[F.when(c, i) for i, c in enumerate(ladder)], F.lit(len(ladder)))
    return selection.best_per_group(rows.withColumn("rung", rung.cast("long")), [group], [F.asc("rung"), *order])


def threshold_sweep(pairs: DataFrame, distance: str, same: str, thresholds: list[float], total: Column | None = None) -> DataFrame:
    """Precision, recall and F1 of pairs at each threshold, in one pass over the pairs. Where
    pairs beyond the last threshold are left out, `total` (an aggregate) tells how many of all
    are the same."""
    total = F.sum(same) if total is None else total
    rows = [F.struct(F.lit(t).alias("threshold"), F.sum(F.when(F.col(distance) <= t, F.col(same)).otherwise(0)).alias("tp"), F.sum((F.col(distance) <= t).cast("int")).alias("named"), total.alias("real")) for t in thresholds]
    one = pairs.agg(F.array(*rows).alias("r")).select(F.inline("r"))
    f1 = F.when(F.col("named") + F.col("real") > 0, 2 * F.col("tp") / (F.col("named") + F.col("real"))).otherwise(0.0)
    return one.select("threshold", (F.col("tp") / F.nullif("named", F.lit(0))).alias("precision"), (F.col("tp") / F.nullif("real", F.lit(0))).alias("recall"), f1.alias("f1"))


def fitted_ranker(pairs: DataFrame, features: list[str], iterations: int = 50) -> dict[str, float]:
    """Bradley-Terry weights: logistic regression without intercept on the differences
    better - worse (columns b_ and w_), each pair also turned round."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    d = pairs.select(*[(F.col(f"b_{f}") - F.col(f"w_{f}")).alias(f) for f in features])
    both = d.withColumn("label", F.lit(1.0)).unionByName(d.select(*[(-F.col(f)).alias(f) for f in features]).withColumn("label", F.lit(0.0)))
    model = LogisticRegression(fitIntercept=False, regParam=1e-3, maxIter=iterations, standardization=False).fit(VectorAssembler(inputCols=features, outputCol="features").transform(both))
    return dict(zip(features, model.coefficients.toArray().tolist(), strict=True))


def gallery(rows: DataFrame, chapter: str, moment: str, duplicate: str, score: str, at: str, key: str, target: int, per_moment: int, reach: int, density: int, least: int) -> DataFrame:
    """The whole selection: best of each moment without duplicates, chapter quotas, coverage of
    every chapter, and a cap on density; rows of the result are kept."""
    top = selection.keepers(rows, moment, duplicate, score, key, F.lit(per_moment)).drop("place")
    volumes = top.groupBy(chapter).agg(F.count(F.lit(1)).alias("volume"), F.avg(score).alias("importance"))
    kept = selection.within_quota(top, chapter, score, key, selection.quotas(volumes, "volume", "importance", target)).select(rows.columns)
    covered = selection.enforce_coverage(kept, rows, chapter, least, score, key).select(rows.columns)
    return selection.density_capped(covered, chapter, at, score, key, reach, density)
