"""Semi, anti, range, band, as-of and self joins that scale with their output."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W


def pending(rows: DataFrame, done: DataFrame, key: str, versions: dict[str, object]) -> DataFrame:
    """Rows never processed, or processed under any other version: the incremental work list."""
    current = done
    for name, value in versions.items():
        current = current.where(F.col(name).eqNullSafe(F.lit(value)))
    return rows.join(current.select(key), key, "left_anti")


def not_in(rows: DataFrame, key: str, others: DataFrame, other_key: str) -> DataFrame:
    """NOT IN over a subquery that excludes nulls; rows with a null key are left out, as in SQL."""
    there = others.where(F.col(other_key).isNotNull()).select(F.col(other_key).alias("_k")).distinct()
    return rows.where(F.col(key).isNotNull()).join(there, F.col(key) == F.col("_k"), "left_anti")


def range_join(points: DataFrame, at: str, ranges: DataFrame, start: str, end: str, width: int, how: str = "inner") -> DataFrame:
    """Points with the closed ranges that hold them ("left" keeps points that none holds).
    Ranges are exploded into the buckets of `width` that they touch, so the join hashes on the
    bucket; a point falls into one bucket, so no pair comes twice. Choose width near the usual
    length of a range."""
    buckets = ranges.withColumn("_c", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    dealt = points.withColumn("_b", F.floor(F.col(at) / width))
    return dealt.join(buckets, (F.col("_b") == F.col("_c")) & F.col(at).between(F.col(start), F.col(end)), how).drop("_b", "_c")


def window_counts(points: DataFrame, at: str, member: str, ranges: DataFrame, key: str, start: str, width: int) -> DataFrame:
    """key, rows and members of ranges [start, start + width] (one row for each key, whole
    numbers): how many points lie within and of how many distinct members, without a pair.

    A member is within a range that starts at s by its first point t from s on: s lies after the
    member's point before t and from t - width to t. Those spans of a member don't overlap, so
    the members at s are the spans that begin up to s less those that end before it. Everything
    is a running total over distinct times, within buckets and over one row for each bucket."""
    seen = points.select(F.col(at).cast("long").alias("_x"), F.col(member).alias("_m")).where("_x IS NOT NULL")
    own = seen.where("_m IS NOT NULL").distinct()
    before = F.lag("_x").over(W.partitionBy("_m").orderBy("_x"))
    begins = own.select(F.greatest(before + 1, F.col("_x") - width).alias("_x"), F.lit(1).alias("_b"))
    asked = ranges.where(F.col(start).isNotNull()).select(key, F.col(start).cast("long").alias("_s")).select(
        key, F.explode(F.array(*[F.struct((F.col("_s") + d).alias("_x"), *[F.lit(n).alias(f"_k{i}") for i, n in enumerate(signs)]) for d, signs in ((width, (1, 0, 0)), (-1, (-1, -1, 0)), (0, (0, 0, 1)))])).alias("_a")).select(key, "_a.*")
    none = [F.lit(0).alias(c) for c in "nmb"]
    marks = seen.select("_x", F.lit(1).alias("n"), *none[1:]).unionByName(own.select("_x", none[0], F.lit(1).alias("m"), none[2]))
    marks = marks.unionByName(begins.select("_x", *none[:2], F.col("_b").alias("b"))).unionByName(asked.select("_x", *none))
    sums = marks.groupBy("_x").agg(*[F.sum(c).alias(c) for c in "nmb"]).withColumn("_bucket", F.floor(F.col("_x") / max(width // 64, 1)))
    first = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)  # one row for each bucket
    offsets = sums.groupBy("_bucket").agg(*[F.sum(c).alias(c) for c in "nmb"]).select("_bucket", *[F.coalesce(F.sum(c).over(first), F.lit(0)).alias(f"_{c}") for c in "nmb"])
    within = W.partitionBy("_bucket").orderBy("_x").rowsBetween(W.unboundedPreceding, 0)
    total = sums.select("_x", "_bucket", *[F.sum(c).over(within).alias(c) for c in "nmb"]).join(offsets, "_bucket")
    total = total.select("_x", *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in "nmb"])
    rows = F.sum(F.col("_k0") * F.col("n"))
    members = F.sum(F.col("_k1") * F.col("m") + F.col("_k2") * F.col("b"))
    return asked.join(total, "_x").groupBy(key).agg(rows.alias("rows"), members.alias("members"))


def band_pairs(rows: DataFrame, key: str, at: str, reach: int, group: list[str] | None = None, carry: list[str] = ()) -> DataFrame:
    """Unordered pairs (left before right, ties by key) at most `reach` apart, as an equi-join
    on time buckets of that width: the right row looks in its own and the previous bucket."""
    group = list(group or [])
    side = lambda name: rows.select(*[F.col(g).alias(f"_{name}_{g}") for g in group], F.col(key).alias(name), F.col(at).alias(f"{name}_at"), *[F.col(c).alias(f"{name}_{c}") for c in carry])
    left = side("a").withColumn("_b", F.floor(F.col("a_at") / reach))
    bucket = F.floor(F.col("b_at") / reach)
    right = side("b").withColumn("_b", F.explode(F.array(bucket - 1, bucket)))
    joined = left.join(right.withColumnRenamed("_b", "_c"), [F.col("_b") == F.col("_c"), *[F.col(f"_a_{g}").eqNullSafe(F.col(f"_b_{g}")) for g in group]])
    before = (F.col("a_at") < F.col("b_at")) | ((F.col("a_at") == F.col("b_at")) & (F.col("a") < F.col("b")))
    kept = joined.where(before & (F.col("b_at") - F.col("a_at") <= reach))
    return kept.drop("_b", "_c", *[f"_{s}_{g}" for s in "ab" for g in group]).withColumn("gap", F.col("b_at") - F.col("a_at"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, values: list[str]) -> DataFrame:
    """For each left row the values of the last right row of its keys at or before it: one
    union, one sort and a running last. Of right rows at the same time the greatest values win."""
    held = F.struct(F.col(right_at).alias("_at"), *values)
    none = F.lit(None).cast(right.select(held.alias("s")).schema["s"].dataType)
    ident = F.struct(*[F.col(c) for c in left.columns])
    a = left.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), ident.alias("_row"), none.alias("_v"))
    b = right.select(*keys, F.col(right_at).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), held.alias("_v"))
    order = W.partitionBy(*keys).orderBy("_t", "_side", "_v").rowsBetween(W.unboundedPreceding, 0)
    filled = a.unionByName(b).withColumn("_last", F.last("_v", ignorenulls=True).over(order)).where("_side = 1")
    return filled.select("_row.*", *[F.col(f"_last.{v}").alias(v) for v in values])


def interval_overlaps(rows: DataFrame, key: str, start: str, end: str, group: list[str], least: float) -> DataFrame:
    """Pairs of a group's intervals whose shared span is at least `least` of the shorter one
    (floored at one unit)."""
    s = lambda n: rows.select(*group, F.col(key).alias(n), F.col(start).alias(f"{n}0"), F.col(end).alias(f"{n}1"))
    shared = F.least("a1", "b1") - F.greatest("a0", "b0")
    shorter = F.greatest(F.least(F.col("a1") - F.col("a0"), F.col("b1") - F.col("b0")), F.lit(1))
    return s("a").join(s("b"), group).where((F.col("a") < F.col("b")) & (shared > 0)).withColumn("overlap", shared / shorter).where(F.col("overlap") >= least).select(*group, "a", "b", "overlap")


def group_sets(rows: DataFrame, groups: list[str], member: str, share: int = 500_000) -> tuple[DataFrame, int]:
    """_bucket, groups, members (the distinct ones of a group), and the number of partitions: groups
    are dealt by a bucket, about `share` rows to a partition, so that no task grows with the table."""
    parts = max(1, -(-rows.count() // share))
    bucket = F.pmod(F.xxhash64(*groups), F.lit(32 * parts)).cast("int")
    dealt = rows.select(bucket.alias("_bucket"), *groups, member).repartition(parts, "_bucket")
    known = dealt.where(" AND ".join(f"{c} IS NOT NULL" for c in (*groups, member)))
    return known.groupBy("_bucket", *groups).agg(F.collect_set(member).alias("members")), parts


def counted_pairs(sets: DataFrame, parts: int, keys: list[str], counts: dict[str, Column]) -> DataFrame:
    """keys, a, b and sums of `counts` over the pairs a < b of members of bounded sets: counted in
    each bucket first, which takes no shuffle, then over all, in so many partitions again."""
    carry = [c for c in sets.columns if c != "members"]
    one = sets.where(F.size("members") > 1).select(*carry, "members", F.explode("members").alias("a"))
    pairs = one.select(*carry, "a", F.size("members").alias("_size"), F.explode(F.filter("members", lambda x: x > F.col("a"))).alias("b"))
    here = pairs.groupBy("_bucket", *keys, "a", "b").agg(*[F.sum(c).alias(n) for n, c in counts.items()])
    return here.repartition(parts, *keys, "a", "b").groupBy(*keys, "a", "b").agg(*[F.sum(n).alias(n) for n in counts])


def cooccurrence(rows: DataFrame, group: str, member: str) -> DataFrame:
    """Unordered pairs of distinct members that share groups, and how many groups they share.
    Meant for groups of bounded size (an order's lines); pairs are made of each group's set."""
    sets, parts = group_sets(rows, [group], member)
    return counted_pairs(sets, parts, [], {"together": F.lit(1)})


def tied(rows: DataFrame, group: str, member: str) -> DataFrame:
    """(a, b), a < b: the least member of each group with every other one. They connect what all
    pairs of the group connect, and grow with the rows."""
    sets, _ = group_sets(rows, [group], member)
    return sets.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where("a < b")


def companions(rows: DataFrame, group: str, member: str, most: int, share: int = 500_000) -> DataFrame:
    """node, neighbour, together: the `most` members that share most groups with each member (ties:
    the smaller). Pairs are counted once and dealt by node into as many partitions as the rows need."""
    sets, parts = group_sets(rows, [group], member, share)
    edges = both_directions(counted_pairs(sets, parts, [], {"together": F.lit(1)}), "together").repartition(parts, "node")
    place = F.row_number().over(W.partitionBy("node").orderBy(F.desc("together"), "neighbour"))
    return edges.withColumn("_i", place).where(F.col("_i") <= most).drop("_i")


def both_directions(edges: DataFrame, *carry: str) -> DataFrame:
    """node, neighbour and `carry` of every edge and its reverse, in one pass over the edges."""
    ends = lambda x, y: F.struct(F.col(x).alias("node"), F.col(y).alias("neighbour"))
    return edges.select(F.explode(F.array(ends("a", "b"), ends("b", "a"))).alias("_ends"), *carry).select("_ends.node", "_ends.neighbour", *carry)


def match_cascade(left: DataFrame, right: DataFrame, left_key: str, right_key: str, strategies: list[tuple[str, list[Column]]]) -> DataFrame:
    """Matches by strategies in order of strength. Each strategy sees the left rows that the
    stronger ones left over; of several right rows the smallest key wins. All keys are taken in
    one pass over each side and cut, so texts are read once and only keys move."""
    from catalith.operators.similarity import cut

    named = [[f"_m{n}_{i}" for i in range(len(columns))] for n, (_, columns) in enumerate(strategies)]
    keyed = lambda df, key: cut(df.select(key, *[c.alias(k) for keys, (_, columns) in zip(named, strategies, strict=True) for k, c in zip(keys, columns, strict=True)]))
    rest, there, found = keyed(left, left_key), keyed(right, right_key), None
    for (name, _), keys in zip(strategies, named, strict=True):
        known = there.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
        best = known.groupBy(*keys).agg(F.min(right_key).alias(right_key))
        hit = cut(rest.join(best, keys).select(left_key, right_key, F.lit(name).alias("strategy")))
        found = hit if found is None else found.unionByName(hit)
        rest = rest.join(hit.select(left_key), left_key, "left_anti")
    return found


def clock_offsets(rows: DataFrame, camera: str, at: str, bucket: int, reach: int, sample: int = 400) -> DataFrame:
    """Offset of every camera's clock to that of the reference, the one with most rows (ties:
    the smaller): differences of at most `sample` evenly spaced times of each (the operator's
    own bound), the mode of their buckets (ties: the smaller), the mean of the differences
    within `reach` of it, and the share of the smaller sample that the mode holds. The
    reference's sample is bounded and is broadcast."""
    w = W.partitionBy(camera)
    n = rows.select(camera, at).withColumns({"_i": F.row_number().over(w.orderBy(at)) - 1, "_n": F.count(F.lit(1)).over(w)})
    strided = n.where(F.col("_i") % F.ceil(F.col("_n") / sample) == 0).select(camera, at)
    first = rows.groupBy(camera).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), camera).limit(1).select(F.col(camera).alias("reference"))
    reference = strided.join(F.broadcast(first), F.col(camera) == F.col("reference")).select("reference", F.col(at).alias("_r"))
    others = strided.join(F.broadcast(first), F.col(camera) != F.col("reference"), "left_semi")
    deltas = others.join(F.broadcast(reference)).select(camera, "reference", (F.col("_r") - F.col(at)).alias("d"))
    counted = deltas.groupBy(camera, F.floor(F.col("d") / bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    mode = counted.withColumn("_i", F.row_number().over(W.partitionBy(camera).orderBy(F.desc("n"), "bucket"))).where("_i = 1").drop("_i")
    sizes = strided.groupBy(camera).agg(F.count(F.lit(1)).alias("_own"))
    whole = reference.agg(F.count(F.lit(1)).alias("_all"))
    near = deltas.join(mode, camera).where(F.abs(F.col("d") - F.col("bucket") * bucket) <= reach)
    offset = near.groupBy(camera, "bucket", "n").agg(F.avg("d").cast("long").alias("offset"))
    least = F.least("_own", "_all")
    return offset.join(sizes, camera).crossJoin(F.broadcast(whole)).select(camera, "bucket", "offset", (F.least("n", least) / least).alias("confidence"))  # one row


def best_partners(actions: DataFrame, reactions: DataFrame, key: str, at: str, owner: str, value: str, reach: int, span: int = 16) -> DataFrame:
    """action, reaction, bonus: of each reaction the action of another owner at most `reach` away
    with the greatest bonus, (1 - gap / reach) * value to six places; ties by the smaller action.

    The bonus falls with the gap (rises, for negative values), so each side of a reaction is
    walked from the nearest action outwards (the farthest inwards) and left where the bonus gets
    smaller; no pair leaves a task. Of actions at one time the least of each of two owners are
    enough. A reaction meets the actions of its bucket of `span` times the reach and of the reach
    on both sides of it."""
    known = lambda df: df.where(F.col(at).isNotNull() & F.col(owner).isNotNull() & F.col(key).isNotNull())
    least = known(actions).groupBy(F.col(at).alias("at"), F.col(owner).alias("owner")).agg(F.min(key).alias("key"))
    least = least.withColumn("_i", F.row_number().over(W.partitionBy("at").orderBy("key"))).where("_i <= 2").drop("_i")
    wide = reach * span
    held = least.withColumn("_b", F.explode(F.sequence(F.floor((F.col("at") - reach) / wide), F.floor((F.col("at") + reach) / wide))))
    asked = known(reactions).select(F.col(at).alias("at"), F.col(owner).alias("owner"), F.col(key).alias("key"), F.col(value).cast("double").alias("value")).withColumn("_b", F.floor(F.col("at") / wide))

    def walked(t, i, step, v, mine, times, ids, owners):
        """Best bonus and its least action of each reaction on one side, from place i on."""
        best, who = np.full(len(t), -np.inf), np.full(len(t), -1)
        on = np.arange(len(t))
        while len(on):
            inside = (i[on] >= 0) & (i[on] < len(times))
            ahead = times[np.clip(i[on], 0, len(times) - 1)] - t[on]
            gap = np.abs(ahead)
            # Walked inwards (negative values), a side ends at the reaction itself.
            inside &= (gap <= reach) & ((ahead * step <= 0) | (v[on] >= 0))
            on, gap = on[inside], gap[inside]
            y = (1 - gap / float(reach)) * v[on]
            y = np.copysign(np.floor(np.abs(y) * 1e6 + 0.5), y) / 1e6
            at_ = i[on]
            other, better, equal = owners[at_] != mine[on], y > best[on], y == best[on]
            take = other & (better | (equal & (ids[at_] < ids[who[on]])))
            best[on[take]], who[on[take]] = y[take], at_[take]
            on = on[better | equal | ~np.isfinite(best[on])]
            i[on] += step
        return best, who

    def met(there: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
        if not len(here) or not len(there):
            return pd.DataFrame({"action": [], "reaction": [], "bonus": []})
        there = there.sort_values(["at", "key"])
        times, ids, owners = (there[c].to_numpy() for c in ("at", "key", "owner"))
        t, mine, v = here["at"].to_numpy(), here["owner"].to_numpy(), here["value"].to_numpy()
        v = np.where(np.isnan(v), 0.0, v)
        found = []
        for some, places in (
            (v >= 0, (lambda x: np.searchsorted(times, x, "left") - 1, lambda x: np.searchsorted(times, x, "left"))),
            (v < 0, (lambda x: np.searchsorted(times, x + reach, "right") - 1, lambda x: np.searchsorted(times, x - reach, "left"))),
        ):
            at_ = np.flatnonzero(some)
            (one, a), (two, b) = (walked(t[at_], place(t[at_]), step, v[at_], mine[at_], times, ids, owners) for place, step in zip(places, (-1, 1), strict=True))
            left = (one > two) | ((one == two) & (ids[a] < ids[b]))
            who, best = np.where(left, a, b), np.where(left, one, two)
            kept = np.isfinite(best)
            found.append(pd.DataFrame({"action": ids[who[kept]], "reaction": here["key"].to_numpy()[at_][kept], "bonus": np.where(here["value"].isna().to_numpy()[at_][kept], np.nan, best[kept])}))
        return pd.concat(found)

    return held.groupBy("_b").cogroup(asked.groupBy("_b")).applyInPandas(met, "action long, reaction long, bonus double")


def greedy_links(pairs: DataFrame, action: str, reaction: str, bonus: str, most: int) -> DataFrame:
    """Each reaction goes to its best action (bonus, then smaller action); each action keeps
    its `most` best reactions (bonus, then smaller reaction)."""
    one = pairs.withColumn("_i", F.row_number().over(W.partitionBy(reaction).orderBy(F.desc(bonus), action))).where("_i = 1")
    return one.withColumn("place", F.row_number().over(W.partitionBy(action).orderBy(F.desc(bonus), reaction))).where(F.col("place") <= most).drop("_i")
