"""Window and sequence operators over ordered rows of a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from catalith.functions.columns import clamp, upper_element
from catalith.operators.metrics import range_bounds, range_of
from catalith.operators.similarity import cut


def sweep_medians(times: np.ndarray, values: np.ndarray, asked: np.ndarray, around: int) -> np.ndarray:
    """For each asked time (ascending) the upper median of the values at times (ascending) within
    `around` of it; NaN without any. Values enter and leave a tree of counts by rank, so each
    costs a logarithm, however many are in reach."""
    n = len(values)
    order = np.argsort(values, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(1, n + 1)
    rank, tree, top = rank.tolist(), [0] * (n + 1), 1 << max(n, 1).bit_length() - 1

    def add(i: int, by: int) -> None:
        while i <= n:
            tree[i] += by
            i += i & -i

    first = np.searchsorted(times, asked - around, "left").tolist()
    last = np.searchsorted(times, asked + around, "right").tolist()
    out, lo, hi = np.full(len(asked), np.nan), 0, 0
    for j, (a, b) in enumerate(zip(first, last, strict=True)):
        for i in range(hi, b):
            add(rank[i], 1)
        for i in range(lo, a):
            add(rank[i], -1)
        lo, hi = a, b
        if b > a:
            want, at, step = (b - a) // 2, 0, top
            while step:
                if at + step <= n and tree[at + step] <= want:
                    at += step
                    want -= tree[at]
                step >>= 1
            out[j] = values[order[at]]
    return out


def rolling_upper_medians(rows: DataFrame, group: str, at: str, key: str, value: str, around: int, block: int = 4096) -> DataFrame:
    """group, key and median: of each row of groups of more than `block` rows, the upper median of
    the values of its group within `around`. Ranges of `at` of about `block` rows are swept apart;
    each also has the rows of other ranges that lie within its reach."""
    large, size = long_groups(rows, group, block)
    kinds = dict(rows.dtypes)
    some = rows.select(group, at, key, value).join(large.select(group), group, "left_semi")
    bounds = range_bounds(some, at, max(1, -(-size // block)))
    place = lambda x: F.size(F.filter(bounds, lambda q: q <= x))
    near = some.select("*", place(F.col(at)).alias("_own"), F.explode(F.sequence(place(F.col(at) - around), place(F.col(at) + around))).alias("_range"))

    def swept(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at, kind="stable")
        known, mine = pdf[pdf[value].notna()], pdf[pdf["_own"] == pdf["_range"]]
        found = sweep_medians(known[at].to_numpy(), known[value].to_numpy(float), mine[at].to_numpy(), around)
        return pd.DataFrame({group: mine[group], key: mine[key], "median": found}).astype({"median": "Float64"})

    return near.groupBy(group, "_range").applyInPandas(swept, f"`{group}` {kinds[group]}, `{key}` {kinds[key]}, median double")


def cadence_windows(rows: DataFrame, group: str, at: str, key: str, around: int, scale: float, low: float, high: float, block: int = 4096) -> DataFrame:
    """Adaptive session window of each row: `scale` times the upper median of the forward gaps
    whose left row lies within `around`, clamped; `high` where there is none. Groups of at most
    `block` rows gather the gaps of a window; larger ones are swept, see rolling_upper_medians."""
    order = W.partitionBy(group).orderBy(at, key)
    gaps = rows.withColumn("gap", F.greatest(F.lead(at).over(order) - F.col(at), F.lit(0)))
    near = W.partitionBy(group).orderBy(at).rangeBetween(-around, around)
    large, size = long_groups(rows, group, block)
    windowed = lambda df, median: df.withColumn("window", clamp(F.coalesce(median * scale, F.lit(high)), low, high))
    short = windowed(gaps.join(large.select(group), group, "left_anti") if size else gaps, upper_element(F.collect_list("gap").over(near), 1, 2))
    if not size:
        return short
    medians = rolling_upper_medians(gaps, group, at, key, "gap", around, block)
    return short.unionByName(windowed(gaps.join(medians, [group, key]), F.col("median")).drop("median"))


def sessions(rows: DataFrame, group: str, at: str, key: str, breaks: Column) -> DataFrame:
    """Numbers the sessions of each group: a new one starts where `breaks` holds; in it the
    column `gap` is the distance to the row before."""
    order = W.partitionBy(group).orderBy(at, key)
    return rows.withColumn("gap", F.col(at) - F.lag(at).over(order)).withColumn("session", F.sum(F.when(F.col("gap").isNull() | breaks, 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0)))


def islands(rows: DataFrame, group: str, at: str, key: str, hard_gap: int) -> DataFrame:
    """Gaps-and-islands: one row for each run without a gap of at least hard_gap."""
    s = sessions(rows, group, at, key, F.col("gap") >= hard_gap)
    return s.groupBy(group, "session").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("rows"))


def smoothed(rows: DataFrame, group: str, at: str, key: str, value: str) -> DataFrame:
    """Three-point kernel (1/4, 1/2, 1/4) with mirrored ends; groups of fewer than three rows
    keep their values."""
    order, by = W.partitionBy(group).orderBy(at, key), W.partitionBy(group)
    before, after = F.lag(value).over(order), F.lead(value).over(order)
    kernel = 0.25 * F.coalesce(before, after) + 0.5 * F.col(value) + 0.25 * F.coalesce(after, before)
    return rows.withColumn("smooth", F.when(F.count(F.lit(1)).over(by) < 3, F.col(value)).otherwise(kernel))


def peaks(rows: DataFrame, group: str, value: str, key: str) -> DataFrame:
    """Best row of each group (ties: the smaller key) and its margin over the runner-up,
    relative to the best; margin 1 where there is no other."""
    by = W.partitionBy(group).orderBy(F.desc(value), key)
    two = rows.withColumns({"_i": F.row_number().over(by), "second": F.lead(value).over(by)}).where("_i = 1")
    return two.select(group, key, value, F.when(F.col("second").isNull(), 1.0).when(F.col(value) > 0, (F.col(value) - F.col("second")) / F.col(value)).otherwise(0.0).alias("margin"))


def change_signal(rows: DataFrame, group: str, at: str, key: str, value: str, kind: str) -> DataFrame:
    """Fused distance of each row to the one before: value distance over the root of the gap
    in seconds, change of kind, and the logarithm of the gap."""
    order = W.partitionBy(group).orderBy(at, key)
    s = rows.withColumns({"_gap": (F.col(at) - F.lag(at).over(order)) / 1e6, "_dv": F.abs(F.col(value) - F.lag(value).over(order)), "_dk": (F.col(kind) != F.lag(kind).over(order)).cast("double")})
    return s.withColumn("signal", F.when(F.col("_gap").isNull(), 0.0).otherwise(0.5 * F.col("_dv") / 100 / F.sqrt(F.greatest("_gap", F.lit(1.0))) + 0.35 * F.col("_dk") + 0.15 * F.least(F.ln(1 + F.col("_gap")) / F.lit(12.0), F.lit(1.0)))).drop("_gap", "_dv", "_dk")


#: Log scores are whole multiples of 1 / FINE, so that sums do not depend on how they are cut.
FINE = 1 << 20


def fine(scores: np.ndarray) -> np.ndarray:
    return np.rint(scores * FINE).astype(np.int64)


def viterbi(scores: np.ndarray, transition: np.ndarray) -> list[int]:
    """Best path for log scores of each step and state from a uniform start; ties: the lower state."""
    best, back = scores[0].copy(), []
    for step in scores[1:]:
        reach = best[:, None] + transition
        back.append(reach.argmax(0))
        best = reach.max(0) + step
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def block_product(scores: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Best score of a block from each state before it (rows) to each state at its end."""
    best = transition + scores[0]
    for step in scores[1:]:
        best = (best[:, :, None] + transition[None]).max(1) + step
    return best


def block_paths(scores: np.ndarray, transition: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(paths, entries): for each state at a block's end the best states along it, and the state
    before it (-1 for a group's first block), given the best scores before it."""
    n, states = scores.shape
    back = np.full((n, states), -1)
    best = scores[0].copy()
    for i in range(n):
        if i or before is not None:
            reach = (best if i else before)[:, None] + transition
            back[i], best = reach.argmax(0), reach.max(0) + scores[i]
    paths = np.empty((n, states), np.int64)
    paths[-1] = np.arange(states)
    for i in range(n - 1, 0, -1):
        paths[i - 1] = back[i][paths[i]]
    return paths, back[0][paths[0]]


def chain_transition(states: int, stay: float = 0.8, forward: float = 0.14, back: float = 0.04, other: float = 0.02) -> np.ndarray:
    """Log transition matrix of an ordered chain whose last state is `other`: forward and
    backward mass falls with distance; rows sum to one."""
    m = np.zeros((states, states))
    last = states - 1
    for i in range(last):
        m[i, i] = stay
        for mass, to in ((forward, range(i + 1, last)), (back, range(i - 1, -1, -1))):
            norm = sum(1 / abs(j - i) for j in to)
            for j in to:
                m[i, j] = mass / abs(j - i) / norm
        m[i, last] = other
    m[last] = (1 - stay) / max(1, last)
    m[last, last] = stay
    return np.log(np.maximum(m / m.sum(1, keepdims=True), 1e-12))


def long_groups(rows: DataFrame, group: str, block: int) -> tuple[DataFrame, int]:
    """(group, _n) of groups of more than `block` rows, and their rows together."""
    large = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block)
    return large, int(large.agg(F.sum("_n")).first()[0] or 0)


def viterbi_smoothed(rows: DataFrame, group: str, at: str, key: str, state: str, states: list[str], trust: float = 0.6, block: int = 4096) -> DataFrame:
    """Most likely state of each row of its group's chain; observations carry `trust` on the
    observed state; of equally likely paths, the lowest states from the end.

    Groups of more than `block` rows are cut into blocks of a range of `at`, of ranges that hold
    about `block` rows of all such groups. A block is first one matrix of best scores between
    the state before it and that at its end; a group's matrices are multiplied in order (max,
    plus), which gives the best scores before each block; with those each block finds its path
    for every state at its end, and the state before it; the states at the ends are then read
    off from the last block to the first. Only matrices and states of a long group, one row for
    each block, meet in one task."""
    transition, index = fine(chain_transition(len(states))), {s: i for i, s in enumerate(states)}
    n, (low, high) = len(states), fine(np.log([(1 - trust) / (len(states) - 1), trust])).tolist()
    kinds = dict(rows.dtypes)
    g, k = f"`{group}` {kinds[group]}", f"`{key}` {kinds[key]}"

    def scores(pdf: pd.DataFrame) -> np.ndarray:
        seen = np.full((len(pdf), n), low, np.int64)
        seen[np.arange(len(pdf)), pdf[state].map(index).to_numpy()] = high
        return seen

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        seen = scores(pdf.sort_values([at, key], kind="stable"))
        alone = seen[:1] if len(seen) == 1 else None
        first = seen[0] if alone is not None else (seen[0][:, None] + block_product(seen[1:], transition)).max(0)
        return pd.DataFrame({group: pdf[group].iloc[:1], "block": pdf["block"].iloc[:1], "first": [first.tolist()], "product": [block_product(seen, transition).ravel().tolist()]})

    def before(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, best, out = pdf.sort_values("block"), None, []
        for first, matrix in zip(pdf["first"], pdf["product"], strict=True):
            out.append(None if best is None else best.tolist())
            best = np.asarray(first) if best is None else (best[:, None] + np.asarray(matrix).reshape(n, n)).max(0)
        return pd.DataFrame({group: pdf[group], "block": pdf["block"], "before": out, "last": [*[None] * (len(out) - 1), int(best.argmax())]}).astype({"last": "Int32"})

    def paths(_, pdf: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([at, key], kind="stable")
        start = given["before"].iloc[0]
        ways, entries = block_paths(scores(pdf), transition, None if start is None else np.asarray(start))
        return pd.DataFrame({group: pdf[group], key: pdf[key], "block": pdf["block"], "ways": ways.tolist(), "entries": [entries.tolist(), *[None] * (len(pdf) - 1)]})

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", ascending=False)
        end, out = int(pdf["last"].iloc[0]), []
        for entries in pdf["entries"]:
            out.append(end)
            end = int(entries[end])
        return pd.DataFrame({group: pdf[group], "block": pdf["block"], "end": out})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([at, key], kind="stable")
        return pd.DataFrame({group: pdf[group], key: pdf[key], "smoothed": [states[i] for i in viterbi(scores(pdf), transition)]})

    rows = rows.select(group, at, key, state)
    large, size = long_groups(rows, group, block)
    short = rows.join(large, group, "left_anti") if size else rows
    done = short.groupBy(group).applyInPandas(whole, f"{g}, {k}, smoothed string")
    if not size:
        return done
    long_ = rows.join(large.select(group), group, "left_semi")
    dealt = long_.withColumn("block", range_of(long_, at, -(-size // block)))
    by = [group, "block"]
    products = dealt.groupBy(*by).applyInPandas(product, f"{g}, block int, first array<long>, product array<long>")
    given = cut(products.groupBy(group).applyInPandas(before, f"{g}, block int, before array<long>, last int"))
    ways = cut(dealt.groupBy(*by).cogroup(given.groupBy(*by)).applyInPandas(paths, f"{g}, {k}, block int, ways array<int>, entries array<int>"))
    exits = ways.where("entries IS NOT NULL").select(*by, "entries").join(given.select(*by, "last"), by).groupBy(group).applyInPandas(ends, f"{g}, block int, end int")
    names = F.array(*[F.lit(s) for s in states])
    return done.unionByName(ways.join(exits, by).select(group, key, F.get(names, F.get("ways", F.col("end"))).alias("smoothed")))


def change_points(signal: np.ndarray, penalty: float) -> list[int]:
    """Exact optimal partition of a series into runs of least squared error plus a penalty for
    each run, with pruning; start of each run. All rows belong to a run."""
    n = len(signal)
    s, s2 = np.concatenate(([0], np.cumsum(signal))), np.concatenate(([0], np.cumsum(signal * signal)))
    best, from_, alive = np.zeros(n + 1), np.zeros(n + 1, int), np.array([0])
    best[0] = -penalty
    for to in range(1, n + 1):
        size = to - alive
        cost = best[alive] + (s2[to] - s2[alive]) - (s[to] - s[alive]) ** 2 / size
        i = int(cost.argmin())
        best[to], from_[to] = cost[i] + penalty, alive[i]
        alive = np.append(alive[cost <= best[to]], to)
    out, at = [], n
    while at > 0:
        at = int(from_[at])
        out.append(at)
    return out[::-1]


def segments(signal: np.ndarray, least: int, most: int, low: float = 5e-4, high: float = 40.0, steps: int = 18) -> list[int]:
    """Change points under a penalty found by bisection until least <= runs <= most."""
    runs = [0]
    for _ in range(steps):
        middle = float(np.sqrt(low * high))
        runs = change_points(signal, middle)
        if len(runs) > most:
            low = middle
        elif len(runs) < least:
            high = middle
        else:
            break
    return runs


def segmented(rows: DataFrame, group: str, at: str, key: str, signal: str, least: int, most: int) -> DataFrame:
    """Numbers the runs of each group's series; least and most bound how many runs there are."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([at, key], kind="stable")
        starts = segments(pdf[signal].to_numpy(float), min(least, len(pdf)), most)
        return pd.DataFrame({group: pdf[group], key: pdf[key], "segment": np.searchsorted(starts, np.arange(len(pdf)), "right")})

    kinds = dict(rows.dtypes)
    return rows.select(group, at, key, signal).groupBy(group).applyInPandas(one, f"{group} {kinds[group]}, {key} {kinds[key]}, segment long")
