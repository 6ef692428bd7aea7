"""Runs, levels, influence and child rows: what turns rows into the structure around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W


def short_runs_merged(rows: DataFrame, group: str, at: str, key: str, kind: str, least: int, shortest: int, support: str | None = None, distinct: float = 0.25) -> DataFrame:
    """Adds `segment`: runs of equal `kind` in order. A run stands by itself if it has at least
    `least` rows and lasts `shortest`, or if its mean support is at least `distinct` and its kind
    is not that of the run before it that stands; the rest is taken in by the segment before.
    A group's first run stands in any case. Without `support`, only length counts.

    Whether the run before stands decides what its kind is compared with, so runs (not rows)
    are gone through in order; the kind of a segment is that of most of its rows, the smaller of
    equals. With `support` a group's runs, one narrow row each, pass through one task."""
    order = W.partitionBy(group).orderBy(at, key)
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    new = F.coalesce((F.lag(kind).over(order) != F.col(kind)).cast("int"), F.lit(1))
    runs = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(so_far))
    mean = F.avg(support) if support else F.lit(0.0)
    each = runs.groupBy(group, "_run").agg(F.first(kind).alias("_kind"), F.count(F.lit(1)).alias("_n"), (F.max(at) - F.min(at)).alias("_lasts"), mean.alias("_support"))
    kinds = dict(each.dtypes)
    stands = (F.col("_n") >= least) & (F.col("_lasts") >= shortest)

    def one(pdf):
        pdf = pdf.sort_values("_run")
        segment, opens, held = 0, [], {}
        for kind_, n, long_enough, mean_ in zip(pdf["_kind"], pdf["_n"], pdf["_stands"], pdf["_support"], strict=True):
            now = min(held, key=lambda k: (-held[k], k)) if held else None
            if now is None or long_enough or (support and kind_ != now and mean_ >= distinct):
                segment, held = segment + 1, {}
            held[kind_] = held.get(kind_, 0) + n
            opens.append(segment)
        return pdf[[group, "_run"]].assign(segment=opens)

    if support:
        numbered = each.withColumn("_stands", stands).groupBy(group).applyInPandas(one, f"`{group}` {kinds[group]}, _run long, segment long")
    else:
        opens = F.when(stands | (F.col("_run") == 1), 1).otherwise(0)
        numbered = each.select(group, "_run", F.sum(opens).over(W.partitionBy(group).orderBy("_run").rowsBetween(W.unboundedPreceding, 0)).alias("segment"))
    return runs.join(numbered, [group, "_run"]).drop("_new", "_run")


def levels(edges: DataFrame, nodes: DataFrame, most: int = 64) -> DataFrame:
    """(node, level) of a directed acyclic graph of (a, b) edges: the longest path that ends in
    the node. Each round moves one step along the edges and is cut in the checkpoint folder."""
    from catalith.operators.similarity import cut

    edges = cut(edges.select("a", "b"))
    inner = edges.select(F.col("b").alias("node")).distinct()
    front = cut(nodes.select("node").distinct().join(inner, "node", "left_anti"))
    found = front.withColumn("level", F.lit(0))
    for level in range(1, most + 1):
        front = cut(front.join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct())
        if front.isEmpty():
            return found.groupBy("node").agg(F.max("level").alias("level"))
        found = found.unionByName(front.withColumn("level", F.lit(level)))
    raise RuntimeError(f"the graph has a cycle or a path of more than {most} edges")


def capped_influence(rows: DataFrame, group: str, most: float) -> DataFrame:
    """group, rows and weight: a group with a larger share of all rows than the cap is weighed
    down until its share of the weighed rows is the cap: weight x rows = cap / (1 - cap) x the
    other rows. The cap is never below an equal share of the groups."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("rows"))
    total = sizes.agg(F.sum("rows").alias("_all"), F.greatest(F.lit(most), 1 / F.count(F.lit(1))).alias("_cap"))
    share, cap = F.col("rows") / F.col("_all"), F.col("_cap")
    held = cap * (F.col("_all") - F.col("rows")) / (F.nullif(1 - cap, F.lit(0.0)) * F.col("rows"))
    weight = F.when((share > cap + 1e-6) & (cap < 1), F.least(F.lit(1.0), held)).otherwise(1.0)
    return sizes.crossJoin(F.broadcast(total)).select(group, "rows", weight.alias("weight"))  # one row


def lifted(rows: DataFrame, group: str, value: str, most: float) -> DataFrame:
    """Adds `lifted`: each value moved towards its group's mean by at most `most`."""
    step = F.avg(value).over(W.partitionBy(group)) - F.col(value)
    return rows.withColumn("lifted", F.col(value) + F.least(F.greatest(step, F.lit(-most)), F.lit(most)))


def reason_rows(rows: DataFrame, key: str, reasons: dict[str, Column]) -> DataFrame:
    """Child rows (key, place, reason) of the reasons that hold, in the order given."""
    held = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in reasons.items()]))
    return rows.select(key, F.posexplode(held).alias("place", "reason"))


def strongest_reasons(rows: DataFrame, key: str, reason: str, weight: str, n: int) -> DataFrame:
    """key and its n heaviest reasons as text; ties by reason. The reasons of a key are few."""
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col(weight)).alias("w"), F.col(reason).alias("r")))), 1, n)
    return rows.groupBy(key).agg(F.array_join(F.transform(best, lambda s: s["r"].cast("string")), ",").alias("reasons"))


def with_handles(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    """Replaces a key by a stable handle: its place among the distinct keys, which are numbered
    apart from the rows. The keys (projects, tenants) are few."""
    handles = rows.select(key).distinct().withColumn("handle", F.concat(F.lit(prefix), F.row_number().over(W.orderBy(key)).cast("string")))
    return rows.join(handles, key).drop(key)


def least_error(rows: DataFrame, key: str, candidates: DataFrame, error: Column, veto: Column) -> DataFrame:
    """The candidate of a bounded literal table with the least error that no veto hits; ties by
    name. `candidates` has a column `candidate` and is broadcast."""
    scored = rows.crossJoin(F.broadcast(candidates)).where(~veto).withColumn("error", error)
    best = scored.groupBy(key).agg(F.min(F.struct(F.round("error", 9).alias("error"), "candidate")).alias("b"))
    return best.select(key, "b.candidate", "b.error")


def band_statistics(rows: DataFrame, band: Column, angle: Column) -> DataFrame:
    """rows, circular mean in degrees and cohesion (length of the mean unit vector) of each band."""
    x, y = F.avg(F.cos(F.radians(angle))), F.avg(F.sin(F.radians(angle)))
    sums = rows.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("rows"), x.alias("_x"), y.alias("_y"))
    mean = F.degrees(F.atan2("_y", "_x"))
    return sums.select("band", "rows", F.when(mean < 0, mean + 360).otherwise(mean).alias("mean"), F.sqrt(F.col("_x") ** 2 + F.col("_y") ** 2).alias("cohesion"))
