"""Approximate search: a navigable graph for each part of the vectors, as a versioned table.

Vectors go to the nearest of a bounded number of pivots, and a pivot's vectors are dealt into
parts of bounded size by a hash of their key, so a third of all vectors in one place makes many
parts and not one large one. In a part each vector is linked to near ones that no other link
already leads to, and along a ring by key, so every vector can be reached. The graph is a table of
(part, key, vector, links) rows; an insertion links new vectors into the parts they fall into and
writes those parts alone under the next version, and a reader takes the newest version of each.

A query goes to all parts of its nearest pivots. In a part, the closest unvisited vector is
expanded until it is farther than the worst of the `width` best so far; the best of all parts are
merged. Recall depends on width and probes and is measured in the tests.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

PIVOTS, SHARE, DEGREE = 256, 1024, 12
BLOCK = 512  # queries that search a part together


def unit(rows) -> np.ndarray:
    rows = [np.asarray(x, np.float64) for x in rows]
    m = np.stack(rows) if rows else np.zeros((0, 1))
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def diverse(distance: np.ndarray, node: int, near: np.ndarray, most: int) -> list[int]:
    """Of candidates in ascending distance, those closer to the node than to any kept one."""
    kept: list[int] = []
    for c in near.tolist():
        if len(kept) == most:
            break
        if c != node and all(distance[c, k] > distance[node, c] for k in kept):
            kept.append(c)
    return kept


def linked(pdf: pd.DataFrame, old: int, links: list[list[int]] | None = None, degree: int = DEGREE) -> list[list[int]]:
    """Links of a part's rows (places in pdf, ordered by key). Rows before `old` have theirs and
    keep them, but for those that a new row should replace."""
    m = unit(pdf["vector"])
    distance = 1 - m @ m.T
    out = [list(x) for x in links or []] + [[] for _ in range(len(m) - old)]
    for node in range(old, len(m)):
        near = np.argsort(distance[node], kind="stable")[: 4 * degree]
        out[node] = diverse(distance, node, near, degree)
    for node in range(old, len(m)):  # both ways
        for other in list(out[node]):
            if node not in out[other]:
                out[other].append(node)
            if len(out[other]) > 2 * degree:
                near = np.array(sorted(out[other], key=lambda x: (distance[other, x], x)))
                out[other] = diverse(distance, other, near, 2 * degree)
    return out


def _part(pdf: pd.DataFrame, links: list[list[int]], version: int) -> pd.DataFrame:
    """Rows of the table; the ring by key joins what links alone would leave apart."""
    keys = pdf["key"].to_numpy()
    ring = np.roll(np.argsort(keys, kind="stable"), -1)[np.argsort(np.argsort(keys, kind="stable"), kind="stable")]
    named = [sorted({int(keys[j]) for j in [*row, int(ring[i])] if j != i}) for i, row in enumerate(links)]
    return pd.DataFrame({"pivot": pdf["pivot"], "sub": pdf["sub"], "key": keys, "vector": pdf["vector"], "links": named, "version": version})


TABLE = "pivot int, sub int, key long, vector array<double>, links array<long>, version int"


def placed(rows: DataFrame, pivots: np.ndarray, probes: int = 1) -> DataFrame:
    """key, vector, pivot: rows beside their nearest pivots (ties: the lower number)."""

    def each(frames):
        for pdf in frames:
            if len(pdf) and len(pivots):
                near = np.argsort(np.round(1 - unit(pdf["vector"]) @ pivots.T, 12), axis=1, kind="stable")[:, :probes]
                at = np.repeat(np.arange(len(pdf)), near.shape[1])
                yield pd.DataFrame({"key": pdf["key"].to_numpy()[at], "vector": pdf["vector"].to_numpy()[at], "pivot": near.ravel().astype(np.int32)})

    return rows.mapInPandas(each, "key long, vector array<double>, pivot int")


def _rows(base: DataFrame, key: str, vector: str) -> DataFrame:
    return base.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector")).where("vector IS NOT NULL")


def _pivots(spark: SparkSession, path: str) -> np.ndarray:
    """A bounded table: PIVOTS rows at most."""
    return unit(r["vector"] for r in spark.read.parquet(f"{path}/pivots").orderBy("place").collect())


def _choose(rows: DataFrame, path: str, share: int, most: int) -> None:
    """Pivots are the rows of the smallest hashes: one for each share of rows, `most` at most."""
    count = max(1, min(most, -(-rows.count() // share)))
    chosen = rows.orderBy(F.xxhash64("key"), "key").limit(count).select("vector").collect()
    rows.sparkSession.createDataFrame([(i, list(r["vector"])) for i, r in enumerate(chosen)], "place int, vector array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/pivots")


def build(base: DataFrame, key: str, vector: str, path: str, share: int = SHARE, most_pivots: int = PIVOTS, degree: int = DEGREE) -> None:
    """Writes pivots and graph (version 0) below path."""
    rows = _rows(base, key, vector)
    spark = base.sparkSession
    _choose(rows, path, share, most_pivots)
    near = placed(rows, _pivots(spark, path))
    parts = near.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / share).alias("parts"))  # PIVOTS rows at most
    dealt = near.join(F.broadcast(parts), "pivot").withColumn("sub", F.pmod(F.xxhash64("key", F.lit(7)), F.col("parts")).cast("int"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable").reset_index(drop=True)
        return _part(pdf, linked(pdf, 0, degree=degree), 0)

    dealt.select("pivot", "sub", "key", "vector").groupBy("pivot", "sub").applyInPandas(one, TABLE).write.parquet(f"{path}/graph/at=0")


def latest(spark: SparkSession, path: str) -> DataFrame:
    """Every part in its newest version."""
    every = spark.read.schema(TABLE).option("recursiveFileLookup", True).parquet(f"{path}/graph")
    newest = every.groupBy("pivot", "sub").agg(F.max("version").alias("version"))
    return every.join(newest, ["pivot", "sub", "version"], "left_semi")


def insert(rows: DataFrame, key: str, vector: str, path: str, share: int = SHARE, degree: int = DEGREE) -> int:
    """Links rows whose keys the index lacks into the parts they fall into, and writes those
    parts as the next version; how many parts were written. Full parts (of 2 * share rows) stay
    as they are: what would go there opens a new part of its pivot."""
    spark = rows.sparkSession
    now = latest(spark, path)
    fresh = _rows(rows, key, vector).join(now.select("key"), "key", "left_anti").dropDuplicates(["key"])
    sizes = now.groupBy("pivot", "sub").count()
    room = sizes.where(F.col("count") < 2 * share).groupBy("pivot").agg(F.array_sort(F.collect_list("sub")).alias("open"))
    used = sizes.groupBy("pivot").agg((F.max("sub") + 1).alias("next")).join(room, "pivot", "left")  # a row for each pivot
    pivots = _pivots(spark, path)
    if not len(pivots):  # the index was built of nothing
        _choose(fresh, path, share, PIVOTS)
        pivots = _pivots(spark, path)
    near = placed(fresh, pivots).join(F.broadcast(used), "pivot", "left")
    some = F.pmod(F.xxhash64("key", F.lit(7)), F.size("open")).cast("int")
    sub = F.when(F.size("open") > 0, F.get("open", some)).otherwise(F.coalesce("next", F.lit(0)))
    fresh = near.select("pivot", sub.alias("sub"), "key", "vector")
    version = (now.agg(F.max("version")).first()[0] or 0) + 1
    touched = now.join(fresh.select("pivot", "sub").distinct(), ["pivot", "sub"], "left_semi").select("pivot", "sub", "key", "vector", "links")

    def grown(_, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        old = old.sort_values("key", kind="stable")
        pdf = pd.concat((old[["pivot", "sub", "key", "vector"]], new.sort_values("key", kind="stable"))).reset_index(drop=True)
        place = {k: i for i, k in enumerate(old["key"])}
        return _part(pdf, linked(pdf, len(old), [[place[k] for k in x] for x in old["links"]], degree), version)

    fresh_parts = touched.groupBy("pivot", "sub").cogroup(fresh.groupBy("pivot", "sub")).applyInPandas(grown, TABLE)
    fresh_parts.write.parquet(f"{path}/graph/at={version}")
    return spark.read.schema(TABLE).parquet(f"{path}/graph/at={version}").select("pivot", "sub").distinct().count()


def beam(m: np.ndarray, links: list[np.ndarray], query: np.ndarray, start: int, width: int) -> list[tuple[float, int]]:
    """The `width` best (distance, place) found from `start` along the links."""
    seen = np.zeros(len(m), bool)
    seen[start] = True
    first = (float(1 - m[start] @ query), start)
    ahead, best = [first], [(-first[0], -start)]
    while ahead:
        d, node = heapq.heappop(ahead)
        if len(best) == width and d > -best[0][0]:
            break
        fresh = links[node][~seen[links[node]]]
        seen[fresh] = True
        for dist, place in zip((1 - m[fresh] @ query).tolist(), fresh.tolist(), strict=True):
            if len(best) < width or dist < -best[0][0]:
                heapq.heappush(ahead, (dist, place))
                (heapq.heappush if len(best) < width else heapq.heappushpop)(best, (-dist, -place))
    return sorted((-d, -p) for d, p in best)


def search(spark: SparkSession, path: str, queries: DataFrame, key: str, vector: str, k: int = 10, width: int = 64, probes: int = 8) -> DataFrame:
    """key, neighbour, distance, place: about the k nearest of each query, itself excluded; ties
    by key. Queries of a part go in blocks, each beside a copy of the part."""
    pivots = _pivots(spark, path)
    asked = placed(_rows(queries, key, vector), pivots, probes)
    table = latest(spark, path).select("pivot", "sub", "key", "vector", "links")
    blocks = asked.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))  # PIVOTS rows at most
    parts = table.select("pivot", "sub").distinct()
    asked = asked.join(F.broadcast(blocks), "pivot").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).join(parts, "pivot").select("pivot", "sub", "block", "key", "vector").toDF("in_pivot", "in_sub", "in_block", "key", "vector")
    table = table.join(F.broadcast(blocks), "pivot").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def walk(_, here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(here) and len(there):
            here = here.sort_values("key", kind="stable")
            keys, m = here["key"].to_numpy(), unit(here["vector"])
            links = [np.searchsorted(keys, np.asarray(x, np.int64)) for x in here["links"]]
            start = int(np.argmax(m @ m.mean(0)))
            for one, query in zip(there["key"].tolist(), unit(there["vector"]), strict=True):
                near = [(one, int(keys[p]), d) for d, p in beam(m, links, query, start, max(width, k + 1)) if keys[p] != one]
                found += near[:k]
        return pd.DataFrame(found, columns=["key", "neighbour", "distance"])

    met = table.groupBy("pivot", "sub", "block").cogroup(asked.groupBy("in_pivot", "in_sub", "in_block")).applyInPandas(walk, "key long, neighbour long, distance double")
    ranked = met.withColumn("distance", F.round(F.greatest("distance", F.lit(0.0)), 9)).withColumn("place", F.row_number().over(W.partitionBy("key").orderBy("distance", "neighbour")))
    return ranked.where(F.col("place") <= k).withColumnRenamed("key", key)
