"""Vector and hash similarity, components and clustering."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from catalith.functions.columns import hamming, sign_bits
from catalith.sources.tables import shared_folder


def nearest(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int, block: int = 4096) -> DataFrame:
    """The k nearest base rows of each query row by cosine distance, itself excluded; ties by
    key. Of a block of queries and a block of base rows, one matrix product and a partial top-k
    stand for all pairs, so k rows leave for each query and block."""

    def closest(here, there, distance):
        ids = there[key].to_numpy(np.int64)
        order = np.lexsort((np.broadcast_to(ids, distance.shape), distance), axis=1)[:, :k]
        best = np.take_along_axis(distance, order, 1)
        keep = np.isfinite(best)
        return pd.DataFrame({key: np.repeat(here[key].to_numpy(), keep.sum(1)), "neighbour": ids[order][keep], "distance": best[keep]})

    found = against_all(queries, base, key, vector, closest, f"`{key}` long, neighbour long, distance double", block)
    ranked = found.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("distance", "neighbour")))
    return ranked.where(F.col("place") <= k)


def within_radius(queries: DataFrame, base: DataFrame, key: str, vector: str, radius: float, block: int = 4096) -> DataFrame:
    """key, hits, nearest: how many base rows lie within a cosine distance of each query row that
    has any, itself excluded, and the distance of the nearest. Counted where pairs are compared,
    by distances that are neither rounded nor clipped."""

    def hits(here, there, distance):
        return pd.DataFrame({key: here[key], "hits": (distance <= radius).sum(1), "nearest": distance.min(1)}).query("hits > 0")

    found = against_all(queries, base, key, vector, hits, f"`{key}` long, hits long, nearest double", block, digits=None)
    return found.groupBy(key).agg(F.sum("hits").alias("hits"), F.min("nearest").alias("nearest"))


def swept(queries: DataFrame, base: DataFrame, key: str, vector: str, label: str, thresholds: list[float], block: int = 4096) -> DataFrame:
    """threshold, named (base rows within it of the queries) and right (those of the query's label)."""

    def counts(here, there, distance):
        same = here[label].to_numpy()[:, None] == there[label].to_numpy()[None, :]
        return pd.DataFrame([(t, int((distance <= t).sum()), int(((distance <= t) & same).sum())) for t in thresholds], columns=["threshold", "named", "right"])

    found = against_all(queries, base, key, vector, counts, "threshold double, named long, right long", block, (label,))
    return found.groupBy("threshold").agg(F.sum("named").alias("named"), F.sum("right").alias("right"))


def against_all(queries: DataFrame, base: DataFrame, key: str, vector: str, pick, shape: str, block: int = 4096, extra: tuple[str, ...] = (), digits: int | None = 9) -> DataFrame:
    """A stated query set against all base rows, exactly: both are dealt into blocks of about
    `block` rows by a hash of their keys, each block of queries meets each block of base rows in
    a task of its own, and `pick` turns their distances (rows: queries; infinite for itself)
    into rows of `shape`; without `digits` distances stay as the product gives them. Nothing passes through the driver, and vectors are copied once for
    each block of the other side, against which they bring `block` products."""
    parts = lambda df: max(1, -(-df.count() // block))
    asked, held = parts(queries), parts(base)
    dealt = lambda df, mine, n, other, m: df.select(key, vector, *extra, F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))

    def met(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(here) and len(there):
            matrix, other = (np.stack(x[vector].to_numpy()).astype(np.float64) for x in (here, there))
            for at in range(0, len(here), 512):
                some = here.iloc[at : at + 512]
                distance = 1 - matrix[at : at + 512] @ other.T
                if digits is not None:
                    distance = np.round(np.clip(distance, 0, 2), digits)
                distance[some[key].to_numpy()[:, None] == there[key].to_numpy()[None, :]] = np.inf
                out.append(pick(some, there, distance))
        return pd.concat(out) if out else pd.DataFrame(columns=[x.strip().split()[0].strip("`") for x in shape.split(",")])

    left = dealt(queries, "_q", asked, "_b", held).groupBy("_q", "_b")
    right = dealt(base, "_b", held, "_q", asked).withColumnsRenamed({"_b": "_held", "_q": "_asked"}).groupBy("_asked", "_held")
    return left.cogroup(right).applyInPandas(met, shape)


def within(base: DataFrame, key: str, vector: str, radius: float, planes: int = 8, tables: int = 12, seed: int = 9) -> DataFrame:
    """Pairs (a < b) within a cosine distance, among rows that share the signs of `planes`
    random projections in one of `tables` tables. Candidates are joined on the table and its
    signs and compared exactly; recall is that of the tables (see the tests)."""
    width = len(base.select(vector).head()[0]) if base.head(1) else 1
    hyper = np.random.default_rng(seed).standard_normal((tables, planes, width))

    def each(frames):
        for pdf in frames:
            m = np.stack(pdf[vector].to_numpy()).astype(np.float64) if len(pdf) else np.zeros((0, width))
            for i in range(tables):
                yield pd.DataFrame({key: pdf[key], "spot": (i << planes) + ((m @ hyper[i].T > 0) << np.arange(planes)).sum(1)})

    spots = base.select(key, vector).mapInPandas(each, f"{key} long, spot long")
    pairs = spots.withColumnRenamed(key, "a").join(spots.withColumnRenamed(key, "b"), "spot").where("a < b").select("a", "b").distinct()
    return measured(pairs, base, key, vector).where(F.col("distance") <= radius)


def measured(pairs: DataFrame, base: DataFrame, key: str, vector: str) -> DataFrame:
    from catalith.functions.columns import cosine_distance

    side = lambda n: base.select(F.col(key).alias(n), F.col(vector).alias(f"_{n}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", cosine_distance("_a", "_b").alias("distance"))


def group_pairs(base: DataFrame, key: str, vector: str, group: str) -> DataFrame:
    """Distances of all pairs of a group: for groups of bounded size (bursts, moments)."""
    from catalith.functions.columns import cosine_distance

    s = lambda n: base.select(group, F.col(key).alias(n), F.col(vector).alias(f"_{n}"))
    return s("a").join(s("b"), group).where("a < b").select(group, "a", "b", cosine_distance("_a", "_b").alias("distance"))


def medoids(base: DataFrame, key: str, vector: str, group: str) -> DataFrame:
    """The member of each group with the least total distance to the others; ties by key.
    Of unit vectors the total is n minus the product with the group's sum, so no pair is made."""
    from catalith.functions.columns import dot

    parts = base.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.sum(F.col("x").cast("double")).alias("x"))
    sums = parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("_sum"))
    n = base.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    total = base.join(sums, group).join(n, group).withColumn("total", F.round(F.col("_n") - dot(vector, "_sum"), 6))
    return total.withColumn("_i", F.row_number().over(W.partitionBy(group).orderBy("total", key))).where("_i = 1").select(group, key, "total")


def diversity(base: DataFrame, vector: str, group: str, scale: float = 0.3) -> DataFrame:
    """Mean pairwise cosine distance of each group of unit vectors over `scale`, clamped to
    0..1; from the squared length of the group's sum, without pairs."""
    parts = base.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.sum(F.col("x").cast("double")).alias("x"))
    squares = parts.groupBy(group).agg(F.sum(F.col("x") * F.col("x")).alias("_s2"))
    own = base.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("_own"))
    mean = 1 - (F.col("_s2") - F.col("_own")) / (F.col("_n") * (F.col("_n") - 1))
    return own.join(squares, group).select(group, F.when(F.col("_n") > 1, F.least(F.greatest(mean / scale, F.lit(0.0)), F.lit(1.0))).otherwise(0.0).alias("diversity"))


def with_hash(base: DataFrame, vector: str) -> DataFrame:
    return base.withColumn("bits", sign_bits(vector))


def band_radii(radius: int, bands: int) -> list[int]:
    """How far each band may differ: hashes within `radius` bits agree that far in one band at
    least, as the radii and one more for each band add up to radius + 1. -1: not looked at."""
    return [(radius + 1 + i) // bands - 1 for i in range(bands)]


def hash_pairs(hashes: DataFrame, bits: str, radius: int, width: int = 64, band: int = 16, most: float = 0.002, block: int = 16384) -> DataFrame:
    """(x, y, distance) of distinct hashes x < y that differ in at most `radius` bits, exactly.

    Where at most a share `most` of random pairs would be candidates of it, by multi-index
    hashing; beyond that (3.4 % at radius 14 of 64) joining candidates costs more than comparing
    all pairs, and blocks of hashes meet."""
    one = hashes.select(F.col(bits).alias("x")).distinct()
    looked = sum(sum(m.bit_count() <= n for m in range(1 << band)) for n in band_radii(radius, -(-width // band)))
    return looked_up(one, radius, width, band) if looked <= most * (1 << band) else block_pairs(one, radius, block)


def block_pairs(one: DataFrame, radius: int, block: int = 16384) -> DataFrame:
    """hash_pairs by comparing all of them: hashes are dealt into blocks of about `block`, and two
    blocks meet in a partition of their own, so no task grows with the table. A hash is copied
    once for each block; only pairs within the radius leave a task."""
    parts = max(1, -(-one.count() // block))
    mine = F.pmod(F.xxhash64("x"), F.lit(parts)).cast("int")
    spread = lambda ends, names: one.select("x", F.explode(F.sequence(*ends)).alias("_o"), mine.alias("_m")).toDF("x", *names).repartition(parts * (parts + 1) // 2, "i", "j")
    left = spread((mine, F.lit(parts - 1)), ("j", "i"))
    right = spread((F.lit(0), mine), ("i", "j"))

    def met(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        x, y = (df["x"].to_numpy(np.int64) for df in (here, there))
        own = len(here) and len(there) and here["i"].iloc[0] == here["j"].iloc[0]
        out = [pd.DataFrame({"x": x[:0], "y": x[:0], "distance": np.zeros(0, np.int32)})]
        for at in range(0, len(x) if len(y) else 0, 16):
            apart = np.bitwise_count(x[at : at + 16, None].view(np.uint64) ^ y[None, :].view(np.uint64))
            i, j = np.nonzero(apart <= radius)
            a, b = x[at + i], y[j]
            keep = a < b if own else a != b
            out.append(pd.DataFrame({"x": np.minimum(a, b)[keep], "y": np.maximum(a, b)[keep], "distance": apart[i, j].astype(np.int32)[keep]}))
        return pd.concat(out)

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(met, "x long, y long, distance int")


def looked_up(one: DataFrame, radius: int, width: int = 64, band: int = 16) -> DataFrame:
    """hash_pairs by multi-index hashing: the hash is cut into wide bands; of each band of x, all
    values within the band's radius are looked up among the bands of the others. A pair is kept
    in the first band that finds it, so no distinct follows. Values to look up grow as binomials
    of band and radius / bands: some 700 for each band at radius 14 of 64."""
    bands = -(-width // band)
    radii = band_radii(radius, bands)
    values = lambda n: [m for m in range(1 << band) if m.bit_count() <= n]
    part = lambda x, i: F.shiftrightunsigned(x, band * i).bitwiseAND(F.lit((1 << band) - 1)).cast("int")
    masks = one.sparkSession.createDataFrame([(i, m) for i, n in enumerate(radii) for m in values(n)], "band int, mask int").coalesce(1)
    spots = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), part(F.col("x"), i).alias("value")) for i, n in enumerate(radii) if n >= 0]))
    there = one.select("x", spots.alias("s")).select(F.col("x").alias("y"), "s.band", "s.value")
    asked = one.select("x", spots.alias("s")).select("x", "s.band", "s.value").join(F.broadcast(masks), "band")  # a literal table
    met = asked.select("x", "band", F.col("value").bitwiseXOR(F.col("mask")).alias("value")).join(there, ["band", "value"]).where("x < y")
    earlier = F.lit(False)
    for i, n in enumerate(radii):
        earlier = earlier | ((F.col("band") > i) & (F.bit_count(part(F.col("x").bitwiseXOR(F.col("y")), i)) <= n))
    return met.where(~earlier).select("x", "y", hamming("x", "y").alias("distance")).where(F.col("distance") <= radius)


def hamming_near(base: DataFrame, key: str, bits: str, radius: int, width: int = 64) -> DataFrame:
    """Pairs (a < b) whose hashes differ in at most `radius` bits, exactly: pairs of distinct
    hashes, and the rows that share one."""
    rows = base.select(F.col(key).alias("key"), F.col(bits).alias("bits")).where("bits IS NOT NULL")
    side = lambda k, h: rows.toDF(k, h)
    apart = hash_pairs(rows, "bits", radius, width).join(side("i", "x"), "x").join(side("j", "y"), "y")
    equal = side("i", "x").join(side("j", "x"), "x").where("i < j").select("i", "j", F.lit(0).alias("distance"))
    return apart.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "distance").unionByName(equal.toDF("a", "b", "distance"))


def classified_pairs(pairs: DataFrame, same: str, bits: str, distance: str, most_bits: int = 4, most: float = 0.03, far: float = 1.0) -> DataFrame:
    """Identical, near or variant, with a confidence, from a content match, the bit distance
    (of 64) and the cosine distance."""
    near = (F.col(bits) <= most_bits) & (F.col(distance) <= most)
    kind = F.when(F.col(same), "identical").when(near, "near").otherwise("variant")
    margins = ((most_bits - F.col(bits)) / most_bits + (most - F.col(distance)) / most) / 2
    excess = F.least(F.greatest((F.col(bits) - most_bits) / (64 - most_bits), (F.col(distance) - most) / (far - most), F.lit(0.0)), F.lit(1.0))
    return pairs.withColumns({"kind": kind, "confidence": F.when(F.col(same), 1.0).when(near, 0.5 + 0.5 * margins).otherwise(0.55 + 0.45 * excess)})


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, as Parquet: a plan over it starts from the
    file's own size. `checkpoint()` hands on the constraints and size estimates of the plan it
    ends, which a loop multiplies round by round until the driver is full of them. The shuffle
    files of df are removed with the end of the write, so that a loop holds those of one step."""
    session = df.sparkSession
    context = session.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(session))
    folder = f"{context._jsc.sc().getCheckpointDir().get()}/cut-{uuid.uuid4().hex}"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = session.conf.get(cleanup, None)
    session.conf.set(cleanup, "true")
    try:
        df.write.parquet(folder)
    finally:
        session.conf.unset(cleanup) if before is None else session.conf.set(cleanup, before)
    return session.read.schema(df.schema).parquet(folder)


def forget(*frames: DataFrame | None) -> None:
    """Delete the files of frames that `cut` made and that no plan reads any more."""
    for df in frames:
        for file in df.inputFiles()[:1] if df is not None else []:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if folder.getName().startswith("cut-"):
                folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def components(edges: DataFrame, nodes: DataFrame | None = None, key: str = "node", rounds: int = 40) -> DataFrame:
    """(node, root): the smallest node reachable, by rounds of least labels with label jumping,
    each cut in the checkpoint folder. Nodes without edges keep themselves."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))
    both = cut(edges.select(ends.alias("_ends")).select("_ends.x", "_ends.y").distinct())  # edges are made once
    labels = cut(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("root")))
    for _ in range(rounds):
        heard = both.join(labels.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("root").alias("near"))
        step = labels.join(heard, "x").select("x", F.least("root", "near").alias("to"))
        jump = step.join(labels.select(F.col("x").alias("to"), F.col("root").alias("far")), "to", "left").select("x", F.least("to", "far").alias("next"))
        new = cut(labels.join(jump, "x").select("x", "root", "next"))
        moved = new.where("root <> next").limit(1).count()
        labels = new.select("x", F.col("next").alias("root"))
        if not moved:
            break
    else:
        raise RuntimeError("components did not settle")
    found = labels.select(F.col("x").alias(key), "root")
    return found if nodes is None else nodes.select(key).distinct().join(found, key, "left").withColumn("root", F.coalesce("root", key))


def merge_closest(sums: np.ndarray, sizes: np.ndarray, spread: np.ndarray, limit: float, cohesion: float, floor: float) -> np.ndarray:
    """Label (place) of each of some clusters given by sums of unit vectors, sizes and spreads
    (changed here): the closest pair is merged again and again."""
    label, alive = np.arange(len(sums)), np.ones(len(sums), bool)
    link = 1 - (sums @ sums.T) / np.outer(sizes, sizes)
    np.fill_diagonal(link, np.inf)
    least = link.min(1)  # of each row
    while len(sums) > 1 and np.isfinite(best := least.min()) and best <= limit:
        a = int(least.argmin())
        b = int(link[a].argmin())
        a, b = min(a, b), max(a, b)
        if best > cohesion * max(spread[a], spread[b], floor):
            link[a, b] = link[b, a] = np.inf
            least[[a, b]] = link[[a, b]].min(1)
            continue
        stale = (link[a] == least) | (link[b] == least)
        sums[a] += sums[b]
        sizes[a] += sizes[b]
        spread[a] = max(1 - float(sums[a] @ sums[a]) / sizes[a] ** 2, 0)
        label[label == b] = a
        alive[b] = False
        row = 1 - (sums @ sums[a]) / (sizes * sizes[a])
        row[~alive] = np.inf
        row[a] = np.inf
        link[a], link[:, a], link[b], link[:, b] = row, row, np.inf, np.inf
        least = np.minimum(least, row)
        stale[[a, b]] = True
        least[stale] = link[stale].min(1)
    return label


def agglomerated(base: DataFrame, group: str, key: str, vector: str, limit: float = 0.55, cohesion: float = 2.2, floor: float = 0.12, weight: str | None = None) -> DataFrame:
    """Average-linkage clusters of each group of bounded size: the closest pair of clusters is
    merged while its linkage is within the limit and within cohesion times the wider of the
    two spreads (at least `floor`). A row counts `weight` times."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        sizes = np.array(pdf[weight], float) if weight else np.ones(len(pdf))
        label = merge_closest(np.stack(pdf[vector].to_numpy()).astype(np.float64) * sizes[:, None], sizes, np.zeros(len(pdf)), limit, cohesion, floor)
        return pd.DataFrame({group: pdf[group], key: pdf[key], "cluster": pdf[key].to_numpy()[label]})

    kinds = dict(base.dtypes)
    return base.select(group, key, vector, *([weight] if weight else [])).groupBy(group).applyInPandas(one, f"{group} {kinds[group]}, {key} {kinds[key]}, cluster {kinds[key]}")


def assigned(base: DataFrame, centres: DataFrame, key: str, vector: str, ceiling: float, margin: float) -> DataFrame:
    """Nearest of a small table of centres (centre, vector), where it is within the ceiling and
    clearer than the runner-up by the margin. Centres are a bounded table and are broadcast."""
    from catalith.functions.columns import cosine_distance

    d = base.select(key, vector).crossJoin(F.broadcast(centres.select("centre", F.col("vector").alias("_v")))).select(key, "centre", F.round(cosine_distance(vector, "_v"), 9).alias("distance"))
    two = d.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "centre"))), 1, 2).alias("best"))
    first, second = F.col("best")[0], F.get("best", F.lit(1))
    return two.where((first["distance"] <= ceiling) & (second.isNull() | (second["distance"] - first["distance"] >= margin))).select(key, first["centre"].alias("centre"), first["distance"].alias("distance"))
