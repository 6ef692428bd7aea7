"""Graph index, multi-index hashing and isotonic fits against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalith.operators import graph_index, metrics, similarity


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 24))
    rows = [(i, (centres[rng.integers(12)] + 0.6 * rng.standard_normal(24)).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[7][1]) for i in range(300)]  # one vector in many copies
    return spark.createDataFrame(rows, "id long, v array<double>").repartition(5).cache(), rows


def recall(spark, path, rows, k=32, **how):
    matrix, ids = graph_index.unit(v for _, v in rows), np.array([i for i, _ in rows])
    queries = spark.createDataFrame([r for r in rows if r[0] % 40 == 0], "id long, v array<double>")
    got = {}
    for r in graph_index.search(spark, path, queries, "id", "v", k, **how).collect():
        got.setdefault(r["id"], []).append((r["place"], r["neighbour"], r["distance"]))
    hits = 0
    for one, found in got.items():
        distance = np.round(1 - matrix @ matrix[ids == one][0], 9)
        distance[ids == one] = 9
        assert len(found) == k and one not in {x[1] for x in found}
        hits += sum(d <= np.sort(distance)[k - 1] + 1e-6 for _, _, d in found)
    assert len(got) == queries.count()
    return hits / (k * len(got))


def test_graph_search_finds_what_exact_search_finds(spark, vectors, tmp_path):
    base, rows = vectors
    path = str(tmp_path / "index")
    graph_index.build(base, "id", "v", path, share=200)
    assert graph_index.latest(spark, path).groupBy("pivot", "sub").count().agg(F.max("count")).first()[0] < 400
    assert recall(spark, path, rows, width=96, probes=6) >= 0.9


def test_insertion_writes_only_the_parts_it_touches(spark, vectors, tmp_path):
    base, rows = vectors
    path = str(tmp_path / "index")
    graph_index.build(base.where("id % 10 <> 3"), "id", "v", path, share=200)
    parts = graph_index.latest(spark, path).select("pivot", "sub").distinct().count()
    few = base.where("id = 3 OR id = 4")
    assert graph_index.insert(few, "id", "v", path, share=200) == 1  # 4 is there already
    versions = {r["version"]: r["n"] for r in graph_index.latest(spark, path).select("pivot", "sub", "version").distinct().groupBy("version").agg(F.count("*").alias("n")).collect()}
    assert versions == {0: parts - 1, 1: 1}
    graph_index.insert(base, "id", "v", path, share=200)
    now = graph_index.latest(spark, path)
    assert sorted(r["key"] for r in now.select("key").collect()) == sorted(i for i, _ in rows)
    assert recall(spark, path, rows, width=96, probes=6) >= 0.9


def test_graph_of_nothing_and_of_one(spark, tmp_path):
    for n in (0, 1):
        path = str(tmp_path / f"index{n}")
        rows = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(n)] + [(9, None)], "id long, v array<double>")
        graph_index.build(rows, "id", "v", path)
        assert graph_index.search(spark, path, rows, "id", "v").count() == 0
        assert graph_index.insert(spark.createDataFrame([(5, [0.0, 1.0])], "id long, v array<double>"), "id", "v", path) == 1
        assert graph_index.latest(spark, path).count() == n + 1


def test_hamming_pairs_and_their_candidates(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(150)]
    rows = []
    for i in range(400):
        v = rng.choice(base)
        for _ in range(rng.randint(0, 12)):
            v ^= 1 << rng.randrange(63)
        rows.append((i, v if i % 2 else v - (1 << 63)))
    rows.append((900, None))
    bits = spark.createDataFrame(rows, "id long, h long")
    apart = lambda x, y: ((x ^ y) & ((1 << 64) - 1)).bit_count()
    for radius in (14, 12, 5, 2, 0):
        want = {(a, b, apart(x, y)) for a, x in rows[:-1] for b, y in rows[:-1] if a < b and apart(x, y) <= radius}
        got = similarity.hamming_near(bits, "id", "h", radius).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want) and (want or radius == 0)
    assert sum(n + 1 for n in similarity.band_radii(14, 4)) == 15
    looked = sum(sum(1 for m in range(1 << 16) if m.bit_count() <= n) for n in similarity.band_radii(14, 4))
    assert looked / (1 << 16) < 0.05  # the share of random pairs that meet


def test_classified_pairs_reach_every_kind(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal(64)
    turned = lambda n: np.where(np.arange(64) < n, -v, v)
    small = v * np.where(np.arange(64) < 3, 0.01, 1)
    rows = [(0, v), (1, v * 2), (2, np.where(np.arange(64) < 3, -small, small)), (3, turned(12)), (4, -v)]
    base = spark.createDataFrame([(i, (x / np.linalg.norm(x)).tolist()) for i, x in rows], "id long, v array<double>")
    base = similarity.with_hash(base, "v")
    near = similarity.hamming_near(base, "id", "bits", 12).withColumnRenamed("distance", "bits")
    known = similarity.measured(near.select("a", "b"), base, "id", "v").join(near, ["a", "b"]).withColumn("same", F.col("bits") == 0)
    got = {(r["a"], r["b"]): r["kind"] for r in similarity.classified_pairs(known, "same", "bits", "distance", 12, 0.1, 1.0).collect()}
    assert got[0, 1] == "identical" and got[0, 2] == "near" and got[0, 3] == "variant" and (0, 4) not in got


def plain_isotonic(points):
    out = []
    for x, y, n in points:
        out.append([y, n, x * n])
        while len(out) > 1 and out[-2][0] * out[-1][1] > out[-1][0] * out[-2][1]:
            top = out.pop()
            out[-1] = [a + b for a, b in zip(out[-1], top, strict=True)]
    return [(sx / n, y / n) for y, n, sx in out]


@pytest.mark.parametrize(("seed", "digits", "parts"), [(0, 1, 64), (1, 2, 3), (2, 4, 200), (3, 4, 1)])
def test_isotonic_fit_and_reading_are_those_of_a_plain_fit(spark, seed, digits, parts):
    rng = random.Random(seed)
    rows = [(x := round(rng.random(), digits), int(rng.random() < (x if seed % 2 else x > 0.5))) for _ in range(700)]
    sums = {}
    for x, y in rows:
        s = sums.setdefault(x, [0, 0])
        s[0], s[1] = s[0] + y, s[1] + 1
    want = plain_isotonic((x, *sums[x]) for x in sorted(sums))
    knots = metrics.isotonic_knots(spark.createDataFrame([*rows, (None, 1)], "p double, y int"), "p", "y", parts=parts)
    assert np.allclose(sorted((r["x"], r["y"]) for r in knots.collect()), want)
    asked = [(i / 50 - 0.1,) for i in range(70)] + [(x,) for x, _ in want] + [(None,)]
    got = metrics.isotonic_applied(spark.createDataFrame(asked, "p double"), "p", knots, "c", parts=5).collect()
    assert len(got) == len(asked)
    assert all(r["c"] is None if r["p"] is None else r["c"] == pytest.approx(np.interp(r["p"], *zip(*want, strict=True))) for r in got)


def test_close_scores_are_not_one_point_and_few_knots_are_none(spark):
    rows = spark.createDataFrame([(0.10001, 0), (0.10009, 1)], "p double, y int")
    assert metrics.isotonic_knots(rows, "p", "y").count() == 2
    none = metrics.isotonic_knots(rows.limit(1), "p", "y")
    assert none.count() == 0 and metrics.isotonic_applied(rows, "p", none, "c").where("c <> p").count() == 0
