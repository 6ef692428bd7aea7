"""Sequential kernels and table functions against plain definitions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalith.operators import aggregates, incremental, joins, metrics, selection, sequences, similarity
from catalith.sources import tables


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(1)
    transition = sequences.chain_transition(4)
    assert np.allclose(np.exp(transition).sum(1), 1)
    for _ in range(20):
        seen = np.log(rng.random((5, 4)))
        score = lambda path: seen[np.arange(5), path].sum() + sum(transition[a, b] for a, b in itertools.pairwise(path))  # noqa: B023, E731
        best = max(itertools.product(range(4), repeat=5), key=lambda p: score(list(p)))
        assert score(sequences.viterbi(seen, transition)) == pytest.approx(score(list(best)))


def test_change_points_are_the_best_partition():
    rng = np.random.default_rng(2)
    for _ in range(30):
        x = np.concatenate([rng.normal(m, 0.3, rng.integers(1, 5)) for m in rng.integers(0, 5, 3)])
        n, penalty = len(x), 0.5
        cost = lambda starts: sum(((x[a:b] - x[a:b].mean()) ** 2).sum() for a, b in itertools.pairwise([*starts, n])) + penalty * len(starts)  # noqa: B023, E731
        every = [[0, *c] for k in range(n) for c in itertools.combinations(range(1, n), k)]
        assert cost(sequences.change_points(x, penalty)) == pytest.approx(min(map(cost, every)))


def test_segments_cover_all_rows_within_bounds():
    x = np.repeat([0.0, 5.0, 1.0, 7.0, 2.0, 9.0, 3.0], 10)
    assert sequences.segments(x, 6, 20) == [0, 10, 20, 30, 40, 50, 60]


def test_isotonic_fit_is_monotone_and_keeps_the_mean(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([(x := rng.random(), int(rng.random() < x * x)) for _ in range(500)], "p double, y int")
    knots = metrics.isotonic_knots(rows, "p", "y").orderBy("x").collect()
    assert [k["y"] for k in knots] == sorted(k["y"] for k in knots)
    got = metrics.isotonic_applied(rows, "p", metrics.isotonic_knots(rows, "p", "y"), "c").agg(F.min("c"), F.max("c")).first()
    assert 0 <= got[0] <= got[1] <= 1


def test_nearest_does_not_depend_on_blocks(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    base = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<float>").repartition(4)
    want = {(i, int(j)) for i in range(0, 60, 7) for j in sorted((k for k in range(60) if k != i), key=lambda k: (1 - v[i] @ v[k], k))[:5]}
    for block in (3, 1000):
        got = similarity.nearest(base.where("id % 7 = 0"), base, "id", "v", 5, block=block)
        assert {(r["id"], r["neighbour"]) for r in got.collect()} == want


def test_hashed_pairs_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 32))
    v = np.repeat(centres, 10, axis=0) + rng.normal(0, 0.2, (200, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    base = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<float>")
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if 1 - v[i] @ v[j] <= 0.1}
    got = {(r["a"], r["b"]) for r in similarity.within(base, "id", "v", 0.1).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_hamming_bands_lose_no_pair(spark):
    rng = random.Random(6)
    bits = [rng.getrandbits(64) for _ in range(20)]
    bits += [b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 8))) for b in bits for _ in range(3)]
    signed = [b - (1 << 64) if b >> 63 else b for b in bits]
    base = spark.createDataFrame(list(enumerate(signed)), "id long, bits long")
    want = {(i, j) for i in range(80) for j in range(i + 1, 80) if (bits[i] ^ bits[j]).bit_count() <= 6}
    assert {(r["a"], r["b"]) for r in similarity.hamming_near(base, "id", "bits", 6).collect()} == want


def test_components_of_a_chain_and_lone_nodes(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 80)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(41), 80, 90, 99]], "node long")
    got = {r["node"]: r["root"] for r in similarity.components(edges, nodes).collect()}
    assert got == {**{i: 0 for i in range(41)}, 80: 80, 90: 80, 99: 99}


def test_agglomeration_finds_separate_clusters(spark):
    rng = np.random.default_rng(7)
    v = np.repeat(np.eye(6), 5, axis=0) + rng.normal(0, 0.05, (30, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    base = spark.createDataFrame([(0, i, x.tolist()) for i, x in enumerate(v)], "g int, id long, v array<float>")
    got = {r["id"]: r["cluster"] for r in similarity.agglomerated(base, "g", "id", "v").collect()}
    assert len(set(got.values())) == 6 and all(got[i] == got[i // 5 * 5] for i in range(30))


def test_density_cap_is_greedy(spark):
    rng = random.Random(8)
    rows = [(1, i, rng.randrange(400), rng.random()) for i in range(80)]
    kept = []
    for _, key, at, score in sorted(rows, key=lambda r: (-r[3], r[1])):
        if sum(abs(at - a) <= 6 for a, _ in kept) < 2:
            kept.append((at, key))
    got = selection.density_capped(spark.createDataFrame(rows, "g int, id long, at long, s double"), "g", "at", "s", "id", 6, 2)
    assert {r["id"] for r in got.collect()} == {k for _, k in kept}


def test_as_of_takes_the_last_row_at_or_before(spark):
    left = spark.createDataFrame([(1, 10), (1, 5), (2, 7), (1, 1)], "k int, t long")
    right = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (2, 8, "c")], "k int, u long, v string")
    assert {(r["k"], r["t"]): r["v"] for r in joins.as_of(left, right, ["k"], "t", "u", ["v"]).collect()} == {(1, 10): "b", (1, 5): "a", (2, 7): None, (1, 1): None}


def test_range_join_has_each_pair_once_whatever_the_width(spark):
    points = spark.createDataFrame([(i, i * 3) for i in range(40)], "id long, t long")
    ranges = spark.createDataFrame([(1, 0, 50), (2, 30, 31), (3, 33, 33)], "r long, s long, e long")
    for width in (1, 10, 1000):
        got = joins.range_join(points, "t", ranges, "s", "e", width).collect()
        assert sorted((r["id"], r["r"]) for r in got) == sorted((i, r) for i in range(40) for r, s, e in ((1, 0, 50), (2, 30, 31), (3, 33, 33)) if s <= i * 3 <= e)


def test_small_and_windowed_elements_agree(spark):
    rows = spark.createDataFrame([(i % 5, i * 37 % 101) for i in range(90)] + [(7, None)], "g int, v int")
    for num, den in ((1, 2), (3, 4)):
        a = {r["g"]: r["m"] for r in aggregates.ordered_element(rows, ["g"], "v", num, den, "m").collect()}
        b = {r["g"]: r["m"] for r in aggregates.small_ordered_element(rows.where("v IS NOT NULL"), ["g"], "v", num, den, "m").collect()}
        assert a == b


def test_upsert_is_idempotent(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = incremental.upsert(old, new, "k")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, incremental.upsert(once, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_snapshots_refuse_other_versions(spark, tmp_path):
    df = spark.range(5)
    tables.write_snapshot(df, f"{tmp_path}/s", "v1")
    assert tables.read_snapshot(spark, f"{tmp_path}/s", "v1").count() == 5
    with pytest.raises(Exception, match="snapshot version"):
        tables.read_snapshot(spark, f"{tmp_path}/s", "v2").collect()
    assert tables.verified_backup(df, f"{tmp_path}/b") == 5


def test_file_manifest_digests_and_recordings(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.JSON").write_text('{"name": "x", "status": 200}')
    (tmp_path / "d" / "b.json").write_text('{"name": 5, "status": "bad"}')
    (tmp_path / "c.json").write_text("")
    got = {r["name"]: r["accepted"] for r in tables.scan_files(spark, str(tmp_path), ("json",)).collect()}
    assert got == {"a.JSON": True, "b.json": True}  # the reader itself leaves empty files out
    assert tables.content_digests(spark, str(tmp_path)).select("digest").distinct().count() == 2
    rows = tables.read_recordings(spark, f"{tmp_path}/d/b.json", "name string, status int").collect()
    assert len(rows) == 1 and rows[0]["status"] is None and rows[0]["_corrupt_record"]
