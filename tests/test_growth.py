"""What must not grow faster than the input: plans of loops, pairs, and tasks."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from catalith.operators import joins, linkage, similarity, structure


def test_what_a_loop_cuts_hands_no_constraints_on(spark):
    edges = spark.range(40).select(F.col("id").alias("b"), F.expr("id div 3").alias("a")).where("b >= 3")
    front = spark.range(3).select(F.col("id").alias("node"))
    for _ in range(3):
        front = similarity.cut(front.join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct())
    plan = front._jdf.queryExecution().optimizedPlan()
    assert plan.constraints().size() == 0
    assert int(plan.stats().sizeInBytes()) < 10**6


def test_levels_of_a_graph_of_many_rounds(spark):
    nodes = spark.range(700).select(F.col("id").alias("node"))
    edge = lambda n: spark.range(n, 700).select(F.expr(f"id div {n}").alias("a"), F.col("id").alias("b"))
    got = {r["node"]: r["level"] for r in structure.levels(edge(2).unionByName(edge(5)).distinct(), nodes).collect()}
    want = {}
    for i in range(700):
        want[i] = max([want[i // n] + 1 for n in (2, 5) if i >= n], default=0)
    assert got == want


def test_a_radius_is_not_widened_by_rounding(spark):
    """0.7500000003 is not within 0.75, and 0.1234549997 is 0.12345 to five places."""
    at = lambda d: [1 - d, float(np.sqrt(1 - (1 - d) ** 2))]
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, at(0.7500000003)), (2, at(0.1234549997)), (3, at(1.9))], "id long, v array<double>")
    got = [tuple(r) for r in similarity.within_radius(rows.where("id = 0"), rows, "id", "v", 0.75).withColumn("nearest", F.round("nearest", 5)).collect()]
    assert got == [(0, 1, 0.12345)]


def test_windows_are_counted_without_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 9)) if rng.random() < 0.9 else None, int(rng.integers(-300, 900))) for _ in range(400)]
    ranges = [(i, int(s)) for i, s in enumerate(rng.integers(-400, 1000, 60))]
    made = joins.window_counts(spark.createDataFrame(rows, "m long, t long"), "t", "m", spark.createDataFrame(ranges, "r long, s long"), "r", "s", 100)
    want = {r: [(m, t) for m, t in rows if s <= t <= s + 100] for r, s in ranges}
    assert {r["r"]: (r["rows"], r["members"]) for r in made.collect()} == {r: (len(x), len({m for m, _ in x} - {None})) for r, x in want.items()}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "_x" in plan and "<=" not in plan  # no range condition, so no pair


def test_best_partners_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(4)
    made = lambda n, first: [(first + i, int(rng.integers(0, 4000)) // 7 * 7, int(rng.integers(0, 4)), float(rng.choice([0.0, 0.001, 3.0, 41.5, -2.0, -0.003]))) for i in range(n)]
    actions, reactions = made(150, 0), [*made(200, 1000), (2000, 50, None, 1.0)]
    frame = lambda rows: spark.createDataFrame(rows, "k long, t long, u long, v double")
    got = {r["reaction"]: (r["action"], r["bonus"]) for r in joins.best_partners(frame(actions), frame(reactions), "k", "t", "u", "v", 60).collect()}
    want = {}
    for k, t, u, v in reactions[:-1]:
        near = [(-round((1 - abs(t - s) / 60) * v, 6), a) for a, s, w, _ in actions if w != u and abs(t - s) <= 60]
        if near:
            want[k] = (min(near)[1], -min(near)[0])
    assert got == want and len(want) > 100


def test_no_task_of_a_wide_radius_sees_more_than_two_blocks(spark):
    rng = np.random.default_rng(6)
    hashes = rng.integers(-(2**63), 2**63 - 1, 300)
    hashes[200:] = hashes[:100] ^ (1 << rng.integers(0, 63, 100))
    rows = spark.createDataFrame([(int(x),) for x in hashes], "x long").distinct()
    pairs = similarity.block_pairs(rows, 14, block=60)
    assert pairs.rdd.getNumPartitions() >= 15  # five blocks meet pair by pair
    apart = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    ids = [int(x) for x in hashes]
    want = sorted((a, b, apart(a, b)) for a in ids for b in ids if a < b and apart(a, b) <= 14)
    assert sorted(tuple(r) for r in pairs.collect()) == want and len(want) >= 100
    assert "cogroup" in similarity.hash_pairs(rows, "x", 14)._jdf.queryExecution().toString().lower()
    assert "cogroup" not in similarity.hash_pairs(rows, "x", 5)._jdf.queryExecution().toString().lower()


def test_keys_of_a_cascade_are_taken_in_one_pass(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def key(x):
        seen.add(1)
        return x[0]

    left = spark.createDataFrame([(1, "aa"), (3, "ab"), (5, "cc"), (7, "d")], "k long, t string")
    right = spark.createDataFrame([(2, "aa"), (4, "ac"), (6, "cd")], "o long, t string")
    got = joins.match_cascade(left, right, "k", "o", [("whole", [F.col("t")]), ("first", [key("t")])])
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2, "whole"), (3, 2, "first"), (5, 6, "first")]
    assert sorted(tuple(r) for r in got.collect()) and seen.value == 7


def test_pairs_are_made_and_counted_in_as_many_parts_as_rows_need(spark):
    rng = np.random.default_rng(7)
    rows = [(int(g) if g < 90 else None, int(m) if m else None) for g, m in zip(rng.integers(0, 95, 900), rng.integers(0, 12, 900), strict=True)]
    table = spark.createDataFrame(rows, "g long, m long").repartition(3)
    held = {}
    for g, m in rows:
        held.setdefault(g, set()).add(m)
    want = {(a, b): n for a in range(1, 12) for b in range(a + 1, 12) if (n := sum(g is not None and {a, b} <= s for g, s in held.items()))}
    made = joins.cooccurrence(table, "g", "m")
    assert {(r["a"], r["b"]): r["together"] for r in made.collect()} == want
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
    sets, parts = joins.group_sets(table, ["g"], "m", share=100)
    pairs = joins.counted_pairs(sets, parts, [], {"together": F.lit(1)})
    assert parts == 9 and pairs.rdd.getNumPartitions() == 9  # not those of the session
    assert {(r["a"], r["b"]): r["together"] for r in pairs.collect()} == want


def test_companions_make_pairs_without_a_join(spark, sf):
    from catalith.plans import catalog

    plan = catalog.QUERIES["companions"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" in plan


def test_companions_are_dealt_in_as_many_parts_as_rows_need(spark):
    rng = np.random.default_rng(8)
    rows = [(int(g), int(m)) for g, m in zip(rng.integers(0, 200, 900), rng.integers(0, 15, 900), strict=True)]
    held, together = {}, {}
    for g, m in rows:
        held.setdefault(g, set()).add(m)
    for s in held.values():
        for a in s:
            for b in s - {a}:
                together[a, b] = together.get((a, b), 0) + 1
    want = {(a, b, n) for a in range(15) for n, b in sorted(((n, b) for (x, b), n in together.items() if x == a), key=lambda e: (-e[0], e[1]))[:3]}
    best = joins.companions(spark.createDataFrame(rows, "g long, m long"), "g", "m", 3, share=100)
    assert best.rdd.getNumPartitions() == 9  # not those of the session
    assert {tuple(r) for r in best.collect()} == want and len(want) == 45


def test_both_directions_of_an_edge_are_made_in_one_pass(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def same(x):
        seen.add(1)
        return x

    edges = spark.createDataFrame([(1, 2, 5), (2, 3, 7)], "a long, b long, n long").select("a", same("b").alias("b"), "n")
    assert sorted(tuple(r) for r in joins.both_directions(edges, "n").collect()) == [(1, 2, 5), (2, 1, 5), (2, 3, 7), (3, 2, 7)]
    assert seen.value == 2


def test_components_of_pairs_of_more_parts_than_the_session_has(spark):
    rows = spark.createDataFrame([(g, m) for g in range(40) for m in ((g % 4) * 2, (g % 4) * 2 + 1)], "g long, m long")
    sets, parts = joins.group_sets(rows, ["g"], "m", share=10)
    edges = joins.counted_pairs(sets, parts, [], {"together": F.lit(1)}).where("together >= 10")
    assert parts == 8 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {r["node"]: r["root"] for r in similarity.components(edges).collect()} == {m: m // 2 * 2 for m in range(8)}


def test_suppliers_that_share_one_order_are_one_component(spark, tmp_path):
    from catalith.plans import catalog

    lines = [(o, s) for o, suppliers in enumerate(([5, 2, 9], [9, 7], [4, 3], [3, 3], [6, None], [8])) for s in suppliers]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1, 10).toDF("s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {(r["node"], r["root"]) for r in catalog.QUERIES["components"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1), (2, 2), (5, 2), (7, 2), (9, 2), (3, 3), (4, 3), (6, 6), (8, 8)}
    con = duckdb.connect()
    for name in ("lineitem", "supplier"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == set(con.sql(catalog.SQL["components"]).fetchall())


def test_components_make_their_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def same(x):
        seen.add(1)
        return x

    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 9), (9, 8)], "a long, b long").select("a", same("b").alias("b"))
    assert {r["node"]: r["root"] for r in similarity.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7}
    assert seen.value == 4


def test_evidence_of_roles_counts_nothing_distinct(spark, sf):
    from catalith.plans import catalog

    plan = catalog.QUERIES["identity_roles"](spark, sf)._jdf.queryExecution().analyzed().toString()
    assert "lineitem" not in plan.lower() and "l_suppkey" not in plan  # identities and pairs are cut, and read


def test_blocks_meet_once_in_waves_of_few_copies(spark):
    """Also the blocks of few asked rows with those of all; and the copies of one wave do not grow with the table."""
    for asked, held in ((10**6, 10**6), (10**7, 10**7), (100, 10**6), (5 * 10**5, 10**6), (10, 10)):
        for once in (False, True) if asked == held else (False,):
            for blocks, parts, steps, _ in linkage.waves(asked, held, once):
                assert len(steps) == 1 or len(steps) * (asked + held * blocks / parts) <= 6 * held
    rows = spark.range(100).select((F.col("id") * 3).alias("k"), (F.col("id") * 7).alias("v")).cache()

    def pairs(here, there, own):
        a, b = (np.array(x, float).ravel() for x in np.meshgrid(here["k"], there["k"]))
        return pd.DataFrame({"a": a, "b": b, "own": own})

    def met(asked, once, **how):
        plan = linkage.waves(asked.count(), 100, once, **how)
        return len(plan), [tuple(r) for w in plan for r in linkage.meeting_blocks(asked, rows, "k", pairs, "a long, b long, own boolean", w).collect()]

    for block in (10, 12):  # parts: even and odd
        waves, once = met(rows, True, block=block, copies=2)
        assert waves > 4
        both = sorted(once + [(b, a, own) for a, b, own in once if not own])
        assert [x[:2] for x in both] == [(a, b) for a in range(0, 300, 3) for b in range(0, 300, 3)]
        waves, every = met(rows.where("k % 2 = 0"), False, block=block, copies=3)
        assert waves > 2 and sorted(x[:2] for x in every) == [(a, b) for a in range(0, 300, 6) for b in range(0, 300, 3)]


def test_a_cut_leaves_no_shuffle_files_and_can_be_forgotten(spark):
    import time

    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: str(files.getAllFiles().mkString(" ")).count("/shuffle_")
    before, setting = held(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    made = similarity.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if held() <= before:
            break
        time.sleep(0.1)
    assert held() <= before and made.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == setting
    similarity.forget(None, made)
    with pytest.raises(Exception, match="(?i)exist|not.found"):
        made.collect()


def test_rounds_keep_no_clusters_of_earlier_ones(spark):
    """What linkage leaves in the checkpoint folder are labels, not vectors of every round."""
    rng = np.random.default_rng(3)
    v = rng.standard_normal((120, 6)) + 2
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    similarity.cut(spark.range(1))
    folder = str(spark.sparkContext._jsc.sc().getCheckpointDir().get()).removeprefix("file:")
    before = set(os.listdir(folder))
    assert linkage.linked(table, "id", "v", 0.5, floor=0.5, bounded=10).select("cluster").distinct().count() >= 1
    wide = [c for c in set(os.listdir(folder)) - before if "sum" in spark.read.parquet(f"{folder}/{c}").columns]
    assert len(wide) <= 2
