"""Robust levels, capped influence and merged runs against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalith.operators import levels, structure


def plain_intercept(x, y, w, passes=2):
    for done in range(passes):
        a = (x * w[:, None]).T @ x + np.diag([1e-6, *[0.1] * (x.shape[1] - 1)])
        beta = np.linalg.solve(a, (x * w[:, None]).T @ y)
        if done + 1 < passes:
            r = np.abs(y - x @ beta)
            r = r / max(1.4826 * np.sort(r)[len(r) // 2], 1e-4)
            w = w * np.where(r <= 1.345, 1, 1.345 / np.maximum(r, 1e-12))
    return beta[0]


def test_levels_are_those_of_plain_fits(spark):
    rng = np.random.default_rng(4)
    n = 600
    g, b, archive = rng.integers(0, 3, n), rng.integers(0, 2, n), np.minimum(rng.integers(0, 8, n), 4) % 4
    archive[rng.random(n) < 0.5] = 0
    x = rng.standard_normal((n, 3))
    y = np.stack((1 + 0.5 * g + x[:, 0] + 0.2 * rng.standard_normal(n), 3 * b - x[:, 1] + rng.standard_t(2, n)), 1)
    y[rng.random(n) < 0.03] += 40  # outliers
    known = rng.random(n) < 0.7
    rows = [(int(i), int(j), int(k), *map(float, u), float(v[0]), float(v[1]) if ok else None) for i, j, k, u, v, ok in zip(g, b, archive, x, y, known, strict=True)]
    samples = spark.createDataFrame(rows, "g int, b int, k int, x0 double, x1 double, x2 double, y0 double, y1 double").repartition(3)
    got = {(r["level"], r["of"], r["target"]): (r["samples"], r["raw"], r["fitted"]) for r in levels.fitted_levels(samples, [[], ["g"], ["g", "b"]], "k", [F.col(f"x{i}") for i in range(3)], [F.col("y0"), F.col("y1")], [40.0, 12.0, 12.0]).collect()}
    share = np.bincount(archive) / n
    cap = max(0.35, 1 / len(share))
    scale = np.array([cap * (1 - s) / ((1 - cap) * s) if s > cap else 1.0 for s in share])
    assert scale[0] < 1 and scale[0] * share[0] / (scale * share).sum() == pytest.approx(cap)
    wide, left = np.column_stack((np.ones(n), x)), y.copy()
    for number, (keys, prior) in enumerate((([], 40), ([g], 12), ([g, b], 12))):
        names = np.array(["/".join(str(k[i]) for k in keys) for i in range(n)])
        new = left.copy()
        for name in np.unique(names):
            for target in (0, 1):
                at = (names == name) & (known | (target == 0))
                raw, size = plain_intercept(wide[at], left[at, target], scale[archive[at]]), int((names == name).sum())
                assert got.pop((number, str(name), target)) == (size, pytest.approx(raw, abs=1e-8), pytest.approx(raw * size / (size + prior), abs=1e-8))
                new[names == name, target] -= raw * size / (size + prior)
        left = new
    assert not got


def test_upper_medians_are_elements(spark):
    rng = random.Random(2)
    rows = [(g, v) for g in range(4) for v in ([rng.choice([0.5, rng.random(), 1e6 * rng.random()]) for _ in range(rng.randint(1, 400))] if g else [7.0] * 50)] + [(9, None)]
    got = {r["g"]: r["median"] for r in levels.upper_medians(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", bins=16).collect()}
    assert got == {g: (s := sorted(v for k, v in rows if k == g))[len(s) // 2] for g in range(4)}


def test_a_capped_group_holds_the_cap_afterwards(spark):
    rows = spark.createDataFrame([(("a", "b", "b", "c", "d", "d", "d", "d", "d", "d")[i % 10],) for i in range(500)], "k string")
    got = {r["k"]: (r["rows"], r["weight"]) for r in structure.capped_influence(rows, "k", 0.3).collect()}
    assert got["d"][0] * got["d"][1] / sum(n * w for n, w in got.values()) == pytest.approx(0.3)
    assert all(got[k][1] == 1 for k in "abc")
    two = structure.capped_influence(rows.where("k < 'c'"), "k", 0.3).collect()
    assert {r["k"]: round(r["weight"], 9) for r in two} == {"a": 1.0, "b": 0.5}  # never below an equal share
    assert structure.capped_influence(rows.where("k = 'a'"), "k", 0.3).first()["weight"] == 1


@pytest.mark.parametrize("support", [None, "s"])
def test_short_runs_are_merged_in_order(spark, support):
    rng = random.Random(5)
    rows = [(u, i, at, rng.choice("aabbc"), rng.random()) for u in range(6) for i, at in enumerate(sorted(rng.randrange(4000) for _ in range(80)))]
    got = {(r["u"], r["i"]): r["segment"] for r in structure.short_runs_merged(spark.createDataFrame(rows, "u int, i int, at long, k string, s double"), "u", "at", "i", "k", 2, 60, support, 0.7).collect()}
    for u in range(6):
        runs = []
        for r in (r for r in rows if r[0] == u):
            if runs and runs[-1][-1][3] == r[3]:
                runs[-1].append(r)
            else:
                runs.append([r])
        segments = []
        for run in runs:
            stands = len(run) >= 2 and run[-1][2] - run[0][2] >= 60
            if segments and not stands and support:
                kinds = [r[3] for r in segments[-1]]
                most = min(set(kinds), key=lambda k: (-kinds.count(k), k))  # noqa: B023
                stands = run[0][3] != most and sum(r[4] for r in run) / len(run) >= 0.7
            if not segments or stands:
                segments.append(list(run))
            else:
                segments[-1] += run
        assert all(got[u, r[1]] == n for n, s in enumerate(segments, 1) for r in s)


def test_medians_move_no_row_by_its_group(spark):
    rows = spark.range(2_000_000).selectExpr("id % 3 AS g", "double(id) AS v")
    made = levels.upper_medians(rows, ["g"], "v")
    assert "SortMergeJoin" not in made._jdf.queryExecution().executedPlan().toString()
    assert {r["g"]: r["median"] for r in made.collect()} == {0: 999_999.0, 1: 1_000_000.0, 2: 1_000_001.0}
