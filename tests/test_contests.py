"""Roles, joint targets, normal forms and half floats against plain versions."""

import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalith.functions import coding
from catalith.operators import contests


def plain_solve(faces, band, ceiling=0.94):
    """faces: (value, bright, weight, cap)."""
    between = lambda a, b: 2.2 * math.log2(max(b, 1e-4) / max(a, 1e-4))
    stepped = lambda v, by: min(max(max(v, 0) * 2 ** (by / 2.2), 0), 1)

    def reach(f, target):
        wanted = between(f[0], min(max(target, min(f[0], band)), max(f[0], band)))
        return max(wanted, -0.6) if wanted <= 0 else min(wanted, f[3], 1.2, max(between(f[1], ceiling), 0))

    target = band
    for _ in range(3):
        target = sum(stepped(f[0], reach(f, target)) * f[2] for f in faces) / sum(f[2] for f in faces)
    steps = [reach(f, target) for f in faces]
    after = [stepped(f[0], s) for f, s in zip(faces, steps, strict=True)]
    most = min(after) + 0.08
    for i, f in enumerate(faces):
        wanted = max(most, min(f[0], after[i]))
        if len(faces) > 1 and after[i] > most and wanted < after[i] - 1e-4:
            steps[i] = min(max(between(f[0], wanted), -0.6), 1.2)
            after[i] = stepped(f[0], steps[i])
    return target, steps, after


def test_groups_are_solved_like_plain_ones(spark):
    rng = random.Random(3)
    groups = [[(v := rng.random(), min(1, v + 0.2), rng.choice([0.1, 1.0]), rng.choice([0.0, 0.4, 1.2])) for _ in range(n)] for n in (1, 2, 5, 9, 20)]
    rows = [(g, i, *map(float, f)) for g, faces in enumerate(groups) for i, f in enumerate(faces)]
    out = contests.group_solved(spark.createDataFrame(rows, "g int, i int, v double, hi double, w double, cap double"), "g", "v", "hi", "w", 0.5, F.col("cap"))
    got = {(r["g"], r["i"]): r for r in out.collect()}
    for g, faces in enumerate(groups):
        target, steps, after = plain_solve(faces, 0.5)
        for i in range(len(faces)):
            assert got[g, i]["target"] == pytest.approx(target)
            assert got[g, i]["steps"] == pytest.approx(steps[i], abs=1e-9) and got[g, i]["after"] == pytest.approx(after[i])
            assert after[i] >= min(faces[i][0], min(after)) - 1e-9  # nobody is put below where they started to be fair


def test_the_best_pair_is_the_couple_and_close_scores_are_ambiguous(spark):
    identities = [(1, "a", 10, 0.5, 4, 2, 0.9), (1, "b", 9, 0.5, 4, 2, 0.9), (1, "c", 9, 0.1, 0, 0, 0.2), (1, "d", 1, 0.1, 0, 0, 0.1), (2, "a", 5, 0.2, 0, 0, 0.5), (2, "b", 5, 0.2, 0, 0, 0.5), (2, "c", 5, 0.2, 0, 0, 0.5), (3, "z", 7, 0.2, 1, 0, 0.5)]
    pairs = [(1, "a", "b", 8, 6), (1, "a", "c", 5, 0), (1, "b", "c", 1, 0), (2, "a", "b", 4, 1), (2, "a", "c", 4, 1), (2, "b", "c", 1, 0)]
    out = contests.roles(spark.createDataFrame(identities, "g int, id string, frames long, area double, scenes long, ceremony long, centrality double"), spark.createDataFrame(pairs, "g int, a string, b string, frames long, portraits long"), "g")
    got = {(r["g"], r["id"]): (r["role"], r["ambiguous"], r["confidence"]) for r in out.collect()}
    assert {k: v[:2] for k, v in got.items()} == {
        (1, "a"): ("couple", False), (1, "b"): ("couple", False), (1, "c"): ("close", False), (1, "d"): ("unknown", False),
        (2, "a"): ("couple", True), (2, "b"): ("couple", True), (2, "c"): ("close", False), (3, "z"): ("guest", False),
    }
    assert got[2, "a"][2] <= contests.SCENELESS < got[1, "a"][2] <= 1


def test_normal_forms_of_all_code_planes(spark):
    texts = ["".join(map(chr, range(at, min(at + 4096, 0x110000)))).encode("utf-8", "ignore").decode() for at in range(0, 0x30000, 4096)]
    texts += [unicodedata.normalize("NFD", t) for t in texts] + ["é", "", None, "a\\b/é", "".join(map(chr, range(0xE0000, 0xE0200)))]
    got = {r["i"]: r["k"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", coding.nfc("t").alias("k")).collect()}
    assert [got[i] for i in range(len(texts))] == [None if t is None else unicodedata.normalize("NFC", t) for t in texts]
    assert spark.range(1).select(coding.compare_key(F.lit("A\\é")).alias("k")).first()["k"] == "A/é"


def test_every_half_comes_back(spark):
    halves = np.arange(1 << 16, dtype=np.uint16).view("<f2")
    rows = spark.createDataFrame([(i, halves[i * 256 : (i + 1) * 256].astype(float).tolist()) for i in range(256)] + [(900, None)], "i int, v array<double>")
    coded = rows.select("i", coding.half_encoded("v").alias("h")).cache()
    got = {r["i"]: r["h"] for r in coded.collect()}
    for i in range(256):
        mine, back = halves[i * 256 : (i + 1) * 256], np.frombuffer(bytes(got[i]), "<f2")
        assert ((mine.view(np.uint16) == back.view(np.uint16)) | (np.isnan(mine) & np.isnan(back))).all()
    again = {r["i"]: r["v"] for r in coded.select("i", coding.half_decoded("h", 256).alias("v")).collect()}
    assert np.array_equal(np.array(again[3], "<f2"), halves[768:1024], equal_nan=True) and again[900] is None
    assert coded.where("i = 1").select(coding.half_decoded("h", 255).alias("v")).first()["v"] is None
    near = spark.range(1).select(coding.half_encoded(F.array(F.lit(1.0 + 2**-11), F.lit(1.0 + 3 * 2**-11), F.lit(1e6))).alias("h")).first()["h"]
    assert np.frombuffer(bytes(near), "<f2").tolist() == [1.0, 1.0 + 2**-9, math.inf]
