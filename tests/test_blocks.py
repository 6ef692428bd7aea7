"""Sequences in blocks against whole-sequence kernels."""

import numpy as np
import pytest

from catalith.operators import sequences


@pytest.mark.parametrize("block", [7, 10_000])
def test_blocks_give_the_path_of_the_whole_sequence(spark, block):
    rng = np.random.default_rng(block)
    states = ["a", "b", "c", "x"]
    rows = [(g, int(at), i, states[rng.integers(0, 4) if rng.random() < 0.4 else (i // 9) % 3]) for g, n in ((1, 1), (2, 60), (3, 200), (4, 7)) for i, at in enumerate(np.sort(rng.integers(0, 500, n)))]
    df = spark.createDataFrame(rows, "g int, at long, id int, s string").repartition(3)
    assert sequences.long_groups(df, "g", block)[1] == (260 if block < 100 else 0)
    got = {(r["g"], r["id"]): r["smoothed"] for r in sequences.viterbi_smoothed(df, "g", "at", "id", "s", states, block=block).collect()}
    transition = sequences.fine(sequences.chain_transition(4))
    low, high = sequences.fine(np.log([0.4 / 3, 0.6]))
    for g in (1, 2, 3, 4):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        seen = np.full((len(mine), 4), low)
        seen[np.arange(len(mine)), [states.index(r[3]) for r in mine]] = high
        assert [got[g, r[2]] for r in mine] == [states[i] for i in sequences.viterbi(seen, transition)]
    assert len(got) == len(rows)


def test_swept_medians_are_upper_medians():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 7, 200):
        times = np.sort(rng.integers(0, 300, n))
        values = rng.integers(0, 9, n).astype(float)
        asked = np.sort(rng.integers(-40, 340, 60))
        got = sequences.sweep_medians(times, values, asked, 20)
        for t, m in zip(asked, got, strict=True):
            near = np.sort(values[abs(times - t) <= 20])
            assert np.isnan(m) if not len(near) else m == near[len(near) // 2]


def test_a_sweep_of_many_rows_in_reach_takes_time_in_proportion():
    import time

    began = time.process_time()
    times = np.arange(60_000)
    got = sequences.sweep_medians(times, np.arange(60_000.0) % 1009, times, 40_000)
    assert len(got) == 60_000 and time.process_time() - began < 20


@pytest.mark.parametrize("block", [6, 40])
def test_long_groups_have_the_windows_of_short_ones(spark, block):
    rng = np.random.default_rng(block)
    rows = [(g, int(at), 1000 * g + i) for g, n in ((1, 3), (2, 90), (3, 30), (4, 200)) for i, at in enumerate(np.sort(rng.integers(0, 2000, n)))]
    df = spark.createDataFrame(rows, "g int, at long, id int").repartition(3)
    whole = sequences.cadence_windows(df, "g", "at", "id", 100, 2.5, 3.0, 90.0)
    cut = sequences.cadence_windows(df, "g", "at", "id", 100, 2.5, 3.0, 90.0, block=block).select(whole.columns)
    assert sorted(map(str, cut.collect())) == sorted(map(str, whole.collect())) and whole.count() == len(rows)
