import numpy as np
import pytest

from shiftlab.operators import detect as de
from shiftlab.operators import select as se

# The detection series of seed 4, 50 steps, +20 from step 20, in 24ths.
GOLDEN = [0] * 8 + [1, 1, 1, 3, 4, 5, 9, 11, 13, 14, 18, 18, 18, 17, 14, 13, 9, 9, 6, 5, 3, 3, 2, 2, 1, 1, 0, 0] + [-1] * 7 + [0] * 7


def random_series():
    v = np.random.RandomState(4).randn(50)
    v[20:] += 20
    return v


def plain(v, t, lmin, lmax, two_sided=True):
    """The detector step by step."""
    n, dts, cover = len(v), np.zeros(len(v)), np.zeros(len(v))
    for length in range(lmin, lmax + 1):
        m = n // length
        starts = [k * length for k in range(m)]
        starts = starts + [s + n - m * length for s in starts] if two_sided else [s + (n - m * length) // 2 for s in starts]
        slopes = []
        for s in starts:
            x, y = t[s : s + length], v[s : s + length]
            below = length * (x * x).sum() - x.sum() ** 2
            slopes.append((length * (x * y).sum() - x.sum() * y.sum()) / below if below else 0.0)
        med = np.median(slopes)
        mad = np.median(np.abs(np.array(slopes) - med))
        for s, b in zip(starts, slopes):
            cover[s : s + length] += 1
            if abs(b - med) > 3 * mad:
                dts[s : s + length] += np.sign(b - med)
    return dts / cover.max() if two_sided else dts / (lmax - lmin + 1)


def test_golden_vector():
    got = de.ASDETECT().fit_predict(random_series(), np.arange(50.0))
    assert np.allclose(got, np.array(GOLDEN) / 24, atol=1e-12)


def test_hand_example():
    got = de.ASDETECT(2, 3, segmentation="original").fit_predict(np.array([0, 0, 0, 1, 1, 1.0]), np.arange(6.0))
    assert got.tolist() == [0, 0, 0.5, 0.5, 0, 0]


@pytest.mark.parametrize("mode", ["two_sided", "original"])
def test_against_plain(mode):
    rng = np.random.default_rng(1)
    v = rng.integers(-5, 6, (6, 40)).astype(float)
    got = de.ASDETECT(5, 13, segmentation=mode).block(v, np.arange(40.0))
    assert all(np.allclose(g, plain(x, np.arange(40.0), 5, 13, mode == "two_sided")) for g, x in zip(got, v))


def test_lengths():
    with pytest.raises(ValueError):
        de.ASDETECT().lengths(np.arange(15.0))
    assert de.ASDETECT().lengths(np.arange(18.0)) == (5, 6)
    assert de.ASDETECT(timescale=(10, 40)).lengths(np.arange(0, 200, 2.0)) == (5, 20)
    with pytest.raises(ValueError):
        de.ASDETECT(timescale=(2, 40)).lengths(np.arange(100.0))
    with pytest.raises(ValueError):
        de.ASDETECT(timescale=(10, 40)).lengths(np.arange(30.0) ** 2)


@pytest.fixture(scope="module")
def grid(spark):
    v = np.round(random_series() * 4)
    cells = {0: v, 1: np.ones(50), 2: [None] * 50, 3: [None if i == 7 else x for i, x in enumerate(v)], 4: [float("nan") if i == 9 else x for i, x in enumerate(v)], 5: -v}
    return spark.createDataFrame([(c, i, None if x is None else float(x)) for c, s in cells.items() for i, x in enumerate(s)], "cell_id long, t_idx int, v double")


def test_cells_and_both_forms(grid):
    status = {r.cell_id: (r.constant, r.all_null, r.gappy, r.valid) for r in de.cell_status(grid, "v", 50).collect()}
    assert status == {0: (False, False, False, True), 1: (True, False, False, False), 2: (False, True, False, False), 3: (False, False, True, False), 4: (False, False, True, False), 5: (False, False, False, True)}
    a = {(r.cell_id, r.t_idx): r.dts for r in de.detect(grid, "v", list(range(50))).collect()}
    b = {(r.cell_id, r.t_idx): r.dts for r in de.detect_sql(grid, "v", 50).collect()}
    assert {c for c, _ in a} == {0, 5} and a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_plan_has_one_shuffle_and_no_python_in_sql(grid):
    plan = de.detect_sql(grid, "v", 50)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    plan = de.detect(grid, "v", list(range(50)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def shifts(spark, *series):
    return spark.createDataFrame([(c, i, None if x is None else float(x)) for c, s in enumerate(series) for i, x in enumerate(s)], "cell_id long, t_idx int, dts double")


@pytest.mark.parametrize(
    ("series", "local", "top"),
    [
        ([1, 1, 1], [1], [1]),
        ([1, 0, 1, 1], [0, 2], [0]),
        ([1, 1, 0, 1], [0, 3], [0]),
        ([0, 0.6, -0.7, 0.6, 0], [2], [2]),
        ([0.5, 0.4], [], []),
        ([0.6, None, 0.9], [0, 2], [2]),
        ([0.9, 0.6, 0.9, 0.6], [1], [0]),
        ([], [], []),
    ],
)
def test_peaks(spark, series, local, top):
    df = shifts(spark, series)
    assert sorted(r.t_idx for r in se.local_peaks(df, 0.5).collect()) == local
    assert sorted(r.t_idx for r in se.global_peaks(df, 0.5).collect()) == top


def test_directions(spark):
    df = shifts(spark, [0.6, 0, -0.7, 0, 0.5])
    pick = lambda d: sorted((r.t_idx, r.sign) for r in se.select_points(df, 0.5, d, "all").collect())
    assert pick("both") == [(0, 1), (2, -1)] and pick("positive") == [(0, 1)] and pick("negative") == [(2, -1)]
    for bad in ({"threshold": -1}, {"direction": "up"}, {"selection": "some"}):
        with pytest.raises(ValueError):
            se.select_points(df, **bad)


def test_histogram(spark):
    n = {r.bin: r.n for r in se.shift_histogram(shifts(spark, [-1, 1, 0.999, 0, None]), 20).collect()}
    assert len(n) == 20 and n[0] == 1 and n[19] == 2 and n[10] == 1 and sum(n.values()) == 4
