import numpy as np
import pytest

from hitstream.functions import kernels
from hitstream.functions.kernels import Flt0

P = Flt0(th1=500, th2=100, t_quiet=20, t_period=40, t_sepmax=30, nc_min=2, nc_max=8)


def trace(values):
    t = np.zeros(512, dtype=int)
    for k, v in values.items():
        t[k] = v
    return t


CASES = {
    "01": ({}, []),
    "02": ({130: 700, 131: 110, 133: 110, 140: 550}, [(130, 3)]),
    "03": ({150: 700, 152: 110}, []),
    "04": ({150: 800, 152: 110, 154: 110}, [(150, 3)]),
    "05": ({150: 800} | {152 + 2 * k: 110 for k in range(7)}, []),
    "06": ({150: 800} | {152 + 2 * k: 110 for k in range(9)}, []),
    "07": ({150: 800, 152: 110, 179: 110}, []),
    "08": ({50: 800, 52: 110, 54: 110}, []),
    "09": ({150: 800, 152: 110, 154: 110, 350: 800, 352: 110, 354: 110}, [(150, 3), (350, 3)]),
    "10": ({150: 800, 152: 110, 168: 110}, []),
    "11": ({150: 800, 152: 110, 166: 110}, [(150, 3)]),
}


@pytest.mark.parametrize("case", CASES)
def test_flt0_cases(case):
    values, want = CASES[case]
    assert [(i, nc) for i, nc, _ in kernels.flt0(trace(values), P)] == want


def slow_flt0(x, p):
    out = []
    for i in range(len(x)):
        if x[i] <= p.th1 or i <= p.skip or any(v > p.th1 for v in x[max(0, i - p.t_quiet // 2) : i]):
            continue
        at = [i] + [j for j in range(i + 1, min(len(x), i + p.t_period // 2)) if x[j] > p.th2 >= x[j - 1]]
        if p.nc_min < len(at) < p.nc_max and all(2 * (b - a) <= p.t_sepmax for a, b in zip(at, at[1:])):
            out.append((i, len(at), float(x[i])))
    return out


@pytest.mark.parametrize("seed", range(20))
def test_flt0_against_the_definition(seed):
    x = np.random.default_rng(seed).normal(0, 220, 400)
    p = Flt0(th1=420, th2=150, t_quiet=16, t_period=44, t_sepmax=16, nc_min=2, nc_max=7, skip=20)
    assert kernels.flt0(x, p) == slow_flt0(x, p)


def slow_notch(x):
    c = kernels.notch_coefficients()
    g = lambda a, n: a[n] if n >= 0 else 0.0
    y1, y2, y = [], [], []
    for n in range(len(x)):
        y1.append(c["b2"] * x[n] + c["b1"] * g(x, n - 1) + g(x, n - 2))
        y2.append(y1[n] + c["b3"] * g(y1, n - 1) + c["b4"] * g(y1, n - 2))
        y.append(c["a1"] * g(y, n - 4) + c["a2"] * g(y, n - 8) + g(y2, n - 2) + c["b5"] * g(y2, n - 4) + c["b6"] * g(y2, n - 6))
    return y


def test_notch_against_the_recurrence():
    x = np.random.default_rng(0).normal(0, 100, (3, 300))
    assert np.allclose(kernels.notch(x), [slow_notch(r) for r in x], rtol=1e-12, atol=1e-9)


def test_notch_removes_its_frequency():
    t = np.arange(4000) / kernels.FS
    power = lambda f: (kernels.notch(np.sin(2 * np.pi * f * t)[None, :])[0, 2000:] ** 2).mean()
    assert power(39e6) < 1e-3 * power(100e6)


def test_fir_impulse_and_floor():
    taps = np.array([0.25, 0.5, 0.25])
    x = np.zeros((1, 100))
    x[0, 10] = 1000
    y = kernels.fir(x, taps)[0]
    assert [(i, v) for i, v in enumerate(y) if v] == [(70, 250), (71, 500), (72, 250)]
    x[0, 10] = -3
    assert [v for v in kernels.fir(x, taps)[0] if v] == [-1, -2, -1]  # floor, not truncation


def test_calibration_gain_and_rounding():
    x = np.zeros((1, 64))
    x[0, 0] = 5
    assert kernels.calibrate(x, np.array([0.0, 250.0]), np.array([0.5, 0.5]))[0, 0] == 2  # 2.5 rounds to even
    tone = 1000 * np.cos(2 * np.pi * 50 * np.arange(500) / 500)[None, :]
    assert abs(kernels.calibrate(tone, np.array([40.0, 60.0]), np.array([1.0, 3.0])).max() - 2000) <= 1


def test_int16_truncates_and_wraps():
    assert kernels.as_int16(np.array([1.9, -1.9, 32768.2])).tolist() == [1, -1, -32768]


def test_correlation_is_one_for_a_scaled_template():
    t = np.sin(np.arange(20) / 2)
    x = np.zeros((2, 100))
    x[0, 37:57] = -3 * t
    c = kernels.correlations(x, t)
    assert c[0].argmin() == 37 and c[0, 37] == pytest.approx(-1) and not c[1].any()
    which, shift, corr = kernels.best_template(x, [t, t, np.ones(20)])
    assert (which.tolist(), shift.tolist()) == ([0, -1], [37, 0]) and corr[0] == pytest.approx(1)


def test_template_fit():
    fine = np.sin(np.arange(40) / 4)
    x = np.zeros(300)
    x[100:120] = 2 * fine[1::2]
    k, s, peak, corr = kernels.template_fit(x, 108, [fine], peak=8, window=6, factor=2)
    assert (k, s, peak) == (0, 1, 108) and corr == pytest.approx(1)
    assert kernels.template_fit(x, 299, [fine], 8, 6, 2) is None
    assert kernels.template_fit(np.zeros(300), 108, [fine], 8, 6, 2)[0] == -1


def test_flt1_selection():
    assert kernels.flt1(512, 0.5, 0.9) == (32768, 2) and kernels.flt1(1024, 0.9, 0.5) == (32768, 3)
    assert kernels.flt1(1536, 0.5, 0.5)[1] == 3 and kernels.flt1(1536, 0.6, 0.5)[1] == 2 and kernels.flt1(512, None, 0.4) == (None, 2)


def test_fixed_point():
    assert kernels.q20_12(1.0) == 4096 and kernels.q20_12(-1.0) == (1 << 32) - 4096


def test_over_traces_keeps_ids_and_lengths_apart(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [3.0]), (4, []), (5, [4.0, 5.0])], "id long, x array<double>")
    got = kernels.over_traces(df, ["id"], "x", "s double", lambda x: [(i, float(r.sum())) for i, r in enumerate(x)]).collect()
    assert sorted(map(tuple, got)) == [(1, 3.0), (3, 3.0), (5, 9.0)]
