import numpy as np
import pytest
from pyspark.sql import functions as F

from hitstream.operators import electronics, pipeline
from hitstream.operators.filters import FilterConfig

PULSE = np.array([0, 800, 0, 200, 0, 200, 0, 0], dtype=float)


def config(**k):
    trigger = FilterConfig(window=20_000, nhit=3, **k)
    return pipeline.Cascade(20, 40, 30, 2, 8, 0.5, 3, trigger, notch=False, peak=1, window=4)


@pytest.fixture(scope="module")
def inputs(spark):
    quiet = [0] * 300
    loud = list(quiet)
    loud[150:158] = PULSE.astype(int).tolist()
    sim = []
    for event, dus in ((1, [1, 2, 3, 4]), (2, [1, 2]), (3, [1, 2, 3, 9])):
        for d in (1, 2, 3, 4, 9):
            on = loud if d in dus else quiet
            sim.append((event, d if event != 1 else 65_000 + d, 10**9 + 3000 * d, 10_000 * event, on, quiet, quiet))
    sim = spark.createDataFrame(sim, "event long, du long, t_ns long, scan_ns long, x array<int>, y array<int>, z array<int>")
    du_map = spark.createDataFrame([(d, 100 + d) for d in (1, 2, 3, 4)], "du long, feb_id int")
    md = spark.createDataFrame([(100 + d, t, t, quiet, quiet, quiet) for d in (1, 2, 3, 4) for t in (9_000, 19_000, 31_000)], "feb_id int, t_ns long, entry long, x array<int>, y array<int>, z array<int>")
    th = spark.createDataFrame([(100 + d, c, 500.0, 100.0) for d in (1, 2, 3) for c in "xy"], "feb_id int, channel string, th1 double, th2 double")
    return sim, du_map, md, th


def test_cascade(spark, inputs):
    got = {r.event: r for r in pipeline.process(*inputs, {"x": [PULSE], "y": [PULSE]}, config()).collect()}
    assert (got[1].n_flt0, got[1].n_flt1, got[1].triggered, got[1].selected_du_ids) == (3, 3, True, [65001, 65002, 65003])  # DU 4 has no thresholds
    assert (got[2].n_flt1, got[2].triggered, got[2].reject_reason) == (2, False, None)  # too few for the second level
    assert (got[3].n_flt0, got[3].triggered) == (3, True)  # DU 9 has no front end


def test_background_counts(spark, inputs):
    sim, du_map, md, th = inputs
    drowned = md.withColumn("x", F.when(F.col("t_ns") == 9_000, F.transform("x", lambda v: v + 600)).otherwise(F.col("x")))
    got = {r.event: r.triggered for r in pipeline.process(sim, du_map, drowned, th, {"x": [PULSE], "y": [PULSE]}, config()).collect()}
    assert got == {1: False, 2: False, 3: True}  # event 1 lies nearest to the drowned background
    assert {r.event: r.n_flt0 for r in pipeline.process(sim, du_map, md.where("false"), th, {"x": [PULSE], "y": [PULSE]}, config()).collect()} == {1: 0, 2: 0, 3: 0}


def test_calibration_scales_the_signal(spark, inputs):
    sim, du_map, md, th = inputs
    cal = spark.createDataFrame([(100 + d, "x", [0.0, 250.0], [0.1, 0.1]) for d in (1, 2, 3)], "feb_id int, channel string, freq array<double>, gain array<double>")
    assert not any(r.triggered for r in pipeline.process(sim, du_map, md, th, {"x": [PULSE], "y": [PULSE]}, config(), calibration=cal).collect())


def test_causal_cascade(spark, inputs):
    far = {(65_000 + a, 65_000 + b): 1.0 for a in range(5) for b in range(a, 5)} | {(a, b): 1e6 for a in range(5) for b in range(a, 5)}
    got = {r.event: (r.triggered, r.reject_reason) for r in pipeline.process(*inputs, {"x": [PULSE], "y": [PULSE]}, config(causal=True), far).collect()}
    assert got == {1: (False, "causal_subset_too_small"), 2: (False, None), 3: (True, None)}


def test_patterns_outcomes_registers(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "x boolean, y boolean")
    assert [r.p for r in df.select(electronics.trigger_pattern(F.col("x"), F.col("y")).alias("p")).collect()] == [1536, 512, 1024, None]
    sc = spark.createDataFrame([(False, None), (True, None), (True, 30_000), (True, 40_000)], "f boolean, s int")
    assert [r.o for r in sc.select(electronics.outcome(F.col("f"), F.col("s"), 0.5).alias("o")).collect()] == ["FLT0", "FLT_SUPPRESSED", "FLT1", "PASS"]
    one = spark.range(1)
    n = lambda v: F.lit(v)
    t = one.select(electronics.event_time(n(2024), n(1), n(1), n(0), n(0), n(18), n(250), n(1000 | (1 << 31))).alias("t")).first().t
    assert t == 1704067200 * 10**9 + 250_000_000
    regs = one.select(*[f(F.lit(20)).alias(k) for k, f in electronics.REGISTERS.items()]).first()
    assert (regs.rate, regs.half, regs.tenth, regs.from_one, regs.inverted) == (20 << 8 | 143, 10, 2, 19, 0)
    words = spark.createDataFrame([(0, 0, 4, 5), (0, 4, 4, 3), (8, 2, 1, 1)], "base int, start int, nbits int, value int")
    assert sorted(map(tuple, electronics.packed(words).collect())) == [(0, 53), (8, 4)]
    with pytest.raises(Exception, match="does not fit"):
        electronics.packed(spark.createDataFrame([(0, 0, 2, 4)], "base int, start int, nbits int, value int")).collect()
    assert [r.x for r in one.select(electronics.saturating_add(n(2**63 - 2), n(5)).alias("x")).collect()] == [2**63 - 1]


def test_batches_routes_regressions(spark):
    h = spark.createDataFrame([(1, 10**9 + 5), (1, 10**9 + 2), (1, 10**9 + 5), (1, 2 * 10**9), (2, 7)], "du long, t_ns long")
    assert sorted((r.du, r.second, r.times) for r in electronics.second_batches(h).collect()) == [(1, 1, [10**9 + 2, 10**9 + 5]), (1, 2, [2 * 10**9]), (2, 0, [7])]
    assert sorted(map(tuple, electronics.trigger_frequency(h).collect())) == [(1, 1, 3), (1, 2, 1), (2, 0, 1)]
    ev = spark.createDataFrame([(32, 0), (512, 50), (512, 49)], "pattern int, score int")
    assert [r.route for r in electronics.routed(ev, 50).collect()] == ["raw", "t2", "dropped"]
    seq = spark.createDataFrame([(1, i, b) for i, b in enumerate([3, 2, 4, 4, 3, 5])], "du int, i int, tm_id long")
    assert [r.tm_id for r in electronics.regressed(seq, ["du"], ["i"]).orderBy("i").collect()] == [3, 4, 4, 5]
    act = spark.createDataFrame([(1, 5), (1, 90), (2, 40)], "du int, t long")
    assert electronics.active_dus(act, 100, 30).first().active_du_count == 1
