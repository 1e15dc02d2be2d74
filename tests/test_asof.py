import random

import pytest

from hitstream.operators import asof, lookups


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    targets = [(rng.randrange(4), rng.randrange(60), i) for i in range(120)]
    series = [(rng.randrange(3), rng.randrange(60), i) for i in range(70)]
    return targets, series, spark.createDataFrame(targets, "k long, t long, target long"), spark.createDataFrame(series, "k long, t long, id long")


def near(targets, series, n):
    return {x: [(t2, i) for _, t2, i in sorted((abs(t2 - t), t2, i) for k2, t2, i in series if k2 == k)[:n]] for k, t, x in targets}


def test_nearest_with_ties(tables):
    targets, series, a, b = tables
    got = {r.target: (r.match_t, r.match_id) for r in asof.nearest(a, b, "k", "t", "id").collect()}
    assert got == {x: (m[0] if m else (None, None)) for x, m in near(targets, series, 1).items()}


def test_nearest_two_in_time_order(tables):
    targets, series, a, b = tables
    got = {r.target: [(r.t1, r.id1), (r.t2, r.id2)] for r in asof.nearest_two(a, b, "k", "t", "id").collect()}
    assert got == {x: sorted(m) for x, m in near(targets, series, 2).items() if len(m) == 2}


def test_last_n(tables):
    targets, series, a, b = tables
    got = {}
    for r in asof.last_n(a, b, "k", "t", "id", 4).collect():
        got.setdefault((r.target, r.status), []).append((r.age, r.hist_t, r.hist_id))
    want = {}
    for k, t, x in targets:
        own = sorted((t2, i) for k2, t2, i in series if k2 == k)
        before = [m for m in own if m[0] <= t]
        if not own or t > own[-1][0]:
            want[x, "after_end"] = [(None, None, None)]
        elif len(before) < 4:
            want[x, "too_few"] = [(None, None, None)]
        else:
            want[x, "ok"] = [(4 - i, *m) for i, m in enumerate(before[-4:])]
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}
    assert len({s for _, s in want}) == 3


def test_empty_sides(spark, tables):
    _, _, a, b = tables
    none = spark.createDataFrame([], b.schema)
    assert asof.nearest(a, none, "k", "t", "id").where("match_id is null").count() == 120
    assert asof.nearest_two(a, none, "k", "t", "id").count() == 0
    assert asof.last_n(a, none, "k", "t", "id", 2).where("status = 'after_end'").count() == 120


def test_grid_validation_and_size(spark):
    assert lookups.grid_size(0, 1, 0.25) == 4 and lookups.grid_size(10.0, 12.6, 0.25) == 11
    assert [r.t for r in lookups.time_grid(spark, 5.0, 6.0, 0.5).orderBy("idx").collect()] == [5.0, 5.5]
    for bad in ((0, 1, 0), (0, 1, -1), (1, 1, 0.1), (2, 1, 0.1)):
        with pytest.raises(ValueError):
            lookups.grid_size(*bad)


def test_chunks(spark):
    assert [r.id for r in lookups.chunk(spark.range(12), "id", 2, 5).orderBy("id").collect()] == [10, 11]


def test_small_marks_by_size(spark):
    assert "broadcast" in lookups.small(spark.range(10))._jdf.queryExecution().toString().lower()
    assert "broadcast" not in lookups.small(spark.range(10), 5)._jdf.queryExecution().logical().toString().lower()
