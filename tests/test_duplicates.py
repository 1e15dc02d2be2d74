import random

from hitstream.operators import filters


def test_duplicate_events_against_all_pairs(spark):
    rng = random.Random(2)
    rows = lambda n: [(e, a, b, rng.randrange(-60, 60)) for e in range(n) for a in range(4) for b in range(a + 1, 4) if rng.random() < 0.8]
    now, old = rows(12), rows(15)
    want = {}
    for e, a, b, d in now:
        for h, x, y, k in old:
            if (a, b) == (x, y) and abs(d - k) < 25:
                want[e, h] = want.get((e, h), 0) + 1
    got = filters.duplicate_events(spark.createDataFrame(now, "event long, a long, b long, dt long"), spark.createDataFrame(old, "hist long, a long, b long, dt long"), 25, 3)
    assert {(r.event, r.hist): r.matches for r in got.collect()} == {k: v for k, v in want.items() if v >= 3}


def test_pairs_take_the_last_of_a_repeated_pair(spark):
    hits = spark.createDataFrame([(1, 5, 0, 0), (1, 2, 4, 1), (1, 5, 9, 2)], "event long, du long, t long, i int")
    got = {(r.a, r.b): r.dt for r in filters.pairs_of(hits, "event").collect()}
    assert got == filters.pair_differences([5, 2, 5], [0, 4, 9])
