import random
import tracemalloc

import numpy as np
import pytest

from hitstream.operators import filters, fragments, windows
from hitstream.operators.filters import FilterConfig, TriggerFilter


def slow_windows(hits, window, nhit):
    """The definition, hit by hit."""
    hits, out, i = sorted(hits), [], 0
    while i < len(hits):
        inside = [h for h in hits[i:] if h[0] - hits[i][0] <= window]
        if len({du for _, du in inside}) >= nhit:
            out.append(inside)
            i += len(inside)
        else:
            i += 1
    return out


@pytest.mark.parametrize("seed", range(30))
def test_greedy_windows(seed):
    rng = random.Random(seed)
    hits = sorted((rng.randrange(200), rng.randrange(8)) for _ in range(rng.randrange(60)))
    t, du = (np.array([h[i] for h in hits], dtype=np.int64) for i in (0, 1))
    window, nhit = rng.randrange(1, 25), rng.randrange(1, 5)
    assert [hits[i:j] for i, j in windows.greedy(t, du, window, nhit)] == slow_windows(hits, window, nhit)


def test_windows_and_flags(spark):
    rng = random.Random(1)
    hits = [(b, b * 1000 + rng.randrange(1000), rng.randrange(9)) for b in range(6) for _ in range(40)]
    df = spark.createDataFrame(hits, "tm_id long, t long, du long")
    got = sorted((r.tm_id, r.window_start, r.window_end, r.hit_count, r.du_ids) for r in windows.coincidences(df, 60, 4).collect())
    want = []
    for b in range(6):
        want += [(b, w[0][0], w[-1][0], len(w), sorted({d for _, d in w})) for w in slow_windows([(t, d) for x, t, d in hits if x == b], 60, 4)]
    assert got == sorted(want) and got
    first = windows.coincidences(df, 60, 4, first_only=True).collect()
    assert len(first) == len({r[0] for r in got})
    flags = windows.candidate_flags(df, 60, 4).collect()
    assert all(r.n_du == len({d for x, t, d in hits if x == r.tm_id and r.t <= t <= r.t + 60}) for r in flags)


def cliques(near, n):
    best = []
    for mask in range(1 << n):
        own = [i for i in range(n) if mask >> i & 1]
        if len(own) > len(best) and all(near[i] >> j & 1 for i in own for j in own if i != j):
            best = own
    return len(best)


@pytest.mark.parametrize("seed", range(40))
def test_causal_subset_is_a_maximum_clique(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 11)
    du, t = [rng.randrange(7) for _ in range(n)], sorted(rng.randrange(300) for _ in range(n))
    far = {(a, b): rng.randrange(200) for a in range(7) for b in range(a, 7) if rng.random() < 0.8}
    got = filters.maximum_causal_subset(du, t, far, 5)
    near = filters.adjacency(du, t, far, 5)
    assert got == sorted(got) and all(near[i] >> j & 1 for i in got for j in got if i != j)
    assert len(got) == cliques(near, n)


def test_ties_take_the_first_in_exploration_order():
    # two separate pairs of equal degree: the one that holds the earliest hit is reached first
    assert filters.maximum_causal_subset([1, 2, 3, 4], [0, 10, 1, 11], {(1, 2): 50.0, (3, 4): 50.0}) == [0, 1]
    # equal degrees and times: the smaller id leads, whatever its index
    assert filters.maximum_causal_subset([9, 8, 3, 4], [0, 0, 0, 0], {(8, 9): 1.0, (3, 4): 1.0}) == [2, 3]
    # a higher degree leads: hit 2 knows two partners, and its first partner in order completes the pair
    assert filters.maximum_causal_subset([1, 2, 3], [5, 6, 0], {(1, 3): 50.0, (2, 3): 50.0}) == [0, 2]


def test_same_du_is_not_compatible_with_itself():
    assert filters.maximum_causal_subset([1, 1, 2], [0, 1, 2], {(1, 1): 99.0, (1, 2): 99.0}) == [0, 2]


def first_in_order(du, t, far, tolerance):
    """The search by its definition: every subproblem of the pivot rule in turn, a clique counts if it is larger than the best so far."""
    near = filters.adjacency(du, t, far, tolerance)
    rank = sorted(range(len(du)), key=lambda i: (-near[i].bit_count(), t[i], du[i], i))
    near = [{j for j in rank if near[i] >> j & 1} for i in range(len(du))]
    best = []

    def search(clique, open_, tried):
        nonlocal best
        if not open_ and not tried and len(clique) > len(best):
            best = clique
        if not open_ or len(clique) + len(open_) <= len(best):
            return
        pivot = max((*open_, *tried), key=lambda v: len(near[v] & set(open_)))
        for v in [v for v in open_ if v not in near[pivot]]:
            search([*clique, v], [x for x in open_ if x in near[v]], [x for x in tried if x in near[v]])
            open_, tried = [x for x in open_ if x != v], [*tried, v]

    search([], rank, [])
    return sorted(best)


@pytest.mark.parametrize("seed", range(60))
def test_causal_subset_is_the_first_in_order(seed):
    rng = random.Random(seed)
    n, k, span = rng.randrange(45), rng.randrange(1, 30), rng.choice([5, 40, 300, 3000])
    hits = sorted((rng.randrange(span), rng.randrange(k)) for _ in range(n))
    hits = [h for h in hits for _ in range(rng.choice([1, 1, 1, 4]))]  # hits of a DU at one time
    t, du = [h[0] for h in hits], [h[1] for h in hits]
    if seed % 3 == 0:
        rng.shuffle(t)
    far = {(a, b): rng.choice([rng.randrange(200), 20.5, -3.0]) for a in range(k) for b in range(a if seed % 2 else 0, k) if rng.random() < 0.8}
    assert filters.maximum_causal_subset(du, t, far, 2.5) == first_in_order(du, t, far, 2.5)


def test_causal_subset_of_many_hits():
    """Each hit sixty times, and a window in which all fits: the same clique as once, without a subproblem for each hit."""
    rng = np.random.default_rng(1)
    t, du = np.sort(rng.integers(0, 7200, 278)), rng.integers(0, 50, 278)
    far = {(a, b): 3.0 * (b - a) + 10 for a in range(50) for b in range(a, 50) if (a + b) % 7}
    got = filters.maximum_causal_subset(np.repeat(du, 60), np.repeat(t, 60), far, 60)
    assert got == [60 * i for i in filters.maximum_causal_subset(du, t, far, 60)] and len(got) > 4
    everywhere = {(a, b): 50.0 for a in range(150) for b in range(a, 150)}
    assert filters.maximum_causal_subset(np.arange(150), np.arange(150) // 10, everywhere) == list(range(150))


def config(**k):
    return FilterConfig(**({"window": 100, "nhit": 2} | k))


def test_filter_chain_order_and_history():
    f = TriggerFilter(config(template=True, coefficient=0.5, duplicate=True, history=2, time_diff=5, min_pairs=1))
    a = (np.array([1, 2]), np.array([0, 10]), np.array([60_000, 60_000]))
    low = (a[0], a[1], np.array([100, 100]))
    assert f.decide(*low) == ([0, 1], "template_below_threshold") and f.previous == {}
    assert f.decide(*a)[1] == "" and f.decide(a[0], a[1] + 3, a[2])[1] == "duplicate"
    assert f.decide(a[0], np.array([0, 15]), a[2])[1] == ""  # a difference of exactly 5 is not below it
    assert list(f.history) == [{(1, 2): -10}]
    with pytest.raises(ValueError):
        TriggerFilter(config(causal=True))


def test_pair_sign():
    assert filters.pair_differences([5, 2, 5], [0, 4, 9]) == {(2, 5): -5, (5, 5): -9}
    assert filters.pair_differences([5, 2], [0, 4], canonical_sign=True) == {(2, 5): 4}


def test_pairs_of_a_window_with_many_hits_of_few_dus():
    rng = random.Random(3)
    for n in range(0, 40):
        du, t = [rng.randrange(5) for _ in range(n)], sorted(rng.randrange(90) for _ in range(n))
        for sign in (False, True):
            want = {}
            for i in range(n):
                for j in range(i + 1, n):
                    want[min(du[i], du[j]), max(du[i], du[j])] = (t[j] - t[i] if sign and du[i] > du[j] else t[i] - t[j])
            assert filters.pair_differences(du, t, sign) == want
    tracemalloc.start()
    assert len(filters.pair_differences(np.arange(4000) % 50, np.arange(4000))) == 50 * 51 // 2
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 10e6  # all 8 million pairs took hundreds of MB


def test_high_multiplicity_passes_unsearched():
    f = TriggerFilter(config(causal=True), {(1, 2): 1.0})
    assert f.decide(np.arange(20), np.arange(20) * 1000, np.zeros(20))[0] == list(range(20))
    assert f.decide(np.arange(19), np.arange(19) * 1000, np.zeros(19)) == ([0], "causal_subset_too_small")


@pytest.mark.parametrize("n", [4, 19, 20, 60])
def test_a_window_of_any_size_is_searched(n):
    f = TriggerFilter(config(causal=True, bypass=None), {(0, 1): 10.0, (0, 2): 10.0, (1, 2): 10.0})
    assert f.decide(np.arange(n), np.arange(n) * 2, np.zeros(n)) == ([0, 1, 2], "")


def test_trigger_end_to_end(spark):
    """Five hits 3 us apart trigger; the same event again is a duplicate."""
    hits = [(0, d, 1_000_000 + 3000 * d, 60_000) for d in range(5)] + [(0, d, 2_000_000 + 3000 * d, 60_000) for d in range(5)]
    df = spark.createDataFrame(hits, "tm_id long, du long, t long, score long")
    out = windows.trigger(df, None, config(window=15_000, nhit=5, template=True, coefficient=0.5, duplicate=True, history=10, time_diff=100, min_pairs=2)).orderBy("window_start").collect()
    assert [(r.triggered, r.reject_reason) for r in out] == [(True, None), (False, "duplicate")]
    assert out[0].selected_du_ids == [0, 1, 2, 3, 4] and out[1].selected_t == []
    wide = spark.createDataFrame([(0, d, 9000 * d, 60_000) for d in range(10)], "tm_id long, du long, t long, score long")
    assert windows.trigger(wide, None, config(window=15_000, nhit=5)).count() == 0


def test_fragment_validity(spark):
    f = spark.createDataFrame([(1, 1, 9, 0), (1, 1, 9, 1), (1, 3, 9, 2), (2, 1, 9, 3), (1, 7, 9, 4), (1, 2, 0, 5)], "tag long, du int, size int, seq int")
    p = spark.createDataFrame([(1, [1, 2])], "tag long, expected array<int>")
    d = spark.createDataFrame([(1,), (2,), (3,)], "du int")
    got = {r.seq: r.label for r in fragments.validity(f, p, d, ["seq"]).collect()}
    assert got == {0: "ok", 1: "duplicate", 2: "not_expected", 3: "no_pending", 4: "invalid", 5: "invalid"}
    done = spark.createDataFrame([(1, [2]), (2, [2, 3]), (3, [])], "tag int, missing array<int>")
    assert sorted(map(tuple, fragments.missing_per_du(done).collect())) == [(2, 2), (3, 1)]


def test_statistics_of_the_chain(spark):
    hits = spark.createDataFrame([(0, 10 * i + d, d, 30_000 if i else 10) for i in range(3) for d in range(4)], "tm_id long, t long, du long, score long")
    config = FilterConfig(window=5, nhit=3, causal=True, template=True, coefficient=0.1, duplicate=True, time_diff=1, min_pairs=2)
    far = {(a, b): 10.0 for a in range(4) for b in range(4)}
    out = windows.trigger(hits, far, config)
    rows, s = out.collect(), windows.statistics(out, config).first()
    assert [r.reject_reason for r in sorted(rows)] == ["template_below_threshold", None, "duplicate"]
    assert (s.windows, s.triggered, s.causal_evaluated, s.causal_input_sum, s.causal_kept_max, s.causal_rejected, s.bypassed) == (3, 1, 3, 12, 4, 0, 0)
    assert (s.template_evaluated, s.template_rejected, s.duplicate_rejected, s.nhit_rejected) == (3, 1, 1, 0) and abs(s.template_mean_max - 30_000 / 65_536) < 1e-12


@pytest.mark.parametrize("rows", [1, 7, 64])
def test_windows_from_pieces(rows):
    rng = random.Random(rows)
    for _ in range(20):
        hits = sorted((rng.randrange(300), rng.randrange(8)) for _ in range(rng.randrange(1, 150)))
        t, du = (np.array([h[i] for h in hits], dtype=np.int64) for i in (0, 1))
        c = config(window=rng.randrange(1, 25), nhit=rng.randrange(1, 6))
        pieces = [[x[k : k + rows] for x in (t, du, du * 1.0)] for k in range(0, len(t), rows)]
        got = list(windows._windows(iter(pieces), c))
        assert [list(zip(w[0].tolist(), w[1].tolist())) for w in got] == slow_windows(hits, c.window, c.nhit)


def test_a_bucket_is_never_held_whole():
    n, c = 200_000, config(window=100, nhit=3)
    t, most = np.arange(n, dtype=np.int64), 0
    for _ in windows._windows(([t[k : k + 1000], t[k : k + 1000] % 50, t[k : k + 1000] * 1.0] for k in range(0, n, 1000)), c):
        if not tracemalloc.is_tracing():
            tracemalloc.start()
        most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1e6  # the bucket has 4.8 MB


def test_history_of_an_array_runs_over_batches_and_buckets(spark):
    """Arrays of which one is unnamed; the history of each goes on in its next bucket and starts anew in another array."""
    rows = [(a, b, d, 1000 * b + 3 * d, 60_000) for a in ("x", None) for b in range(40) for d in range(5)]
    df = spark.createDataFrame(rows, "array string, tm_id long, du long, t long, score long")
    c = config(window=100, nhit=5, duplicate=True, time_diff=2, min_pairs=2)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        out = windows.trigger(df, None, c, "array").collect()
        alone = windows.trigger(df.where("array = 'x'"), None, c).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(out) == 80 and sorted(r.tm_id for r in out if r.triggered) == [0, 0]
    assert len(alone) == 40 and all(r.triggered for r in alone)
