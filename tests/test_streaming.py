import random
import time

import pytest
from pyspark.sql import functions as F

from hitstream.streaming import builder, gate
from hitstream.streaming.builder import Builder
from hitstream.streaming.gate import Gate, GateConfig


def config(**k):
    return GateConfig(**({"cut": 100, "timeout": 50, "cap": 80, "idle_gap": 20, "retention": 500} | k))


def close_time(mode, arrivals, **k):
    g = Gate(config(mode=mode, **k))
    for now, du, t in arrivals:
        g.arrive(now, du, [t])
    return g.next_deadline()


def test_deadline_modes():
    hits = [(0, 1, 10), (45, 2, 20), (60, 3, 30)]
    assert close_time("last_arrival", hits) == 110
    assert close_time("first_arrival", hits[:2]) == 50
    assert close_time("bounded_sliding", hits) == 80  # the cap
    assert close_time("bounded_sliding", hits[:2]) == 65  # 45 + idle gap
    assert close_time("bounded_sliding", [(0, 1, 10), (40, 1, 10)]) == 50  # nothing new: no progress
    assert close_time("bounded_sliding", [(0, 1, 10), (40, 1, 10)], extend_on_progress_only=False) == 60


def test_replace_and_append():
    g = Gate(config())
    g.arrive(0, 1, [10, 10, 20])
    g.arrive(1, 1, [30])
    assert g.pending[0].hits == {1: [30]}
    g.arrive(2, 1, [30, 40], replace=False)
    assert g.pending[0].hits == {1: [30, 40]}
    g.arrive(3, 2, [50, 150])
    assert sorted(g.pending) == [0, 1]


def test_late_hits():
    g = Gate(config())
    g.arrive(0, 1, [10])
    g.arrive(70, 2, [20])  # still pending but past its deadline
    assert g.stats["late_ingress"] == 1 and g.stats["late_age_max"] == 20
    assert [c.reason for c in g.poll(70)] == ["timeout"]
    g.arrive(80, 2, [20])
    assert g.stats["late_guard"] == 1 and not g.pending
    g.arrive(600, 2, [20])  # the guard has been forgotten
    assert list(g.pending) == [0] and g.stats["late"] == 2


def test_capacity_and_drain():
    g = Gate(config(max_pending=2))
    for i, t in enumerate((500, 100, 300)):
        g.arrive(i, 1, [t])
    out = g.poll(3)
    assert [(c.tm_id, c.reason) for c in out] == [(5, "forced")] and g.stats["forced"] == 1
    assert [c.tm_id for c in g.drain(4)] == [1, 3]


def test_shadow_completion_is_only_observed():
    g = Gate(config(expected=(1, 2)))
    for du in (1, 2):
        g.arrive(0, du, [10])
    for du in (1, 2):
        g.arrive(1, du, [110])
    assert g.stats["shadow"] == 1 and sorted(g.pending) == [0, 1]


@pytest.mark.parametrize("bad", [{"mode": "x"}, {"cut": 0}, {"timeout": 0}, {"max_pending": 0}, {"cap": 10}])
def test_config_validation(bad):
    with pytest.raises(ValueError):
        config(**bad)


def arrivals(seed):
    rng = random.Random(seed)
    t = sorted(rng.randrange(3000) for _ in range(300))
    return [(a, x + rng.randrange(120), i, rng.randrange(5), x) for a in ("p", "q") for i, x in enumerate(t)]


ARRIVALS = "array string, arrival long, seq long, du long, t long"


def model(rows, cfg):
    out = []
    for a in ("p", "q"):
        g = Gate(cfg)
        for _, now, _, du, t in sorted(r for r in rows if r[0] == a):
            while (at := g.next_deadline()) is not None and at <= now:
                out += [(a, c.tm_id, c.closed_at, c.reason, c.hit_count, c.du_ids) for c in g.poll(at)]
            g.arrive(now, du, [t], replace=False)
            out += [(a, c.tm_id, c.closed_at, c.reason, c.hit_count, c.du_ids) for c in g.poll(now)]
        while (at := g.next_deadline()) is not None:
            out += [(a, c.tm_id, c.closed_at, c.reason, c.hit_count, c.du_ids) for c in g.poll(at)]
    return sorted(out)


def closed(rows):
    return sorted((r.array, r.tm_id, r.closed_at, r.reason, r.hit_count, r.du_ids) for r in rows)


def test_replay_is_the_model(spark):
    rows = arrivals(1)
    assert closed(gate.replay(spark.createDataFrame(rows, ARRIVALS), config()).collect()) == model(rows, config())


def test_stream_is_the_replay(spark, tmp_path):
    rows = sorted(arrivals(2), key=lambda r: r[1])
    for i in range(4):  # files in order of arrival, then one that moves the clock to the end
        part = rows[i * 150 : (i + 1) * 150]
        spark.createDataFrame(part, ARRIVALS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(a, 1 << 40, 0, None, None) for a in ("p", "q")], ARRIVALS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(ARRIVALS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = gate.stream(source, config()).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
    run.trigger(availableNow=True).start().awaitTermination()
    assert closed(spark.read.parquet(str(tmp_path / "out")).collect()) == model(rows, config())


def test_statistics_are_the_models(spark):
    rows, cfg = arrivals(5), config(max_pending=1)
    got = {r.array: r.asDict() for r in gate.statistics(spark.createDataFrame(rows, ARRIVALS), cfg).collect()}
    for a in ("p", "q"):
        g = Gate(cfg)
        for _, now, _, du, t in sorted(r for r in rows if r[0] == a):
            while (at := g.next_deadline()) is not None and at <= now:
                g.poll(at)
            g.arrive(now, du, [t], replace=False)
            g.poll(now)
        while (at := g.next_deadline()) is not None:
            g.poll(at)
        assert got[a] == {"array": a} | g.stats and g.stats["forced"] and g.stats["closed"]


def test_batches_replace(spark):
    rows = [("p", 0, 0, 1, [10, 20]), ("p", 5, 1, 1, [30]), ("p", 6, 2, 2, [40, 140])]
    df = spark.createDataFrame(rows, "array string, arrival long, seq long, du long, ticks array<long>")
    assert [(r.tm_id, r.hit_count, r.du_ids) for r in sorted(gate.replay(df, config()).collect())] == [(0, 2, [1, 2]), (1, 1, [2])]


def test_heaps_find_what_scans_find():
    """Deadlines, guards and the oldest bucket against the plain reading of their rules, under random arrivals."""
    rng = random.Random(3)
    g, guard = Gate(config(max_pending=4, mode="last_arrival")), {}
    for now in range(0, 4000, 7):
        guard = {k: v for k, v in guard.items() if v > now}
        oldest = min(g.pending.values(), key=lambda b: b.first).tm_id if g.pending else None
        before = set(g.pending)
        g.arrive(now, rng.randrange(3), [rng.randrange(1500)])
        assert set(g.guard) == set(guard) | {k for k in before if k in g.guard}
        if len(g.pending) > 4:
            assert oldest in g.forced
        due = {k for k, b in g.pending.items() if now >= b.close_at}
        closed = {c.tm_id for c in g.poll(now) if c.reason == "timeout"}
        assert closed == due
        guard = dict(g.guard)
        assert g.next_deadline() == min((b.close_at for b in g.pending.values()), default=None)


def test_silent_arrays_wake_up(spark, tmp_path):
    rows = [("p", 10, 0, 1, 10), ("p", 12, 1, 2, 140), ("q", 11, 2, 1, 20)]
    spark.createDataFrame(rows, ARRIVALS).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(ARRIVALS).parquet(str(tmp_path / "in"))
    run = gate.stream(source, config(), wake_ms=300, ticks_per_ms=1).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
    query = run.trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            got = spark.read.schema("array string, tm_id long, reason string").parquet(str(tmp_path / "out")).collect() if (tmp_path / "out").exists() else []
            if len(got) == 3:
                break
    finally:
        query.stop()
    assert sorted((r.array, r.tm_id, r.reason) for r in got) == [("p", 0, "timeout"), ("p", 1, "timeout"), ("q", 0, "timeout")]


def test_builder_outcomes():
    b = Builder(timeout=10, max_pending=2, known=frozenset({1, 2, 3}))
    assert b.begin(0, 7, [1, 2]) == [] and b.begin(0, 7, [1]) == [] and b.begin(0, 9, []) == []
    assert [o.kind for o in b.fragment(1, 7, 9)] == ["invalid_fragment"] and [o.kind for o in b.fragment(1, 7, 1, 0)] == ["invalid_fragment"]
    assert [o.kind for o in b.fragment(1, 8, 1)] == ["no_pending_event"] and [o.kind for o in b.fragment(1, 7, 3)] == ["not_expected"]
    assert b.fragment(2, 7, 2) == [] and [o.kind for o in b.fragment(2, 7, 2)] == ["duplicate_fragment"]
    assert [(o.kind, o.attached) for o in b.fragment(3, 7, 1)] == [("complete", [1, 2])]
    b.begin(4, 1, [1, 2])
    b.begin(5, 2, [1])
    assert [o.kind for o in b.begin(6, 3, [1])] == ["rejected"]
    b.fragment(7, 1, 1)
    assert [(o.tag, o.kind, o.at, o.missing) for o in b.advance(15)] == [(1, "partial", 14, [2]), (2, "timeout", 15, [1])]
    b.begin(16, 5, [3])
    assert [(o.tag, o.kind) for o in b.stop(17)] == [(5, "stop")]


MESSAGES = "tag long, at long, seq long, expected array<int>, du int, size int"


def messages(seed):
    rng = random.Random(seed)
    out = []
    for tag in range(40):
        at = rng.randrange(100)
        out.append((tag, at, 0, list(range(1, rng.randrange(2, 5))), None, None))
        out += [(tag, at + rng.randrange(-2, 30), i + 1, None, rng.randrange(1, 6), 1) for i in range(rng.randrange(6))]
    return out


def outcomes(rows):
    return sorted((r.tag, r.at, r.kind, r.attached, r.missing) for r in rows)


def test_admission_limit_across_tags(spark):
    rows = [(1, 0, 0, [1], None, None), (2, 1, 1, [1], None, None), (3, 2, 2, [1, 2], None, None), (1, 3, 3, None, 1, 1), (4, 4, 4, [1], None, None)]
    df = spark.createDataFrame(rows, MESSAGES).withColumn("array", F.lit("p"))
    got = outcomes(builder.replay(df, 10, "array", 2).collect())
    assert got == [(1, 3, "complete", [1], []), (2, 11, "timeout", [], [1]), (3, 2, "rejected", [], [1, 2]), (4, 14, "timeout", [], [1])]


def test_events_that_get_no_more_messages_end(spark, tmp_path):
    rows = [(1, 0, 0, [1, 2], None, None), (1, 1, 1, None, 1, 1), (2, 1, 2, [1], None, None)]
    spark.createDataFrame(rows, MESSAGES).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(MESSAGES).parquet(str(tmp_path / "in"))
    run = builder.stream(source, 20, wake_ms=300).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
    query = run.trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            got = spark.read.schema(builder.OUTCOME).parquet(str(tmp_path / "out")).collect() if (tmp_path / "out").exists() else []
            if len(got) == 2:
                break
    finally:
        query.stop()
    assert outcomes(got) == [(1, 20, "partial", [1], [2]), (2, 21, "timeout", [], [1])]


def test_builder_replay_and_stream(spark, tmp_path):
    rows = messages(4)
    want = []
    for tag in range(40):
        b, out = Builder(20), []
        for _, at, _, expected, du, size in sorted((r for r in rows if r[0] == tag), key=lambda r: (r[1], r[2])):
            out += b.begin(at, tag, expected) if expected is not None else b.fragment(at, tag, du, size)
        want += [*out, *b.advance(1 << 62)]
    want = sorted((o.tag, o.at, o.kind, o.attached, o.missing) for o in want)
    assert outcomes(builder.replay(spark.createDataFrame(rows, MESSAGES), 20).collect()) == want
    rows = sorted(rows, key=lambda r: (r[1], r[2]))
    for part in (rows[:60], rows[60:], [(tag, 1 << 40, 0, None, None, None) for tag in range(40)]):
        spark.createDataFrame(part, MESSAGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = builder.stream(source, 20).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
    run.trigger(availableNow=True).start().awaitTermination()
    assert outcomes(spark.read.parquet(str(tmp_path / "out")).collect()) == want
