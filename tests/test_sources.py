import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitstream.functions import text
from hitstream.operators import loss, telemetry
from hitstream.sinks import files
from hitstream.sources import binary, config, logs, tables

HEADER = "feb_id th1_x th2_x th1_y th2_y\n"


def write(path, body):
    path.write_text(body)
    return str(path)


def threshold_rows(spark, path):
    return sorted(map(tuple, tables.thresholds(spark, path).collect()))


def test_thresholds_with_all_that_a_file_may_hold(spark, tmp_path):
    body = "# made by hand\r\n\r\n  FEB_ID,th1_x th2_x\tth1_y , th2_y\r\n7,12.5,3 , 9 9\n#8 1 2 3 4\n\n8 1e2 50\t+4 -4"
    assert threshold_rows(spark, write(tmp_path / "t", body)) == [(7, "x", 12.5, 3.0), (7, "y", 9.0, 9.0), (8, "x", 100.0, 50.0), (8, "y", 4.0, -4.0)]


GOOD = "5 9 8 7 6"


@pytest.mark.parametrize(
    "body,why",
    [
        ("", "no header"), ("# only\n\n", "no header"), (HEADER, "no data"), (GOOD, "line 1: the header"), (HEADER.replace("th2_y", "th3_y") + GOOD, "line 1: the header"),
        (HEADER + GOOD + " 5", "line 2: 5 fields"), (HEADER + "5 9 8", "line 2: 5 fields"), (HEADER + "5 9 eight 7 6", "line 2: not numeric"), (HEADER + "5.25 9 8 7 6", "line 2: feb_id"),
        (HEADER + "5 8 9 7 6", "line 2: th1 below th2 in channel x"), (HEADER + "5 9 8 6 7", "line 2: th1 below th2 in channel y"), (HEADER + GOOD + "\n6 9 8 7 6\n5.0 1 1 1 1", "line 4: duplicate"),
        (HEADER + "5 9 8\n" + GOOD + "\n6 1 2 3 4\nx 1 1 1 1", "line 2: 5 fields.*line 4: th1.*line 5: not numeric"),
    ],
)
def test_bad_lines_of_thresholds_are_all_named(spark, tmp_path, body, why):
    with pytest.raises(ValueError, match=why):
        tables.thresholds(spark, write(tmp_path / "t", body))


def test_no_threshold_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.thresholds(spark, tmp_path / "none")


def test_du_maps(tmp_path):
    want = {1: 5, 65001: 5, 2: 6, 65002: 6}
    assert tables.du_to_feb({"1": "5", "65002": 6}) == want
    assert tables.du_to_feb(write(tmp_path / "m.json", '{"1": 5, "2": 6}')) == want
    assert tables.du_to_feb(write(tmp_path / "m.txt", "DU FEB\n# c\n1 5\n65002, 6\n")) == want


def test_distances(spark, tmp_path):
    df = tables.distances(spark, write(tmp_path / "d", "1 2 299.702547\nbad line\n3 3 0\n1 2 599.405094\n"))
    got = {(r.a, r.b): round(r.light, 6) for r in df.collect()}
    assert got == {(1, 2): 2000.0, (2, 1): 2000.0, (3, 3): 0.0}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.distances(spark, str(tmp_path / "none")).count()


def test_arrays(tmp_path):
    assert [t.tolist() for t in tables.templates(write(tmp_path / "t", "# c\n1 2.5\n\n3 4\n"))] == [[1.0, 2.5], [3.0, 4.0]]
    assert tables.traces(write(tmp_path / "r", "1 2\n3 4\n")).tolist() == [[1, 2], [3, 4]]
    assert tables.samples(write(tmp_path / "s", "# c\n5\n6 # x\n")).tolist() == [5, 6]
    assert tables.calibration(tmp_path / "none") is None
    f, c = tables.calibration(write(tmp_path / "c", "f,a,b,c,d,e,g\n1,0,0,0,0,0,2\n3,0,0,0,0,0,4\n"))
    assert f.tolist() == [1, 3] and c.tolist() == [2, 4]
    xml = '<a><b name="PARAM.CoefficientVector">0.25,\n 0.5, 0.25</b></a>'
    assert tables.fir_taps(write(tmp_path / "x", xml)).tolist() == [0.25, 0.5, 0.25]


def test_lookup_tables(spark, tmp_path):
    rec = spark.createDataFrame([(1, 10, 5, "f", 0, [1, 2]), (1, 11, 3, "f", 1, None), (None, 1, 1, "f", 2, [1]), (2, None, None, "g", 0, [3])], "feb_id int, sec long, nsec long, file_path string, entry_index int, x array<int>")
    got = sorted(map(tuple, tables.md_lookup(rec).collect()))
    assert got == [(1, 10.000000005, "f", 0, 2), (1, 11.000000003, "f", 1, 0), (2, 0.0, "g", 0, 1)]
    rel = sorted((r.entry_index, r.relative_time_sec) for r in tables.relative_entries(rec, 1).collect())
    assert rel == [(0, "0.000000000"), (1, "0.999999998")]
    tables.md_lookup(rec).withColumnRenamed("feb_id", "du_id").write.parquet(str(tmp_path / "l.parquet"))
    assert "feb_id" in tables.lookup_table(spark, str(tmp_path / "l.parquet")).columns
    rec.select("feb_id").write.csv(str(tmp_path / "bad"), header=True)
    with pytest.raises(ValueError, match="missing columns"):
        tables.lookup_table(spark, str(tmp_path / "bad"))


def test_simulation_folders(spark, tmp_path):
    for d, names in (("sim_0002", ["adc_b.root", "adc_a.root", "shower_x.root"]), ("sim_0001", ["adc_a.root", "shower_x.root"]), ("sim_0003", ["adc_a.root"])):
        (tmp_path / d).mkdir()
        for n in names:
            write(tmp_path / d / n, "x")
    got = [(r.global_sim_id, r.i_dir, r.adc_file_path[-10:]) for r in tables.simulation_files(spark, str(tmp_path)).orderBy("i_dir").collect()]
    assert got == [(0, 1, "adc_a.root"), (1, 2, "adc_a.root")]


def test_duplicate_log_round_trip(spark, tmp_path):
    ev = spark.createDataFrame([([(7, 5_000_000_120), (3, 5_000_000_100)],), ([(1, 4_000_000_000), (2, 4_000_000_009), (1, 3_999_999_999)],)], "hits array<struct<du:long,t_ns:long>>")
    files.write_duplicate_log(ev, str(tmp_path / "log"))
    text_rows = sorted(r.value for r in spark.read.text(str(tmp_path / "log")).collect())
    assert text_rows == ["3.999999999: [(1, 999999999), (1, 0), (2, 9)]", "5.000000100: [(3, 100), (7, 120)]"]
    write(tmp_path / "log" / "extra.txt", "junk\n1.000000000: [(1, 5)]\n2.000000000: [(1, x)]\n")
    log = logs.duplicate_log(spark, str(tmp_path / "log"))
    assert sorted((r.t_ns, len(r.hits)) for r in log.collect()) == [(3_999_999_999, 3), (5_000_000_100, 2)]
    assert [r.t_ns for r in logs.first_events(log, 1).collect()] == [3_999_999_999]


def health(ts, builder=None, **loss_stats):
    body = {"builder": builder} if builder else {}
    return {"ts": ts, "health": body | ({"loss_stats": loss_stats} if loss_stats else {})}


def builder(expected, missing, timeouts=0, per=None):
    return {"expected_fragments": expected, "missing_on_timeout": missing, "timeout_events": timeouts} | ({"missing_on_timeout_per_du": per} if per else {})


def jsonl(path, *rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path)


EVENT = {"observed_unix_ms": 1_772_000_010_000, "tag": 42, "event_ts_ns": 123456789, "expected": 4, "attached": 2, "missing_count": 2, "missing_du": [101, 102]}


def rows_of(summary):
    return [(r.start, r.missing) for r in summary.buckets.orderBy("start").collect()], summary.totals.first()


def test_counter_deltas_across_files(spark, tmp_path):
    a = jsonl(tmp_path / "health_a.jsonl", health("2026-04-28T00:00:00Z", builder(10, 1, 1, {"101": 1})), health("2026-04-28T00:04:00Z", builder(20, 3, 2, {"101": 2, "102": 1, "bad": 9}), recent_events=[EVENT]))
    b = jsonl(tmp_path / "health_b.jsonl", health("2026-04-28T00:06:00Z", builder(28, 4, 3, {"101": 2, "102": 2}), recent_events=[EVENT]))
    rec = logs.health_records(spark, [a, b])
    out = loss.summarise(rec)
    buckets, totals = rows_of(out)
    assert out.source == "counter_delta" and [m for _, m in buckets] == [2, 1]
    assert (totals.expected, totals.missing, totals.timeouts) == (18, 3, 2)
    assert [(r.du, r.missing, r["rank"]) for r in loss.counter_top(rec, 300_000).orderBy("start", "rank").collect()] == [(101, 1, 1), (102, 1, 2), (102, 1, 1)]
    recent = loss.recent(rec).collect()
    assert [(r.tag, r.missing_du, r.expected) for r in recent] == [(42, [101, 102], 4)]


def test_embedded_buckets_come_first_and_counters_fill(spark, tmp_path):
    a = jsonl(tmp_path / "health_20260428_000000.jsonl", health("2026-04-28T00:00:00Z", builder(10, 0)), health("2026-04-28T00:04:00Z", builder(20, 2)))
    bucket = {"start_unix_ms": 1777334700000, "expected_fragments": 8, "missing_fragments": 3, "timeout_events": 1, "loss_pct": 0.375, "top_missing_du": []}
    b = jsonl(tmp_path / "health_20260428_000000_20260428.jsonl", health("2026-04-28T00:06:00Z", builder(30, 5), bucket_sec=300, buckets=[bucket]))
    out = loss.summarise(logs.health_records(spark, [a, b]))
    buckets, totals = rows_of(out)
    assert out.source == "mixed" and [m for _, m in buckets] == [2, 3] and totals.missing == 5


def test_log_fallback_needs_parse_errors(spark, tmp_path):
    good = health("2026-04-29T08:06:53Z", builder(100, 0), buckets=[])
    bad = {"ts": "2026-04-29T08:06:58Z", "raw": "health_parse_error"}
    line = "[2026/04/29 16:{}] [WARN] Builder diag type=Timeout tag={} du_id=0 trigger_number=0 fragment_trigger_time=0 event_trigger_timestamp_ns={}"
    log = logs.timeout_log(spark, write(tmp_path / "console_20260428_091336.log", line.format("06:58.136", 848728, 8390296971816438) + "\n" + line.format("16:47.9", 961470, 8390886915034485) + "\nother\n"))
    assert sorted(r.observed_ms % 1000 for r in log.collect()) == [136, 900]
    rec = logs.health_records(spark, jsonl(tmp_path / "health_20260428_091336.jsonl", good, bad, "{broken"))
    assert tuple(logs.scan_quality(rec).first()) == (3, 1, 1, 1)
    out = loss.summarise(rec, log=log)
    buckets, totals = rows_of(out)
    assert out.source == "log_timeout" and (totals.missing, totals.timeouts) == (2, 2)
    assert [r.tag for r in loss.recent(rec, log).collect()] == [848728, 961470]
    clean = logs.health_records(spark, jsonl(tmp_path / "health_20260429_091336.jsonl", good))
    assert rows_of(loss.summarise(clean, log=log))[1].missing == 0


def test_live_snapshot_replaces(spark, tmp_path):
    rec = logs.health_records(spark, jsonl(tmp_path / "health_a.jsonl", health("2026-04-28T00:00:00Z", builder(10, 1)), health("2026-04-28T00:04:00Z", builder(20, 3))))
    bucket = {"start_unix_ms": 1_777_460_400_000, "expected_fragments": 1000, "missing_fragments": 8, "timeout_events": 7, "loss_pct": 0.008, "top_missing_du": []}
    totals = {"expected_fragments": 1000, "missing_fragments": 8, "timeout_events": 7, "loss_pct": 0.008}
    live = logs.health_records(spark, jsonl(tmp_path / "live.jsonl", health(None, totals=totals, buckets=[bucket]))).select("health")
    out = loss.summarise(rec, live=live)
    buckets, t = rows_of(out)
    assert out.source == "live_health" and buckets == [(1_777_460_400_000, 8)] and (t.missing, t.loss) == (8, 0.008)


def test_focus_range(spark):
    rows = spark.createDataFrame([(100_000, 0), (400_000, 3), (700_000, 2), (1_600_000, 0)], "start long, missing long")
    assert tuple(telemetry.focus_range(rows, "start", "missing", 300_000).first()) == (100_000, 1_000_000)


def test_runs_and_last_lines(spark, tmp_path):
    a = jsonl(tmp_path / "health_20260428_000000.jsonl", health("2026-04-28T00:00:00Z", builder(5, 0)), '{"ts": "2026-04-28T00:00:05Z", "active_du_count": 7}')
    b = jsonl(tmp_path / "health_20260429_000000_20260430.jsonl.txt", health("2026-04-28T00:00:00Z"))
    rec = logs.health_records(spark, [a, b])
    assert sorted({(r.run, r.day) for r in rec.collect()}, key=str) == [("20260428_000000", "20260428"), (None, None)]
    assert logs.latest_run(rec).first().run == "20260428_000000"
    assert [r.value for r in logs.fast_fields(spark, a).collect()] == [7]
    assert "active_du_count" in logs.last_line(spark, a).first().value
    assert {r.run for r in logs.with_run(rec).collect()} >= {"20260428_000000"}
    sib = spark.createDataFrame([("x.log", "20260428_000000"), ("y.log", "20250101_000000")], "file string, run string")
    assert [r.file for r in logs.siblings(rec, sib).collect()] == ["x.log"]


def test_rate_golden_values(spark):
    def deltas(samples):
        df = spark.createDataFrame([(0, t, c) for t, c in samples], "run int, t long, c long")
        d = telemetry.with_delta(df, ["run"], ["t"], "c").withColumn("dt", F.col("t") - F.lag("t").over(__import__("pyspark.sql.window", fromlist=["Window"]).Window.partitionBy("run").orderBy("t")))
        return [max(0, r.delta) / r.dt for r in d.where("delta is not null").orderBy("t").collect()]

    assert deltas([(0, 100), (5, 130), (15, 190)]) == [6.0, 6.0] and deltas([(0, 100), (5, 90)]) == [0.0]


def test_t2_replay(spark, tmp_path):
    df = logs.t2_batches(spark, write(tmp_path / "r.json", '{"batches": [{"du_id": 4, "timestamps": [9, 8]}, {"du_id": 5, "timestamps": []}]}'))
    assert sorted(map(tuple, df.select("seq", "du", "pos", "t").collect())) == [(0, 4, 0, 9), (0, 4, 1, 8)]


def test_t2_payloads(spark):
    hits = [(1_800_000_000_123_456_789, 3, 65_535), (5, 0, 1)]
    rows = [(1, binary.t2_payload(70_000, hits)), (2, b"\1\0\0\0"), (3, binary.t2_payload(1, hits)[:-1])]
    got = sorted(map(tuple, binary.t2_hits(spark.createDataFrame(rows, "id long, payload binary")).collect()))
    assert got == [(1, 70_000, 0, *hits[0]), (1, 70_000, 1, *hits[1])]


def test_wire_packets():
    pack = lambda kind, body: struct.pack("<II", 8 + len(body), kind) + body
    data = pack(3, b"abc") + pack(4, b"12345678") + pack(5, b"xy")
    assert list(binary.packets(data + pack(3, b"zz")[:-1])) == [("t2", b"abc"), ("daqevent", b"12345678"), ("rawevent", b"xy")]
    assert binary.packet(pack(3, b"abc")[:-1]) == (0, "unknown") and binary.packet(pack(9, b"abc"))[0] == -1
    assert binary.packet(pack(3, b""))[0] == -1 and binary.packet(pack(4, b"1234567"))[0] == -1
    assert binary.packet(struct.pack("<II", (1 << 20) + 1, 3))[0] == -1
    assert binary.inbound_payload([b"\0", b"p"]) == b"p" and binary.inbound_payload([b"\0", b"m" * 20, b"p"]) == b"p"
    assert binary.inbound_payload([b"", b"p"]) is None and binary.inbound_payload([b"\0", b"m", b"p"]) is None and binary.inbound_payload([b"p"]) is None


def test_dat_round_trip(spark, tmp_path):
    rows = [(e, s, 1, 10 + s, bytes([e, s]) * (20 if e != 3 else 90)) for e in range(8) for s in range(3)]
    df = spark.createDataFrame(rows, "event long, seq long, rec_type long, source long, payload binary")
    made = files.dat_files(df, "MOD", 12, "L1", 1_700_000_000, max_bytes=600, max_events=3).orderBy("file_id").collect()
    assert [f.name for f in made][0] == "MOD_20231114_221320_RUN12_L1-0001.dat" and all(f.events <= 3 for f in made) and len(made) >= 3
    for f in made:
        (tmp_path / f.name).write_bytes(f.content)
    (tmp_path / "broken-0009.dat").write_bytes(made[0].content[:-3])
    (tmp_path / "short-0010.dat").write_bytes(b"x")
    dat = binary.dat_records(spark, str(tmp_path))
    whole = [r for r in dat.collect() if "MOD_" in r.path]
    assert sorted((r.source, bytes(r.payload)) for r in whole) == sorted((r[3], r[4]) for r in rows) and {r.run for r in whole} == {12}
    by_file = {}
    for r in whole:
        by_file.setdefault(bytes(r.payload)[0], set()).add(r.path)
    assert all(len(p) == 1 for p in by_file.values())  # no event is split
    assert sorted(r.error for r in dat.collect() if r.error) == ["file too small for header", "truncated payload"]
    assert tuple(binary.file_ids(dat).first())[0] == len(made) + 2
    assert binary.record_at(dat, 0).count() == len(made) + 1


def test_tag_offsets(spark):
    df = spark.createDataFrame([(1, bytes.fromhex("00ff12ee12")), (2, bytes.fromhex("0ff120")), (3, b"")], "id long, payload binary")
    got = {r.id: (r.a, r.b) for r in df.select("id", binary.tag_offset("payload", "ff12").alias("a"), binary.tag_offset("payload", "ee12").alias("b")).collect()}
    assert got == {1: (1, 3), 2: (-1, -1), 3: (-1, -1)}
    assert [r.x for r in df.select(text.tag_offsets(F.col("payload"), "ff12").alias("x")).collect()] == [[1], [], []]


def test_run_numbers_and_routes():
    names = ["a_RUN7_x-0001.dat", "RUN12_CD_y.dat", "FOORUN99_x.dat", "a_RUN5.dat", "a_RUN8_x.txt", "a_RUN4294967296_x.dat"]
    assert files.next_run(names) == 13 and files.next_run(names, "CD_") == 13 and files.next_run(names, "MD_", 10_001) == 10_001
    assert files.next_run(["RUN4294967295_a.dat"]) == 4294967295
    assert [files.routes(m) for m in range(5)] == [[], ["l1"], ["cd"], ["l1", "cd"], ["l1", "md"]]
    assert files.file_name("M", 0, 3, "L3-CD", 5, 200) == "M_19700101_000000_RUN3_L3-CD-0200-5.dat"


def test_signatures_and_lines(spark, tmp_path):
    assert files.fnv1a64(b"") == 0xCBF29CE484222325 and files.fnv1a64(b"a") == 0xAF63DC4C8601EC8C
    row = files.stage_trace(spark.createDataFrame([(4, b"a")], "du long, payload binary")).first().value
    assert json.loads(row) == {"du": 4, "size": 1, "signature": "af63dc4c8601ec8c"}
    df = spark.createDataFrame([(1, 0.5)], "i long, x double")
    assert files.fixed_lines(df, ["i", "x"]).first().value == "1 0.500000000"
    assert not files.write_if_rows(df.where("i > 5"), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    assert files.write_if_rows(df, str(tmp_path / "some")) and spark.read.csv(str(tmp_path / "some"), header=True).count() == 1
    assert files.not_yet_done(spark.range(4), spark.range(2), "id").count() == 2


def test_text_functions(spark):
    rows = [("3", "2026-04-28T00:00:00Z"), (" 4 ", "2026-04-28T08:00:00+08:00"), ("3.5", "x"), (None, None)]
    df = spark.createDataFrame(rows, "a string, t string")
    assert [r.x for r in df.select(text.to_long(F.col("a"), 0).alias("x")).collect()] == [3, 4, 0, 0]
    assert [r.x for r in df.select(text.iso_ms(F.col("t")).alias("x")).collect()] == [1777334400000, 1777334400000, None, None]
    one = spark.createDataFrame([("2026/04/29 16:06:58", "1369", "≥3 EeV <x", "log_20260428_091336")], "d string, f string, k string, s string")
    r = one.select(text.log_ms(F.col("d"), F.col("f"), "Asia/Shanghai").alias("ms"), text.sanitise_key(F.col("k")).alias("k"), text.strip_stamp(F.col("s")).alias("s"), text.split_fields(F.lit(" 1, 2  3")).alias("p"), text.half_even(F.lit(2.5), 0).alias("h"), text.midpoint(F.lit(3), F.lit(8)).alias("m")).first()
    assert (r.ms, r.k, r.s, r.p, r.h, r.m) == (1777450018136, "ge3_EeV_ltx", "log", ["1", "2", "3"], 2.0, 5)
    keys = spark.createDataFrame([({"1": 5, "x": 6},)], "m map<string,long>").select(text.int_keys(F.col("m")).alias("m")).first().m
    assert keys == {1: 5}
    name = spark.createDataFrame([("health_20260428_091336_20260501.jsonl.gz",), ("health_20260428_091336.jsonl",), ("other",)], "n string")
    assert [tuple(r) for r in name.select(text.run_id(F.col("n")), text.run_day(F.col("n"))).collect()] == [("20260428_091336", "20260501"), ("20260428_091336", "20260428"), (None, None)]
    assert one.select(text.local_text(F.lit(1777450018136), 8).alias("x")).first().x == "2026/04/29 16:06:58"


YAML = """# run
global:
  t3TriggerTimeCut: 1000
  gateTimeoutMs: 1800   # ms
  mode: bounded
  flag: true
dataUnits:
  - type: du
    ID: 1001
    ip: 10.0.0.1
    port: 5001
  - ID: 1002
    ip: "10.0.0.2"
    port: 5002
"""


def test_run_config(tmp_path, monkeypatch):
    c = config.run_config(write(tmp_path / "c.yaml", YAML))
    assert c.scalars == {"t3TriggerTimeCut": 1000, "gateTimeoutMs": 1800, "mode": "bounded", "flag": True}
    assert c.units == [config.DataUnit(1001, "10.0.0.1", 5001, "du"), config.DataUnit(1002, "10.0.0.2", 5002)]
    assert config._plain_yaml(YAML)["dataUnits"][1]["ip"] == "10.0.0.2"
    assert c.gate({"timeout": "gateTimeoutMs"}, cut=1, cap=2000, idle_gap=150, retention=1).timeout == 1800
    for bad in ("dataUnits:\n", YAML.replace("ID: 1001", "IX: 1"), YAML.replace("5001", "70000"), YAML.replace("10.0.0.1", '""'), YAML.replace("1001", "x")):
        with pytest.raises(ValueError):
            config.run_config(write(tmp_path / "bad.yaml", bad))
    assert config.resolve("c.yaml", "HITSTREAM_CONF", tmp_path) == tmp_path / "c.yaml"
    monkeypatch.setenv("HITSTREAM_CONF", "/x/y.yaml")
    assert str(config.resolve("c.yaml", "HITSTREAM_CONF", tmp_path)) == "/x/y.yaml"
    with pytest.raises(FileNotFoundError):
        config.resolve("c.yaml", "HITSTREAM_NONE", tmp_path / "none")


def test_pipeline_config(tmp_path):
    body = {s: {} for s in config.SECTIONS} | {"scan_params": {"t_start": 0, "t_end": 1, "t_step": 0.5}}
    assert config.pipeline_config(write(tmp_path / "p.json", json.dumps(body)))["scan_params"]["t_end"] == 1
    for bad in ({k: v for k, v in body.items() if k != "slt_params"}, body | {"scan_params": {"t_start": 0, "t_end": 0, "t_step": 1}}):
        with pytest.raises(ValueError):
            config.pipeline_config(write(tmp_path / "p.json", json.dumps(bad)))


def test_phase_exposure_against_interpolation(spark):
    from hitstream.operators import analysis

    rng = np.random.default_rng(0)
    x = rng.random(53)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, idx long, value double")

    def filled(offset, step):
        at = np.arange(offset, len(x), step)
        y = np.interp(np.arange(len(x)), at, x[at])
        lo, hi = (x[at[1]] - x[at[0]]) / step, (x[at[-1]] - x[at[-2]]) / step
        n = np.arange(len(x))
        return np.where(n < at[0], x[at[0]] + (n - at[0]) * lo, np.where(n > at[-1], x[at[-1]] + (n - at[-1]) * hi, y))

    for step in (5, 20):
        e = np.array([filled(o, step).sum() for o in range(step)]) * 0.5
        r = analysis.phase_exposure(df, ["k"], step, 0.5).first()
        assert r.offsets == step and abs(r["mean"] - e.mean()) < 1e-5 and abs(r.spread - e.std()) < 1e-5
        got = [q.approx for q in analysis.interpolated(df, ["k"], step).orderBy("idx").collect()]
        assert np.allclose(got, filled(0, step))


def test_found_files(spark, tmp_path):
    for name in ("b/health_20240102_000000.jsonl", "a/health_20240101_000000_20240103.jsonl", "a/health_20240101_000000.jsonl.gz", "a/x.log"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    got = tables.found_files(spark, [str(tmp_path), str(tmp_path / "a" / "*.jsonl"), str(tmp_path / "a" / "x.log")], name=r"^health_").collect()
    assert [(r.file, r.run, r.day) for r in got] == [
        ("health_20240101_000000.jsonl.gz", "20240101_000000", "20240101"), ("health_20240102_000000.jsonl", "20240102_000000", "20240102"), ("health_20240101_000000_20240103.jsonl", "20240101_000000", "20240103"),
    ]
    assert [r.file for r in tables.found_files(spark, [str(tmp_path)], pattern="*.log").collect()] == ["x.log"]


def test_npz_results_in_two_layouts(spark, tmp_path):
    def put(place, array):
        path = tmp_path / place
        path.parent.mkdir(parents=True, exist_ok=True)
        np.savez(path, triggered=array)

    put("sim_batch_0001/sim_00007.npz", np.array([True, False, True]))
    put("sim_batch/sim_batch_0001/sim_00007.npz", np.array([False]))
    put("sim_batch/sim_batch_0002/sim_00008.npz", np.array([0, 1]))
    (tmp_path / "sim_batch_0003").mkdir()
    (tmp_path / "sim_batch_0003" / "sim_00009.npz").write_bytes(b"no archive")
    np.savez(tmp_path / "sim_batch_0003" / "sim_00010.npz", other=np.zeros(3))
    got = sorted(map(tuple, tables.npz_results(spark, str(tmp_path)).collect()))
    assert got == [(1, 7, 2, 3), (2, 8, 1, 2), (3, 9, None, None), (3, 10, None, None)]


@pytest.mark.parametrize("name", ["t.parquet", "t.csv"])
def test_lookup_tables_round_trip(spark, tmp_path, name):
    df = spark.createDataFrame([(1, 2.5, "f", 3, 512)], tables.LOOKUP)
    files.write_lookup(df, str(tmp_path / name))
    assert [tuple(r) for r in tables.lookup_table(spark, str(tmp_path / name)).collect()] == [(1, 2.5, "f", 3, 512)]


def test_lookup_tables_as_text_and_in_wrong_forms(spark, tmp_path):
    path = write(tmp_path / "t.txt", "du_id;timestamp_sec  file_path\tentry_index trace_length\n7; 1.5 x 2 512\n\n8 2.5 y 3 1024\n")
    assert [tuple(r) for r in tables.lookup_table(spark, path).collect()] == [(7, 1.5, "x", 2, 512), (8, 2.5, "y", 3, 1024)]
    for bad in ("t.pkl", "t.pickle"):
        with pytest.raises(ValueError):
            tables.lookup_table(spark, str(tmp_path / bad))
    with pytest.raises(ValueError):
        files.write_lookup(spark.range(1), str(tmp_path / "t.pkl"))


def test_samples_of_record_files(spark):
    rows = [(f"/d/run-{k}.dat", 1, None, None, i, 2, 3, bytes([k, i]), "cut short" if (k, i) == (1, 1) else None) for k in range(3) for i in range(4)]
    dat = spark.createDataFrame(rows, binary.DAT)
    got = sorted((r.name, bytes(r.payload)) for r in binary.samples(dat, 2, 3).collect())
    assert got == [("run-0_0000.bin", b"\0\0"), ("run-0_0001.bin", b"\0\1"), ("run-0_0002.bin", b"\0\2"), ("run-1_0000.bin", b"\1\0"), ("run-1_0002.bin", b"\1\2")]


def test_summary_and_rows(spark, tmp_path):
    one = spark.createDataFrame([(3,)], "n long")
    assert files.write_summary(one, spark.range(2), str(tmp_path / "a")) and not files.write_summary(one, spark.range(0), str(tmp_path / "b"))
    assert spark.read.json(str(tmp_path / "b" / "summary")).first().n == 3 and (tmp_path / "a" / "rows").exists() and not (tmp_path / "b" / "rows").exists()


def test_registers_out_of_bounds(spark):
    from hitstream.operators import electronics

    df = spark.createDataFrame([(9,)], "v long")
    assert df.select(electronics.register("rate", F.col("v"))).first()[0] == 9 * 256 + 143
    for name, value in (("from_one", 9), ("gain", 24)):
        with pytest.raises(Exception, match="not within"):
            spark.createDataFrame([(value,)], "v long").select(electronics.register(name, F.col("v"))).collect()


def test_background_traces_fit(spark):
    from hitstream.operators import pipeline

    rows = [(1, [1.0, 2.0], [3.0, 4.0], 2), (2, [1.0], [2.0], 2), (3, None, None, 2)]
    df = spark.createDataFrame(rows, "i int, a array<double>, b array<double>, n int")
    fit = pipeline.fitted_trace(F.col("a"), F.col("b"), F.col("n"))
    assert [r.t for r in df.select(fit.alias("t")).collect()] == [[1.0, 2.0], [1.0, 2.0], None]
    with pytest.raises(Exception, match="does not fit"):
        spark.createDataFrame([(1, [1.0, 2.0, 3.0], [1.0], 2)], df.schema).select(fit).collect()
