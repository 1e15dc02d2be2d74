"""Logs as tables: duplicate-reject logs, health JSONL, console logs."""

from __future__ import annotations

import json
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hitstream.functions import text
from hitstream.operators import lookups

DUPLICATE_LINE = r"^\s*(\d+)\.(\d{9}):\s*\[(.*)\]\s*$"
TIMEOUT_LINE = r"^\[(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2})(?:\.(\d+))?\].*Builder diag type=Timeout tag=(\d+).*?event_trigger_timestamp_ns=(\d+)"
HEALTH = (
    "ts string, raw string, health struct<active_du_count:long, builder:struct<expected_fragments:string, missing_on_timeout:string, timeout_events:string, complete_events:string, "
    "missing_on_timeout_per_du:map<string,string>>, loss_stats:struct<totals:struct<expected_fragments:long, missing_fragments:long, timeout_events:long, loss_pct:double>, "
    "buckets:array<struct<start_unix_ms:long, expected_fragments:long, missing_fragments:long, timeout_events:long, loss_pct:double, top_missing_du:array<struct<du_id:long, missing:long, expected:long, loss_pct:double>>>>, "
    "recent_events:array<struct<observed_unix_ms:long, tag:long, event_ts_ns:long, expected:long, attached:long, missing_count:long, missing_du:array<long>, source:string>>>>, bad string"
)


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """value with its file's name and its line number in the file (order within a file; gz is transparent)."""
    raw = spark.read.text(paths).select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"))
    return raw.withColumn("run", text.run_id(F.col("file"))).withColumn("day", text.run_day(F.col("file")))


def duplicate_log(spark: SparkSession, paths: str | list[str], least_hits: int = 2) -> DataFrame:
    return duplicates_in(lines(spark, paths), least_hits)


def duplicates_in(log: DataFrame, least_hits: int = 2) -> DataFrame:
    """Events of duplicate-reject lines (value, file, line): t_ns, ts, hits (du, t_ns) in file order; lines that don't parse or hold too few hits are dropped."""
    raw = log.select("file", "line", *[F.regexp_extract("value", DUPLICATE_LINE, i).alias(c) for i, c in enumerate(("s", "n", "list"), 1)]).where("s <> ''")
    pairs = [F.regexp_extract_all("list", F.lit(r"\(\s*(\d+)\s*,\s*(\d+)\s*\)"), F.lit(g)) for g in (1, 2)]
    hits = F.transform(F.arrays_zip(pairs[0].alias("du"), pairs[1].alias("t")), lambda p: F.struct(p["du"].cast("long").alias("du"), p["t"].cast("long").alias("t_ns")))
    rest = F.regexp_replace(F.regexp_replace("list", r"\(\s*\d+\s*,\s*\d+\s*\)", ""), r"[\s,]", "")
    t = F.col("s").cast("long") * 1_000_000_000 + F.col("n").cast("long")
    out = raw.where(rest == "").select("file", "line", t.alias("t_ns"), F.concat("s", F.lit("."), "n").cast("double").alias("ts"), hits.alias("hits"))
    return out.where(F.size("hits") >= least_hits)


def first_events(log: DataFrame, n: int) -> DataFrame:
    """The log's head: its first n events by time, file and line."""
    return log.orderBy("t_ns", "file", "line").limit(n)


def health_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return health_in(lines(spark, paths))


def health_in(log: DataFrame) -> DataFrame:
    """Health lines (value, file, run, day, line) with their record, time in ms and a state: ok, parse_error, health_parse_error or no_health."""
    raw = log.where(F.trim("value") != "")
    rec = raw.withColumn("r", F.from_json("value", HEALTH, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}))
    state = F.when(F.col("r").isNull() | F.col("r.bad").isNotNull(), "parse_error").when(F.col("r.raw") == "health_parse_error", "health_parse_error").when(F.col("r.health").isNull(), "no_health").otherwise("ok")
    return rec.select("file", "run", "day", "line", state.alias("state"), text.iso_ms(F.col("r.ts")).alias("t_ms"), F.col("r.health").alias("health"))


def scan_quality(records: DataFrame) -> DataFrame:
    """One row: lines, parse errors, lines the producer marked, files."""
    return records.agg(F.count("*").alias("lines"), F.count_if(F.col("state") == "parse_error").alias("parse_errors"), F.count_if(F.col("state") == "health_parse_error").alias("health_parse_errors"), F.count_distinct("file").alias("files"))


def fast_fields(spark: SparkSession, paths: str | list[str], field: str = "active_du_count") -> DataFrame:
    """t_ms and one integer field by pattern, without parsing the JSON; lines without either are dropped."""
    rows = lines(spark, paths).select("file", "line", text.iso_ms(F.regexp_extract("value", r'"ts"\s*:\s*"([^"]+)"', 1)).alias("t_ms"), F.regexp_extract("value", rf'"{field}"\s*:\s*(\d+)', 1).try_cast("long").alias("value"))
    return rows.where("t_ms is not null and value is not null")


def timeout_log(spark: SparkSession, paths: str | list[str], zone: str = "UTC") -> DataFrame:
    return timeouts_in(lines(spark, paths), zone)


def timeouts_in(log: DataFrame, zone: str = "UTC") -> DataFrame:
    """Timeout lines of console logs: observed_ms, tag, event_ts_ns. The zone of the host's clock is stated, not assumed."""
    parts = [F.regexp_extract("value", TIMEOUT_LINE, i) for i in range(1, 5)]
    rows = log.where(F.col("value").rlike(TIMEOUT_LINE))
    return rows.select("file", "line", text.log_ms(parts[0], F.nullif(parts[1], F.lit("")), zone).alias("observed_ms"), parts[2].cast("long").alias("tag"), parts[3].cast("long").alias("event_ts_ns")).where("observed_ms > 0")


def last_line(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The last non-empty line of each file."""
    return lines(spark, paths).where(F.trim("value") != "").groupBy("file").agg(F.max_by("value", "line").alias("value"))


def siblings(records: DataFrame, logs: DataFrame) -> DataFrame:
    """Log files (columns file, run) whose run occurs in the records."""
    return logs.join(records.select("run").where("run is not null").distinct(), "run", "left_semi")


def latest_run(records: DataFrame) -> DataFrame:
    return records.agg(F.max("run").alias("run"))


def with_run(records: DataFrame) -> DataFrame:
    """``run`` filled: a file without a run id continues the one before it (files by run, day, name)."""
    files = records.select("file", "run", "day").distinct()
    order = Window.orderBy(F.coalesce("run", F.lit("")), F.coalesce("day", F.lit("")), "file").rowsBetween(Window.unboundedPreceding, 0)
    runs = files.withColumn("known", F.last("run", True).over(order)).select("file", "known")
    return records.join(lookups.small(runs), "file").withColumn("run", F.col("known")).drop("known")


def live_health(spark: SparkSession, url: str, timeout: float = 5.0) -> DataFrame:
    """A live snapshot as one health record; fetched by the driver."""
    with urlopen(url, timeout=timeout) as reply:  # noqa: S310
        body = json.dumps({"ts": None, "health": json.loads(reply.read())})
    return spark.createDataFrame([(body,)], "value string").select(F.from_json("value", HEALTH).alias("r")).select("r.health")


def t2_batches(spark: SparkSession, path: str) -> DataFrame:
    """Replay captures {"batches": [{"du_id", "timestamps"}]} as hits: seq (batch), pos, du, t."""
    df = spark.read.schema("batches array<struct<du_id:long,timestamps:array<long>>>").json(path, multiLine=True)
    each = df.select(F.posexplode("batches").alias("seq", "b"))
    return each.select("seq", F.col("b.du_id").alias("du"), F.posexplode("b.timestamps").alias("pos", "t"))
