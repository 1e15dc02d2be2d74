"""Loss summary over health records: embedded buckets, counter deltas, log fallback and a live snapshot, by precedence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hitstream.functions import text
from hitstream.operators import telemetry

COUNTERS = {"expected": "expected_fragments", "missing": "missing_on_timeout", "timeouts": "timeout_events"}
VALUES = ["expected", "missing", "timeouts", "loss"]


def _deltas(records: DataFrame) -> DataFrame:
    """Health rows with the counters before them; the baseline resets with the run, not with the file."""
    w = Window.partitionBy("run").orderBy("day", "file", "line")
    rows = records.where("state = 'ok'")
    for name, field in COUNTERS.items():
        rows = rows.withColumn(name, F.coalesce(text.to_long(F.col(f"health.builder.{field}")), F.lit(0)))
    per_du = F.coalesce(text.int_keys(F.col("health.builder.missing_on_timeout_per_du")), F.create_map().cast("map<bigint,string>"))
    rows = rows.withColumn("per_du", per_du)
    for name in [*COUNTERS, "per_du"]:
        rows = rows.withColumn(f"last_{name}", F.lag(name).over(w))
    return rows.withColumn("first", F.row_number().over(w) == 1).where("not first")


def counter_buckets(records: DataFrame, width_ms: int) -> DataFrame:
    """start, expected, missing, timeouts, loss from counter steps; a counter that falls back counts as 0."""
    d = _deltas(records)
    step = lambda c: F.sum(F.greatest(F.lit(0), F.col(c) - F.col(f"last_{c}"))).alias(c)
    start = F.when(F.col("t_ms") > 0, telemetry.bucket("t_ms", width_ms)).otherwise(F.lit(0))
    out = d.groupBy(start.alias("start")).agg(*[step(c) for c in COUNTERS])
    return out.withColumn("loss", F.when(F.col("expected") > 0, F.col("missing") / F.col("expected")).otherwise(0.0))


def counter_top(records: DataFrame, width_ms: int, n: int = 10) -> DataFrame:
    """start, du, missing, rank: the DUs that lost most in each bucket."""
    d = _deltas(records)
    start = F.when(F.col("t_ms") > 0, telemetry.bucket("t_ms", width_ms)).otherwise(F.lit(0)).alias("start")
    each = d.select(start, "last_per_du", F.explode("per_du").alias("du", "now"))
    before = F.coalesce(text.to_long(F.try_element_at("last_per_du", F.col("du"))), F.lit(0))
    each = each.withColumn("step", F.greatest(F.lit(0), F.coalesce(text.to_long(F.col("now")), F.lit(0)) - before)).where("step > 0")
    return telemetry.top_per_bucket(each.groupBy("start", "du").agg(F.sum("step").alias("missing")), ["start"], "du", "missing", n)


def _normalised(b) -> list:
    expected, missing = F.coalesce(b["expected_fragments"], F.lit(0)), F.coalesce(b["missing_fragments"], F.lit(0))
    loss = F.coalesce(b["loss_pct"], F.when(expected > 0, missing / expected), F.lit(0.0))
    return [b["start_unix_ms"].alias("start"), expected.alias("expected"), missing.alias("missing"), F.coalesce(b["timeout_events"], F.lit(0)).alias("timeouts"), loss.alias("loss")]


def embedded_buckets(records: DataFrame) -> DataFrame:
    """Buckets that the records carry; of one start the last record's counts."""
    each = records.where("state = 'ok'").select("run", "day", "file", "line", F.posexplode("health.loss_stats.buckets").alias("pos", "b"))
    each = each.where("b.start_unix_ms > 0").select(F.struct(F.coalesce("run", F.lit("")), F.coalesce("day", F.lit("")), "file", "line", "pos").alias("at"), *_normalised(F.col("b")))
    return each.groupBy("start").agg(*[F.max_by(v, "at").alias(v) for v in VALUES])


def recent(records: DataFrame, log: DataFrame | None = None, limit: int = 200) -> DataFrame:
    """Recent loss events by (tag, event_ts_ns): best detail, the most recently touched ``limit``."""
    rows = records.where("state = 'ok'").select("run", "day", "file", "line", F.posexplode("health.loss_stats.recent_events").alias("pos", "e")).where("e.observed_unix_ms > 0")
    n = lambda c: F.coalesce(F.col(f"e.{c}"), F.lit(0))
    du = F.coalesce("e.missing_du", F.array().cast("array<bigint>"))
    seq = F.struct(F.lit(0).alias("src"), F.coalesce("run", F.lit("")).alias("run"), F.coalesce("day", F.lit("")).alias("day"), "file", "line", "pos")
    ev = rows.select(seq.alias("seq"), F.col("e.observed_unix_ms").alias("observed_ms"), n("tag").alias("tag"), n("event_ts_ns").alias("event_ts_ns"), n("expected").alias("expected"), n("attached").alias("attached"), F.coalesce("e.missing_count", F.size(du)).cast("long").alias("missing_count"), du.alias("missing_du"), F.coalesce("e.source", F.lit("health")).alias("source"))
    if log is not None:
        seq = F.struct(F.lit(1).alias("src"), F.lit("").alias("run"), F.lit("").alias("day"), "file", "line", F.lit(0).alias("pos"))
        zero = F.lit(0).cast("long")
        ev = ev.unionByName(log.select(seq.alias("seq"), "observed_ms", "tag", "event_ts_ns", zero.alias("expected"), zero.alias("attached"), F.lit(1).cast("long").alias("missing_count"), F.array().cast("array<bigint>").alias("missing_du"), F.lit("console_log").alias("source")))
    ev = ev.withColumn("score", text.detail_score(F.col("missing_du"), F.col("expected"), F.col("attached")))
    keep = ["observed_ms", "expected", "attached", "missing_count", "missing_du", "source"]
    return telemetry.recent_events(ev, ["tag", "event_ts_ns"], "seq", "score", limit, keep).drop("last").orderBy("observed_ms", "tag")


@dataclass
class Loss:
    """The summary: its source, buckets and totals as tables."""

    source: str
    buckets: DataFrame
    totals: DataFrame


def log_buckets(log: DataFrame, width_ms: int) -> DataFrame:
    return log.groupBy(telemetry.bucket("observed_ms", width_ms).alias("start")).agg(F.count("*").alias("missing"), F.count("*").alias("timeouts"))


def summarise(records: DataFrame, width_ms: int = 300_000, log: DataFrame | None = None, live: DataFrame | None = None) -> Loss:
    """Buckets by precedence: live snapshot; else embedded, with counter steps where there are none; else counter steps. Log timeouts
    fill in only if some health lines failed to parse."""
    counters, embedded = counter_buckets(records, width_ms), embedded_buckets(records)
    source, buckets = "counter_delta", counters
    if embedded.take(1):
        merged = telemetry.merge_priority(embedded, counters, "start", VALUES)
        source = "mixed" if merged.where("origin = 'second'").take(1) else "health_loss_stats"
        buckets = merged.drop("origin")
    if log is not None and log.take(1) and records.where("state = 'health_parse_error'").take(1):
        filled = telemetry.fill_from_log(buckets, log_buckets(log, width_ms))
        if filled.where("from_log").take(1):
            source = "log_timeout" if source == "counter_delta" and not counters.take(1) else "mixed_log_fallback"
        buckets = filled.drop("from_log")
    totals = None
    if live is not None:
        own = live.select(F.explode("health.loss_stats.buckets").alias("b")).where("b.start_unix_ms > 0").select(*_normalised(F.col("b")))
        if own.take(1):
            source, buckets = "live_health", own
        t = live.select("health.loss_stats.totals.*").where("expected_fragments is not null or missing_fragments is not null")
        if t.take(1):
            totals = t.select(F.col("expected_fragments").alias("expected"), F.col("missing_fragments").alias("missing"), F.col("timeout_events").alias("timeouts"), F.coalesce("loss_pct", F.col("missing_fragments") / F.col("expected_fragments"), F.lit(0.0)).alias("loss"))
    if totals is None:
        sums = buckets.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("expected", "missing", "timeouts")])
        totals = sums.withColumn("loss", F.when(F.col("expected") > 0, F.col("missing") / F.col("expected")).otherwise(0.0))
    return Loss(source, buckets.select("start", *VALUES), totals)
