"""Telemetry queries: a user's events are a run, its event ids a counter that only grows, its cents a counter that may fall."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitstream.functions import text
from hitstream.operators import telemetry
from hitstream.plans.registry import query
from hitstream.tables import HITS, HOUR, SECOND, hits, read

H = f"WITH h AS ({HITS})"
B300 = 300 * SECOND


@query(f"{H} SELECT (t // {B300}) * {B300} AS start, count(*) AS samples, sum(cents)::BIGINT AS total, min(cents) AS low, max(cents) AS high, round(avg(cents), 6) AS mean FROM h GROUP BY 1")
def bucket_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.sample_stats(hits(spark, sf_dir), "t", "cents", B300)


@query(
    f"""{H}, k AS (SELECT (t // {B300}) * {B300} AS f, (t // {HOUR}) * {HOUR} AS c, cents FROM h)
SELECT CASE WHEN f IS NULL THEN 'coarse' ELSE 'fine' END AS level, coalesce(f, c) AS start, count(*) AS samples, sum(cents)::BIGINT AS total, min(cents) AS low, max(cents) AS high
FROM k GROUP BY GROUPING SETS ((f), (c))"""
)
def two_level_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.two_level(hits(spark, sf_dir), "t", "cents", B300, HOUR)


@query(
    f"""{H}, d AS (SELECT t, event_id - lag(event_id) OVER w AS dc, t - lag(t) OVER w AS dt FROM h WINDOW w AS (PARTITION BY du ORDER BY t, event_id)),
p AS (SELECT dc, dt, t - dt // 2 AS mid, dc * {SECOND}::DOUBLE > dt * 0.01::DOUBLE AS fast FROM d WHERE dc >= 0 AND dt > 0 AND dt <= {24 * HOUR})
SELECT (mid // {6 * HOUR}) * {6 * HOUR} AS start, coalesce(sum(dc) FILTER (NOT fast), 0)::BIGINT AS steps, coalesce(sum(dt) FILTER (NOT fast), 0)::BIGINT AS elapsed,
       count(*) FILTER (NOT fast) AS pairs, count(*) FILTER (fast) AS skipped, round(sum(dc) FILTER (NOT fast) * {SECOND}::DOUBLE / sum(dt) FILTER (NOT fast), 6) AS rate FROM p GROUP BY 1"""
)
def counter_rate_midpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.midpoint_rates(hits(spark, sf_dir), ["du"], ["t", "event_id"], "event_id", "t", 6 * HOUR, 24 * HOUR, 0.01, SECOND)


@query(
    f"""{H}, d AS (SELECT t, cents - lag(cents) OVER (PARTITION BY du ORDER BY t, event_id) AS delta FROM h)
SELECT (t // {HOUR}) * {HOUR} AS start, sum(greatest(0, delta))::BIGINT AS delta, count(*) AS pairs FROM d WHERE delta IS NOT NULL GROUP BY 1"""
)
def counter_delta_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.clamped_delta_buckets(hits(spark, sf_dir), ["du"], ["t", "event_id"], "cents", "t", HOUR)


@query(f"{H} SELECT du, arg_max(cents, (t, event_id)) - arg_min(cents, (t, event_id)) AS total, count(*) AS samples FROM h GROUP BY du")
def run_first_last_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.run_totals(hits(spark, sf_dir), "du", F.struct("t", "event_id"), "cents")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir)
    return h.groupBy(telemetry.bucket("t", HOUR).alias("t")).agg(F.sum(F.when(F.col("kind") == "error", F.col("cents")).otherwise(F.lit(0))).alias("cents"))


@query(
    f"""{H}, s AS (SELECT (t // {HOUR}) * {HOUR} AS t, sum(CASE WHEN kind = 'error' THEN cents ELSE 0 END)::BIGINT AS cents FROM h GROUP BY 1)
SELECT t, cents, round(pow(10, avg(CASE WHEN cents > 0 THEN log10(cents) END) OVER (ORDER BY t RANGE BETWEEN {3 * HOUR} PRECEDING AND {3 * HOUR} FOLLOWING)), 4) AS geo FROM s"""
)
def rolling_geometric_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.rolling_geometric_mean(hourly(spark, sf_dir), "t", "cents", 3 * HOUR).withColumn("geo", F.round("geo", 4))


@query(
    f"""{H}, l AS (SELECT du, t, cents, lag(t) OVER (PARTITION BY du ORDER BY t) AS b FROM h)
SELECT du, t, cents AS value, false AS gap FROM l UNION ALL SELECT du, b + {8 * HOUR}, NULL, true FROM l WHERE t - b > {8 * HOUR}"""
)
def gap_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.gap_markers(hits(spark, sf_dir).select("du", "t", "cents"), ["du"], "t", "cents", 8 * HOUR)


STATS = f"s AS (SELECT (t // {HOUR}) * {HOUR} AS start, count(*) AS samples, min(cents) AS low, round(avg(cents), 6) AS mean FROM h GROUP BY 1)"


@query(
    f"""{H}, {STATS}, m AS (SELECT list_sort(list(mean))[count(*) // 2 + 1] AS median FROM s)
SELECT start, samples, low, mean, CASE WHEN low < mean * 0.6::DOUBLE THEN greatest(low::DOUBLE, floor(mean) - 4) ELSE low::DOUBLE END AS low_clean
FROM s, m WHERE samples >= 3 AND mean >= greatest(median - 8.0::DOUBLE, median * 0.78::DOUBLE)"""
)
def restart_edge_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry.sample_stats(hits(spark, sf_dir), "t", "cents", HOUR).select("start", "samples", "low", "mean")
    return telemetry.clean_restart_edges(rows, 3)


MISSING = "c AS (SELECT t // 86400000000 AS day, du, count(*) AS missing FROM h WHERE kind = 'error' GROUP BY ALL)"


def missing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = hits(spark, sf_dir).where("kind = 'error'")
    return errors.groupBy(F.expr("t div 86400000000").alias("day"), "du").agg(F.count("*").alias("missing"))


@query(f"{H}, {MISSING} SELECT day, du, missing, row_number() OVER (PARTITION BY day ORDER BY missing DESC, du) AS rank FROM c QUALIFY rank <= 10")
def top_missing_per_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.top_per_bucket(missing_counts(spark, sf_dir), ["day"], "du", "missing").withColumn("rank", F.col("rank").cast("long"))


@query(
    f"""{H}, c AS (SELECT du, count(*) AS n FROM h WHERE kind = 'error' GROUP BY du), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, du) AS k, sum(n) OVER () AS w FROM c)
SELECT CASE WHEN k <= 10 THEN du::VARCHAR ELSE 'other' END AS label, sum(n)::BIGINT AS count, count(*) AS items, round(sum(n) * 100.0::DOUBLE / any_value(w), 2) AS share_pct FROM r GROUP BY 1"""
)
def share_and_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = hits(spark, sf_dir).where("kind = 'error'").groupBy("du").agg(F.count("*").alias("n"))
    return telemetry.shares(totals, "du", "n")


@query(
    f"""{H}, c AS (SELECT du, count(*) AS n FROM h WHERE kind = 'error' GROUP BY du), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, du) AS k FROM c)
SELECT count(*) AS affected, round(max(n) * 100.0::DOUBLE / sum(n), 2) AS top_share_pct,
       round(CASE WHEN count(*) >= 3 THEN sum(n) FILTER (k <= 3) ELSE max(n) END * 100.0::DOUBLE / sum(n), 2) AS top3_share_pct FROM r"""
)
def concentration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = hits(spark, sf_dir).where("kind = 'error'").groupBy("du").agg(F.count("*").alias("n"))
    return telemetry.concentration(totals, "du", "n")


MERGE_A = f"a AS (SELECT (t // {HOUR}) * {HOUR} AS start, sum(cents)::BIGINT AS expected, count(*) AS missing FROM h WHERE kind = 'error' GROUP BY 1)"
MERGE_B = f"b AS (SELECT (t // {HOUR}) * {HOUR} AS start, sum(cents)::BIGINT AS expected, count(*) AS missing FROM h WHERE kind = 'click' GROUP BY 1)"


@query(
    f"""{H}, {MERGE_A}, {MERGE_B} SELECT coalesce(a.start, b.start) AS start, CASE WHEN a.start IS NOT NULL THEN a.expected ELSE b.expected END AS expected,
       CASE WHEN a.start IS NOT NULL THEN a.missing ELSE b.missing END AS missing, CASE WHEN a.start IS NOT NULL THEN 'first' ELSE 'second' END AS origin FROM a FULL JOIN b ON a.start = b.start"""
)
def bucket_merge_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir)
    part = lambda kind: h.where(F.col("kind") == kind).groupBy(telemetry.bucket("t", HOUR).alias("start")).agg(F.sum("cents").alias("expected"), F.count("*").alias("missing"))
    return telemetry.merge_priority(part("error"), part("click"), "start", ["expected", "missing"])


@query(
    f"""{H}, a AS (SELECT (t // {HOUR}) * {HOUR} AS start, count(*) AS expected, count(*) FILTER (cents > 5000) AS missing, count(*) FILTER (cents > 9000) AS timeouts FROM h WHERE kind = 'view' GROUP BY 1),
l AS (SELECT (t // {HOUR}) * {HOUR} AS start, count(*) AS missing, count(*) AS timeouts FROM h WHERE kind = 'error' GROUP BY 1),
j AS (SELECT coalesce(a.start, l.start) AS start, coalesce(a.expected, 0) AS expected, coalesce(a.missing, 0) AS am, coalesce(a.timeouts, 0) AS tm, l.missing AS lm, l.timeouts AS lt,
      l.missing IS NOT NULL AND (a.start IS NULL OR a.missing <= 0) AS from_log FROM a FULL JOIN l ON a.start = l.start)
SELECT start, expected, CASE WHEN from_log THEN lm ELSE am END AS missing, CASE WHEN from_log THEN greatest(tm, lt) ELSE tm END AS timeouts, from_log,
       round(CASE WHEN expected > 0 THEN (CASE WHEN from_log THEN lm ELSE am END)::DOUBLE / expected ELSE 0 END, 6) AS loss FROM j"""
)
def log_fallback_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir)
    start = telemetry.bucket("t", HOUR).alias("start")
    view = h.where("kind = 'view'").groupBy(start).agg(F.count("*").alias("expected"), F.count_if(F.col("cents") > 5000).alias("missing"), F.count_if(F.col("cents") > 9000).alias("timeouts"))
    log = h.where("kind = 'error'").groupBy(start).agg(F.count("*").alias("missing"), F.count("*").alias("timeouts"))
    return telemetry.fill_from_log(view, log).withColumn("loss", F.round("loss", 6))


@query(
    f"""{H}, l AS (SELECT du, cents, lag(cents) OVER w - cents AS back, max(cents) OVER (PARTITION BY du ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest
  FROM h WINDOW w AS (PARTITION BY du ORDER BY t, event_id))
SELECT du, count(*) AS samples, count(*) FILTER (back > 0) AS violations, coalesce(max(back) FILTER (back > 0), 0) AS max_back, count(*) FILTER (cents < latest) AS regressed FROM l GROUP BY du"""
)
def monotonic_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.violations(hits(spark, sf_dir), ["du"], ["t", "event_id"], "cents")


@query(
    f"""{H}, b AS (SELECT du, kind, max(event_id) AS last, arg_max((cents, event_id), ((cents // 1000) % 3, event_id)) AS r FROM h GROUP BY ALL)
SELECT du, kind, r[1]::BIGINT AS cents, r[2]::BIGINT AS event_id, last FROM (SELECT *, row_number() OVER (ORDER BY last DESC) AS k FROM b) WHERE k <= 200"""
)
def dedup_recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 keys touched last, each with its best detail: a top-k report."""
    h = hits(spark, sf_dir).withColumn("score", F.expr("(cents div 1000) % 3"))
    return telemetry.recent_events(h, ["du", "kind"], "event_id", "score", 200, ["cents", "event_id"])


@query(
    f"""{H}, v AS (SELECT try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, props, kind FROM h)
SELECT kind, coalesce(k, -1) AS k, count(*) AS n, count(*) FILTER (k IS NULL) AS bad FROM v GROUP BY ALL"""
)
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir).withColumn("k", text.to_long(F.get_json_object("props", "$.k")))
    return h.groupBy("kind", F.coalesce("k", F.lit(-1).cast("long")).alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("k").isNull()).alias("bad"))


@query(
    r"""WITH l AS (SELECT regexp_extract(url, '^(https?)://([^/?#]+)(/[^?#]*)?', 2) AS host, regexp_extract(url, '[?&]page=(\d+)', 1) AS page,
  len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"')) AS links, regexp_extract(html, '<html[^>]* lang="([a-z]+)"', 1) AS lang FROM pages)
SELECT host, lang, count(*) AS n, sum(links)::BIGINT AS links, max(try_cast(nullif(page, '') AS BIGINT)) AS max_page FROM l GROUP BY ALL"""
)
def log_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    part = lambda c, p, g: F.regexp_extract(c, p, g)
    rows = pages.select(
        part("url", r"^(https?)://([^/?#]+)(/[^?#]*)?", 2).alias("host"), part("url", r"[?&]page=(\d+)", 1).alias("page"),
        F.regexp_count("html", F.lit(r'<a [^>]*href="([^"]*)"')).cast("long").alias("links"), part("html", r'<html[^>]* lang="([a-z]+)"', 1).alias("lang"),
    )
    return rows.groupBy("host", "lang").agg(F.count("*").alias("n"), F.sum("links").alias("links"), F.max(text.to_long(F.col("page"))).alias("max_page"))


@query(
    f"""{H}, s AS (SELECT (t // {HOUR}) * {HOUR} AS start, count(*) FILTER (cents > 20000) AS missing FROM h GROUP BY 1), z AS (SELECT min(start) AS a, max(start) AS b FROM s WHERE missing > 0)
SELECT greatest(0, a - {HOUR}) AS "from", b + {HOUR} AS "to" FROM z WHERE a IS NOT NULL"""
)
def loss_focus_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hits(spark, sf_dir).groupBy(telemetry.bucket("t", HOUR).alias("start")).agg(F.count_if(F.col("cents") > 20_000).alias("missing"))
    return telemetry.focus_range(rows, "start", "missing", HOUR)


DAY0 = 1_704_067_200_000_000


@query(
    f"""{H}, r AS (SELECT du AS run, min(t) AS first_t, max(t) AS last_t FROM h GROUP BY du), o AS (SELECT *, least(last_t, {DAY0 + 240 * HOUR}) - greatest(first_t, {DAY0 + 5 * HOUR}) AS overlap FROM r)
SELECT run, first_t, last_t, overlap FROM o WHERE overlap > 0 ORDER BY overlap DESC, run LIMIT 1"""
)
def best_run_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = hits(spark, sf_dir).groupBy(F.col("du").alias("run")).agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    return telemetry.best_run(runs, DAY0 + 5 * HOUR, DAY0 + 240 * HOUR)


@query(f"{H}, m AS (SELECT du, min(t) AS f FROM h GROUP BY du) SELECT h.du, count(*) FILTER (kind = 'error' AND t - f < {240 * HOUR}) AS early_errors, count(DISTINCT kind) AS kinds FROM h JOIN m USING (du) GROUP BY h.du")
def active_du_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir)
    first = h.groupBy("du").agg(F.min("t").alias("f"))
    return h.join(first, "du").groupBy("du").agg(F.count_if((F.col("kind") == "error") & (F.col("t") - F.col("f") < 240 * HOUR)).alias("early_errors"), F.count_distinct("kind").alias("kinds"))
