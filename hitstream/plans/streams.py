"""Batch forms of the streaming operators, with arrival times made from the hits themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitstream.plans.registry import query
from hitstream.streaming import builder, gate
from hitstream.tables import HITS, HOUR, hits, read

GATE = gate.GateConfig(cut=HOUR, timeout=2 * HOUR, cap=3 * HOUR, idle_gap=HOUR // 2, retention=24 * HOUR)


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits arrive up to four hours late, by their cents; eight arrays share the DUs."""
    h = hits(spark, sf_dir)
    return h.select((F.col("du") % 8).alias("array"), (F.col("t") + (F.col("cents") % 15) * (HOUR // 4)).alias("arrival"), F.col("event_id").alias("seq"), "du", "t")


@query()
def gate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gate.replay(arrivals(spark, sf_dir), GATE)
    return out.withColumn("du_ids", F.array_join(F.transform("du_ids", lambda x: x.cast("string")), ","))


@query()
def gate_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.statistics(arrivals(spark, sf_dir), GATE)


@query()
def gate_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A DU's hits of an hour and a kind as one batch, which replaces those that the DU had there."""
    one = arrivals(spark, sf_dir).withColumn("tm", F.expr(f"t div {HOUR}"))
    batches = one.groupBy("array", "du", "tm", (F.col("seq") % 2).alias("half")).agg(F.max("arrival").alias("arrival"), F.max("seq").alias("seq"), F.array_sort(F.collect_list("t")).alias("ticks"))
    out = gate.replay(batches.select("array", "arrival", "seq", "du", "ticks"), GATE)
    return out.withColumn("du_ids", F.array_join(F.transform("du_ids", lambda x: x.cast("string")), ","))


FIRST = gate.GateConfig(cut=HOUR, timeout=2 * HOUR, cap=3 * HOUR, idle_gap=HOUR // 2, retention=10_000 * HOUR, mode="first_arrival", max_pending=1 << 30)
ARRIVALS = f"WITH h AS ({HITS}), a AS (SELECT du % 8 AS ar, t + (cents % 15) * {HOUR // 4} AS arrival, du, t, t // {HOUR} AS tm_id FROM h), b AS (SELECT *, min(arrival) OVER (PARTITION BY ar, tm_id) + {FIRST.timeout} AS close_at FROM a)"


@query(
    f"""{ARRIVALS} SELECT ar AS "array", tm_id, close_at AS closed_at, 'timeout' AS reason, {FIRST.timeout}::BIGINT AS waited, count(DISTINCT du) AS du_count, count(DISTINCT (du, t)) AS hit_count,
       array_to_string(list_sort(list(DISTINCT du)), ',') AS du_ids FROM b WHERE arrival < close_at GROUP BY ALL"""
)
def gate_first_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets close two hours after their first hit; what comes later is late for ever."""
    out = gate.replay(arrivals(spark, sf_dir), FIRST).drop("shadow_at")
    return out.withColumn("du_ids", F.array_join(F.transform("du_ids", lambda x: x.cast("string")), ","))


@query(
    f"""{ARRIVALS}, s AS (SELECT ar, count(DISTINCT tm_id) AS closed, count(*) FILTER (arrival >= close_at) AS late, coalesce(max(arrival - close_at) FILTER (arrival >= close_at), 0) AS late_age_max,
       coalesce(sum(arrival - close_at) FILTER (arrival >= close_at), 0)::BIGINT AS late_age_sum FROM b GROUP BY ar)
SELECT ar AS "array", closed, closed * {FIRST.timeout} AS wait_sum, {FIRST.timeout}::BIGINT AS wait_max, closed AS timeouts, 0::BIGINT AS forced, late, late AS late_guard, 0::BIGINT AS late_ingress, late_age_max, late_age_sum, 0::BIGINT AS shadow FROM s"""
)
def gate_first_arrival_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.statistics(arrivals(spark, sf_dir), FIRST)


@query(
    """WITH b AS (SELECT o_orderkey AS tag, epoch(o_orderdate)::BIGINT // 86400 AS d0, o_orderkey % 3 + 2 AS n FROM orders),
f AS (SELECT l_orderkey AS tag, epoch(l_shipdate)::BIGINT // 86400 AS day_, l_linenumber AS du, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS ord FROM lineitem),
v AS (SELECT f.*, n, d0, d0 IS NOT NULL AND day_ >= d0 AND day_ < d0 + 400 AS valid FROM f LEFT JOIN b USING (tag)),
w AS (SELECT *, valid AND du <= n AND row_number() OVER (PARTITION BY tag, valid, du ORDER BY ord) = 1 AS first FROM v),
c AS (SELECT tag, CASE WHEN count(*) FILTER (first) = any_value(n) THEN max(ord) FILTER (first) END AS done, list_sort(list(du) FILTER (first)) AS got FROM w GROUP BY tag),
k AS (SELECT w.*, done, CASE WHEN NOT valid OR ord > done THEN 'no_pending_event' WHEN du > n THEN 'not_expected' WHEN NOT first THEN 'duplicate_fragment' WHEN ord = done THEN 'complete' END AS kind FROM w JOIN c USING (tag))
SELECT tag, day_ AS "at", kind, CASE WHEN kind = 'complete' THEN array_to_string(range(1, n + 1), ',') ELSE du::VARCHAR END AS attached, '' AS missing FROM k WHERE kind IS NOT NULL
UNION ALL SELECT tag, d0 + 400, CASE WHEN len(coalesce(got, [])) > 0 THEN 'partial' ELSE 'timeout' END, array_to_string(coalesce(got, []), ','), array_to_string(list_filter(range(1, n + 1), lambda d: NOT list_contains(coalesce(got, []), d)), ',')
FROM b LEFT JOIN c USING (tag) WHERE done IS NULL"""
)
def builder_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders begin events, lines are fragments, days are time: 400 days from the order until the timeout."""
    day = lambda c: F.unix_date(F.to_date(c)).cast("long")
    begun = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("tag"), day("o_orderdate").alias("at"), F.lit(0).cast("long").alias("seq"),
        F.sequence(F.lit(1), (F.col("o_orderkey") % 3 + 2).cast("int")).alias("expected"), F.lit(None).cast("int").alias("du"), F.lit(None).cast("int").alias("size"),
    )
    got = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("tag"), day("l_shipdate").alias("at"), F.col("l_linenumber").cast("long").alias("seq"),
        F.lit(None).cast("array<int>").alias("expected"), F.col("l_linenumber").cast("int").alias("du"), F.lit(1).alias("size"),
    )
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return builder.replay(begun.unionByName(got), 400).withColumns({"attached": text("attached"), "missing": text("missing")})
