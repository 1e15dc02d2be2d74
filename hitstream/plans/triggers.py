"""Trigger queries over hits from ``events``: buckets are days, windows minutes, DUs users."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitstream.operators import filters, fragments, windows
from hitstream.operators.filters import FilterConfig
from hitstream.plans.registry import query
from hitstream.tables import DAY, HITS, SECOND, hits, read

WINDOW, NHIT = 7200 * SECOND, 5
B = f"WITH RECURSIVE hits AS (SELECT *, t // {DAY} AS tm_id FROM ({HITS}))"


def bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.with_bucket(hits(spark, sf_dir), DAY)


def joined(column: str):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


GREEDY = f"""{B},
h AS (SELECT row_number() OVER (PARTITION BY tm_id ORDER BY t, du) AS i, * FROM hits),
n AS (SELECT x.tm_id, x.i, count(DISTINCT y.du) AS c, max(y.i) AS j FROM h x JOIN h y
      ON x.tm_id = y.tm_id AND y.i >= x.i AND y.t <= x.t + {WINDOW} GROUP BY x.tm_id, x.i),
cand AS (SELECT * FROM n WHERE c >= {NHIT}),
nxt AS (SELECT a.tm_id, a.i, a.j, a.c, min(z.i) AS ni FROM cand a LEFT JOIN cand z ON z.tm_id = a.tm_id AND z.i > a.j GROUP BY ALL),
g AS (SELECT f.* FROM nxt f JOIN (SELECT tm_id, min(i) AS i FROM cand GROUP BY tm_id) m USING (tm_id, i)
      UNION ALL SELECT x.* FROM g JOIN nxt x ON x.tm_id = g.tm_id AND x.i = g.ni)
"""


@query(
    GREEDY
    + """SELECT g.tm_id, min(h.t) AS window_start, max(h.t) AS window_end, count(*) AS hit_count, count(DISTINCT h.du) AS du_count,
       array_to_string(list_sort(list(DISTINCT h.du)), ',') AS du_ids
FROM g JOIN h ON h.tm_id = g.tm_id AND h.i BETWEEN g.i AND g.j GROUP BY g.tm_id, g.i"""
)
def coincidence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.coincidences(bucketed(spark, sf_dir), WINDOW, NHIT).withColumn("du_ids", joined("du_ids"))


@query(f"{B} SELECT tm_id, count(*) AS hit_count, array_to_string(list_sort(list(DISTINCT du)), ',') AS du_ids, min(t) AS first_t, max(t) AS last_t FROM hits GROUP BY tm_id")
def passthrough_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.passthrough(bucketed(spark, sf_dir)).withColumn("du_ids", joined("du_ids"))


@query(
    f"""{B} SELECT x.event_id, count(DISTINCT y.du) AS n_du, count(DISTINCT y.du) >= {NHIT} AS candidate
FROM hits x JOIN hits y ON x.tm_id = y.tm_id AND y.t BETWEEN x.t AND x.t + {WINDOW} GROUP BY x.event_id"""
)
def nhit_candidate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = windows.candidate_flags(bucketed(spark, sf_dir), WINDOW, NHIT)
    return flags.select("event_id", F.col("n_du").cast("long").alias("n_du"), "candidate")


# pairs: an order is an event, its lines' suppliers are DUs, ship days are times in list order of (time, line, part)
LINES = "SELECT l_orderkey AS event, l_suppkey % 50 AS du, epoch_us(l_shipdate) // 86400000000 AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_extendedprice) AS i FROM lineitem"
PAIRS = f"""l AS ({LINES}),
pairs AS (SELECT x.event, least(x.du, y.du) AS a, greatest(x.du, y.du) AS b, arg_max(x.t - y.t, x.i * 100000 + y.i) AS dt
  FROM l x JOIN l y ON x.event = y.event AND x.i < y.i GROUP BY ALL)"""


def event_lines(spark: SparkSession, sf_dir: str, du: Column | None = None) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    order = F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_extendedprice")
    return lines.select(F.col("l_orderkey").alias("event"), (F.col("l_suppkey") % 50 if du is None else du).alias("du"), F.unix_date(F.to_date("l_shipdate")).cast("long").alias("t"), order.alias("i"))


def event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.pairs_of(event_lines(spark, sf_dir), "event")


@query(f"WITH {PAIRS} SELECT event, a, b, dt FROM pairs")
def pair_time_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_pairs(spark, sf_dir)


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A distance for most pairs of the 50 DUs: light time in ticks from their ids; the pair table is 50 x 50 at every scale."""
    ids = spark.range(50)
    grid = ids.select(F.col("id").alias("a")).crossJoin(F.broadcast(ids.select(F.col("id").alias("b"))))
    return grid.where((F.col("a") <= F.col("b")) & ((F.col("a") + F.col("b")) % 7 != 0)).withColumn("light", ((F.col("b") - F.col("a")) * 9 + 30).cast("double"))


@query(
    f"""WITH {PAIRS}, d AS (SELECT x.i AS a, y.i AS b, (y.i - x.i) * 9 + 30 AS light FROM range(50) x(i), range(50) y(i) WHERE x.i <= y.i AND (x.i + y.i) % 7 <> 0)
SELECT event, a, b, dt, light::DOUBLE AS light FROM pairs JOIN d USING (a, b) WHERE a <> b AND abs(dt) <= light + 5"""
)
def causal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.causal_pairs(event_pairs(spark, sf_dir), distances(spark, sf_dir), 5.0).select("event", "a", "b", "dt", "light")


@query(
    f"""WITH {PAIRS.replace("l_suppkey % 50", "l_suppkey")}, current AS (SELECT * FROM pairs WHERE event % 2 = 0), hist AS (SELECT event AS hist, a, b, dt FROM pairs WHERE event % 2 = 1)
SELECT event, hist, count(*) AS matches FROM current c JOIN hist h USING (a, b) WHERE abs(c.dt - h.dt) < 200 GROUP BY event, hist HAVING count(*) >= 2"""
)
def duplicate_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even orders are current events, odd ones the history: the two sides of the fingerprint join."""
    pairs = filters.pairs_of(event_lines(spark, sf_dir, F.col("l_suppkey")), "event")
    history = pairs.where(F.col("event") % 2 == 1).withColumnRenamed("event", "hist")
    return filters.duplicate_events(pairs.where(F.col("event") % 2 == 0), history, 200, 2)


@query(
    """WITH begun AS (SELECT o_orderkey AS tag, o_orderkey % 3 + 3 AS n FROM orders),
f AS (SELECT l_orderkey AS tag, l_linenumber AS du, min(epoch_us(l_shipdate)) AS t, count(*) AS n_all FROM lineitem GROUP BY ALL),
x AS (SELECT b.tag, b.n, list(f.du ORDER BY f.du) FILTER (f.du <= b.n) AS got, coalesce(sum(f.n_all) FILTER (f.du <= b.n), 0) AS arrived, coalesce(sum(f.n_all) FILTER (f.du > b.n), 0) AS foreign_ FROM begun b LEFT JOIN f USING (tag) GROUP BY b.tag, b.n)
SELECT tag, n AS expected, coalesce(len(got), 0) AS attached, (arrived - coalesce(len(got), 0))::BIGINT AS duplicates, foreign_::BIGINT AS unexpected,
       array_to_string(list_filter(range(1, n + 1), lambda d: NOT list_contains(coalesce(got, []), d)), ',') AS missing,
       CASE WHEN coalesce(len(got), 0) = n THEN 'complete' WHEN coalesce(len(got), 0) > 0 THEN 'partial' ELSE 'empty' END AS state FROM x"""
)
def fragments_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    begun = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tag"), F.sequence(F.lit(1), (F.col("o_orderkey") % 3 + 3).cast("int")).alias("expected"))
    got = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tag"), F.col("l_linenumber").alias("du"))
    out = fragments.completion(begun, got)
    size = lambda c: F.size(c).cast("long")
    return out.select("tag", size("expected").alias("expected"), size("attached").alias("attached"), "duplicates", "unexpected", joined("missing").alias("missing"), "state")


@query(
    """WITH sent AS (SELECT o_orderkey AS tag, o_custkey % 25 AS du, epoch_us(o_orderdate) AS sent FROM orders WHERE o_orderstatus <> 'P'),
got AS (SELECT l_orderkey AS tag, min(epoch_us(l_shipdate)) AS got FROM lineitem GROUP BY l_orderkey),
j AS (SELECT du, (got - sent) // 1000000 AS lat, got IS NULL AS pending FROM sent LEFT JOIN got USING (tag))
SELECT coalesce(du, -1) AS du, count(*) FILTER (NOT pending) AS responses, count(*) FILTER (pending) AS pending, sum(lat)::BIGINT AS latency_sum, max(lat) AS latency_max,
       round(avg(lat), 4) AS latency_avg, count(*) FILTER (lat > 10000000) AS slow FROM j GROUP BY ROLLUP (du)"""
)
def response_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    day = lambda c: F.unix_date(F.to_date(c)).cast("long") * 86_400
    sent = orders.select(F.col("o_orderkey").alias("tag"), (F.col("o_custkey") % 25).alias("du"), day("o_orderdate").alias("sent"))
    got = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("tag")).agg(F.min(day("l_shipdate")).alias("got"))
    return fragments.latency(sent, got, 10_000_000)


@query(
    f"""WITH h AS ({HITS}), ring AS (SELECT event_id, du, t, row_number() OVER (PARTITION BY du ORDER BY t DESC, event_id DESC) AS rn FROM h),
asked AS (SELECT DISTINCT du, t FROM h WHERE kind = 'error')
SELECT a.du, a.t, r.event_id, CASE WHEN r.event_id IS NULL THEN 'LOST' ELSE 'FOUND' END AS state FROM asked a LEFT JOIN ring r ON r.du = a.du AND r.t = a.t AND r.rn <= 20"""
)
def ring_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir)
    return fragments.ring_lookup(h.where("kind = 'error'").select("du", "t"), h.select("du", "t", "event_id"), ["du"], "t", "event_id", capacity=2000, slot=100)


CHAIN = FilterConfig(window=WINDOW, nhit=5, causal=True, tolerance=60.0 * SECOND, template=True, coefficient=0.02, duplicate=True, history=10, time_diff=20 * SECOND, min_pairs=3)


def chained(spark: SparkSession, sf_dir: str, config: FilterConfig = CHAIN) -> DataFrame:
    """The full chain: greedy windows, largest causal subset, template score, and duplicates of earlier buckets of the same run of 24."""
    h = bucketed(spark, sf_dir).withColumn("run", F.expr("tm_id div 24")).withColumn("du", F.col("du") % 50).withColumn("score", F.least(F.lit(65_535), F.col("cents")).cast("long"))
    table = {(a, b): ((b - a) * 30.0 + 100.0) * SECOND / 10 for a in range(50) for b in range(a, 50) if (a + b) % 7}
    return windows.trigger(h, table, config, "run")


@query()
def max_clique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain with the largest causal subset of every window, however many DUs it has."""
    out = chained(spark, sf_dir, replace(CHAIN, bypass=None))
    return out.withColumns({c: joined(c) for c in ("du_ids", "selected_du_ids", "selected_t")})


@query()
def filter_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the chain as it runs in production, where windows of many DUs pass unsearched and are counted apart."""
    return windows.statistics(chained(spark, sf_dir), CHAIN)
