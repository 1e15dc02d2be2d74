"""As-of joins, lookups, grids and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitstream.operators import asof, lookups
from hitstream.plans.registry import query
from hitstream.sources import tables
from hitstream.tables import HITS, HOUR, hits, read

H = f"WITH h AS ({HITS})"


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Targets are errors, the series is all other events; users are antennas."""
    h = hits(spark, sf_dir).select("du", "t", "event_id", "kind")
    return h.where("kind = 'error'").select("du", "t", F.col("event_id").alias("target")), h.where("kind <> 'error'").select("du", "t", "event_id")


SIDES = f"{H}, a AS (SELECT du, t, event_id AS target FROM h WHERE kind = 'error'), b AS (SELECT du, t, event_id FROM h WHERE kind <> 'error')"
RANKED = f"{SIDES}, r AS (SELECT a.*, b.t AS bt, b.event_id, row_number() OVER (PARTITION BY a.target ORDER BY abs(a.t - b.t), b.t, b.event_id) AS k FROM a LEFT JOIN b USING (du))"


@query(f"{RANKED} SELECT du, t, target, bt AS match_t, event_id AS match_id FROM r WHERE k = 1")
def nearest_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets, series = sides(spark, sf_dir)
    return asof.nearest(targets, series, "du", "t", "event_id")


@query(
    f"""{RANKED}, two AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY bt, event_id) AS p, count(*) OVER (PARTITION BY target) AS n FROM r WHERE k <= 2 AND event_id IS NOT NULL)
SELECT x.du, x.t, x.target, x.bt AS t1, x.event_id AS id1, y.bt AS t2, y.event_id AS id2 FROM two x JOIN two y ON x.target = y.target AND x.p = 1 AND y.p = 2"""
)
def nearest_two_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets, series = sides(spark, sf_dir)
    return asof.nearest_two(targets, series, "du", "t", "event_id")


@query(
    f"""{SIDES}, e AS (SELECT du, max(t) AS last FROM b GROUP BY du),
r AS (SELECT a.*, b.t AS hist_t, b.event_id AS hist_id, row_number() OVER (PARTITION BY a.target ORDER BY b.t DESC, b.event_id DESC) AS age FROM a JOIN b ON a.du = b.du AND b.t <= a.t),
c AS (SELECT a.*, (SELECT count(*) FROM b WHERE b.du = a.du AND b.t <= a.t) AS n, last FROM a LEFT JOIN e USING (du)),
s AS (SELECT du, t, target, CASE WHEN last IS NULL OR t > last THEN 'after_end' WHEN n < 5 THEN 'too_few' ELSE 'ok' END AS status FROM c)
SELECT s.*, hist_t, hist_id, age FROM s LEFT JOIN r ON r.target = s.target AND s.status = 'ok' AND age <= 5 WHERE s.status <> 'ok' OR age IS NOT NULL"""
)
def last_n_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets, series = sides(spark, sf_dir)
    return asof.last_n(targets, series, "du", "t", "event_id", 5).withColumn("age", F.col("age").cast("long"))


@query(
    """WITH m AS (SELECT s_suppkey AS du, s_nationkey AS feb FROM supplier UNION ALL SELECT s_suppkey + 65000, s_nationkey FROM supplier),
d AS (SELECT n_nationkey AS feb, n_regionkey * 100 AS th1 FROM nation WHERE n_nationkey % 5 <> 0),
r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey + 65000 WHEN l_linenumber % 7 = 0 THEN -1 ELSE l_suppkey END AS du, l_quantity FROM lineitem)
SELECT m.feb, coalesce(th1, -1) AS th1, d.feb IS NOT NULL AS found, count(*) AS n, count(*) FILTER (coalesce(l_quantity > th1 / 10, false)) AS passed FROM r LEFT JOIN m USING (du) LEFT JOIN d ON d.feb = m.feb GROUP BY ALL"""
)
def left_mask_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = lookups.dual_indexed(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("du"), F.col("s_nationkey").alias("feb")), "du")
    side = read(spark, sf_dir, "nation").where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("feb"), (F.col("n_regionkey") * 100).alias("th1"))
    du = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey") + 65_000).when(F.col("l_linenumber") % 7 == 0, F.lit(-1)).otherwise(F.col("l_suppkey"))
    rows = read(spark, sf_dir, "lineitem").select(du.alias("du"), "l_quantity")
    out = lookups.masked_lookup(rows, mapping, side, "du", "feb", {"th1": -1})
    passed = F.col("found") & (F.col("l_quantity") > F.col("th1") / 10)
    return out.groupBy("feb", "th1", "found").agg(F.count("*").alias("n"), F.count_if(passed).alias("passed"))


@query("SELECT s_suppkey, i AS idx, round(10.0::DOUBLE + i * 0.25::DOUBLE, 6) AS t FROM supplier, range(0, 11) AS g(i)")
def time_grid_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = lookups.on_grid(read(spark, sf_dir, "supplier").select("s_suppkey"), 10.0, 12.6, 0.25)
    return grid.withColumn("t", F.round("t", 6)).withColumn("idx", F.col("idx").cast("long"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def missing_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return lookups.missing(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), done, "c_custkey")


@query(
    """WITH n AS (SELECT o_orderkey AS tag, o_totalprice AS v FROM orders WHERE o_orderkey % 10 <> 0),
o AS (SELECT o_orderkey AS tag, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice + 1 WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 11 <> 0)
SELECT coalesce(n.tag, o.tag) AS tag, n.v AS new_value, o.v AS old_value,
       CASE WHEN o.tag IS NULL THEN 'only_new' WHEN n.tag IS NULL THEN 'only_old' WHEN n.v IS NOT DISTINCT FROM o.v THEN 'equal' ELSE 'mismatch' END AS state FROM n FULL JOIN o ON n.tag = o.tag"""
)
def full_outer_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two dumps made from one table, each lacking some keys and differing in some values: the comparison's input, not a filter of it."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tag"), F.col("o_totalprice").alias("v"))
    old = F.when(F.col("tag") % 4 == 0, F.col("v") + 1).when(F.col("tag") % 9 == 0, F.lit(None)).otherwise(F.col("v"))
    return lookups.compare(orders.where("tag % 10 <> 0"), orders.where("tag % 11 <> 0").withColumn("v", old), "tag", "v")


@query(
    f"""{H}, n AS (SELECT du, row_number() OVER (PARTITION BY du ORDER BY t, event_id) AS pos, cents AS v FROM h WHERE kind = 'view'),
o AS (SELECT du, row_number() OVER (PARTITION BY du ORDER BY t, event_id) AS pos, cents AS v FROM h WHERE kind = 'click')
SELECT coalesce(n.du, o.du) AS du, coalesce(n.pos, o.pos) AS pos, n.v AS new_value, o.v AS old_value,
       CASE WHEN o.pos IS NULL THEN 'only_new' WHEN n.pos IS NULL THEN 'only_old' WHEN n.v = o.v THEN 'equal' ELSE 'mismatch' END AS state FROM n FULL JOIN o ON n.du = o.du AND n.pos = o.pos"""
)
def positional_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir)
    out = lookups.compare_by_position(h.where("kind = 'view'"), h.where("kind = 'click'"), ["du"], ["t", "event_id"], "cents")
    return out.withColumn("pos", F.col("pos").cast("long"))


@query(
    f"""{H}, m AS (SELECT kind AS file_path, event_id AS entry_index, (t - min(t) OVER ()) * 1000 AS rel_ns FROM h WHERE du = 7)
SELECT *, (rel_ns // 1000000000)::VARCHAR || '.' || lpad((rel_ns % 1000000000)::VARCHAR, 9, '0') AS relative_time_sec FROM m"""
)
def relative_time_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir)
    records = h.select(F.col("du").alias("feb_id"), F.expr("t div 1000000").alias("sec"), F.expr("t % 1000000 * 1000").alias("nsec"), F.col("kind").alias("file_path"), F.col("event_id").alias("entry_index"))
    return tables.relative_entries(records, 7)
