"""Result analytics: orders are showers (price is energy), events are scan steps, hourly series are efficiencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitstream.operators import analysis
from hitstream.plans.registry import query
from hitstream.tables import HITS, HOUR, hits, read

H = f"WITH h AS ({HITS})"
#: Prices run from 1e3 to 5e5; as energies in GeV they are scaled into the bins' range.
SCALE = 1e5
EDGES = analysis.log_edges()


def showers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a scan step: shower, species, energy, triggered. Lines are the steps; a step triggers when its quantity is above 25."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.substring("o_orderstatus", 1, 1).alias("species"), (F.col("o_totalprice") * F.lit(SCALE)).alias("energy"))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_quantity") > 25).alias("triggered"))
    # steps are reduced to one row a shower before they meet the manifest
    each = analysis.shower_efficiency(lines, ["o_orderkey"])
    return orders.join(each, "o_orderkey", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_trig", "n_total")})


EDGE_CASES = " ".join(f"WHEN e >= {EDGES[i]!r}::DOUBLE AND e < {EDGES[i + 1]!r}::DOUBLE THEN {i}" for i in range(15))
SHOWERS = f"""st AS (SELECT l_orderkey, count(*) FILTER (l_quantity > 25) AS n_trig, count(*) AS n_total FROM lineitem GROUP BY 1),
sh AS (SELECT o_orderkey, o_orderstatus AS species, o_totalprice * {SCALE}::DOUBLE AS e, n_trig, n_total FROM orders LEFT JOIN st ON l_orderkey = o_orderkey)"""


@query(
    f"""WITH {SHOWERS}, b AS (SELECT *, CASE {EDGE_CASES} END AS bin FROM sh), g AS (
  SELECT species, bin, sum(n_trig)::BIGINT AS n_trig, sum(n_total)::BIGINT AS n_total, count(*) AS n_showers FROM b WHERE n_total > 0 AND bin IS NOT NULL GROUP BY ALL)
SELECT *, round(n_trig::DOUBLE / n_total, 6) AS efficiency, round(sqrt((n_trig::DOUBLE / n_total) * (1 - n_trig::DOUBLE / n_total) / n_total), 6) AS error FROM g"""
)
def efficiency_by_energy_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned = showers(spark, sf_dir).withColumn("bin", analysis.bin_of(F.col("energy"), EDGES)).where("bin is not null")
    return analysis.pooled_efficiency(binned, ["species", "bin"])


BANDED = " UNION ALL ".join(
    f"SELECT '{name}' AS band, * FROM x WHERE e >= {lo!r}::DOUBLE" + (f" AND e < {hi!r}::DOUBLE" if hi != float("inf") else "") for name, lo, hi in analysis.BANDS
)


@query(
    f"""WITH x AS (SELECT o_totalprice * 1e13::DOUBLE AS e, year(l_shipdate)::INTEGER AS idx, l_quantity > 25 AS triggered FROM lineitem JOIN orders ON o_orderkey = l_orderkey), z AS ({BANDED})
SELECT band, idx, round(count(*) FILTER (triggered)::DOUBLE / count(*), 6) AS efficiency, count(*) AS n FROM z GROUP BY ALL"""
)
def efficiency_by_band_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") * F.lit(1e13)).alias("energy"))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.year("l_shipdate").alias("idx"), (F.col("l_quantity") > 25).alias("triggered"))
    return analysis.efficiency_series(analysis.in_bands(lines.join(orders, "o_orderkey"), F.col("energy")), ["band", "idx"])


@query(
    f"""{H}, z AS (SELECT min(cents) AS lo, max(cents) AS hi FROM h)
SELECT least(floor((cents - lo) * 20.0::DOUBLE / (hi - lo)), 19)::INTEGER AS bin, count(*) AS n FROM h, z GROUP BY 1"""
)
def histogram_equal_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.histogram(hits(spark, sf_dir), "cents", 20)


#: An hourly efficiency per kind: the cents of a user's share, exact integers on a regular index.
SERIES = f"""s0 AS (SELECT kind, t // {HOUR} - 473352 AS idx, sum(cents)::BIGINT AS cents FROM h GROUP BY ALL),
n AS (SELECT max(idx) AS m FROM s0), grid AS (SELECT kind, i AS idx FROM (SELECT DISTINCT kind FROM s0), range(0, 720) AS r(i), n WHERE i <= m),
s AS (SELECT kind, idx, coalesce(cents, 0) / 100.0::DOUBLE AS value FROM grid LEFT JOIN s0 USING (kind, idx))"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regular hourly grid per kind, empty hours as 0 (473352 hours lead to 2024)."""
    h = hits(spark, sf_dir)
    hours = h.groupBy("kind", (F.expr(f"t div {HOUR}") - 473_352).alias("idx")).agg(F.sum("cents").alias("cents"))
    last = hours.agg(F.max("idx").alias("m"))
    grid = hours.select("kind").distinct().crossJoin(F.broadcast(last)).select("kind", F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("idx"))
    return grid.join(hours, ["kind", "idx"], "left").select("kind", "idx", (F.coalesce("cents", F.lit(0)) / F.lit(100.0)).alias("value"))


def interpolation(step: str, offset: str = "0") -> str:
    """DuckDB: linear interpolation of every step-th sample with extrapolation, as (kind, idx, value, approx) for one offset column o."""
    return f"""(SELECT s.kind, s.idx, s.value, s.o, a.value + (s.idx - a.idx) * (b.value - a.value) / {step} AS approx FROM
  (SELECT *, greatest(0, least(floor((idx - {offset}) / {step}), floor((m - {offset}) / {step}) - 1))::BIGINT AS k FROM so) s
  JOIN s a ON a.kind = s.kind AND a.idx = {offset} + s.k * {step} JOIN s b ON b.kind = s.kind AND b.idx = {offset} + (s.k + 1) * {step})"""


@query(
    f"""{H}, {SERIES}, so AS (SELECT s.*, 0 AS o, (SELECT max(idx) FROM s) AS m FROM s),
c AS (SELECT kind, idx, value, approx, sum(value) OVER w AS e, sum(approx) OVER w AS a FROM {interpolation("25")} WINDOW w AS (PARTITION BY kind ORDER BY idx ROWS UNBOUNDED PRECEDING))
SELECT kind, idx, round(e, 3) AS exposure, round(a, 3) AS exposure_sampled, round(CASE WHEN e > 0 THEN abs(a - e) / e * 100 END, 4) AS rel_err_pct FROM c"""
)
def cumulative_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = analysis.interpolated(series(spark, sf_dir), ["kind"], 25)
    e = analysis.cumulative(both, ["kind"], "idx", "value", 1.0)
    a = analysis.cumulative(e.withColumnRenamed("exposure", "e"), ["kind"], "idx", "approx", 1.0)
    rel = F.when(F.col("e") > 0, F.abs(F.col("exposure") - F.col("e")) / F.col("e") * 100)
    return a.select("kind", "idx", F.round("e", 3).alias("exposure"), F.round("exposure", 3).alias("exposure_sampled"), F.round(rel, 4).alias("rel_err_pct"))


@query(
    f"""{H}, {SERIES}, so AS (SELECT s.*, 0 AS o, (SELECT max(idx) FROM s) AS m FROM s),
r AS (SELECT kind, sqrt(avg(pow(value - approx, 2))) AS rmse, stddev_pop(value) AS spread, avg(value) AS mean FROM {interpolation("24")} GROUP BY kind)
SELECT kind, round(rmse, 6) AS rmse, round(rmse / spread, 6) AS nrmse, round(rmse / mean, 6) AS rel_err FROM r"""
)
def downsample_nrmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.sampling_error(series(spark, sf_dir), ["kind"], 24)


@query(
    f"""{H}, {SERIES}, so AS (SELECT s.*, o.i AS o, (SELECT max(idx) FROM s) AS m FROM s, range(0, 24) AS o(i)),
p AS (SELECT kind, o, sum(approx) AS e, sum(value) AS true_ FROM {interpolation("24", "o")} GROUP BY kind, o)
SELECT kind, count(*) AS offsets, round(any_value(true_), 6) AS e_true, round(avg(e), 6) AS mean, round(stddev_pop(e), 6) AS spread, round(stddev_pop(e) / any_value(true_) * 100, 6) AS rel_pct FROM p GROUP BY kind"""
)
def phase_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.phase_exposure(series(spark, sf_dir), ["kind"], 24, 1.0)


@query(
    f"""{H}, {SERIES}, n2 AS (SELECT m + 1 AS n FROM n), f AS (SELECT i AS k, i::DOUBLE / (n * 0.05::DOUBLE) AS freq FROM range(0, 400) AS r(i), n2 WHERE i <= n // 2),
p AS (SELECT kind, freq, pow(sum(value * cos(2 * pi() * ((k * idx) % n) / n)), 2) + pow(sum(value * sin(2 * pi() * ((k * idx) % n) / n)), 2) AS power FROM s, f, n2 GROUP BY ALL),
b AS (SELECT kind, sum(power) FILTER (freq > 0 AND freq <= 10) AS ac, coalesce(sum(power) FILTER (freq > 0 AND freq < 1), 0) AS low, coalesce(sum(power) FILTER (freq >= 1 AND freq <= 10), 0) AS high FROM p GROUP BY kind)
SELECT kind, round(low / ac, 6) AS low_share, round(high / ac, 6) AS high_share, round(log10(ac), 6) AS log_ac FROM b"""
)
def band_power_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analysis.band_power(analysis.spectrum(series(spark, sf_dir), ["kind"], 0.05), ["kind"], 1.0, 10.0)
    return out.select("kind", "low_share", "high_share", F.round(F.log10("p_ac"), 6).alias("log_ac"))
