"""Waveform queries: embeddings are traces of 64 samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitstream.functions import kernels
from hitstream.operators import electronics, pipeline
from hitstream.operators.filters import FilterConfig
from hitstream.plans.registry import query
from hitstream.tables import SECOND, read

#: Sine templates of 16 samples.
TEMPLATES = [np.sin(2 * np.pi * np.arange(16) * (k + 1) / 16) for k in range(4)]


@query(
    """WITH t AS (SELECT k, list_transform(range(0, 16), lambda j: sin(2 * pi() * j * (k + 1) / 16)) AS w FROM range(0, 4) r(k)),
c AS (SELECT vec_id, k, s, list_slice(embedding, s + 1, s + 16)::DOUBLE[] AS seg, w FROM embeddings, t, range(0, 49) q(s)),
v AS (SELECT vec_id, k, s, abs(list_dot_product(seg, w) / sqrt(list_dot_product(seg, seg) / 16) / (sqrt(list_dot_product(w, w) / 16) * 16)) AS corr FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY corr DESC, k, s) AS n FROM v)
SELECT vec_id, k AS template_id, s AS shift, round(corr, 6) AS corr FROM r WHERE n = 1"""
)
def template_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(x: np.ndarray) -> list[tuple]:
        return [(i, int(k), int(s), float(c)) for i, (k, s, c) in enumerate(zip(*kernels.best_template(x, TEMPLATES)))]

    out = kernels.over_traces(read(spark, sf_dir, "embeddings"), ["vec_id"], "embedding", "template_id long, shift long, corr double", kernel)
    return out.withColumn("corr", F.round("corr", 6))


P0 = kernels.Flt0(th1=0.2, th2=0.05, t_quiet=8, t_period=40, t_sepmax=14, nc_min=2, nc_max=9, skip=3)


@query(
    f"""WITH s AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
e AS (SELECT *, x > {P0.th2} AND NOT coalesce(lag(x) OVER w > {P0.th2}, true) AS edge, max(CASE WHEN x > {P0.th1} THEN i END) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_
  FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
t AS (SELECT vec_id, i, x FROM e WHERE x > {P0.th1} AND i > {P0.skip} AND (before_ IS NULL OR i - before_ > {P0.t_quiet // 2})),
c AS (SELECT t.vec_id, t.i AS t1, t.x, e.i AS j FROM t JOIN e ON e.vec_id = t.vec_id AND e.i > t.i AND e.i < t.i + {P0.t_period // 2} AND e.edge UNION ALL SELECT vec_id, i, x, i FROM t),
d AS (SELECT *, j - lag(j) OVER (PARTITION BY vec_id, t1 ORDER BY j) AS gap FROM c)
SELECT vec_id, t1, count(*) AS nc, round(x, 6) AS amplitude FROM d GROUP BY vec_id, t1, x HAVING count(*) > {P0.nc_min} AND count(*) < {P0.nc_max} AND coalesce(max(gap), 0) * 2 <= {P0.t_sepmax}"""
)
def flt0_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.flt0_hits(read(spark, sf_dir, "embeddings"), ["vec_id"], "embedding", P0).withColumn("amplitude", F.round("amplitude", 6))


@query()
def notch_fir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notch, then a short symmetric low-pass, of traces scaled to counts; peak and power of the result."""
    taps = np.hamming(9) / np.hamming(9).sum()

    def kernel(x: np.ndarray) -> list[tuple]:
        wide = np.hstack([np.rint(x * 4096), np.zeros((len(x), 64))])  # room for the filter's latency
        y = kernels.fir(kernels.notch(wide), taps)
        return [(i, int(np.abs(r).max()), float((r.astype(float) ** 2).sum())) for i, r in enumerate(y)]

    return kernels.over_traces(read(spark, sf_dir, "embeddings"), ["vec_id"], "embedding", "peak long, power double", kernel)


@query(
    """WITH p AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, list_aggregate(list_transform(embedding, lambda x: abs(x::DOUBLE)), 'max') AS peak FROM embeddings)
SELECT vec_id, CASE WHEN label % 3 = 0 THEN 512 WHEN label % 3 = 1 THEN 1024 ELSE 1536 END AS pattern, round(sqrt(list_dot_product(e, e) / len(e)), 6) AS rms, round(peak, 6) AS peak,
       CASE WHEN peak <= 0.2::DOUBLE THEN 'FLT0' WHEN peak <= 0.25::DOUBLE THEN 'FLT_SUPPRESSED' WHEN floor(peak * 65535) / 65535 > 0.3::DOUBLE THEN 'PASS' ELSE 'FLT1' END AS outcome FROM p"""
)
def trace_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-trace labels without Python: pattern, RMS, peak, outcome."""
    rows = read(spark, sf_dir, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    peak = F.array_max(F.transform("e", F.abs))
    power = F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x)
    pattern = electronics.trigger_pattern(F.col("label") % 3 != 1, F.col("label") % 3 != 0)
    score = F.when(peak > 0.25, F.floor(peak * 65_535))
    outcome = electronics.outcome(peak > 0.2, score, 0.3)
    return rows.select("vec_id", pattern.alias("pattern"), F.round(F.sqrt(power / F.size("e")), 6).alias("rms"), F.round(peak, 6).alias("peak"), outcome.alias("outcome"))


CASCADE = pipeline.Cascade(16, 60, 40, 1, 12, 0.3, 2, FilterConfig(window=SECOND, nhit=2), notch=False, taps=(0.25, 0.5, 0.25), peak=4, window=8)


@query()
def offline_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cascade: ten antennas an event, traces of four stretches of an embedding, over the backgrounds of the same front ends."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x * 1000).cast("int")).alias("e"))
    event, du = F.expr("vec_id div 10"), F.col("vec_id") % 10
    trace = F.concat("e", F.reverse("e"), "e", F.reverse("e"))
    sim = rows.select(event.alias("event"), du.alias("du"), (event * 1_000_000_000 + du * 100).alias("t_ns"), (event * 1_000_000_000).alias("scan_ns"), trace.alias("x"), F.reverse(trace).alias("y"), trace.alias("z"))
    weaker = lambda k: F.transform(trace, lambda x: F.floor(x / k).cast("int"))
    md = rows.select((du + 100).cast("int").alias("feb_id"), (F.col("vec_id") * 100_000_000).alias("t_ns"), F.col("vec_id").alias("entry"), *[weaker(k).alias(c) for c, k in zip("xyz", (8, 9, 10))])
    front_ends = spark.range(9).select(F.col("id").alias("du"), (F.col("id") + 100).cast("int").alias("feb_id"))  # the tenth antenna has none
    levels = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.lit(a).alias("th1"), F.lit(b).alias("th2")) for c, a, b in (("x", 180.0, 60.0), ("y", 200.0, 80.0))]))
    thresholds = front_ends.select("feb_id", levels.alias("l")).select("feb_id", "l.*")
    out = pipeline.process(sim, front_ends, md, thresholds, {"x": TEMPLATES, "y": TEMPLATES}, CASCADE)
    return out.withColumn("selected_du_ids", F.array_join(F.transform("selected_du_ids", lambda x: x.cast("string")), ","))
