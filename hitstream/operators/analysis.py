"""Efficiency, spectra, sampling error and exposure of scan results."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hitstream.operators import lookups

#: Edges of the 15 energy bins are 10 ** (8 + 0.2 i) GeV; bands in eV, half-open.
LOG_LOW, LOG_STEP, BINS = 8.0, 0.2, 15
BANDS = [("gt100_PeV_all", 1e17, math.inf), ("lt3_EeV", 1e17, 3e18), ("ge3_EeV", 3e18, math.inf)]


def log_edges(low: float = LOG_LOW, step: float = LOG_STEP, bins: int = BINS) -> list[float]:
    return [10 ** (low + step * i) for i in range(bins + 1)]


def bin_of(value: Column, edges: list[float]) -> Column:
    """Index of the half-open bin [edge i, edge i + 1); null outside."""
    at = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        at = F.when((value >= F.lit(edges[i])) & (value < F.lit(edges[i + 1])), F.lit(i)).otherwise(at)
    return at


def shower_efficiency(scan: DataFrame, by: list[str]) -> DataFrame:
    """Triggered and evaluated pairs of every shower."""
    return scan.groupBy(*by).agg(F.count_if("triggered").alias("n_trig"), F.count("*").alias("n_total"))


def pooled_efficiency(showers: DataFrame, by: list[str]) -> DataFrame:
    """Efficiency of a group with its binomial error (6 digits); showers without pairs do not count."""
    out = showers.where("n_total > 0").groupBy(*by).agg(F.sum("n_trig").alias("n_trig"), F.sum("n_total").alias("n_total"), F.count("*").alias("n_showers"))
    e = F.col("n_trig") / F.col("n_total")
    return out.withColumn("efficiency", F.round(e, 6)).withColumn("error", F.round(F.sqrt(e * (1 - e) / F.col("n_total")), 6))


def in_bands(df: DataFrame, energy: Column, bands=BANDS) -> DataFrame:
    """A row for each band that holds its energy: bands overlap. The table of bands is a constant."""
    tests = [F.when((energy >= F.lit(lo)) & (energy < F.lit(hi)), F.lit(name)) for name, lo, hi in bands]
    return df.withColumn("band", F.explode(F.array_compact(F.array(*tests))))


def efficiency_series(df: DataFrame, by: list[str]) -> DataFrame:
    """Mean trigger rate of a band per time index, from exact counts."""
    return df.groupBy(*by).agg(F.round(F.count_if("triggered") / F.count("*"), 6).alias("efficiency"), F.count("*").alias("n"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins from minimum to maximum, the last one closed at its right end."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = F.least(F.floor((F.col(value) - F.col("lo")) * F.lit(bins) / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))
    at = F.when(F.col("hi") > F.col("lo"), at).otherwise(F.lit(0)).cast("int")
    return df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def integer_histogram(df: DataFrame, value: str) -> DataFrame:
    """Counts in bins centred on the integers from 0 to the maximum, empty ones included; values below the first bin's edge -0.5 don't count."""
    own = df.where(F.col(value) >= -0.5).groupBy(F.floor(F.col(value) + 0.5).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    bins = own.agg(F.max("bin").alias("top")).where("top is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("bin"))
    return bins.join(own, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def interpolated(series: DataFrame, by: list[str], step: int, offset: int | Column = 0, idx: str = "idx", value: str = "value") -> DataFrame:
    """``series`` (regular index per key) with ``approx``: linear interpolation of every ``step``-th sample, extrapolated at both ends.

    The samples around a point follow from index arithmetic, so each point joins its two by key; beyond the ends the two outermost samples give the slope.
    """
    off = offset if isinstance(offset, Column) else F.lit(offset)
    ends = series.groupBy(*by).agg(F.max(idx).alias("__last"))
    kept = series.where(F.pmod(F.col(idx) - off, F.lit(step)) == 0).where(F.col(idx) >= off)
    s = series.join(ends, by).withColumn("__n", F.floor((F.col("__last") - off) / step))
    slot = F.greatest(F.lit(0), F.least(F.floor((F.col(idx) - off) / step), F.col("__n") - 1))
    s = s.withColumn("__i0", (off + slot * step).cast("long")).withColumn("__i1", F.least(F.col("__i0") + step, off + F.col("__n") * step).cast("long"))
    a = kept.select(*by, F.col(idx).alias("__i0"), F.col(value).alias("__v0"))
    b = kept.select(*by, F.col(idx).alias("__i1"), F.col(value).alias("__v1"))
    s = s.join(a, [*by, "__i0"]).join(b, [*by, "__i1"])
    share = F.when(F.col("__i1") > F.col("__i0"), (F.col(idx) - F.col("__i0")) / (F.col("__i1") - F.col("__i0"))).otherwise(F.lit(0.0))
    return s.withColumn("approx", F.col("__v0") + share * (F.col("__v1") - F.col("__v0"))).drop("__last", "__n", "__i0", "__i1", "__v0", "__v1")


def sampling_error(series: DataFrame, by: list[str], step: int, value: str = "value") -> DataFrame:
    """RMSE of the interpolation, over the population spread (nrmse) and over the mean (relative error); 0 where those are not positive."""
    both = interpolated(series, by, step, value=value)
    out = both.groupBy(*by).agg(
        F.sqrt(F.avg(F.pow(F.col(value) - F.col("approx"), F.lit(2)))).alias("rmse"), F.stddev_pop(value).alias("spread"), F.avg(value).alias("mean")
    )
    over = lambda c: F.round(F.when(F.col(c) > 0, F.col("rmse") / F.col(c)).otherwise(F.lit(0.0)), 6)
    return out.select(*by, F.round("rmse", 6).alias("rmse"), over("spread").alias("nrmse"), over("mean").alias("rel_err"))


def cumulative(series: DataFrame, by: list[str], idx: str, value: str, dt: float) -> DataFrame:
    """Running sum times the step; a key's series is ordered once."""
    w = Window.partitionBy(*by).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn("exposure", F.sum(value).over(w) * F.lit(dt))


def phase_exposure(series: DataFrame, by: list[str], step: int, dt: float, idx: str = "idx", value: str = "value") -> DataFrame:
    """Mean and population spread, over all offsets, of the interpolated exposure of every ``step``-th sample, with the true exposure.

    Interpolated sums are linear in the samples, so each sample enters each offset once: no point is interpolated. Sample i serves offset
    i mod step alone, with the weight of its triangle (step), corrected at the two ends.
    """
    ends = series.groupBy(*by).agg(F.count("*").alias("__size"), F.sum(value).alias("__whole"))
    s = series.join(lookups.small(ends), by).withColumn("__offset", F.col(idx) % step)
    # samples of an offset o: o, o + step, ..., last; m of them
    m = F.floor((F.col("__size") - 1 - F.col("__offset")) / step) + 1
    s = s.withColumn("__m", m).where("__m >= 2").withColumn("__k", F.floor(F.col(idx) / step))
    tail = F.col("__size") - 1 - (F.col("__offset") + (F.col("__m") - 1) * step)
    tri = lambda n: n * (n + 1) / (2.0 * step)  # sum of j / step for j = 1..n
    half = (step - 1) / 2.0  # sum of the falling weights strictly between two samples
    inner = F.when((F.col("__k") > 0) & (F.col("__k") < F.col("__m") - 1), F.lit(2 * half)).otherwise(F.lit(half))
    lead, off = tri(F.col("__offset")), F.col("__offset")
    first = F.when(F.col("__k") == 0, off + lead).when(F.col("__k") == 1, -lead).otherwise(F.lit(0.0))
    last = F.when(F.col("__k") == F.col("__m") - 1, tail + tri(tail)).when(F.col("__k") == F.col("__m") - 2, -tri(tail)).otherwise(F.lit(0.0))
    # with two samples both ends fall on the same pair; the terms add up
    weight = F.lit(1.0) + inner + first + last
    each = s.groupBy(*by, "__offset").agg((F.sum(F.col(value) * weight) * F.lit(dt)).alias("e"), F.first("__whole").alias("__whole"))
    out = each.groupBy(*by).agg(F.count("*").alias("offsets"), F.avg("e").alias("mean"), F.stddev_pop("e").alias("spread"), F.first("__whole").alias("__whole"))
    true = F.col("__whole") * F.lit(dt)
    return out.select(*by, "offsets", F.round(true, 6).alias("e_true"), F.round("mean", 6).alias("mean"), F.round("spread", 6).alias("spread"), F.round(F.col("spread") / true * 100, 6).alias("rel_pct"))


SPECTRUM = "freq double, power double"


def spectrum(series: DataFrame, by: list[str], dt: float, idx: str = "idx", value: str = "value") -> DataFrame:
    """Power of the real transform of each key's series (a band's whole series is one short array)."""
    import numpy as np

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values(idx)[value].to_numpy(dtype=float)
        out = pd.DataFrame({"freq": np.fft.rfftfreq(len(x), dt), "power": np.abs(np.fft.rfft(x)) ** 2})
        for c in by:
            out[c] = rows[c].iloc[0]
        return out[[*by, "freq", "power"]]

    keys = ", ".join(f"{c} {series.schema[c].dataType.simpleString()}" for c in by)
    return series.groupBy(*by).applyInPandas(run, f"{keys}, {SPECTRUM}")


def band_power(spec: DataFrame, by: list[str], split: float, top: float) -> DataFrame:
    """Alternating power up to ``top`` and its shares below and from ``split``."""
    ac = (F.col("freq") > 0) & (F.col("freq") <= top)
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("power"))), F.lit(0.0))
    out = spec.groupBy(*by).agg(total(ac).alias("ac"), total(ac & (F.col("freq") < split)).alias("low"), total(ac & (F.col("freq") >= split)).alias("high"))
    share = lambda c: F.round(F.when(F.col("ac") > 0, F.col(c) / F.col("ac")).otherwise(F.lit(0.0)), 6)
    return out.select(*by, F.round("ac", 3).alias("p_ac"), share("low").alias("low_share"), share("high").alias("high_share"))
