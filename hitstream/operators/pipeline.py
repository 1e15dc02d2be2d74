"""The offline cascade as one DataFrame pipeline: background mixing, filters, first-level triggers, coincidence.

Simulated traces meet the background recorded nearest in time on the same front end (as-of join), channel traces are filtered and
triggered in Arrow batches, and an event's surviving hits go through the window and filter chain. Events are independent of each other and are
the unit of distribution from the second step on; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitstream.functions import kernels
from hitstream.operators import asof, electronics, lookups, windows
from hitstream.operators.filters import FilterConfig


@dataclass
class Cascade:
    """Parameters of the cascade; thresholds come with the traces."""

    t_quiet: int
    t_period: int
    t_sepmax: int
    nc_min: int
    nc_max: int
    score_min: float
    min_flt1_dus: int
    trigger: FilterConfig
    notch: bool = True
    taps: tuple[float, ...] = ()
    peak: int = 32
    window: int = 30
    factor: int = 1


def mixed(sim: DataFrame, du_map: DataFrame, md: DataFrame, calibration: DataFrame | None = None) -> DataFrame:
    """Traces (event, du, t_ns, feb_id, channel, trace): simulated plus background nearest to the event's time.

    ``sim``: event, du, t_ns, scan_ns, x, y, z. ``md``: feb_id, t_ns, entry, x, y, z. ``calibration``: feb_id, channel, freq, gain. A DU without
    front end or background has zeros. X and Y are calibrated, Z is raw.
    """
    located = sim.join(lookups.small(lookups.dual_indexed(du_map, "du")), "du", "left")
    targets = located.where("feb_id is not null").select("feb_id", F.col("scan_ns").alias("t_ns")).distinct()
    near = asof.nearest(targets, md.select("feb_id", "t_ns", "entry"), "feb_id", "t_ns", "entry")
    near = near.select("feb_id", F.col("t_ns").alias("scan_ns"), F.col("match_id").alias("entry"))
    back = md.select("feb_id", "entry", *[F.col(c).alias(f"md_{c}") for c in "xyz"])
    rows = located.join(near, ["feb_id", "scan_ns"], "left").join(back, ["feb_id", "entry"], "left")
    channel = lambda c: F.struct(F.lit(c).alias("channel"), F.col(c).alias("sim"), F.col(f"md_{c}").alias("md"))
    each = rows.select("event", "du", "t_ns", "feb_id", F.explode(F.array(*[channel(c) for c in "xyz"])).alias("k")).select("event", "du", "t_ns", "feb_id", "k.*")
    if calibration is not None:
        each = each.join(lookups.small(calibration), ["feb_id", "channel"], "left")
    else:
        each = each.withColumn("freq", F.lit(None).cast("array<double>")).withColumn("gain", F.lit(None).cast("array<double>"))
    return each


def fitted_trace(before: Column, after: Column, length: Column) -> Column:
    """A background trace of the simulation's length: the nearest one, or the two nearest in order if each is half as long; else an error. Null stays null."""
    n = F.size(before)
    half = (n == F.floor(length / 2)) & after.isNotNull()
    wrong = F.raise_error(F.format_string("a background trace of %s samples does not fit %s", n.cast("string"), length.cast("string")))
    return F.when(before.isNull(), F.lit(None)).when(n == length, before).when(half, F.concat(before, after)).otherwise(wrong.cast("array<double>"))


CHANNEL = "event long, du long, t_ns long, channel string, flt0 boolean, t1 int, score int"


def channels(mixed_traces: DataFrame, thresholds: DataFrame, templates: dict[str, list[np.ndarray]], p: Cascade) -> DataFrame:
    """Per event, DU and channel X, Y: first-level trigger, its sample, and the template score (null where there is none)."""
    rows = mixed_traces.where("channel <> 'z'").join(lookups.small(thresholds), ["feb_id", "channel"], "left")
    rows = rows.select("event", "du", "t_ns", "channel", "sim", "md", "freq", "gain", "th1", "th2")

    def filtered(b: pd.DataFrame, at: np.ndarray) -> np.ndarray:
        """Mixed and filtered traces of rows of one length, as a matrix."""
        sim = np.array(b["sim"].iloc[at].tolist(), dtype=np.float64)
        gains: dict[bytes, list[int]] = {}
        for k, (freq, gain) in enumerate(zip(b["freq"].iloc[at], b["gain"].iloc[at])):
            if freq is not None:
                gains.setdefault(np.asarray([freq, gain]).tobytes(), []).append(k)
        for key, own in gains.items():  # a front end's traces together
            freq, gain = np.frombuffer(key).reshape(2, -1)
            sim[own] = kernels.calibrate(sim[own], freq, gain)
        x = np.array(b["md"].iloc[at].tolist(), dtype=np.float64) + sim
        x = kernels.notch(x) if p.notch else x
        return kernels.fir(x, np.array(p.taps)) if p.taps else x

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            flt0, t1, score = np.zeros(len(b), bool), [None] * len(b), [None] * len(b)
            live = np.flatnonzero(b["md"].notna() & b["th1"].notna())
            size = np.array([len(b["sim"].iloc[k]) for k in live], dtype=int)
            for n in np.unique(size):
                at = live[size == n]
                x = filtered(b, at)
                whole = kernels.as_int16(x)
                for k, trace, fitted in zip(at.tolist(), x, whole):
                    found = kernels.flt0(trace, kernels.Flt0(b["th1"].iloc[k], b["th2"].iloc[k], p.t_quiet, p.t_period, p.t_sepmax, p.nc_min, p.nc_max))
                    if found:
                        flt0[k], t1[k] = True, found[0][0]
                        fit = kernels.template_fit(fitted, t1[k], templates[b["channel"].iloc[k]], p.peak, p.window, p.factor)
                        score[k] = kernels.flt1_score(fit[3]) if fit else None
            out = b[["event", "du", "t_ns", "channel"]].assign(flt0=flt0, t1=pd.array(t1, "Int32"), score=pd.array(score, "Int32"))
            yield out

    return rows.mapInPandas(run, CHANNEL)


def events(channel_rows: DataFrame, p: Cascade, distances: dict[tuple[int, int], float] | None) -> DataFrame:
    """One row an event that has channels: n_flt0, n_flt1, triggered, reject_reason, selected DUs. The second level sees events with enough DUs."""
    rows = channel_rows.withColumn("passed", F.coalesce(F.col("score") / 65_535 > p.score_min, F.lit(False)))
    counts = electronics.survivors(rows)
    best = rows.where("passed").groupBy("event", "du", "t_ns").agg(F.max("score").alias("score"))
    hits = best.join(electronics.preselected(counts, p.min_flt1_dus).select("event"), "event", "left_semi")
    hits = hits.select(F.col("event").alias("tm_id"), "du", F.col("t_ns").alias("t"), F.col("score").cast("long").alias("score"))
    first = windows.trigger(hits, distances, p.trigger)
    one = first.groupBy("tm_id").agg(F.min_by(F.struct("triggered", "reject_reason", "selected_du_ids"), F.struct(~F.col("triggered"), F.col("window_start"))).alias("r"))
    out = counts.join(one, counts.event == one.tm_id, "left")
    return out.select("event", "n_flt0", "n_flt1", F.coalesce("r.triggered", F.lit(False)).alias("triggered"), "r.reject_reason", "r.selected_du_ids")


def process(sim: DataFrame, du_map: DataFrame, md: DataFrame, thresholds: DataFrame, templates: dict[str, list[np.ndarray]], p: Cascade, distances: dict[tuple[int, int], float] | None = None, calibration: DataFrame | None = None) -> DataFrame:
    return events(channels(mixed(sim, du_map, md, calibration), thresholds, templates, p), p, distances)
