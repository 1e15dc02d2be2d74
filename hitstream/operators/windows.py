"""Coincidences of hits: time buckets, candidate flags, greedy windows.

Hits have columns du, t (integer clock ticks) and any others. A bucket is an event-time slice; windows never cross buckets, so
buckets are the unit of distribution and must be short (a second in production).
"""

from __future__ import annotations

from collections.abc import Generator, Iterator
from itertools import chain as chain_of
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hitstream.operators.filters import SCORE_SCALE, FilterConfig, TriggerFilter


def with_bucket(hits: DataFrame, cut: int, t: str = "t") -> DataFrame:
    """tm_id: integer division of the tick, 0 when there is no cut."""
    return hits.withColumn("tm_id", F.expr(f"{t} div {cut}").cast("long") if cut else F.lit(0).cast("long"))


def passthrough(hits: DataFrame) -> DataFrame:
    """One result a bucket: hit count, distinct DUs in order, first and last tick."""
    return hits.groupBy("tm_id").agg(
        F.count("*").alias("hit_count"),
        F.array_sort(F.collect_set("du")).alias("du_ids"),
        F.min("t").alias("first_t"),
        F.max("t").alias("last_t"),
    )


def candidate_flags(hits: DataFrame, window: int, nhit: int) -> DataFrame:
    """Each hit with the number of distinct DUs within ``window`` ticks from it, and whether that reaches ``nhit``.

    A hit is its DU's first one for the ticks behind the DU's hit before it, and within the window for those from t - window to t. So each hit counts
    for one interval of ticks, those of a DU don't overlap, and a running sum over the intervals' ends counts DUs: two ordered passes, however
    many hits a window holds.
    """
    before = F.lag("t").over(Window.partitionBy("tm_id", "du").orderBy("t"))
    names = hits.columns
    rows = hits.select(F.struct(*[hits[f"`{c}`"] for c in names]).alias("hit"), "tm_id", "t", F.greatest(F.col("t") - window, F.coalesce(before + 1, F.col("t") - window)).alias("start"))
    point = lambda at, step, hit: F.struct(at.alias("at"), F.lit(step).alias("step"), hit.alias("hit"))
    nobody = F.when(F.lit(False), F.col("hit"))
    ends = F.when(F.col("start") <= F.col("t"), F.array(point(F.col("start"), 1, nobody), point(F.col("t") + 1, -1, nobody))).otherwise(F.array().cast(rows.select(F.array(point(F.col("t"), 1, nobody))).schema[0].dataType))
    each = rows.select("tm_id", F.explode(F.concat(ends, F.array(point(F.col("t"), 0, F.col("hit"))))).alias("p"))
    # all ends at a tick count before the hits at it: the frame is a range of ticks
    upto = Window.partitionBy("tm_id").orderBy("p.at").rangeBetween(Window.unboundedPreceding, 0)
    out = each.withColumn("n_du", F.sum("p.step").over(upto).cast("int")).where("p.hit is not null")
    return out.select(*[F.col("p.hit").getField(c).alias(c) for c in names], "n_du", (F.col("n_du") >= nhit).alias("candidate"))


def greedy(t: np.ndarray, du: np.ndarray, window: int, nhit: int, settled: int | None = None) -> Generator[tuple[int, int], None, int]:
    """(first, end) of the greedy windows over hits in order of (t, du); returns the first hit not tried as an opening one.

    The earliest hit whose window holds ``nhit`` distinct DUs opens a window; the whole window is consumed. Where hits behind those given may follow,
    only the first ``settled`` ones are tried, those whose windows are here whole.
    """
    end = np.searchsorted(t, t + window, "right")
    counts: dict[int, int] = {}
    i = j = 0
    while i < (len(t) if settled is None else settled):
        while j < end[i]:
            counts[du[j]] = counts.get(du[j], 0) + 1
            j += 1
        if len(counts) >= nhit:
            yield i, j
            counts.clear()
            i = j
            continue
        left = counts[du[i]] - 1
        if left:
            counts[du[i]] = left
        else:
            del counts[du[i]]
        i += 1
    return i


WINDOWS = "tm_id long, window_start long, window_end long, hit_count long, du_count long, du_ids array<long>"


def coincidences(hits: DataFrame, window: int, nhit: int, first_only: bool = False) -> DataFrame:
    """Greedy coincidence windows of every bucket."""

    def run(bucket: pd.DataFrame) -> pd.DataFrame:
        bucket = bucket.sort_values(["t", "du"], kind="stable")
        t, du = bucket["t"].to_numpy(), bucket["du"].to_numpy()
        rows = []
        for i, j in greedy(t, du, window, nhit):
            ids = np.unique(du[i:j])
            rows.append((int(bucket["tm_id"].iloc[0]), int(t[i]), int(t[j - 1]), j - i, len(ids), ids.tolist()))
            if first_only:
                break
        return pd.DataFrame(rows, columns=[f.split()[0] for f in WINDOWS.split(", ")])

    return hits.select("tm_id", "t", "du").groupBy("tm_id").applyInPandas(run, WINDOWS)


#: Numbers that a batch of results holds before it goes out.
OUT_NUMBERS = 200_000
RESULTS = WINDOWS + ", triggered boolean, reject_reason string, selected_du_ids array<long>, selected_t array<long>, kept_count long, mean_score double"


def trigger(hits: DataFrame, distances: dict[tuple[int, int], float] | None, config: FilterConfig, array: str | None = None) -> DataFrame:
    """Greedy windows with the filter chain: causal subset, template score, duplicate history.

    Hits carry ``score`` besides du and t. The duplicate history depends on order, so it lives within a bucket
    (each starts from ``config.seed``); with ``array`` (a column naming an antenna array) it runs over that array's buckets in order.
    Hits come sorted, and a task holds those that a window may still take, never a bucket. Hits without time, bucket or DU belong to no window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for _, parts in groupby(_pieces(batches), lambda p: p[0]):
            chain = TriggerFilter(config, distances)
            for tm_id, bucket in groupby(parts, lambda p: p[1]):
                for t, du, score in _windows((p[2] for p in bucket), config):
                    kept, reason = chain.decide(du, t, score)
                    chosen = np.unique(du[kept])
                    if not reason and len(chosen) < config.nhit:
                        reason = "nhit_below_threshold"
                    ids, mean = np.unique(du), float(np.mean(score[kept])) / SCORE_SCALE if len(kept) else None
                    out.append((tm_id, int(t[0]), int(t[-1]), len(t), len(ids), ids, not reason, reason or None, chosen[:0] if reason else chosen, t[:0] if reason else t[kept], len(kept), None if mean is None or np.isnan(mean) else mean))
                    size += 20 + sum(len(out[-1][c]) for c in (5, 8, 9))
                    if size >= OUT_NUMBERS:
                        yield _results(out)
                        out, size = [], 0
        if out:
            yield _results(out)

    of = lambda c, kind="long": F.col(c).cast(kind)
    rows = hits.select(F.col(array or "tm_id").alias("key"), of("tm_id").alias("tm_id"), of("t").alias("t"), of("du").alias("du"), of("score", "double").alias("score")).where("tm_id is not null and t is not null and du is not null")
    return rows.repartition("key").sortWithinPartitions("key", "tm_id", "t", "du", "score").mapInArrow(run, RESULTS)


def _results(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}
    names, types = zip(*(f.split() for f in RESULTS.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(zip(*rows), types)], list(names))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, int, list[np.ndarray]]]:
    """(key, bucket, its hits' t, du and score) of sorted batches; a bucket that several batches hold comes in as many pieces."""
    for batch in batches:
        keys, (tm_id, *cols) = batch.column(0).to_pylist(), (c.to_numpy(zero_copy_only=False) for c in batch.columns[1:])
        at = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1] or tm_id[i] != tm_id[i - 1]]
        for start, end in zip(at, [*at[1:], len(keys)]):
            yield keys[start], int(tm_id[start]), [c[start:end] for c in cols]


def _windows(pieces: Iterator[list[np.ndarray]], config: FilterConfig) -> Iterator[list[np.ndarray]]:
    """The hits of a bucket's greedy windows. What waits is looked at again when it has doubled, so that the work stays linear."""
    held: list[list[np.ndarray]] = []
    waiting = fresh = 0
    for piece in chain_of(pieces, [None]):
        if piece is not None:
            held.append(piece)
            fresh += len(piece[0])
            if fresh <= waiting:
                continue
        t, du, score = (np.concatenate(c) for c in zip(*held))
        found = greedy(t, du, config.window, config.nhit, None if piece is None else int(np.searchsorted(t, t[-1] - config.window)))
        try:
            while True:
                i, j = next(found)
                yield [t[i:j], du[i:j], score[i:j]]
                if config.first_only:
                    return
        except StopIteration as end:
            i = end.value
        held, waiting, fresh = [[t[i:], du[i:], score[i:]]], len(t) - i, 0


def statistics(results: DataFrame, config: FilterConfig) -> DataFrame:
    """One row of counts, sums and maxima over the results of ``trigger``: windows, causal evaluations and bypasses, template means, rejections by reason."""
    passed = F.lit(False) if config.bypass is None else F.col("du_count") >= config.bypass
    causal, bypass = F.lit(config.causal) & ~passed, F.lit(config.causal) & passed
    matched = F.lit(config.template) & ~F.coalesce(F.col("reject_reason") == "causal_subset_too_small", F.lit(False))
    total = lambda on, c: F.coalesce(F.sum(F.when(on, F.col(c))), F.lit(0))
    most = lambda on, c: F.coalesce(F.max(F.when(on, F.col(c))), F.lit(0))
    rejected = lambda why: F.count_if(F.coalesce(F.col("reject_reason") == why, F.lit(False)))
    return results.agg(
        F.count("*").alias("windows"), F.count_if("triggered").alias("triggered"),
        F.count_if(causal).alias("causal_evaluated"), total(causal, "hit_count").alias("causal_input_sum"), most(causal, "hit_count").alias("causal_input_max"),
        total(causal, "kept_count").alias("causal_kept_sum"), most(causal, "kept_count").alias("causal_kept_max"), rejected("causal_subset_too_small").alias("causal_rejected"),
        F.count_if(bypass).alias("bypassed"), total(bypass, "hit_count").alias("bypass_input_sum"), most(bypass, "hit_count").alias("bypass_input_max"),
        total(bypass, "du_count").alias("bypass_du_sum"), most(bypass, "du_count").alias("bypass_du_max"),
        F.count_if(matched).alias("template_evaluated"), rejected("template_below_threshold").alias("template_rejected"), total(matched, "mean_score").alias("template_mean_sum"), most(matched, "mean_score").alias("template_mean_max"),
        rejected("duplicate").alias("duplicate_rejected"), rejected("nhit_below_threshold").alias("nhit_rejected"),
    )
