"""Counters and health series: deltas, rates, buckets, rankings, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bucket(t: str, width: int) -> Column:
    """Start of the bucket of a tick."""
    return F.expr(f"({t} div {width}) * {width}").cast("long")


def sample_stats(df: DataFrame, t: str, value: str, width: int) -> DataFrame:
    """samples, total, low, high and mean (6 digits) of an exact integer value per time bucket."""
    return df.groupBy(bucket(t, width).alias("start")).agg(
        F.count("*").alias("samples"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"), F.round(F.avg(value), 6).alias("mean")
    )


def two_level(df: DataFrame, t: str, value: str, fine: int, coarse: int) -> DataFrame:
    """Both granularities from one pass over the rows: each row counts for its fine and its coarse bucket."""
    levels = F.array(
        F.struct(F.lit("fine").alias("level"), bucket(t, fine).alias("start")), F.struct(F.lit("coarse").alias("level"), bucket(t, coarse).alias("start"))
    )
    return (
        df.select(value, F.explode(levels).alias("k"))
        .groupBy("k.level", "k.start")
        .agg(F.count("*").alias("samples"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))
    )


def with_delta(df: DataFrame, by: list[str], order: list[str], counter: str) -> DataFrame:
    """Difference to the sample before (null for the first of a run): the baseline resets with the keys ``by``."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("delta", F.col(counter) - F.lag(counter).over(w))


def clamped_delta_buckets(df: DataFrame, by: list[str], order: list[str], counter: str, t: str, width: int) -> DataFrame:
    """Losses: a counter that falls back counts as 0. The baseline of a bucket is the sample before it, in or out of range."""
    each = with_delta(df, by, order, counter).where("delta is not null")
    return each.groupBy(bucket(t, width).alias("start")).agg(F.sum(F.greatest(F.lit(0), "delta")).alias("delta"), F.count("*").alias("pairs"))


def midpoint_rates(df: DataFrame, by: list[str], order: list[str], counter: str, t: str, width: int, max_gap: int, max_rate: float, ticks: int) -> DataFrame:
    """Rate per bucket: sum of counter steps over sum of elapsed time, each pair in the bucket of its midpoint.

    Pairs whose counter falls or whose gap is not in (0, max_gap] are dropped; pairs above ``max_rate`` a second are counted as skipped.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    each = df.withColumn("dc", F.col(counter) - F.lag(counter).over(w)).withColumn("dt", F.col(t) - F.lag(t).over(w))
    each = each.where((F.col("dc") >= 0) & (F.col("dt") > 0) & (F.col("dt") <= max_gap))
    fast = F.col("dc") * ticks > F.col("dt") * F.lit(max_rate)
    each = each.withColumn("mid", F.expr(f"{t} - dt div 2")).withColumn("fast", fast)
    ok = lambda c: F.sum(F.when(~F.col("fast"), F.col(c)))
    out = each.groupBy(bucket("mid", width).alias("start")).agg(
        F.coalesce(ok("dc"), F.lit(0)).alias("steps"), F.coalesce(ok("dt"), F.lit(0)).alias("elapsed"), F.count_if(~F.col("fast")).alias("pairs"), F.count_if("fast").alias("skipped")
    )
    return out.withColumn("rate", F.round(F.try_divide(F.col("steps") * ticks, F.col("elapsed")), 6))


def run_totals(df: DataFrame, run: str, order: Column, counter: str) -> DataFrame:
    """Last minus first counter of each run, not clamped."""
    return df.groupBy(run).agg((F.max_by(counter, order) - F.min_by(counter, order)).alias("total"), F.count("*").alias("samples"))


def rolling_geometric_mean(series: DataFrame, t: str, value: str, half: int) -> DataFrame:
    """Centred geometric mean of the positive values within ``half`` ticks; null if none is positive.

    ``series`` is a bucketed series: one row a bucket, so one ordered pass over it is small.
    """
    w = Window.orderBy(t).rangeBetween(-half, half)
    logs = F.when(F.col(value) > 0, F.log10(F.col(value).cast("double")))
    return series.withColumn("geo", F.pow(F.lit(10.0), F.avg(logs).over(w)))


def gap_markers(series: DataFrame, by: list[str], t: str, value: str, threshold: int) -> DataFrame:
    """The series with an empty row ``threshold`` after the last sample before each longer gap."""
    w = Window.partitionBy(*by).orderBy(t)
    before = F.lag(t).over(w)
    real = F.struct(F.col(t).alias("t"), F.col(value).alias("value"), F.lit(False).alias("gap"))
    mark = F.struct((F.col("before") + threshold).alias("t"), F.lit(None).cast(series.schema[value].dataType).alias("value"), F.lit(True).alias("gap"))
    rows = F.when(F.col(t) - F.col("before") > threshold, F.array(mark, real)).otherwise(F.array(real))
    return series.withColumn("before", before).select(*by, F.explode(rows).alias("r")).select(*by, "r.t", "r.value", "r.gap")


def upper_median(df: DataFrame, value: str) -> DataFrame:
    """One row: the element at position n // 2 of the ascending values, found by counts and not by collecting them.

    Values are counted first; the running count then passes over distinct values only.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("upto", upto).crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).where(F.expr("upto > all div 2")).agg(F.min("v").alias("median"))


def clean_restart_edges(rows: DataFrame, least_samples: int) -> DataFrame:
    """Buckets with enough samples whose mean is near the series' upper median; a low minimum is lifted to floor(mean) - 4.

    Columns samples, mean, low. Near: at least the larger of median - 8 and 0.78 median.
    """
    floor = upper_median(rows, "mean").select(F.greatest(F.col("median") - 8.0, F.col("median") * 0.78).alias("least"))
    kept = rows.crossJoin(F.broadcast(floor)).where((F.col("samples") >= least_samples) & (F.col("mean") >= F.col("least"))).drop("least")
    lifted = F.when(F.col("low") < F.col("mean") * 0.6, F.greatest(F.col("low").cast("double"), F.floor("mean").cast("double") - 4)).otherwise(F.col("low").cast("double"))
    return kept.withColumn("low_clean", lifted)


def top_per_bucket(counts: DataFrame, by: list[str], item: str, count: str, n: int = 10) -> DataFrame:
    """The n largest of each bucket: by count descending, then item."""
    w = Window.partitionBy(*by).orderBy(F.desc(count), item)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def shares(totals: DataFrame, item: str, count: str, n: int = 10) -> DataFrame:
    """Share in percent (2 digits) by rank, the n largest by name and the rest as one row 'other'.

    Only the n largest are ordered; the rest is one sum.
    """
    whole = totals.agg(F.sum(count).alias("whole"))
    top = totals.orderBy(F.desc(count), item).limit(n)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(count), item)))
    named = top.select(F.col(item).cast("string").alias("label"), F.col(count).alias("count"), F.lit(1).cast("long").alias("items"))
    rest = totals.join(F.broadcast(top.select(item)), item, "left_anti").agg(F.sum(count).alias("count"), F.count("*").alias("items")).where("items > 0")
    both = named.unionByName(rest.select(F.lit("other").alias("label"), "count", "items"))
    return both.crossJoin(F.broadcast(whole)).select("label", "count", "items", F.round(F.col("count") * 100.0 / F.col("whole"), 2).alias("share_pct"))


def concentration(totals: DataFrame, item: str, count: str) -> DataFrame:
    """One row: affected items, the largest's share and the three largest's (the largest's alone when there are fewer than three)."""
    top = totals.orderBy(F.desc(count), item).limit(3).agg(
        F.max(count).alias("first"), F.sum(count).alias("three"), F.count("*").alias("n")
    )
    whole = totals.agg(F.count("*").alias("affected"), F.sum(count).alias("whole"))
    share = lambda c: F.round(F.col(c) * 100.0 / F.col("whole"), 2)
    return whole.crossJoin(F.broadcast(top)).select(
        "affected", share("first").alias("top_share_pct"), F.when(F.col("n") >= 3, share("three")).otherwise(share("first")).alias("top3_share_pct")
    )


def merge_priority(first: DataFrame, second: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Rows of ``first``; keys that only ``second`` has are added. ``origin`` says which."""
    a = first.select(key, *[F.col(v).alias(f"a_{v}") for v in values], F.lit(True).alias("has_a"))
    b = second.select(key, *[F.col(v).alias(f"b_{v}") for v in values])
    pick = [F.when(F.col("has_a"), F.col(f"a_{v}")).otherwise(F.col(f"b_{v}")).alias(v) for v in values]
    return a.join(b, key, "full").select(key, *pick, F.when(F.col("has_a"), F.lit("first")).otherwise(F.lit("second")).alias("origin"))


def fill_from_log(buckets: DataFrame, log: DataFrame, key: str = "start") -> DataFrame:
    """Fallback buckets (missing, timeouts) from a log: added where there are none, filled in where nothing is missing."""
    joined = buckets.select(key, "expected", "missing", "timeouts", F.lit(True).alias("here")).join(
        log.select(key, F.col("missing").alias("log_missing"), F.col("timeouts").alias("log_timeouts")), key, "full"
    )
    take = F.col("log_missing").isNotNull() & (F.col("here").isNull() | (F.coalesce("missing", F.lit(0)) <= 0))
    out = joined.select(
        key,
        F.coalesce("expected", F.lit(0)).alias("expected"),
        F.when(take, F.col("log_missing")).otherwise(F.coalesce("missing", F.lit(0))).alias("missing"),
        F.when(take, F.greatest(F.coalesce("timeouts", F.lit(0)), "log_timeouts")).otherwise(F.coalesce("timeouts", F.lit(0))).alias("timeouts"),
        take.alias("from_log"),
    )
    return out.withColumn("loss", F.when(F.col("expected") > 0, F.col("missing") / F.col("expected")).otherwise(F.lit(0.0)))


def recent_events(events: DataFrame, key: list[str], seq: str, score: str, limit: int, keep: list[str]) -> DataFrame:
    """The ``limit`` most recently touched keys, each with its best detail (highest score; of equals the last)."""
    best = events.groupBy(*key).agg(F.max_by(F.struct(*keep), F.struct(score, seq)).alias("row"), F.max(seq).alias("last"))
    return best.orderBy(F.desc("last")).limit(limit).select(*key, "row.*", "last")


def violations(df: DataFrame, by: list[str], order: list[str], t: str) -> DataFrame:
    """Per key: samples earlier than the one before, the largest step back, and samples behind the latest time seen."""
    w = Window.partitionBy(*by).orderBy(*order)
    each = df.withColumn("back", F.lag(t).over(w) - F.col(t)).withColumn("latest", F.max(t).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return each.groupBy(*by).agg(
        F.count("*").alias("samples"), F.count_if(F.col("back") > 0).alias("violations"), F.coalesce(F.max(F.when(F.col("back") > 0, F.col("back"))), F.lit(0)).alias("max_back"), F.count_if(F.col(t) < F.col("latest")).alias("regressed")
    )


def focus_range(buckets: DataFrame, start: str, missing: str, width: int) -> DataFrame:
    """One row: the range of buckets with losses, one bucket wider on both sides."""
    lossy = buckets.where(F.col(missing) > 0)
    return lossy.agg(F.min(start).alias("a"), F.max(start).alias("b")).where("a is not null").select(F.greatest(F.lit(0), F.col("a") - width).alias("from"), (F.col("b") + width).alias("to"))


def best_run(runs: DataFrame, start: int, end: int) -> DataFrame:
    """One row: the run (columns run, first_t, last_t) that overlaps the interval most; of equals the first."""
    overlap = F.least(F.col("last_t"), F.lit(end)) - F.greatest(F.col("first_t"), F.lit(start))
    return runs.withColumn("overlap", overlap).where("overlap > 0").orderBy(F.desc("overlap"), "run").limit(1)


def in_range(df: DataFrame, t: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Samples from ``start`` to ``end``, both included; an end that is None is open."""
    if start is not None:
        df = df.where(F.col(t) >= start)
    return df if end is None else df.where(F.col(t) <= end)


def first_of_time(df: DataFrame, by: list[str], t: str, order: list[str]) -> DataFrame:
    """Of samples with exactly the same time the first in file order."""
    w = Window.partitionBy(*by, t).orderBy(*order)
    return df.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def range_deltas(df: DataFrame, by: list[str], t: str, counters: list[str], width: int, start: int | None = None, end: int | None = None) -> DataFrame:
    """Counter steps per bucket of a time range, falls counted as 0: the sample before the range is the baseline of its first step."""
    w = Window.partitionBy(*by).orderBy(t)
    each = in_range(df, t, None, end)
    for c in counters:
        each = each.withColumn(f"__{c}", F.greatest(F.lit(0), F.col(c) - F.lag(c).over(w)))
    each = in_range(each.withColumn("__nth", F.row_number().over(w)).where("__nth > 1"), t, start)
    return each.groupBy(*by, bucket(t, width).alias("start")).agg(*[F.sum(f"__{c}").alias(c) for c in counters], F.count("*").alias("pairs"))


def overlapping_days(files: DataFrame, day: str, start: int, end: int, slack_days: int = 0, offset_hours: int = 0) -> DataFrame:
    """Files whose day (yyyyMMdd) lies within a range of milliseconds, local days at a fixed offset; files without a day stay."""
    local = lambda ms: F.date_add(F.lit("1970-01-01").cast("date"), F.lit((ms + offset_hours * 3_600_000) // 86_400_000).cast("int"))
    own = F.to_date(F.try_to_timestamp(day, F.lit("yyyyMMdd")))
    inside = (own >= F.date_sub(local(start), slack_days)) & (own <= F.date_add(local(end), slack_days))
    return files.where(F.coalesce(inside, F.lit(True)))


def retained(buckets: DataFrame, start: str, keep: int) -> DataFrame:
    """Buckets that begin within ``keep`` ticks before the latest one."""
    return buckets.crossJoin(F.broadcast(buckets.agg(F.max(start).alias("__last")))).where(F.col(start) >= F.col("__last") - keep).drop("__last")


def loss_distribution(buckets: DataFrame, start: str, missing: str, expected: str) -> DataFrame:
    """One row: windows, those without a loss, and the one with the greatest loss (of equals the first), with its share of all that was expected in percent."""
    worst = F.max_by(F.struct(F.col(start).alias("start"), F.col(missing).alias("missing")), F.struct(F.col(missing), -F.col(start)))
    out = buckets.agg(F.count("*").alias("windows"), F.count_if(F.col(missing) == 0).alias("clean"), worst.alias("worst"), F.sum(expected).alias("expected"))
    pct = F.when(F.col("expected") > 0, F.col("worst.missing") / F.col("expected") * 100).otherwise(F.lit(0.0))
    return out.where("windows > 0").select("windows", "clean", F.col("worst.start").alias("worst_start"), F.col("worst.missing").alias("worst_missing"), pct.alias("worst_pct"))


def contributions(buckets: DataFrame, missing: str, expected: str) -> DataFrame:
    """Buckets with the share of all expected fragments that each of them lost, in percent."""
    whole = F.broadcast(buckets.agg(F.sum(expected).alias("__all")))
    pct = F.when(F.col("__all") > 0, F.col(missing) / F.col("__all") * 100).otherwise(F.lit(0.0))
    return buckets.crossJoin(whole).withColumn("contribution_pct", pct).drop("__all")
