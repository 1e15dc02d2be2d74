"""Front-end arithmetic: trigger patterns, event times, register values, batches per second, event routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Trigger patterns, clock-tick mask, the 10-second pattern, GPS leap seconds to UTC.
PATTERN_X, PATTERN_Y, PATTERN_BOTH, PATTERN_TEN_SECONDS = 512, 1024, 1536, 32
TICK_MASK = 0x7FFFFFFF
LEAP = 18


def trigger_pattern(x: Column, y: Column) -> Column:
    """Pattern of the channels that passed; null if none did."""
    return F.when(x & y, PATTERN_BOTH).when(x, PATTERN_X).when(y, PATTERN_Y)


def outcome(flt0: Column, score: Column, least: float, scale: int = 65_535) -> Column:
    """Label of a channel: FLT0 (no first-level trigger), FLT_SUPPRESSED (no score), FLT1 (score too low), PASS."""
    return F.when(~F.coalesce(flt0, F.lit(False)), "FLT0").when(score.isNull(), "FLT_SUPPRESSED").when(score / scale > least, "PASS").otherwise("FLT1")


def survivors(channels: DataFrame) -> DataFrame:
    """Per event: DUs with a first-level trigger on any channel, and DUs with any channel passed (columns event, du, flt0, passed)."""
    du = channels.groupBy("event", "du").agg(F.bool_or("flt0").alias("flt0"), F.bool_or("passed").alias("passed"))
    return du.groupBy("event").agg(F.count_if("flt0").alias("n_flt0"), F.count_if("passed").alias("n_flt1"))


def preselected(counts: DataFrame, least: int) -> DataFrame:
    return counts.where(F.col("n_flt1") >= least)


def event_time(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column, ctd: Column, ctp: Column, leap: int = LEAP) -> Column:
    """Nanoseconds since 1970 from GPS fields: whole seconds less the leap seconds, fraction = ticks since the pulse over ticks a pulse, truncated."""
    days = F.unix_date(F.make_date(year, month, day)).cast("long")
    seconds = days * 86_400 + hour * 3600 + minute * 60 + second - leap
    per = ctp.bitwiseAND(F.lit(TICK_MASK))
    fraction = F.when(per > 0, F.floor(ctd.cast("double") / per * 1e9)).otherwise(F.lit(0)).cast("long")
    return seconds.cast("long") * 1_000_000_000 + fraction


#: Register transforms by name: what a readable value becomes on the wire.
REGISTERS = {
    "rate": lambda v: F.when(v == 0, F.lit(15)).otherwise(F.shiftleft(v, 8).bitwiseOR(F.lit(143))),
    "half": lambda v: F.floor(v / 2),
    "tenth": lambda v: F.floor(v / 10),
    "from_one": lambda v: v - 1,
    "inverted": lambda v: F.when(v == 0, 1).otherwise(0),
    "block": lambda v: F.when((v < 0) | (v > 16_384), F.lit(10_880)).otherwise(v),
    # whole volts: counts times 2.5 V over the divider 18 / (18 + 91) and 4096 counts, lifted by 0.05 and cut to a tenth, then to a whole
    "battery": lambda v: F.floor(F.floor((F.floor(v * F.lit(2.5 * (18 + 91) / (18 * 4096))) + 0.05) * 10) / 10),
    # gain in dB from -14 to 23.5 over 2.5 V at 4096 counts
    "gain": lambda v: F.floor(F.lit(4096.0) * (v + 14) / F.lit(37.5 * 2.5) + 0.5),
}
#: Registers whose value must lie within bounds.
REGISTER_BOUNDS = {"from_one": (1, 8), "gain": (-14.0, 23.5)}


def register(name: str, value: Column) -> Column:
    """A readable value as it is written; one beyond its bounds is an error."""
    out = REGISTERS[name](value)
    if name not in REGISTER_BOUNDS:
        return out
    low, high = REGISTER_BOUNDS[name]
    wrong = F.raise_error(F.format_string(f"%s is not within {low} and {high} of register {name}", value.cast("string")))
    return F.when((value >= low) & (value <= high), out).otherwise(wrong.cast("double" if name == "gain" else "long"))


def packed(fields: DataFrame) -> DataFrame:
    """Bit fields (base, start, nbits, value) as one word per base; a value that does not fit its bits is an error."""
    fits = (F.col("value") >= 0) & (F.col("value") < F.expr("shiftleft(1L, nbits)"))
    bits = F.expr("shiftleft(cast(value as bigint), start)")
    checked = F.when(fits, bits).otherwise(F.raise_error(F.format_string("value %s does not fit %s bits", "value", "nbits")))
    return fields.groupBy("base").agg(F.bit_or(checked.cast("long")).alias("word"))


def second_batches(hits: DataFrame, t: str = "t_ns") -> DataFrame:
    """T2 batches: the hits of a DU in each second, in order of time, repeated times once."""
    return hits.groupBy("du", F.expr(f"{t} div 1000000000").alias("second")).agg(F.array_sort(F.collect_set(t)).alias("times"))


def trigger_frequency(hits: DataFrame, t: str = "t_ns") -> DataFrame:
    return hits.groupBy("du", F.expr(f"{t} div 1000000000").alias("second")).agg(F.count("*").alias("hz"))


def routed(events: DataFrame, least_score: int) -> DataFrame:
    """Events with ``route``: 10-second events are raw, others pass if their score reaches the cut, the rest is dropped."""
    raw = F.col("pattern") == PATTERN_TEN_SECONDS
    return events.withColumn("route", F.when(raw, "raw").when(F.col("score") >= least_score, "t2").otherwise("dropped"))


def active_dus(activity: DataFrame, now: int, within: int) -> DataFrame:
    """One row: DUs whose last activity is recent."""
    return activity.groupBy("du").agg(F.max("t").alias("last")).agg(F.count_if(F.col("last") > now - within).alias("active_du_count"))


def regressed(hits: DataFrame, by: list[str], order: list[str], tm_id: str = "tm_id") -> DataFrame:
    """Hits without those of a bucket behind one already seen."""
    seen = F.max(tm_id).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return hits.withColumn("__seen", seen).where(F.col("__seen").isNull() | (F.col(tm_id) >= F.col("__seen"))).drop("__seen")


def saturating_add(a: Column, b: Column) -> Column:
    """Sum of two whole numbers, at most the largest long; a summand that may be no long itself is a decimal of up to 37 digits."""
    top, total = (1 << 63) - 1, a.cast("decimal(37,0)") + b.cast("decimal(37,0)")
    return F.when(total > F.lit(top).cast("decimal(38,0)"), F.lit(top)).otherwise(total.cast("long"))
