"""Fragments of registered events: completion, response latency, ring-buffer lookup, validity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def completion(begun: DataFrame, fragments: DataFrame) -> DataFrame:
    """Begun events (tag, expected: array of DUs) with attached and missing DUs, duplicate and unexpected fragments, and a state.

    Fragments are counted per (tag, du) before they meet their event, so an event that many fragments hit is one row per DU.
    """
    each = fragments.groupBy("tag", "du").agg(F.count("*").alias("n"))
    lists = each.groupBy("tag").agg(F.collect_list(F.struct("du", "n")).alias("got"))
    j = begun.join(lists, "tag", "left").withColumn("got", F.coalesce("got", F.array()))
    known = F.filter("got", lambda g: F.array_contains("expected", g["du"]))
    other = F.filter("got", lambda g: ~F.array_contains("expected", g["du"]))
    total = lambda rows: F.aggregate(rows, F.lit(0).cast("long"), lambda s, g: s + g["n"])
    j = j.withColumn("attached", F.array_sort(F.transform(known, lambda g: g["du"]))).withColumn("missing", F.array_except("expected", "attached"))
    state = F.when(F.size("missing") == 0, "complete").when(F.size("attached") > 0, "partial").otherwise("empty")
    return j.select("tag", "expected", "attached", (total(known) - F.size("attached")).alias("duplicates"), total(other).alias("unexpected"), "missing", state.alias("state"))


def missing_per_du(done: DataFrame) -> DataFrame:
    """How often each DU was missing, over incomplete events."""
    return done.where(F.size("missing") > 0).select(F.explode("missing").alias("du")).groupBy("du").agg(F.count("*").alias("missing"))


def latency(sent: DataFrame, got: DataFrame, slow: int) -> DataFrame:
    """Per DU and over all (du = -1): responses, requests still pending, sum, maximum and mean latency, slow ones."""
    j = sent.join(got, "tag", "left").withColumn("lat", F.col("got") - F.col("sent"))
    out = j.rollup("du").agg(
        F.count("lat").alias("responses"), F.count_if(F.col("lat").isNull()).alias("pending"), F.sum("lat").alias("latency_sum"), F.max("lat").alias("latency_max"), F.round(F.avg("lat"), 4).alias("latency_avg"), F.count_if(F.col("lat") > slow).alias("slow")
    )
    return out.withColumn("du", F.coalesce("du", F.lit(-1)))


def ring_lookup(asked: DataFrame, stored: DataFrame, by: list[str], t: str, order: str, capacity: int, slot: int) -> DataFrame:
    """Distinct requests (by, t) answered from a ring that holds the last capacity // slot rows of each key: FOUND or LOST.

    Only rows that a request names are ranked against the ring's edge: the edge is one row a key.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(t), F.desc(order)))
    ring = stored.withColumn("__rank", rank).where(F.col("__rank") <= capacity // slot).drop("__rank")
    j = asked.dropDuplicates([*by, t]).join(ring, [*by, t], "left")
    return j.withColumn("state", F.when(F.col(order).isNull(), "LOST").otherwise("FOUND"))


def validity(fragments: DataFrame, pending: DataFrame, known_dus: DataFrame, order: list[str]) -> DataFrame:
    """Each fragment (tag, du, size) with the reason it is refused, or ``ok``: invalid, no_pending, not_expected, duplicate.

    ``pending`` has tag and expected (array of DUs); ``known_dus`` has du.
    """
    f = fragments.join(known_dus.select("du", F.lit(True).alias("__known")).dropDuplicates(["du"]), "du", "left").join(pending.select("tag", "expected"), "tag", "left")
    bad = F.col("__known").isNull() | F.coalesce(F.col("size") <= 0, F.lit(True))
    first = F.when(bad, "invalid").when(F.col("expected").isNull(), "no_pending").when(~F.array_contains("expected", F.col("du")), "not_expected").otherwise("ok")
    f = f.withColumn("__first", first)
    nth = F.row_number().over(Window.partitionBy("tag", "du", "__first").orderBy(*order))
    label = F.when((F.col("__first") == "ok") & (nth > 1), "duplicate").otherwise(F.col("__first"))
    return f.withColumn("label", label).drop("__known", "__first", "expected")
