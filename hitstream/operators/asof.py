"""As-of joins: the rows of a keyed series nearest in time to each target.

Both sides meet in ordered passes per key: a union in which targets take the last series row seen, going forward for the rows
at or before them and going back for the rows after them. The cost is two sorts by (key, time); no row meets more than a few others. Keys
(an antenna, an array) are the unit of distribution. Ties go to the earlier row, then to the smaller ``order``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _sides(targets: DataFrame, series: DataFrame, key: str, t: str, order: str, n: int) -> DataFrame:
    """Targets with ``before`` and ``after``: rows (t, id) of the n nearest times at or before them, and after them.

    Of rows at one time only the n smallest ids can be among the n nearest.
    """
    same = Window.partitionBy(key, t).orderBy(order)
    few = series.select(key, t, order).withColumn("__n", F.row_number().over(same)).where(F.col("__n") <= n)
    times = few.groupBy(key, t).agg(F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col(order).alias("id")))).alias("rows"))
    along = Window.partitionBy(key).orderBy(t)
    none = F.array()
    back, ahead = (F.concat(F.col("rows"), *[F.coalesce(f("rows", i).over(along), none) for i in range(1, n)]) for f in (F.lag, F.lead))
    whole = F.struct(*targets.columns).alias("__target")
    left = targets.select(F.col(key), F.col(t).alias("__t"), whole, F.lit(None).cast(times.schema["rows"].dataType).alias("back"), F.lit(1).alias("__side")).withColumn("ahead", F.col("back"))
    right = times.select(key, F.col(t).alias("__t"), F.lit(None).cast(left.schema["__target"].dataType).alias("__target"), back.alias("back"), F.lit(0).alias("__side"), ahead.alias("ahead"))
    upto = Window.partitionBy(key).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    beyond = Window.partitionBy(key).orderBy(F.desc("__t"), F.desc("__side")).rowsBetween(Window.unboundedPreceding, 0)
    seen = left.unionByName(right).withColumn("before", F.last("back", True).over(upto)).withColumn("after", F.last("ahead", True).over(beyond))
    return seen.where("__side = 1").select("__target.*", F.coalesce("before", none).alias("before"), F.coalesce("after", none).alias("after"))


def _ranked(targets: DataFrame, series: DataFrame, key: str, t: str, order: str, n: int) -> DataFrame:
    """Targets with ``near``: up to n rows (gap, t, id), nearest first."""
    both = _sides(targets, series, key, t, order, n)
    gap = lambda x: F.struct(F.abs(x["t"] - F.col(t)).alias("gap"), x["t"].alias("t"), x["id"].alias("id"))
    return both.withColumn("near", F.slice(F.array_sort(F.transform(F.concat("before", "after"), gap)), 1, n)).drop("before", "after")


def nearest(targets: DataFrame, series: DataFrame, key: str, t: str, order: str) -> DataFrame:
    """Each target with match_t and match_id of the nearest row of its key; null without any."""
    near = _ranked(targets, series, key, t, order, 1)
    return near.select(*targets.columns, F.get("near", F.lit(0))["t"].alias("match_t"), F.get("near", F.lit(0))["id"].alias("match_id"))


def nearest_two(targets: DataFrame, series: DataFrame, key: str, t: str, order: str) -> DataFrame:
    """Targets of keys with two rows or more: the two nearest, in time order, as t1, id1, t2, id2."""
    near = _ranked(targets, series, key, t, order, 2).where(F.size("near") == 2)
    timed = F.array_sort(F.transform("near", lambda x: F.struct(x["t"].alias("t"), x["id"].alias("id"))))
    return near.withColumn("near", timed).select(*targets.columns, *[F.col("near")[i][f].alias(f"{f}{i + 1}") for i in (0, 1) for f in ("t", "id")])


def last_n(targets: DataFrame, log: DataFrame, key: str, t: str, order: str, n: int) -> DataFrame:
    """Each target with the n log rows of its key at or before it (hist_t, hist_id, age = 1 for the latest), and a status.

    Status: ``ok``, ``too_few`` (fewer than n rows before it) or ``after_end`` (the target lies beyond the log); only ``ok`` targets have
    rows, others one row without.
    """
    along = Window.partitionBy(key).orderBy(t, order)
    row = F.struct(F.col(t).alias("t"), F.col(order).alias("id"))
    lists = log.select(key, t, order, row.alias("row"))
    lists = lists.select(key, F.col(t).alias("__t"), F.col(order).alias("__o"), F.array_compact(F.array(*[F.lag("row", i).over(along) for i in range(n)])).alias("hist"), F.lit(0).alias("__side"))
    ends = log.groupBy(key).agg(F.max(t).alias("__end")).withColumnRenamed(key, "__key")
    whole = F.struct(*targets.columns).alias("__target")
    left = targets.select(key, F.col(t).alias("__t"), F.lit(None).cast(lists.schema["__o"].dataType).alias("__o"), F.lit(None).cast(lists.schema["hist"].dataType).alias("hist"), F.lit(1).alias("__side"), whole)
    both = left.unionByName(lists.withColumn("__target", F.lit(None).cast(left.schema["__target"].dataType)))
    upto = Window.partitionBy(key).orderBy("__t", "__side", "__o").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("hist", F.last("hist", True).over(upto)).where("__side = 1")
    seen = seen.join(ends, F.col(key).eqNullSafe(F.col("__key")), "left")
    status = F.when(F.col("__end").isNull() | (F.col("__t") > F.col("__end")), "after_end").when(F.coalesce(F.size("hist"), F.lit(0)) < n, "too_few").otherwise("ok")
    out = seen.withColumn("status", status).withColumn("hist", F.when(F.col("status") == "ok", F.col("hist")))
    out = out.select("__target.*", "status", F.posexplode_outer("hist").alias("p", "h"))
    return out.select(*targets.columns, "status", F.col("h.t").alias("hist_t"), F.col("h.id").alias("hist_id"), (F.col("p") + 1).alias("age"))
