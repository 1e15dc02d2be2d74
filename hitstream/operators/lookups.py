"""Side-table lookups, masking, grids, missing results and keyed comparisons."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows up to which a side table is sent to every executor; beyond it the join shuffles.
SMALL_ROWS = 100_000


#: And its size as text.
SMALL_BYTES = 64 << 20


def small(df: DataFrame, rows: int = SMALL_ROWS, size: int = SMALL_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it has at most so many rows and bytes (looked at up to that many rows), else as it is."""
    seen = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("size")).first()
    return F.broadcast(df) if seen.n <= rows and seen.size <= size else df


def dual_indexed(mapping: DataFrame, key: str, base: int = 65_000) -> DataFrame:
    """A map that answers to the short id and to ``base`` + id."""
    both = F.array(F.col(key), F.col(key) + base)
    return mapping.withColumn(key, F.explode(both)).dropDuplicates([key])


def masked_lookup(rows: DataFrame, mapping: DataFrame, side: DataFrame, key: str, mid: str, values: dict[str, object]) -> DataFrame:
    """Left joins rows -> mapping (key to mid) -> side (mid to values); what finds nothing gets the mask's value, and ``found`` says so."""
    out = rows.join(small(mapping), key, "left").join(small(side.withColumn("__hit", F.lit(True))), mid, "left")
    masks = {c: F.coalesce(F.col(c), F.lit(v).cast(side.schema[c].dataType)) for c, v in values.items()}
    return out.withColumns(masks).withColumn("found", F.coalesce("__hit", F.lit(False))).drop("__hit")


def grid_size(start: float, end: float, step: float) -> int:
    if step <= 0:
        raise ValueError("the step must be positive")
    if end <= start:
        raise ValueError("the end must lie after the start")
    return math.ceil((end - start) / step)


def time_grid(spark: SparkSession, start: float, end: float, step: float) -> DataFrame:
    """idx and t = start + idx * step over the half-open interval."""
    return spark.range(grid_size(start, end, step)).select(F.col("id").alias("idx"), (F.lit(start) + F.col("id") * F.lit(step)).alias("t"))


def on_grid(rows: DataFrame, start: float, end: float, step: float) -> DataFrame:
    """Each row at each grid time: the scan's plan. The grid is generated in place, row by row, and not joined."""
    n = grid_size(start, end, step)
    return rows.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("t", F.lit(float(start)) + F.col("idx") * F.lit(float(step)))


def missing(manifest: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Manifest rows without a result."""
    return manifest.join(results.select(key).distinct(), key, "left_anti")


def compare(new: DataFrame, old: DataFrame, key: str, value: str) -> DataFrame:
    """Both sides by key: equal, mismatch, only_new or only_old; nulls are equal to nulls."""
    a = new.select(key, F.col(value).alias("new_value"), F.lit(True).alias("__a"))
    b = old.select(key, F.col(value).alias("old_value"), F.lit(True).alias("__b"))
    state = F.when(F.col("__b").isNull(), "only_new").when(F.col("__a").isNull(), "only_old").when(F.col("new_value").eqNullSafe(F.col("old_value")), "equal").otherwise("mismatch")
    return a.join(b, key, "full").select(key, "new_value", "old_value", state.alias("state"))


def compare_by_position(new: DataFrame, old: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Both sides by their position within each group."""
    place = lambda df, name: df.select(*by, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).alias("pos"), F.col(value).alias(name), F.lit(True).alias(f"__{name}"))
    j = place(new, "new_value").join(place(old, "old_value"), [*by, "pos"], "full")
    state = F.when(F.col("__old_value").isNull(), "only_new").when(F.col("__new_value").isNull(), "only_old").when(F.col("new_value").eqNullSafe(F.col("old_value")), "equal").otherwise("mismatch")
    return j.select(*by, "pos", "new_value", "old_value", state.alias("state"))


def chunk(rows: DataFrame, order: str, job: int, size: int) -> DataFrame:
    """Rows [job * size, (job + 1) * size) of a dense 0-based ``order`` column."""
    return rows.where((F.col(order) >= job * size) & (F.col(order) < (job + 1) * size))
