"""The driver tables in the roles of the engine's inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a timestamp, whatever the session's time zone is for one without zone."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        whole = F.unix_date(F.to_date(c)) * F.lit(86_400).cast("long") + F.hour(c) * 3600 + F.minute(c) * 60
        return whole * 1_000_000 + (F.date_part(F.lit("SECONDS"), c) * 1_000_000).cast("long")
    return F.unix_micros(c)


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits from ``events``: event_id, t (microseconds), du, kind, value, cents (exact), props."""
    events = read(spark, sf_dir, "events")
    return events.select(
        "event_id",
        micros(events, "ts").alias("t"),
        F.col("user_id").alias("du"),
        F.col("event_type").alias("kind"),
        "value",
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        "props",
    )


#: The same view in DuckDB.
HITS = "SELECT event_id, epoch_us(ts) AS t, user_id AS du, event_type AS kind, value, round(value * 100)::BIGINT AS cents, props FROM events"

SECOND = 1_000_000
HOUR = 3600 * SECOND
DAY = 86_400 * SECOND
