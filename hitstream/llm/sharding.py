"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Every record, an id with its text, hashes into one of thousands of slots that never change. Bytes are summed per slot, and a small
table (version, slot, shard) says which shard holds which slot. Rebalancing and growing write a new
version of that table that moves as few slots as needed; no record is hashed anew. An edited text is another record, so that the texts
of one id, however many there are, spread over slots.

Defined cases: a null text has size ``overhead``; rows with null ids hash by their text; exact repeats of a
record share a slot; an empty table gives an empty result over a map whose slots all weigh nothing; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hitstream.llm.common import stored

#: Virtual slots: fixed for the life of a corpus, some hundreds for each shard ever planned.
SLOTS = 8192
#: Bytes that a record takes besides its text.
OVERHEAD = 8
#: Parts that a slot's rows are dealt into to be numbered.
DEALS = 8
MAP_SCHEMA = "version int, slot int, shard int"


def slotted(docs: DataFrame, slots: int = SLOTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 (0 for a null text) and virtual_slot; the text goes no further than the scan."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    thin = docs.select(F.col(key).alias("doc_id"), (F.octet_length(body) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    return thin.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def slot_bytes(records: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """Bytes per slot; partial sums meet on the slot, and ``slots`` rows at most reach the driver."""
    total = np.zeros(slots, dtype=np.int64)
    for r in records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).collect():
        total[r.virtual_slot] = r.bytes
    return total


def first_map(slots: int, shards: int) -> np.ndarray:
    """Version 0: slots dealt in turn."""
    return np.arange(slots, dtype=np.int64) % shards


def rebalanced(owner: np.ndarray, weight: np.ndarray, shards: int) -> np.ndarray:
    """An edited map: slots move from the heaviest to the lightest shard while that brings the two closer.

    Each move takes the slot nearest to half the difference, so few slots move and the loop ends when
    no single slot is smaller than the difference. New shards (``shards`` above the map's) start empty.
    """
    owner = owner.copy()
    load = np.bincount(owner, weights=weight, minlength=shards).astype(np.int64)
    held = {s: set(np.flatnonzero((owner == s) & (weight > 0)).tolist()) for s in range(shards)}
    while shards > 1:
        low = int(load.argmin())
        for high in np.argsort(-load, kind="stable").tolist():
            gap = int(load[high] - load[low])
            fits = [s for s in held[high] if weight[s] < gap]
            if gap and fits:
                break
        else:
            break
        slot = min(fits, key=lambda s: (abs(2 * int(weight[s]) - gap), s))
        held[high].remove(slot)
        held[low].add(slot)
        load[high] -= weight[slot]
        load[low] += weight[slot]
        owner[slot] = low
    return owner


def packed_map(weight: np.ndarray, shards: int) -> np.ndarray:
    """A map from nothing: heaviest slot first, each to the lightest shard."""
    owner, heap = np.zeros(len(weight), dtype=np.int64), [(0, s) for s in range(shards)]
    for slot in np.argsort(-weight, kind="stable").tolist():
        load, shard = heapq.heappop(heap)
        owner[slot] = shard
        heapq.heappush(heap, (load + int(weight[slot]), shard))
    return owner


def map_table(spark: SparkSession, versions: list[np.ndarray]) -> DataFrame:
    """The stored form: one row per version and slot. Its size is set by SLOTS, not by the data."""
    rows = [(v, slot, int(shard)) for v, owner in enumerate(versions) for slot, shard in enumerate(owner)]
    return spark.createDataFrame(rows, MAP_SCHEMA)


def assign(records: DataFrame, slot_map: DataFrame, version: int) -> DataFrame:
    """Shard of every record under one map version, and its place there, gapless from 0.

    Places come from counts per virtual slot and deal (prefix sums over a table of ``DEALS`` rows a slot) plus a row number within
    the deal, so no task sorts a whole shard, nor a slot that repeats of one record fill.
    """
    current = slot_map.where(F.col("version") == version).select(F.col("slot").alias("virtual_slot"), "shard")
    counts = records.groupBy("virtual_slot", "deal").agg(F.count("*").alias("n")).join(F.broadcast(current), "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot", "deal").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("virtual_slot", "deal", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("virtual_slot", "deal").orderBy("doc_id", "size", "text_crc32"))
    numbered = records.withColumn("place", place)
    return (
        numbered.join(F.broadcast(base), ["virtual_slot", "deal"])  # base: SLOTS times DEALS rows at most
        .withColumn("slot", (F.col("base") + F.col("place") - 1).cast("long"))
        .withColumn("map_version", F.lit(version))
        .select("doc_id", "size", "text_crc32", "shard", "slot", "virtual_slot", "map_version")
    )


def shard_documents(docs: DataFrame, shards: int, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(records with shards, the map with its versions): version 0 deals slots in turn, 1 balances bytes."""
    spark = docs.sparkSession
    # the texts are read once, and each row's deal is settled when the table is written
    records = stored(slotted(docs, slots).withColumn("deal", F.pmod(F.monotonically_increasing_id(), F.lit(DEALS)).cast("int")), "records")
    weight = slot_bytes(records, slots)
    start = first_map(slots, shards)
    table = map_table(spark, [start, rebalanced(start, weight, shards)])
    return assign(records, table, 1), table
