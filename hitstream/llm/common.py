"""Shared pieces: tables cut from their lineage, runs of sorted rows, connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch that generators below gather before they yield.
OUT_ROWS = 20_000
#: Rows of one batch of whole texts.
TEXT_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder of its own; on a cluster that is an error,
    since executors could not read each other's files there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(shared_dir, "own"):
        shared_dir.own = tempfile.mkdtemp(prefix="hitstream-")
        atexit.register(shutil.rmtree, shared_dir.own, ignore_errors=True)
    return f"file://{shared_dir.own}"


def stored(df: DataFrame, name: str, thin: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: later jobs survive lost executors.

    ``thin``: a table of keys and counts behind a shuffle, small beside the texts. Up to eight of its partitions share a file (one after
    the other in one task, so memory stays that of one partition), as long as all cores have several files to write.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if thin:
        df = df.coalesce(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    MADE.add(path)
    return back


#: Tables of ``stored`` that this driver has made and not deleted.
MADE: set[str] = set()


def _delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    MADE.discard(where)


def dropped(df: DataFrame) -> None:
    """Delete a table of ``stored`` that no later plan reads."""
    _delete(df.sparkSession, df.stored_at)


def sweep(spark: SparkSession) -> int:
    """Delete all tables of ``stored`` still there, once the results that read them have been written; returns how many."""
    left = list(MADE)
    for where in left:
        _delete(spark, where)
    return len(left)


def whole_texts(df: DataFrame) -> DataFrame:
    """``df`` for steps that hand whole texts to Python: batches are counted in rows, and rows are long, so they hold fewer of them."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    return df


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Null-free primitive columns as numpy arrays; binary and list columns as Arrow arrays."""
    out = {}
    for name, col in zip(batch.schema.names, batch.columns):
        flat = pa.types.is_integer(col.type) or pa.types.is_floating(col.type)
        out[name] = col.to_numpy(zero_copy_only=False) if flat else col
    return out


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small pieces: what a step makes of whole texts stays small beside the batch itself."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _cat(parts: list) -> np.ndarray | pa.Array:
    if len(parts) == 1:
        return parts[0]
    return np.concatenate(parts) if isinstance(parts[0], np.ndarray) else pa.concat_arrays(parts)


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[dict]:
    """Runs of equal ``keys`` in sorted batches, each as columns; holds one run at a time."""
    open_parts: list[dict] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = columns_of(batch)
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for k in keys:
            change |= cols[k][1:] != cols[k][:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts[:-1], cuts[1:]):
            key = tuple(cols[k][start].item() for k in keys)
            if open_parts and key != last:
                yield {c: _cat([p[c] for p in open_parts]) for c in open_parts[0]}
                open_parts = []
            open_parts.append({c: v[start:end] for c, v in cols.items()})
            last = key
    if open_parts:
        yield {c: _cat([p[c] for p in open_parts]) for c in open_parts[0]}


def matrix(col: pa.ListArray, dtype=np.float64) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(n, -1) if n else np.empty((0, 0), dtype)


class Forest:
    """Union-find over integer ids, the smaller id as the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        top = x
        while (above := self.up.get(top, top)) != top:
            top = above
        while (above := self.up.get(x, x)) != top:
            self.up[x], x = top, above
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (columns a, b: long); root is the component's smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each step is two keyed
    aggregations and two joins of pre-aggregated minima, the number of steps grows with the logarithm of
    the component sizes, and every step's edges are written to the shared folder. Loops and nulls are
    ignored; empty edges give an empty result.
    """
    now = stored(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and u > v").distinct(),
        "edges",
        thin=True,
    )
    sign = None
    while True:
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit(0xFFFFFFFF))).alias("h")).first()
        if not new.n or (new.n, new.h) == sign:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        sign, before = (new.n, new.h), now
        now = stored(_star(before), "edges", thin=True)
        dropped(before)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
