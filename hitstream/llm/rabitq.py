"""Embedding near-duplicates by randomised-rotation binary codes.

Exact copies collapse to one class first. Every distinct vector is rotated at random and each component is coded in ``LEVEL_BITS`` binary digits, the
first of which is its sign; the inner product of code and vector is stored as a correction factor. The product of two codes over their factors
estimates a cosine without bias, as the codes' errors point anywhere; its spread is known. Only pairs whose confidence bound reaches the threshold
are computed exactly, in double precision, and only those at or above it link.

Vectors meet in cells of equal signs, some signs in each of several tables, so that a pair at
the threshold shares a cell with probability ``RECALL`` and closer pairs with more; the number of signs follows the number of
vectors and keeps cells small, so work stays in proportion to the input. Larger cells (dense groups) are compared as pairs of blocks. Codes alone
go to the cells; vectors follow only for those that have a partner there. Pairs are counted where they are found and never emitted: a cell gives link
counts and a spanning forest.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and rows without an id, link with nothing
and keep themselves; vectors of different dimensions do not link; a repeated row is another vector; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitstream.llm.common import Forest, connected_components, matrix, runs, stored
from hitstream.llm.vectors import rotation, usable

COSINE = 0.9
#: Probability that a pair exactly at the threshold shares a cell.
RECALL = 0.999
#: Vectors that a cell holds on average.
CELL = 512
#: Vectors of one block; larger cells become pairs of blocks.
BLOCK = 2048
#: Spreads of the estimate that the confidence bound allows for.
SPREADS = 5.0
#: Binary digits of a component.
LEVEL_BITS = 4
SEED = 7


def tables(count: int, cosine: float = COSINE, recall: float = RECALL, cell: int = CELL) -> tuple[int, int]:
    """(bits a table, tables): a sign differs with probability angle / pi."""
    bits = max(1, min(30, round(math.log2(max(2, count) / cell)) if count > cell else 1))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def signs(x: np.ndarray, number: int) -> np.ndarray:
    """Signs of vectors under the rotation of that number."""
    return x @ rotation(x.shape[1], SEED + number) > 0


def codes(x: np.ndarray, number: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(levels, correction factors, relative variances) of unit vectors; level l stands for l - 7.5 times the vector's own step."""
    dim, half = x.shape[1], 1 << LEVEL_BITS >> 1
    turned = x @ rotation(dim, SEED + number)
    step = np.maximum(np.abs(turned).max(axis=1, keepdims=True), 1e-300) / half
    levels = np.clip(np.floor(turned / step) + half, 0, 2 * half - 1).astype(np.uint8)
    values = levels - (half - 0.5)
    factor = (values * turned).sum(axis=1)
    return levels, factor, np.maximum(0, (values**2).sum(axis=1) / factor**2 - 1) / max(1, dim - 1)


def packed(levels: np.ndarray) -> list[bytes]:
    """Two levels a byte."""
    even = np.hstack([levels, np.zeros((len(levels), levels.shape[1] % 2), np.uint8)])
    return [r.tobytes() for r in even[:, ::2] | even[:, 1::2] << 4]


def unpacked(col: list[bytes], dim: int) -> np.ndarray:
    both = np.frombuffer(b"".join(col), np.uint8).reshape(len(col), -1)
    return np.stack([both & 15, both >> 4], axis=2).reshape(len(col), -1)[:, :dim]


def maybe(levels: np.ndarray, factor: np.ndarray, variance: np.ndarray, cosine: float, spreads: float = SPREADS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j whose confidence bound reaches ``cosine``, a stripe of rows at a time."""
    values = ((levels - ((1 << LEVEL_BITS) - 1) / 2) / factor[:, None]).astype(np.float32)
    for at in range(0, len(values), 512):
        estimate = values[at : at + 512] @ values[at:].T
        bound = cosine - spreads * np.sqrt(variance[at : at + 512, None] + variance[None, at:]) - 1e-5
        i, j = np.nonzero(estimate >= bound)
        yield i[j > i] + at, j[j > i] + at


def keys(x: np.ndarray, bits: int, count: int) -> np.ndarray:
    """Cell keys (rows by tables) from the signs of as many rotations as are needed."""
    dim = x.shape[1]
    need = bits * count
    found = np.hstack([signs(x, r) for r in range(-(-need // dim))])[:, :need]
    return found.reshape(len(x), count, bits) @ (1 << np.arange(bits, dtype=np.int64))


def units(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _rows(bits: int, count: int):
    """Classes -> one row per table: the cell, the code and its figures."""
    names = [f.split()[0] for f in ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            dims = np.diff(v.offsets.to_numpy())
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                for part in np.array_split(rows, max(1, len(rows) * count // 20_000)):
                    if not len(part):
                        continue
                    take = pa.array(part)
                    x = units(matrix(v.take(take)))
                    levels, factor, variance = codes(x)
                    many = pa.array(np.repeat(np.arange(len(part)), count))
                    each = [pa.array(packed(levels), pa.binary()), pa.array(factor, pa.float32()), pa.array(variance, pa.float32())]
                    slot, cell = np.tile(np.arange(count, dtype=np.int32), len(part)), keys(x, bits, count).reshape(-1)
                    cols = [pa.array(np.full(len(many), dim, np.int32)), pa.array(slot), pa.array(cell), batch.column("id").take(take).take(many), *(c.take(many) for c in each)]
                    yield pa.RecordBatch.from_arrays(cols, names)

    return run


ROWS = "dim int, slot int, cell long, id long, code binary, factor float, variance float"
PLACE = ["dim", "slot", "cell", "i", "j"]


def _partnered(cosine: float):
    """Runs of one cell (or pair of blocks) -> the places of vectors that may have a partner there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in runs(batches, PLACE):
            n, own = len(g["id"]), g["own"]
            if n < 2:
                continue
            cross, some = int(g["i"][0]) != int(g["j"][0]), np.zeros(n, dtype=bool)
            for a, b in maybe(unpacked(g["code"].to_pylist(), int(g["dim"][0])), g["factor"].astype(np.float64), g["variance"].astype(np.float64), cosine):
                if cross:
                    a, b = a[own[a] != own[b]], b[own[a] != own[b]]
                some[a] = some[b] = True
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(g[c][some]) for c in (*PLACE, "own", "id")], [*PLACE, "own", "id"])

    return run


def near(x: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of unit vectors whose cosine is at least ``cosine``; codes rule out the others."""
    for i, j in maybe(*codes(x), cosine):
        for part in range(0, len(i), 65_536):  # exact, in double precision
            a, b = i[part : part + 65_536], j[part : part + 65_536]
            ok = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
            yield a[ok], b[ok]


def _compare(cosine: float, bits: int, count: int):
    """Runs of one cell (or pair of blocks) -> (a, b, null) forest edges and (a, null, links) counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Forest()
        for g in runs(batches, PLACE):
            ids, copies, own = g["id"], g["copies"], g["own"]
            if len(ids) < 2:
                continue
            slot, cross = int(g["slot"][0]), int(g["i"][0]) != int(g["j"][0])
            x = units(matrix(g["v"]))
            key = keys(x, bits, count)[:, :slot]
            links = np.zeros(len(ids), dtype=np.int64)
            edges = []
            for a, b in near(x, cosine):
                if cross:
                    a, b = a[own[a] != own[b]], b[own[a] != own[b]]
                if slot and len(a):  # counted in the first table in which the two meet
                    new = ~(key[a] == key[b]).any(axis=1)
                    a, b = a[new], b[new]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                edges += [e for e in zip(ids[a].tolist(), ids[b].tolist()) if known.join(*e)]
            some = np.flatnonzero(links)
            if len(some):
                ea, eb = (list(c) for c in zip(*edges)) if edges else ([], [])
                n = len(ea)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ea + ids[some].tolist(), pa.int64()), pa.array(eb + [None] * len(some), pa.int64()), pa.array([None] * n + links[some].tolist(), pa.int64())],
                    ["a", "b", "n"],
                )
            if len(known.up) > 500_000:
                known = Forest()

    return run


def near_duplicates(df: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", vector: str = "embedding", cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(usable(vector) & F.col(vec_id).isNotNull(), F.col(vector).cast("array<double>")).alias("v"))
    # two hashes stand for a vector: neither copies nor links meet on vectors
    rows = rows.withColumns({"h": F.when(F.col("v").isNotNull(), F.xxhash64("v")), "k": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(SEED), "v"))})
    classes = rows.where("v is not null").groupBy("h", "k").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v"))
    # numbered once, when the table is written: ids may repeat with different vectors
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "vectors", thin=True)
    bits, count = tables(classes.count(), cosine, cell=cell)
    each = classes.select("id", "v").mapInArrow(_rows(bits, count), ROWS)
    size = each.groupBy("dim", "slot", "cell").agg(F.count("*").alias("size")).where(F.col("size") > block)
    size = size.select("dim", "slot", "cell", F.ceil(F.col("size") / block).cast("int").alias("parts"))
    each = each.join(size, ["dim", "slot", "cell"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    each = each.withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    each = each.select("dim", "slot", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "code", "factor", "variance")
    some = each.repartition(*PLACE).sortWithinPartitions(*PLACE, "id").mapInArrow(_partnered(cosine), "dim int, slot int, cell long, i int, j int, own int, id long")
    some = stored(some, "partnered", thin=True).join(classes.select("id", "copies", "v"), "id").select(*PLACE, "own", "id", "copies", "v")
    found = stored(some.repartition(*PLACE).sortWithinPartitions(*PLACE, "id").mapInArrow(_compare(cosine, bits, count), "a long, b long, n long"), "links", thin=True)
    counts = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "id")
    named = classes.drop("v").join(counts, "id", "left").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    named = named.select("h", "k", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "h", "k").join(named, ["h", "k"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
