"""Nearest neighbours by inner product through collision counting.

Vectors are lifted so that the largest inner product is the smallest distance (divided by the longest length, a last
component fills them up to length one; queries get a zero there). A block of vectors is indexed by single projections onto the axes
of some random rotations, each a sorted array. Around a query's projection a window opens in every array and widens by virtual rehashing
(radius after radius, to the next of the array's marks); a vector met in enough windows at a radius is verified by its exact inner product. A
query is done in a block when as many verified vectors as it wants lie within the radius; at the last radius all that is left is verified.

What a window holds is a set of bits, the difference of two sets kept for the marks of its array, so collisions are counted 64 vectors at a time in
counters that lie bit by bit across words. How many windows make a candidate follows from the rotations: a vector at the radius is one with
probability ``CERTAIN``. The radii are fitted to distances of a bounded sample of the block to all of it, and grow from there.

Blocks and groups of queries have bounded sizes, so every task is bounded, every vector is indexed and every query meets every block; rows are copied once
for each full group of the other side only. Each block gives its best few; a window over those picks the result.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, as queries neither; nor do rows without an id;
vectors of another dimension than the query's are no candidates; a query's own id is no candidate, however often
it occurs; of several vectors of one query id the smallest (component by component) asks; ties go to the smaller id; a repeated row is a candidate as often as
it occurs; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hitstream.llm.common import matrix
from hitstream.llm.vectors import length_of, rotation, usable

K = 20
#: Rotations, each of which gives as many projections as lifted vectors have components.
ROTATIONS = 6
#: Half the width of a window at radius 1.
HALF_WIDTH = 1.4
#: Probability with which a vector at the radius is met in enough windows; nearer ones are with more, and a search goes on beyond the last one wanted.
CERTAIN = 0.4
#: Ranks of a sorted array at which a window may begin or end, as a share of the array.
MARKS = 64
#: Vectors of a block whose distances to all of it give the first radii; later ones grow by GROWTH up to 2, the greatest distance there is.
FITTED = 256
QUANTILES = (0.1, 0.5, 0.9, 1.0)
GROWTH = 1.15
#: Vectors of a block and queries of a group at most; small tables are cut into a block for each core, but not below LEAST vectors.
BLOCK = 65_536
GROUP = 65_536
LEAST = 4096
#: Queries whose windows are counted together.
TOGETHER = 32
SEED = 6

RESULT = "query_id long, vec_id long, score double, verified long"


@cache
def axes(dim: int) -> np.ndarray:
    """Axes of the rotations, as long as Gaussian directions are on average."""
    return np.hstack([rotation(dim, SEED + r) for r in range(ROTATIONS)]) * np.sqrt(dim)


@cache
def threshold(dim: int) -> int:
    """Windows that a vector at the radius is met in with probability ``CERTAIN``: from random directions, as the rotations are random."""
    u = np.random.default_rng([SEED, dim]).standard_normal((4000, dim))
    met = (np.abs(u / np.linalg.norm(u, axis=1, keepdims=True) @ axes(dim)) <= HALF_WIDTH).sum(axis=1)
    return int(np.quantile(met, 1 - CERTAIN, method="lower"))


def at_least(sets: Iterable[np.ndarray], count: int) -> np.ndarray:
    """Bits that are set in ``count`` and more of the sets: full adders bring three words of one weight to one, and one of the next."""
    planes: list[list[np.ndarray]] = []

    def add(word: np.ndarray, i: int) -> None:
        while True:
            if len(planes) == i:
                planes.append([])
            planes[i].append(word)
            if len(planes[i]) < 3:
                return
            a, b, c = planes[i]
            x = a ^ b
            planes[i], word, i = [x ^ c], (a & b) | (x & c), i + 1

    for s in sets:
        add(s, 0)
    i = 0
    while i < len(planes):  # two words of one weight are left at most
        if len(planes[i]) == 2:
            a, b = planes[i]
            planes[i] = [a ^ b]
            add(a & b, i + 1)
        i += 1
    full = ~np.uint64(0)
    more, same = np.zeros_like(planes[0][0]), np.full_like(planes[0][0], full)
    if count >> len(planes):
        return more
    for i in reversed(range(len(planes))):
        bit = planes[i][0] if planes[i] else np.uint64(0)
        if count >> i & 1:
            same = same & bit
        else:
            more |= same & bit
            same = same & ~bit
    return more | same


class Index:
    """Sorted projections of one block of lifted vectors, with the sets of vectors below each mark."""

    def __init__(self, lifted: np.ndarray, k: int) -> None:
        n, dim = lifted.shape
        self.size, self.need = n, threshold(dim)
        at = (lifted @ axes(dim)).T
        order = np.argsort(at, axis=1)
        self.sorted = np.take_along_axis(at, order, axis=1)
        self.marks = np.unique(np.linspace(0, n, min(n, MARKS) + 1).astype(np.int64))
        words = -(-n // 64)
        self.below = np.zeros((len(at), len(self.marks), words), np.uint64)
        rank = np.empty(n, np.int64)
        for j, row in enumerate(order):
            rank[row] = np.arange(n)
            for i, mark in enumerate(self.marks):
                bits = np.packbits(rank < mark, bitorder="little")
                self.below[j, i].view(np.uint8)[: len(bits)] = bits
        some = lifted[:: max(1, n // FITTED)][:FITTED].copy()
        some[:, -1] = 0  # as queries
        some /= np.maximum(np.linalg.norm(some, axis=1, keepdims=True), 1e-300)
        far = np.sqrt(np.maximum(0, 2 - 2 * np.partition(some @ lifted.T, max(0, n - 1 - k), axis=1)[:, max(0, n - 1 - k)]))
        radii = sorted({round(float(r) + 1e-6, 3) for r in np.quantile(far, QUANTILES)})
        while radii[-1] < 2:
            radii.append(min(2.0, radii[-1] * GROWTH + 1e-3))
        self.radii = radii

    def met(self, at: np.ndarray, radius: float) -> np.ndarray:
        """For queries with projections ``at``, the set of vectors in enough windows of that radius (bits in words)."""

        def windows():
            for row, below, x in zip(self.sorted, self.below, at.T):
                low = np.searchsorted(self.marks, row.searchsorted(x - HALF_WIDTH * radius), "right") - 1
                high = np.searchsorted(self.marks, row.searchsorted(x + HALF_WIDTH * radius, "right"), "left")
                yield below[low] ^ below[high]

        return at_least(windows(), self.need)


def search(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, longest: float) -> tuple[np.ndarray, ...]:
    """(query id, vec id, score, vectors verified for the query, on its first row) of the k best found in a block for each query."""
    scaled = x / longest
    lifted = np.hstack([scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1)))[:, None]])
    index = Index(lifted, k)
    norm = np.linalg.norm(queries, axis=1)
    places = np.hstack([queries / norm[:, None], np.zeros((len(queries), 1))]) @ axes(lifted.shape[1])
    out = []
    for start in range(0, len(queries), TOGETHER):
        left = np.arange(start, min(len(queries), start + TOGETHER))
        done = np.zeros((len(left), index.below.shape[2]), np.uint64)
        found: dict[int, list] = {q: [] for q in left.tolist()}
        for radius in index.radii:
            now = index.met(places[left], radius) if radius < 2 else np.full_like(done, ~np.uint64(0))
            new = np.unpackbits((now & ~done).view(np.uint8), axis=1, count=index.size, bitorder="little")
            done |= now
            who, which = np.nonzero(new)
            own = ids[which] != query_ids[left[who]]
            who, which = who[own], which[own]
            # one way of adding for all: equal vectors tie exactly
            score = np.concatenate([(x[which[s : s + 65_536]] * queries[left[who[s : s + 65_536]]]).sum(axis=1) for s in range(0, max(1, len(who)), 65_536)])
            cut = np.searchsorted(who, np.arange(len(left) + 1))
            # distance of lifted vectors, squared: 2 - 2 cos, with cos = inner product / (longest * |query|)
            least = (1 - radius * radius / 2) * longest * norm[left]
            more = []
            for i, q in enumerate(left.tolist()):
                found[q].append((which[cut[i] : cut[i + 1]], score[cut[i] : cut[i + 1]]))
                more.append(sum(int((s >= least[i]).sum()) for _, s in found[q]) < k)
            keep = np.flatnonzero(more)
            left, done = left[keep], done[keep]
            if not len(left):
                break
        for q, parts in found.items():
            which, score = (np.concatenate(c) for c in zip(*parts))
            best = np.lexsort((ids[which], -score))[:k]
            out.append((np.full(len(best), query_ids[q]), ids[which[best]], score[best], np.where(np.arange(len(best)) == 0, len(which), 0)))
    return tuple(np.concatenate(c) for c in zip(*out))


def _search(k: int, longest: float):
    """One block of vectors against one group of queries."""

    def run(table: pa.Table) -> pa.Table:
        v = table.column("v").combine_chunks()
        dims, ids = np.diff(v.offsets.to_numpy()), table.column("vec_id").to_numpy()
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        out = []
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            data, query = rows[~asks[rows]], rows[asks[rows]]
            if len(data) and len(query):
                out.append(search(matrix(v.take(pa.array(data))), ids[data], matrix(v.take(pa.array(query))), ids[query], k, longest))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)]
        return pa.table(dict(zip(("query_id", "vec_id", "score", "verified"), cols)))

    return run


def nearest(df: DataFrame, queries: Column, k: int = K, vec_id: str = "vec_id", vector: str = "embedding", verified: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest found to every row where ``queries`` holds; with how many were verified if asked for."""
    rows = df.where(usable(vector) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")
    )
    known = rows.agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("q"), F.max(length_of("v")).alias("longest")).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    blocks, groups = max(1, -(-known.n // BLOCK), min(cores, known.n // LEAST)), max(1, -(-(known.q or 0) // GROUP))
    deal = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")  # repeated rows don't fill one block
    data = rows.select("vec_id", "v", F.lit(False).alias("asks"), block.alias("block"), every(groups).alias("part"))
    asked = rows.where("asks").groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = asked.select("vec_id", "v", F.lit(True).alias("asks"), every(blocks).alias("block"), deal(groups, 2).alias("part"))
    found = data.unionByName(asked).groupBy("block", "part").applyInArrow(_search(k, float(known.longest or 1.0)), RESULT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = found.withColumn("rank", F.row_number().over(best))
    if verified:
        out = out.withColumn("verified", F.sum("verified").over(Window.partitionBy("query_id")))
    return out.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", *(["verified"] if verified else []))
