"""SimHash near-duplicates through pivot distance tables.

Each text has a 64-bit fingerprint: bit by bit the majority over the XXH64 hashes of its word shingles. For
every distinct fingerprint the Hamming distances to a set of fixed reference fingerprints (pivots) are
computed once and travel with it. Fingerprints meet in cells of equal blocks of bits (with at most ``bits``
differing bits some choice of blocks agrees, so no link is lost); within a cell, pairs whose pivot distances
differ by more than ``bits`` in any coordinate are discarded, and survivors are verified.

``near_duplicates`` links fingerprints alone. ``representatives`` keeps one document of each group of texts whose five-word shingles have
a Jaccard similarity of 0.8 or more. Two such texts differ in 10 of 64 bits on average and in up to some 20, a radius at which neither cells of
equal bits nor pivot distances tell anything apart. So besides the links within ``bits``, texts there meet in cells of equal minima
(five of the sketch's ``HASHES`` least hashes, in ``BANDS`` tables; a pair at 0.8 shares a cell with probability 0.9999), fingerprints beyond ``radius`` are
discarded, and the similarity of survivors is estimated from their whole sketches, with a standard error of 0.018 at 0.8. Pairs that
reach ``similarity`` less one standard error link: at 0.8 five pairs in six, at 0.82 and more practically all, at 0.75 one in thirty.

Defined cases: a null text is empty; texts without words have fingerprint 0 and link with each other like
any others; a component is named by its smallest non-null doc_id; repeated rows each get their row; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitstream.llm.common import Forest, connected_components, runs, stored, unused, whole_texts

BITS = 4
SHINGLE = 4
#: Of ``representatives``: words of a shingle, and the similarity from which texts are near-duplicates.
WORDS = 5
SIMILAR = 0.8
#: Hash functions of a sketch, a byte each; bands of ROWS of them are cells.
HASHES = 512
BANDS = 24
ROWS = 5
SEED = 42
PIVOTS = 24
#: Fingerprints of one block; larger cells are compared as pairs of blocks, so no task holds a whole cell.
BLOCK = 4096
#: Fingerprints that an average cell may hold before the cells are keyed by more bits.
CELL = 256


def _pivots(n: int) -> np.ndarray:
    return np.random.default_rng(20).integers(0, 2**64, n, dtype=np.uint64)


def fingerprint(data: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Of UTF-8 bytes: ASCII lower case, words between ASCII white space, majority bits over shingle hashes."""
    from xxhash import xxh64_intdigest

    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    ends = ends[shingle - 1 :] or ends[-1:]
    counts, n = np.zeros(64, dtype=np.int64), len(ends)
    for at in range(0, n, 65536):  # bounded memory for texts of any length
        part = [xxh64_intdigest(joined[s : e - 1], seed) for s, e in zip(starts[at : at + 65536], ends[at : at + 65536])]
        h = np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(h, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def shingle_hashes(data: bytes, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of the different shingles of UTF-8 bytes, sorted; words as in ``fingerprint``."""
    from xxhash import xxh64_intdigest

    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    ends = ends[shingle - 1 :] or ends[-1:]
    return np.unique(np.fromiter((xxh64_intdigest(joined[s : e - 1], seed) for s, e in zip(starts, ends)), np.uint64, len(ends)))


def sketch(hashes: np.ndarray) -> tuple[int, bytes]:
    """(fingerprint of a set of shingles, the last byte of the least value of each hash function); zeros of an empty set."""
    if not len(hashes):
        return 0, bytes(HASHES)
    counts = np.zeros(64, dtype=np.int64)
    odd = (np.random.default_rng(21).integers(0, 2**32, HASHES, dtype=np.uint32) | 1)[:, None]
    move = np.random.default_rng(22).integers(0, 2**32, HASHES, dtype=np.uint32)[:, None]
    # 32 bits a shingle are enough to order it; the least value is mixed once more, so that each of its bytes tells as much
    small = ((hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 2**32 - 1, np.uint32)
    for at in range(0, len(hashes), 2048):
        counts += np.unpackbits(hashes[at : at + 2048].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        x = small[None, at : at + 2048] * odd + move
        least = np.minimum(least, (x ^ (x >> np.uint32(15))).min(axis=1))
    mixed = (least.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.uint8)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0]), mixed.tobytes()


def _sketches(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(shingle_hashes(x.as_py() or b"", shingle, seed)) for x in batch.column(2)]
            fp = np.array([f for f, _ in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp), pa.array([k for _, k in found], pa.binary())], ["doc_id", "row_key", "fp", "sketch"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, sketch) -> (band, key, id)."""
    weight = np.uint64(256) ** np.arange(ROWS, dtype=np.uint64)
    for batch in batches:
        n = batch.num_rows
        bytes_ = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, HASHES)
        key = bytes_[:, : BANDS * ROWS].reshape(n, BANDS, ROWS).astype(np.uint64) @ weight
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n)), pa.array(key.astype(np.int64).ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["band", "key", "id"]
        )


def radius(similarity: float) -> int:
    """Differing bits of fingerprints that pairs of that similarity keep within, but for one in some ten thousand."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(64 * p + 4 * math.sqrt(64 * p * (1 - p)))


def alike(fp: np.ndarray, sketches: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """Index pairs whose links connect all pairs of one cell that are similar enough; each text is expanded once against those not yet reached."""
    bits, chance = radius(similarity), 1 / 256
    least = similarity - math.sqrt(similarity * (1 - similarity) / HASHES)
    need = math.ceil(HASHES * (least * (1 - chance) + chance))
    left = np.ones(len(fp), dtype=bool)
    for first in range(len(fp)):
        if not left[first]:
            continue
        left[first], todo = False, [first]
        while todo:
            x = todo.pop()
            c = np.flatnonzero(left)
            c = c[np.bitwise_count(fp[c] ^ fp[x]) <= bits]
            c = c[(sketches[c] == sketches[x]).sum(axis=1) >= need]
            left[c] = False
            todo += c.tolist()
            yield from ((x, y) for y in c.tolist())


def _similar(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, edges = Forest(), []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges)], ["a", "b"])
        for g in runs(batches, ["band", "key", "i", "j"]):
            ids = g["id"]
            if len(ids) > 1:
                sketches = np.frombuffer(b"".join(g["sketch"].to_pylist()), np.uint8).reshape(len(ids), HASHES)
                edges += [e for x, y in alike(g["fp"].view(np.uint64), sketches, similarity) if known.join(*(e := (int(ids[x]), int(ids[y]))))]
            if len(edges) > 20_000:
                yield made()
                edges = []
            if len(known.up) > 500_000:
                known = Forest()
        if edges:
            yield made()

    return run


def similar_links(classes: DataFrame, similarity: float = SIMILAR, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect all classes (id, fp, sketch) of that similarity. Only cells with several classes get their sketches."""
    bands = classes.select("id", "sketch").mapInArrow(_bands, "band int, key long, id long")
    cells = bands.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    cells = cells.select("band", "key", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    met = stored(bands.join(stored(cells, "cells", thin=True), ["band", "key"]), "met", thin=True)
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    rows = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id").join(classes.select("id", "fp", "sketch"), "id")
    keys = ["band", "key", "i", "j"]
    return rows.select(*keys, "id", "fp", "sketch").repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(_similar(similarity), "a long, b long")


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(x.as_py() or b"", shingle, seed) for x in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return run


def row_key():
    """Digest of a row's text; a null text differs from an empty one."""
    return F.when(F.col("text").isNotNull(), F.md5(F.col("text").cast("binary"))).otherwise(F.lit("")).alias("row_key")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of every row."""
    thin = whole_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return thin.mapInArrow(_fingerprints(shingle, seed), "doc_id long, fp long")


def _tables(pivots: int):
    refs = _pivots(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            table = np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in table], pa.binary())], ["fp", "dist"])

    return run


def cell_masks(distinct: int, bits: int = BITS, cell: int = CELL) -> list[int]:
    """Masks of which one at least agrees for any two fingerprints within ``bits``.

    The 64 bits are cut into r blocks; with ``bits`` differing bits, r - bits blocks agree at least, so all
    choices of that many blocks are keys. r grows with the number of fingerprints.
    """
    for r in range(bits + 1, bits + 5):
        edges = [round(64 * i / r) for i in range(r + 1)]
        blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
        masks = [sum(c) for c in itertools.combinations(blocks, r - bits)]
        if distinct >> min(m.bit_count() for m in masks) <= cell:
            break
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near(fp: np.ndarray, dist: np.ndarray, bits: int) -> Iterator[tuple[int, int]]:
    """Index pairs whose links connect all that ``bits`` connects within one cell.

    Each fingerprint is expanded once against those not yet reached: the first pivot's sorted distances
    give a window, the other coordinates thin it out, and the rest is verified bit by bit.
    """
    order = np.argsort(dist[:, 0], kind="stable")
    first = dist[order, 0].astype(np.int16)
    low, high = np.searchsorted(first, first - bits, "left"), np.searchsorted(first, first + bits, "right")
    if len(fp) <= 96:  # few: all windows at once
        i, j = np.nonzero(np.triu(first[None, :] - first[:, None] <= bits, 1))
        a, b = order[i], order[j]
        ok = (np.abs(dist[a].astype(np.int16) - dist[b]).max(axis=1, initial=0) <= bits) if len(a) else np.zeros(0, bool)
        a, b = a[ok], b[ok]
        ok = np.bitwise_count(fp[a] ^ fp[b]) <= bits
        yield from zip(a[ok].tolist(), b[ok].tolist())
        return
    table, value, left = dist[order].astype(np.int16), fp[order], np.ones(len(fp), dtype=bool)
    for seed in range(len(fp)):
        if not left[seed]:
            continue
        left[seed], todo = False, [seed]
        while todo:
            x = todo.pop()
            c = low[x] + np.flatnonzero(left[low[x] : high[x]])
            for p in range(1, table.shape[1], 4):
                if len(c) < 32:
                    break
                c = c[(np.abs(table[c, p : p + 4] - table[x, p : p + 4]) <= bits).all(axis=1)]
            c = c[np.bitwise_count(value[c] ^ value[x]) <= bits]
            left[c] = False
            todo += c.tolist()
            yield from ((int(order[x]), int(order[y])) for y in c.tolist())


def _links(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Forest()  # of this task: an edge that joins nothing new is left out
        edges: list[tuple[int, int]] = []
        names = ["a", "b"]
        for g in runs(batches, ["mask", "key", "i", "j"]):
            fp = g["fp"]
            if len(fp) > 1:
                dist = np.frombuffer(b"".join(g["dist"].to_pylist()), dtype=np.uint8).reshape(len(fp), -1)
                edges += [e for x, y in near(fp.view(np.uint64), dist, bits) if known.join(*(e := (int(fp[x]), int(fp[y]))))]
            if len(edges) > 20_000 or len(known.up) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges)], names) if edges else pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names)
                edges = []
                if len(known.up) > 500_000:
                    known = Forest()
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges)], names)

    return run


def links(distinct: DataFrame, count: int, bits: int = BITS, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect all within ``bits``."""
    masks = cell_masks(count, bits)
    rows = distinct.mapInArrow(_tables(pivots), "fp long, dist binary")
    rows = rows.select("fp", "dist", F.posexplode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask", "bitsof"))
    rows = rows.select("fp", "dist", "mask", F.col("fp").bitwiseAND(F.col("bitsof")).alias("key"))
    large = (
        distinct.select("fp", F.posexplode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask", "bitsof"))
        .groupBy("mask", F.col("fp").bitwiseAND(F.col("bitsof")).alias("key"))
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > block)
        .select("mask", "key", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    )
    rows = rows.join(large, ["mask", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("mask", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "dist")
    keys = ["mask", "key", "i", "j"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(_links(bits), "a long, b long")


def _grouped(each: DataFrame, bits: int) -> DataFrame:
    """(fp, root, least): the group and the smallest id of every distinct fingerprint of a stored table."""
    classes = stored(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes", thin=True)
    roots = connected_components(links(classes.select("fp"), classes.count(), bits))
    return classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable by links) of every row.

    Texts are read once; copies collapse to one fingerprint each before any pair is sought.
    """
    each = stored(fingerprints(docs, shingle, seed), "fingerprints")
    named = _grouped(each, bits)
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "root").select("fp", "component_id")
    return each.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, similarity: float = SIMILAR, shingle: int = WORDS, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """Rows of ``docs``, one of each group: that of the smallest id (rows without an id last), its text's digest breaking ties.

    Which rows stay is settled on ids and digests; the texts meet that list in one join. Repeated rows
    of a chosen id and text, where there are any, are thinned out afterwards.
    """
    thin = whole_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), row_key(), F.col("text").cast("binary").alias("text"))
    each = stored(thin.mapInArrow(_sketches(shingle, seed), "doc_id long, row_key string, fp long, sketch binary"), "sketches")
    # texts with the same sketch are one class from the start, however many there are
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")
    classes = stored(each.groupBy("sketch", "fp").agg(first).withColumn("id", F.monotonically_increasing_id()), "classes")
    least = stored(classes.groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n")), "prints", thin=True)
    close = links(least.select("fp"), least.count(), bits)
    at = least.select(F.col("fp").alias("f"), "id")
    close = close.join(at.withColumnsRenamed({"f": "a", "id": "x"}), "a").join(at.withColumnsRenamed({"f": "b", "id": "y"}), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = classes.join(least.where("n > 1").select("fp", F.col("id").alias("a")), "fp").select("a", F.col("id").alias("b"))
    edges = similar_links(classes, similarity).unionByName(close).unionByName(same)
    roots = connected_components(edges).withColumnRenamed("node", "id")
    named = classes.select("id", "first").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    doc, key, row = unused(docs, "kept_doc", "kept_key", "row_key")
    chosen = named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias(doc), F.col("first.row_key").alias(key))
    again = each.groupBy("doc_id", "row_key").agg(F.count("*").alias("n")).where("n > 1").take(1)
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(row) == F.col(key))
    kept = docs.withColumn(row, row_key()).join(chosen, on, "left_semi")
    return (kept.dropDuplicates(["doc_id", row]) if again else kept).select(*[f"`{c}`" for c in docs.columns])
