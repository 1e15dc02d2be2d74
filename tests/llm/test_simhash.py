import numpy as np
import pytest
import xxhash

from hitstream.llm import simhash
from hitstream.llm.common import connected_components
from hitstream.llm.queries import op9_simhash, table


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, bits=4):
    fp = np.array([slow_fingerprint(t) for _, t in rows], dtype=np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= bits
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            m = min(label[j] for j in np.flatnonzero(near[i]))
            if m < label[i]:
                label[i], changed = m, True
    groups = {}
    for (doc_id, _), root in zip(rows, label):
        groups.setdefault(root, []).append(doc_id)
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in groups.items()}
    return sorted(((i, f"{int(f):016x}", least[r]) for (i, _), f, r in zip(rows, fp, label)), key=str)


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_query_against_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in table(spark, small, "documents").collect()]
    assert got(op9_simhash(spark, small)) == brute(docs)


def test_odd_rows_and_empty(spark, odd, empty):
    assert got(simhash.near_duplicates(odd)) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert simhash.near_duplicates(empty).count() == 0


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] % 2**64 == xxhash.xxh64_intdigest("a b c d", 42)


@pytest.mark.parametrize("distinct", [10, 2**24, 2**32, 2**40])
def test_some_mask_agrees(distinct):
    masks = simhash.cell_masks(distinct)
    rng = np.random.default_rng(3)
    for _ in range(300):
        flip = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(not flip & m for m in masks)


def planted(n, copies):
    rng = np.random.default_rng(5)
    fp = rng.integers(0, 2**64, n, dtype=np.uint64)
    for i in range(copies):  # a chain of near copies
        fp[i + 1] = fp[i] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)))
    return np.unique(fp)


@pytest.mark.parametrize("block", [4096, 50])
def test_links_connect_what_brute_force_connects(spark, block):
    fp = planted(700, 300)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    reach = {}
    for i in range(len(fp)):
        if i not in reach:
            todo = [i]
            reach[i] = i
            while todo:
                x = todo.pop()
                for y in np.flatnonzero(near[x]):
                    if y not in reach:
                        reach[y] = i
                        todo.append(y)
    distinct = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    masks = simhash.cell_masks
    roots = {r.node: r.root for r in connected_components(simhash.links(distinct, len(fp), block=block)).collect()}
    assert masks(700) and len(roots) > 100
    signed = fp.view(np.int64)
    want = {}
    for i, r in reach.items():
        want.setdefault(r, []).append(int(signed[i]))
    assert {min(g): sorted(g) for g in want.values() if len(g) > 1} == {
        root: sorted([n for n, r in roots.items() if r == root]) for root in set(roots.values())
    }
