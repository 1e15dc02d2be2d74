import zlib
from collections import Counter, defaultdict

import numpy as np

from hitstream.llm import sharding
from hitstream.llm.queries import op2_sharding, table


def check(rows, texts, shards):
    load, places = Counter(), defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < shards
        load[r.shard] += r["size"]
        places[r.shard].append(r.slot)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts
    )
    for p in places.values():
        assert sorted(p) == list(range(len(p)))
    return load


def test_query_balances_bytes(spark, medium):
    rows = op2_sharding(spark, medium).collect()
    load = check(rows, [(r.doc_id, r.text) for r in table(spark, medium, "documents").collect()], 24)
    assert len(load) == 24 and max(load.values()) - min(load.values()) < 0.02 * max(load.values())
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_odd_rows_and_empty(spark, odd, empty):
    placed, _ = sharding.shard_documents(odd, 3)
    check(placed.collect(), [(r.doc_id, r.text) for r in odd.collect()], 3)
    placed, versions = sharding.shard_documents(empty, 3)
    assert placed.count() == 0 and versions.count() == 2 * sharding.SLOTS


def test_growing_moves_slots_only_into_the_new_shard():
    weight = np.random.default_rng(1).integers(0, 10_000, 512)
    before = sharding.rebalanced(sharding.first_map(512, 7), weight, 7)
    after = sharding.rebalanced(before, weight, 8)
    moved = before != after
    load = np.bincount(after, weights=weight, minlength=8)
    assert moved.sum() < 512 / 4 and load.max() - load.min() < 0.02 * load.max()
    assert (after[moved] == 7).mean() > 0.8
    packed = np.bincount(sharding.packed_map(weight, 8), weights=weight)
    assert packed.max() - packed.min() < 0.02 * packed.max()
