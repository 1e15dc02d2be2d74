import os
import random

import pyarrow as pa
import pytest

from hitstream.llm import common


def roots(edges):
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {x: root(x) for e in edges for x in e if None not in e and e[0] != e[1]}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    edges += [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5001 + i) for i in range(60)] + [(7, 7), (None, 3), (9, None)]
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == roots(edges)


def test_components_of_nothing(spark):
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_runs_span_batches():
    rows = [(i // 7, i // 21, i) for i in range(100)]
    table = pa.table({k: [r[n] for r in rows] for n, k in enumerate(("b", "a", "x"))}).select(["a", "b", "x"])
    for size in (1, 3, 50, 1000):
        got = [(int(g["a"][0]), int(g["b"][0]), g["x"].tolist()) for g in common.runs(table.to_batches(size), ["a", "b"])]
        want = {}
        for b, a, x in rows:
            want.setdefault((a, b), []).append(x)
        assert got == [(*k, v) for k, v in want.items()]


def test_tables_are_swept(spark):
    df = common.stored(spark.range(5).toDF("a"), "probe")
    path = df.stored_at.removeprefix("file://")
    assert df.count() == 5 and os.path.isdir(path)
    assert common.sweep(spark) >= 1 and not os.path.isdir(path) and not common.MADE


def test_a_cluster_needs_a_shared_folder(spark):
    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Cluster)
