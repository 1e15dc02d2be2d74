import numpy as np
import pytest

from hitstream.llm import rabitq
from hitstream.llm.queries import op7_embedding_dedup, table

SCHEMA = "vec_id long, embedding array<float>, label int, cell int"


def brute(rows, cosine=0.9):
    ids = [r.vec_id for r in rows]
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    root, out = list(range(len(ids))), []
    for i in range(len(ids)):
        if root[i] == i:
            todo = [i]
            while todo:
                for j in np.flatnonzero(near[todo.pop()]):
                    if j != i and root[j] == j and j > i:
                        root[j] = i
                        todo.append(j)
    least = {}
    for i, r in enumerate(root):
        least[r] = min(least.get(r, ids[i]), ids[i])
    for i, r in enumerate(root):
        out.append((ids[i], int(near[i].sum()), least[r], ids[i] == least[r]))
    return sorted(out)


def got(df):
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect())


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.1"
    assert got(op7_embedding_dedup(spark, folder)) == brute(table(spark, folder, "embeddings").collect())


@pytest.fixture(scope="module")
def dense(spark):
    """A dense group, chains that just link, exact copies, and random vectors."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 32))
    x[:200] = x[0] + 0.15 * rng.normal(size=(200, 32))
    for i in range(300, 400):
        x[i] = x[i - 1] + 0.4 * rng.normal(size=32)
    x[500:520] = x[500]
    return spark.createDataFrame([(int(i), [float(v) for v in r], 0, 0) for i, r in zip(rng.permutation(1500), x)], SCHEMA)


@pytest.mark.parametrize("cell,block", [(512, 2048), (64, 2048), (512, 60)])
def test_dense_groups_chains_and_copies(dense, cell, block):
    assert got(rabitq.near_duplicates(dense, cell=cell, block=block)) == brute(dense.collect())


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 64))
    x[200:] = x[:200] + rng.normal(size=(200, 64)) * rng.uniform(0.1, 2, (200, 1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    exact, errors = x @ x.T, []
    for number in range(20):
        levels, factor, variance = rabitq.codes(x, number)
        values = (levels - 7.5) / factor[:, None]
        spread = np.sqrt(variance[:, None] + variance[None, :])
        errors.append(((values @ values.T - exact) / spread)[~np.eye(400, dtype=bool)])
    errors = np.concatenate(errors)
    assert abs(errors.mean()) < 0.05 and 0.7 < errors.std() < 1.1 and np.abs(errors).max() < 6
    assert np.array_equal(levels >= 8, x @ rabitq.rotation(64, rabitq.SEED + 19) >= 0)


@pytest.mark.parametrize("dim", [1, 2, 7, 64])
def test_codes_are_packed_and_rule_out_no_link(dim):
    rng = np.random.default_rng(dim)
    x = rabitq.units(np.repeat(rng.normal(size=(60, dim)), 5, axis=0) + 0.3 * rng.normal(size=(300, dim)))
    levels, factor, variance = rabitq.codes(x)
    assert np.array_equal(rabitq.unpacked(rabitq.packed(levels), dim), levels)
    found = {(i, j) for a, b in rabitq.near(x, 0.9) for i, j in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(np.einsum("ij,kj->ik", x, x) >= 0.9, 1)))}
    sure = {(i, j) for i, j in want if abs(x[i] @ x[j] - 0.9) > 1e-12}
    assert sure <= found <= {(i, j) for i in range(300) for j in range(i + 1, 300) if x[i] @ x[j] > 0.9 - 1e-12}


@pytest.mark.parametrize("count", [10, 10**5, 10**8])
def test_tables_keep_pairs_at_the_threshold(count):
    bits, n = rabitq.tables(count)
    same = (1 - np.arccos(0.9) / np.pi) ** bits
    assert 1 - (1 - same) ** n >= 0.999 and count / 2**bits < 800


def test_odd_rows_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1, 1), (2, [2.0, 0.0], 1, 1), (2, [2.0, 0.0], 1, 1), (3, None, 1, 1), (4, [0.0, 0.0], None, 1), (5, [nan, 1.0], 1, 1),
        (6, [inf, 1.0], 1, 1), (7, [None, 1.0], 1, 1), (8, [], 1, 1), (9, [1.0], 1, 1), (10, [0.0, 1.0], 1, 1), (10, [0.0, -1.0], 1, 1), (11, [0.1, 1.0], 1, 1),
    ]
    assert got(rabitq.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == sorted(
        [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False)] + [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)] + [(10, 1, 10, True), (10, 0, 10, True), (11, 1, 10, False)]
    )
    no_id = rabitq.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0], 1, 1), (1, [1.0, 0.0], 1, 1)], SCHEMA)).collect()
    assert sorted(map(tuple, no_id), key=str) == sorted([(None, 0, None, False), (1, 0, 1, True)], key=str)
    assert rabitq.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clashing_columns(spark):
    names = ["v", "h", "k", "id", "least", "copies", "n", "root", "n_links", "component_id", "kept", "dim", "slot", "own", "code"]
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [-0.0, 1.0])]
    df = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "vec_id long, embedding array<float>, " + ", ".join(f"{n} int" for n in names))
    assert got(rabitq.near_duplicates(df)) == [(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False)]
