import math
from collections import defaultdict

import duckdb
import pytest

from hitstream.llm import mixing
from hitstream.llm.queries import MIX_ENTROPY, op1_mixing


def test_query_against_duckdb(spark, small):
    got = sorted(map(tuple, op1_mixing(spark, small).select("doc_id", "source", "copies", "tokens", "mix_epoch", "mix_block", "mix_rank").collect()))
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{small}/documents.parquet')")
    assert got == sorted(db.execute(mixing.oracle_sql(MIX_ENTROPY)).fetchall())


def totals(spark, sizes):
    return spark.createDataFrame([(f"s{i}", n, 1) for i, n in enumerate(sizes)], "source string, n long, docs long")


def entropy(sizes, a):
    w = [n**a for n in sizes]
    return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)


def test_exponent_meets_the_limit_and_no_more(spark):
    sizes = [1000, 100, 10]
    a = mixing.solve_exponent(totals(spark, sizes), None, 3.0)
    assert 100 ** (1 - a) <= 3.0 + 1e-6 < 100 ** (1 - a + 2**-18)


def test_exponent_meets_the_entropy(spark):
    sizes = [1000, 100, 10, 10]
    a = mixing.solve_exponent(totals(spark, sizes), 0.8, 1e9)
    want = 0.8 * math.log(4)
    assert entropy(sizes, a) >= want - 1e-9 > entropy(sizes, a + 2**-18)


@pytest.mark.parametrize("budget", [None, 5000])
def test_budgets_are_met_and_nothing_is_left_out(spark, budget):
    docs = spark.createDataFrame(
        [(i, "w " * (1 + i % 7), "en", "big" if i % 3 else ("mid" if i % 2 else None), 1) for i in range(3000)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    rows = mixing.schedule(docs, budget=budget, block_tokens=500).collect()
    sizes = mixing.source_totals(docs.withColumn("tokens", mixing.words()))
    weights = {r.source: r for r in mixing.weigh(sizes, mixing.solve_exponent(sizes, budget=budget), budget).collect()}
    given, seen = defaultdict(int), defaultdict(set)
    for r in rows:
        given[r.source] += r.tokens
        seen[r.source].add(r.doc_id)
    for s, w in weights.items():
        assert w.budget <= given[s] < w.budget + 7
        assert w.budget / w.n <= 2.001
        if budget is None:
            assert len(seen[s]) == w.docs
    assert len(rows) == len({(r.doc_id, r.mix_epoch) for r in rows})
    blocks = defaultdict(lambda: defaultdict(int))
    for r in rows:
        blocks[r.mix_block][r.source] += r.tokens
    for b in list(blocks.values())[:-1]:  # each block holds the sources in proportion, up to a document
        for s, w in weights.items():
            assert abs(b[s] - sum(b.values()) * w.weight) < 25


def test_odd_rows_and_empty(spark, odd, empty):
    rows = mixing.mix(odd).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in odd.collect()} and sum(r.doc_id == 2 for r in rows) % 2 == 0
    out = mixing.mix(empty)
    assert out.columns[: len(empty.columns)] == empty.columns and out.count() == 0


def test_the_limit_holds_for_a_given_budget(spark):
    sizes = totals(spark, [1000, 100, 10])
    a = mixing.solve_exponent(sizes, None, 3.0, budget=2000)
    repeated = {r.source: r.budget / r.n for r in mixing.weigh(sizes, a, 2000).collect()}
    assert max(repeated.values()) <= 3.05 and repeated["s2"] == max(repeated.values())
    with pytest.raises(ValueError):
        mixing.solve_exponent(sizes, None, 3.0, budget=4000)


def test_rows_that_only_look_alike_stay_apart(spark):
    rows = [(1, None, "x"), (1, "", "x"), (2, "a", "b:c"), (2, "a:b", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = [(r.doc_id, r.source, r.text) for r in mixing.mix(docs, max_epochs=1.0).collect()]
    assert sorted(got, key=str) == sorted(rows, key=str)


def test_clashing_columns(spark):
    names = ["mix_epoch", "mix_block", "mix_rank", "__key", "tokens", "t", "copies", "row", "n", "part", "ranges", "draw", "range", "start", "ahead", "base"]
    docs = spark.createDataFrame([(i, f"w {i}", "ab"[i % 2], *[f"own {i}"] * len(names)) for i in range(6)], ["doc_id", "text", "source", *names])
    out = mixing.mix(docs, max_epochs=1.0)
    assert out.columns == ["doc_id", "text", "source", *names[3:], "mix_epoch", "mix_block", "mix_rank"]
    assert sorted((r.doc_id, r["__key"], r.row, r.mix_epoch) for r in out.collect()) == [(i, f"own {i}", f"own {i}", 0) for i in range(6)]
    kept = mixing.mixed_rows(docs, max_epochs=1.0).select("row.*")
    assert sorted(kept.collect()) == sorted(docs.collect())
