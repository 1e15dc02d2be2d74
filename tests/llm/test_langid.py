import zlib

import numpy as np

from hitstream.llm import langid
from hitstream.llm.queries import op5_language, table


def test_query_holds_out_its_fold_and_is_accurate(spark, medium):
    docs = {r.doc_id: r for r in table(spark, medium, "documents").collect()}
    rows = op5_language(spark, medium).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 200 and np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_learns_nothing_from_the_held_out_fold_or_other_columns(spark, small):
    from pyspark.sql import functions as F

    docs = table(spark, small, "documents")
    a = langid.fit(docs.where(~langid.held_out()))
    wrong = docs.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("q"))
    b = langid.fit(wrong.where(~langid.held_out()))
    assert a.families == b.families and np.array_equal(a.heads, b.heads)


def test_odd_rows(spark, odd, empty):
    model = langid.fit(odd)
    rows = langid.predict(odd, model).collect()
    assert len(rows) == 10 and sorted(r.doc_id for r in rows if r.lang_pred == "und") == [3, 4, 5]
    assert all(r.lang_pred in ("en", "de", "und") for r in rows)
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(empty)).collect()} == {"und"}
    kept = langid.accepted(odd, model)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} <= {1, 2, 6, 7, 8, None}


def test_letters(spark):
    docs = spark.createDataFrame([(1, "12 ½ ² $"), (2, "ª 漢"), (3, "x")], "doc_id long, text string")
    model = langid.Model.fit(np.stack([langid.features(t) for t in ("aaa", "bbb")]), ["en", "fr"])
    assert [r.lang_pred == "und" for r in sorted(langid.predict(docs, model).collect())] == [True, False, False]


def test_machine_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5)).astype(np.float32)
    y = np.where(x @ np.array([1, -2, 0.5, 0, 0]) > 0.3, 1.0, -1.0)
    w = langid.svm(x, y, c=1000)
    assert (np.sign(np.hstack([x, np.ones((300, 1))]) @ w) == y).mean() > 0.99


def test_long_texts_are_read_whole():
    a = langid.features("ab" * 1_000_000 + "xyz" * 500_000)
    b = np.sqrt(np.maximum(0, langid.features("ab" * 1_000_000) ** 2 * 6_000_000 - 3))
    assert a[b == 0].max() > 0.1
