"""Operators on tables whose other columns have the names that operators use themselves."""

import pytest
from pyspark.sql import functions as F

from hitstream.llm import chains, langid, licenses, packing, pii, sharding, simhash
from hitstream.llm.queries import tokenizer_path

NAMES = (
    "size text_crc32 virtual_slot shard slot deal n base place map_version license unit occurrences row lines b at head digest key words id a other_id kind start end similarity "
    "body again least rows lang_pred score held_out spans terms contexts text_key n_email base_sha256 found fingerprint component_id fp root sketch row_key dist mask length ids "
    "doc_tokens task nth sequence_id offset tokens __text __key __spans"
).split()
TEXT = "Released under the MIT License.\nmail a@example.org or b@example.org and read all of the words that follow here without any trouble"


@pytest.fixture(scope="module")
def clashing(spark):
    docs = spark.createDataFrame([(i, TEXT if i < 2 else f"{TEXT} number {i}", "en", "s") for i in range(4)], "doc_id long, text string, lang string, source string")
    return docs, docs.select("*", *[F.lit(7).alias(n) for n in NAMES])


OPERATORS = {
    "op2": lambda d: sharding.shard_documents(d, 3)[0].select("doc_id", "size", "text_crc32", "shard"),
    "op3": licenses.find,
    "op4": lambda d: chains.passages(d, 10),
    "op5": lambda d: langid.predict(d, langid.fit(d)),
    "op8": pii.findings,
    "op9": simhash.near_duplicates,
    "op10": lambda d: packing.pack(d, tokenizer_path()).select("doc_id", "start", "length", "ids"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_change_nothing(clashing, name):
    plain, more = (sorted(map(str, OPERATORS[name](d).collect())) for d in clashing)
    assert plain == more and plain


def test_language_query_against_single_predictions(spark, small):
    """Brute force: every whole text by itself, by the model that the query fits."""
    from hitstream.llm.queries import op5_language, table

    docs = table(spark, small, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    got = {r.doc_id: (r.lang_pred, r.score) for r in op5_language(spark, small).collect()}
    for r in docs.collect():
        want = ("und", 0.0)
        if r.text and any(c.isalpha() for c in r.text):
            names, sure = model.predict(langid.features(r.text)[None, :])
            want = (names[0], sure[0])
        assert got[r.doc_id][0] == want[0] and abs(got[r.doc_id][1] - want[1]) < 1e-6
