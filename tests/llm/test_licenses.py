import re

import duckdb
import pytest

from hitstream.llm import licenses
from hitstream.llm.queries import op3_licenses


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "license", "unit", "occurrences").collect()), key=str)


def test_query_against_duckdb(spark, medium):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{medium}/documents.parquet')")
    got = rows(op3_licenses(spark, medium))
    assert got == sorted(db.execute(licenses.oracle_sql()).fetchall(), key=str) and len(got) > 10


WHOLE = {name: text for name, text in licenses.texts() if len(text) > 300}  # the last form of each: without title, up to the end of the terms


@pytest.mark.parametrize(
    "change",
    [str, str.upper, lambda t: t.replace("\n", "\r\n"), lambda t: "Copyright (c) 2020 A. Person\n\n" + t, lambda t: t.replace(",", " ,").replace('"', "``"), lambda t: re.sub(r"\blicense(s?)\b", r"licence\1", t).replace("copyright holders", "copyright owners"), lambda t: t.replace("\n\n", "\n \t\n* ")],
)
def test_whole_texts_in_other_spellings(spark, change):
    docs = spark.createDataFrame([(i, change(t)) for i, t in enumerate(WHOLE.values())], "doc_id long, text string")
    found = {(r.doc_id, r.license) for r in licenses.find(docs).where("unit = 'document'").collect()}
    assert found == set(enumerate(WHOLE))


def rewrapped(text, width):
    import textwrap

    return "\n\n".join("\n".join(textwrap.wrap(p, width, break_long_words=False, break_on_hyphens=False)) for p in text.split("\n\n"))


@pytest.mark.parametrize("width", [40, 72, 100, 10_000])
def test_licence_files_alone_and_inside_documents(spark, width):
    """The usual files: a title, a copyright line, the whole text, wrapped anyhow; alone, and with code around it."""
    names = ["MIT", "ISC", "Zlib", "BSD-2-Clause", "BSD-3-Clause", "Unlicense"]
    body = {n: WHOLE[n] if n != "Unlicense" else next(t for k, t in licenses.texts() if k == n and len(t) > 300) for n in names}
    forms = [lambda n, t: f"The {n} License\n\nCopyright (c) 2024 Some Body\nAll rights reserved.\n\n{t}\n", lambda n, t: f"code\n{t}\nmore code\n", lambda n, t: t]
    rows = [(10 * i + k, form(n, rewrapped(body[n], width))) for i, n in enumerate(names) for k, form in enumerate(forms)]
    found = {(r.doc_id, r.license) for r in licenses.find(spark.createDataFrame(rows, "doc_id long, text string")).where("unit != 'line'").collect()}
    missed = {(10 * i + k, n) for i, n in enumerate(names) for k in range(3)} - found
    assert missed <= ({(10 * i + k, n) for i, n in enumerate(names) for k in range(3)} if width == 10_000 else set())


def test_words_may_be_parted_by_anything(spark):
    texts = ["This is free and unencumbered software released into the public" + gap + "domain." for gap in (" ", "\n", "  ", "-\n  ")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.doc_id, r.license) for r in licenses.find(docs).collect()} == {(i, "Unlicense") for i in range(4)}


def test_a_changed_word_is_no_match(spark):
    docs = spark.createDataFrame([(1, WHOLE["MIT"].replace("without restriction", "with restriction"))], "doc_id long, text string")
    assert licenses.find(docs).count() == 0


def test_notice_inside_a_text(spark):
    docs = spark.createDataFrame([(1, "Some prose.\n" + "Released under the MIT Licence\nmore prose\nReleased under the MIT License."), (2, "about the MIT License")], "doc_id long, text string")
    assert rows(licenses.find(docs)) == [(1, "MIT", "line", 2)]


def test_of_two_known_texts_on_one_line_the_longest_counts(spark):
    full = next(t for n, t in licenses.texts() if n == "Apache-2.0" and "APPENDIX" in t)
    docs = spark.createDataFrame([(1, full), (1, full)], "doc_id long, text string")
    assert rows(licenses.find(docs).where("unit = 'document'")) == [(1, "Apache-2.0", "document", 1)] * 2


def test_python_and_spark_agree_on_the_canonical_form(spark):
    from pyspark.sql import functions as F

    lines = [x for t in WHOLE.values() for x in t.split("\n")] + ["", "(c) 2020 x", "(c) You must", "A licence, per cent!", "  Wilful -- centre", "All rights reserved", "é Ü copyright", "copyright notice", " 2. The"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string").select("i", licenses.canonical(F.col("t")).alias("c")).orderBy("i")
    assert [r.c for r in got.collect()] == [licenses.canonical_line(t) for t in lines]


def test_odd_rows_and_empty(spark, odd, empty):
    assert licenses.find(odd).count() == 0 and licenses.find(empty).count() == 0


def test_every_known_text_carries_the_mark_in_any_spelling():
    for _, text in licenses.texts():
        for changed in (text, text.upper(), re.sub(r"\s+", "\n", text), re.sub(r"\s+", " - ", text)):
            assert re.search(licenses.MARK, changed), text
    assert len(licenses.registry()) > 60
