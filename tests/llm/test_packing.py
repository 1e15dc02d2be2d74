import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from hitstream.llm import packing
from hitstream.llm.queries import op10_packing, table, tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


def expected(rows, tokenizer):
    """Brute force: whole texts through the tokenizer, binary digits cut by hand."""
    out = Counter()
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        at, left = 0, len(ids)
        while left:
            n = min(4096, 1 << (left.bit_length() - 1))
            out[doc_id, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids)] += 1
            at, left = at + n, left - n
    return out


def check(rows, want):
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows))) and all(r.offset == 0 for r in rows)
    ordered = sorted(rows, key=lambda r: r.sequence_id)
    assert all(a.length >= b.length for a, b in zip(ordered, ordered[1:]))


def test_query_against_brute_force(spark, small, tokenizer):
    docs = [(r.doc_id, r.text) for r in table(spark, small, "documents").collect()]
    check(op10_packing(spark, small).collect(), expected(docs, tokenizer))


def test_odd_rows_and_empty(spark, odd, empty, tokenizer):
    from pyspark.sql import functions as F

    docs = [(r.doc_id, r.text) for r in odd.collect()]
    check(packing.pack(odd, tokenizer_path()).withColumn("ids_crc32", F.crc32("ids")).collect(), expected(docs, tokenizer))
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_words_split_as_the_tokenizer_splits(tokenizer):
    words = packing.WordIds(tokenizer)
    texts = ["It's we'LL 'TIS don't", "ÄÖÜß ÿ ¼½ 12a3 ª º µ", "a b", "x<|endoftext|>y", "tab\tnew\nline\r", "\x85 \x1c", "ﬁ Å Å", "!!!'s''re", "A" * 300, "", "'s ' s 's's"]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(words.of(texts)) == want and list(words.of(texts)) == want


def test_memory_of_words_is_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    words = packing.WordIds(tokenizer)
    for text in ["one two three", "four five six", "one six seven eight nine ten"]:
        assert list(words.of([text])) == [np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]


def test_lengths():
    assert packing.lengths(4096 * 2 + 5) == [4096, 4096, 4, 1] and packing.lengths(0) == [] and packing.lengths(1) == [1]
