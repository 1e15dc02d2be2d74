"""Packing by power-of-two decomposition.

A document's token ids and its end mark are cut into pieces whose lengths are powers of two: as many of the
longest as fit, then the binary digits of the rest, longest first. Equal lengths make a bucket; every
sequence is one piece, so none crosses documents and none is padded. Sequences are numbered bucket by bucket,
longest first, gapless from 0.

Defined cases: a null or empty text is its end mark alone (one piece of length 1); repeated rows are packed
again, each with sequences of its own; extra columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hitstream.llm.common import OUT_ROWS, stored, whole_texts
from hitstream.operators.lookups import small

LONGEST = 4096
END_ID = 2
#: Words that one worker remembers the ids of, in two generations: words in use move to the young one, the old one is let go when that is full.
REMEMBERED = 800_000
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, task int, nth long"
#: Within these characters (Latin-1 without controls) lower-casing and the vocabulary's word pattern are the same in Python.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ÿ]*")
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+")


def _without_splitting(tokenizer):
    """The same vocabulary for words that are already normalised and split: white space alone separates them."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    plain = Tokenizer.from_str(tokenizer.to_str())
    plain.normalizer = normalizers.Sequence([])
    plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return plain


class WordIds(dict):
    """Ids (little-endian unsigned 32-bit bytes) of words of the vocabulary's pattern, remembered by a worker."""

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self.tokenizer, self.old = tokenizer, {}
        self.plain = _without_splitting(tokenizer)
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that end a word
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True

    def learn(self, words: set[str]) -> None:
        """Encode words not seen before as one text; ids that end a word tell them apart."""
        new = [w for w in words if w not in self]
        if 2 * (len(self) + len(new)) > REMEMBERED:
            self.old = dict(self)
            self.clear()
            new = list(words)
        self.update((w, self.old[w]) for w in new if w in self.old)
        new = [w for w in new if w not in self.old]
        parts = [" ".join(new[at : at + 256]) for at in range(0, len(new), 256)]
        found = self.plain.encode_batch_fast(parts, add_special_tokens=False)
        ids = np.array([i for f in found for i in f.ids], "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(new):
            raise ValueError("the vocabulary's words do not end where its pattern ends them")
        data, start = ids.tobytes(), 0
        for word, end in zip(new, (4 * cuts).tolist()):
            self[word] = data[start:end]
            start = end

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of texts: word by word where Python splits them as the tokenizer does, else by the tokenizer."""
        at = 0
        while at < len(texts):  # some megabytes at a time
            size, end = 0, at
            while end < len(texts) and (end == at or size + len(texts[end]) < 2_000_000):
                size += len(texts[end])
                end += 1
            split = [WORD.findall(t.lower()) if "<|" not in t and PLAIN.fullmatch(t) else None for t in texts[at:end]]
            self.learn(set().union(*filter(None, split)))
            for text, words in zip(texts[at:end], split):
                yield self.whole(text) if words is None else b"".join(map(self.__getitem__, words))
            at = end


@cache
def _word_ids(path: str) -> WordIds:
    from tokenizers import Tokenizer

    return WordIds(Tokenizer.from_file(path))


def lengths(tokens: int, longest: int = LONGEST) -> list[int]:
    """Piece lengths of a document of so many tokens, longest first."""
    rest = tokens % longest
    return [longest] * (tokens // longest) + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _pieces(path: str, longest: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(path)
        task, nth, rows = TaskContext.get().partitionId(), {}, []
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "task", "nth"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64()]
        end, held = np.array([end_id], "<u4").tobytes(), 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.of(texts)):
                ids += end
                total, at = len(ids) // 4, 0
                for n in lengths(total, longest):
                    k = nth.get(n, 0)
                    nth[n] = k + 1
                    rows.append((doc_id, at, n, ids[4 * at : 4 * (at + n)], total, task, k))
                    at += n
                held += len(ids)
                if len(rows) >= OUT_ROWS or held > 8_000_000:
                    yield made()
                    rows, held = [], 0
        if rows:
            yield made()

    return cut


def pack(docs: DataFrame, tokenizer_path: str, longest: int = LONGEST, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset (always 0).

    One pass cuts the documents where they are read and stores the pieces; sequence numbers then come from
    counts per task and length, a table of at most 13 rows a task.
    """
    thin = whole_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stored(thin.mapInArrow(_pieces(tokenizer_path, longest, end_id), PIECES), "pieces")
    counts = stored(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "counts", thin=True)
    before = Window.orderBy(F.desc("length"), "task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # few tasks: their table goes to the pieces; many: both sides are shuffled
    return pieces.join(small(base), ["length", "task"]).select(
        "doc_id", "start", "length", "ids", "doc_tokens", (F.col("base") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
