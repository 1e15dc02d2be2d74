"""Information-theoretic sanitisation of personal data.

Base detection finds e-mail addresses, IPv4 addresses, payment cards and phone numbers: the protected entities.
The corpus then tells which terms reveal them. For a term t in the context of an entity e, pointwise mutual
information log(p(e, t) / (p(e) p(t))) is compared with the entity's information content -log p(e): their
ratio is the share of the entity that the term discloses (1: the term occurs only where the entity does). Pairs
whose ratio reaches ``DISCLOSES``, on the evidence of at least ``SUPPORT`` different contexts, are disclosing, and all
occurrences of the term, in whatever document, become spans of kind ``term``. Probabilities are over lines: a line is
an observation, an entity's context is the words within ``REACH`` words of it on its line. Terms with digits are
generalised to their shape, all others removed.

Counts cover every whole text and are of different lines throughout, on the side of the entities and on that of the
corpus: copies of a line count once, so copies of a document are neither evidence for a term nor against it.
Whole texts are read four times and never shuffled by the query.

Defined cases: a null text is empty and has no spans; spans are code points, end exclusive; repeated rows each get
their row; a corpus without entities has base counts of zero and no term spans; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitstream.llm.common import sliced, stored, unused, whole_texts

#: Share of an entity's information content that a term may give away.
DISCLOSES = 0.9
#: Different contexts in which term and entity must meet.
SUPPORT = 3
#: Words to either side of an entity that are its context.
REACH = 8

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
LINE = re.compile(r"[^\n]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of EMAIL: tried only where a run of local characters before an @ begins.

    Scanning from every character would read each long run again and again; a run's first character matches if any does.
    """
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every base finding, by start, then kind as listed; failing matches are dropped."""
    found = [(s, e, 0) for s, e in _emails(text)]
    if DIGITS.search(text):
        if "." in text:
            found += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(len(v := p.lstrip("0")) <= 3 and int(v or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), m.end(), 2))
        if "+" in text:
            found += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 9 <= len(DIGITS.findall(m[0])) <= 15]
    found.sort(key=lambda x: (x[0], x[2]))
    return [(s, e, KINDS[k]) for s, e, k in found]


def entity_of(kind: str, value: str) -> str:
    """The entity behind a finding: kind and value without case and separators."""
    return f"{kind}:{value.lower() if kind == 'email' else re.sub(r'[^0-9.]' if kind == 'ip' else r'[^0-9]', '', value)}"


def contexts(text: str, spans: list[tuple[int, int, str]], reach: int = REACH) -> Iterator[tuple[str, str, int, int, int]]:
    """(entity, term, start, end, line's start) for the words around each finding, none of them within a finding."""
    lines: dict[int, tuple[int, int, list]] = {}
    # findings may overlap (a card within a phone): a word is free if it starts behind all findings that begin before it ends
    starts = [s for s, _, _ in spans]
    furthest = list(accumulate((e for _, e, _ in spans), max))
    for s, e, kind in spans:
        a, b = text.rfind("\n", 0, s) + 1, text.find("\n", e)
        b = len(text) if b < 0 else b
        if a not in lines or lines[a][1] < b:
            words = []
            for m in WORD.finditer(text, a, b):
                k = bisect_right(starts, m.end() - 1)
                if not k or furthest[k - 1] <= m.start():
                    words.append((m.start(), m.end(), m[0].lower()))
            lines[a] = (a, b, words)
        words = lines[a][2]
        at = bisect_right(words, (s,))
        entity = entity_of(kind, text[s:e])
        for ws, we, term in words[max(0, at - reach) : at + reach]:
            yield entity, term, ws, we, a


def _detect(reach: int):
    names = ["doc_id", "text_key", "n_chars_seen", "spans", "contexts"]
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    context = pa.list_(
        pa.struct([("entity", pa.string()), ("term", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("line", pa.string())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            spans, around, size = [], [], []
            for value in batch.column(2):
                text = value.as_py() or ""
                found = base_spans(text)
                keys: dict[int, str] = {}
                rows = []
                for entity, term, s, e, line in contexts(text, found, reach) if found else ():
                    if line not in keys:
                        end = text.find("\n", line)
                        keys[line] = xxhash.xxh3_128_hexdigest(text[line : end if end >= 0 else len(text)])
                    rows.append({"entity": entity, "term": term, "start": s, "end": e, "line": keys[line]})
                size.append(len(text))
                spans.append([{"start": s, "end": e, "kind": k} for s, e, k in found])
                around.append(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(spans, span), pa.array(around, context)], names
            )

    return run


FOUND = (
    "doc_id long, text_key string, n_chars_seen long, spans array<struct<start:int,end:int,kind:string>>, "
    "contexts array<struct<entity:string,term:string,start:int,end:int,line:string>>"
)


def text_key(text: str = "text"):
    """Digest that stands for a whole text where rows of one id are to be told apart; null counts as empty."""
    return F.concat_ws(":", F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _keyed(docs: DataFrame) -> DataFrame:
    return whole_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.col("text").cast("string").alias("text"))


def detect(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Base findings and their contexts, one row per document; texts are read where they lie."""
    return _keyed(docs).mapInArrow(_detect(reach), FOUND)


#: Bits of a sketch of terms. Where terms are many, more words pass it, which costs time and changes no result.
SKETCH = 1 << 20


def _sketch(terms: DataFrame) -> bytes:
    """A bit for each hash that a term of the column ``term`` has; at most SKETCH numbers reach the driver, however many terms there are."""
    marks = np.zeros(SKETCH, dtype=np.uint8)
    at = terms.select((F.crc32(F.col("term").cast("binary")) % SKETCH).cast("int").alias("at")).distinct().toPandas()["at"].to_numpy()
    marks[at.astype(np.int64)] = 1
    return np.packbits(marks, bitorder="little").tobytes()


class _Passing(dict):
    """Whether a sketch lets a word pass, remembered for the words of a task."""

    def __init__(self, sketch: bytes) -> None:
        super().__init__()
        self.sketch = sketch

    def __missing__(self, word: str) -> bool:
        if len(self) > 200_000:
            self.clear()
        at = crc32(word.encode("utf-8", "surrogatepass")) % SKETCH
        self[word] = found = bool(self.sketch[at >> 3] >> (at & 7) & 1)
        return found


def _distinct_lines(texts: Iterator) -> Iterator[tuple[int, set[str]]]:
    """(hash, terms) of the different lines of one batch."""
    import xxhash

    known = set()
    for value in texts:
        for m in LINE.finditer(value.as_py() or ""):
            line = m[0]
            key = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
            if key not in known:
                known.add(key)
                yield key - (1 << 63), set(map(str.lower, WORD.findall(line)))


def _term_counts(sketch: bytes):
    """(term, different lines) per batch of words that pass the sketch: no batch's count is above that of the corpus. The empty term counts all lines."""
    from collections import Counter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = _Passing(sketch)
        for batch in batches:
            n: Counter = Counter()
            lines = 0
            for _, terms in _distinct_lines(batch.column(0)):
                lines += 1
                n.update(t for t in terms if passes[t])
            n[""] = lines  # no word is empty: the number of lines
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], ["term", "lines"])

    return run


def _term_lines(sketch: bytes):
    """(term, line) of words that pass the sketch, and every line with the empty term; once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = _Passing(sketch)
        for batch in batches:
            rows = []
            for key, terms in _distinct_lines(batch.column(0)):
                rows += [("", key), *((t, key) for t in terms if passes[t])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64()))], ["term", "line"])

    return run


def disclosing(docs: DataFrame, found: DataFrame, discloses: float = DISCLOSES, support: int = SUPPORT) -> DataFrame:
    """(entity, term, share): pairs whose share of the entity's information content reaches ``discloses``.

    All counts are of different lines. Pairs need ``support`` of them in which they meet. A first pass over the corpus bounds each
    candidate term's lines from below and so rules out common words; the lines of the others are told apart in a second one.
    """
    met = found.select(F.explode("contexts").alias("c")).select("c.entity", "c.term", "c.line").distinct()
    pairs = stored(met.groupBy("entity", "term").agg(F.count("*").alias("both")).where(F.col("both") >= support), "pairs", thin=True)
    own = stored(met.select("entity", "line").distinct().groupBy("entity").agg(F.count("*").alias("of_entity")).where(F.col("of_entity") >= support), "entities", thin=True)
    nothing = docs.sparkSession.createDataFrame([("",)], "term string")
    texts = whole_texts(docs).select(F.col("text").cast("string").alias("text")).where("text is not null")
    terms = pairs.select("term").distinct()
    # a sketch of the candidates keeps other words out of the shuffle, and the join those that pass it by chance
    counts = texts.mapInArrow(_term_counts(_sketch(terms)), "term string, lines long").join(terms.unionByName(nothing), "term", "left_semi")
    counts = stored(counts.groupBy("term").agg(F.max("lines").alias("least"), F.sum("lines").alias("most")), "counts", thin=True)
    most = counts.where("term = ''").agg(F.coalesce(F.max("most"), F.lit(1)).alias("n")).first().n
    # share >= discloses means of_term <= both * (total / of_entity) ** (1 - discloses), and total <= most
    bound = F.col("both") * F.pow(F.lit(float(most)) / F.col("of_entity"), F.lit(1 - discloses)) * (1 + 1e-9)
    left = pairs.join(own, "entity").join(counts.select("term", "least"), "term").where(F.col("least") <= bound).select("entity", "term", "both", "of_entity")
    left = stored(left, "candidates", thin=True)
    terms = left.select("term").distinct()
    # counted before they meet the candidates: the empty term stands in every line
    lines = texts.mapInArrow(_term_lines(_sketch(terms)), "term string, line long").distinct().groupBy("term").agg(F.count("*").alias("of_term"))
    seen = stored(lines.join(terms.unionByName(nothing), "term", "left_semi"), "terms", thin=True)
    total = seen.where("term = ''").agg(F.coalesce(F.max("of_term"), F.lit(1)).alias("n")).first().n
    share = F.log(F.col("both") * F.lit(float(total)) / (F.col("of_entity") * F.greatest("of_term", "both"))) / F.log(F.lit(float(total)) / F.col("of_entity"))
    scored = left.join(seen, "term").where(F.col("of_entity") < F.lit(total)).withColumn("share", share)
    return scored.where(F.col("share") >= discloses).select("entity", "term", "share")


def _occurrences(sketch: bytes):
    """(doc_id, text_key, term, start, end) of all words that pass the sketch and stand outside base findings."""
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not any(sketch):
            return
        passes = _Passing(sketch)
        for batch in batches:
            rows = []
            for doc, key, value in zip(*batch.columns):
                text = value.as_py() or ""
                hits = [(m.start(), m.end(), w) for m in WORD.finditer(text) if passes[w := m[0].lower()]]
                if hits:
                    spans = base_spans(text)
                    starts, furthest = [s for s, _, _ in spans], list(accumulate((e for _, e, _ in spans), max))
                    for s, e, word in hits:
                        k = bisect_right(starts, e - 1)
                        if not k or furthest[k - 1] <= s:
                            rows.append((doc.as_py(), key.as_py(), word, s, e))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "text_key", "term", "start", "end"])

    return run


def findings(docs: DataFrame, discloses: float = DISCLOSES, support: int = SUPPORT, reach: int = REACH) -> DataFrame:
    """doc_id, text_key, spans: base findings and disclosing terms of every row of ``docs``."""
    found = stored(detect(docs, reach), "found")
    flagged = stored(disclosing(docs, found, discloses, support).select("term").distinct(), "flagged", thin=True)
    extra = (
        _keyed(docs).mapInArrow(_occurrences(_sketch(flagged)), "doc_id long, text_key string, term string, start int, end int")
        .join(flagged, "term", "left_semi")
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set(F.struct("start", "end", F.lit("term").alias("kind"))).alias("extra"))
        .select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "extra")
    )
    joined = found.join(extra, found.doc_id.eqNullSafe(F.col("d")) & (found.text_key == F.col("k")), "left")
    return joined.select("doc_id", "text_key", "spans", F.coalesce("extra", F.array().cast("array<struct<start:int,end:int,kind:string>>")).alias("terms"))


def is_kind(kind: str):
    return lambda span: span["kind"] == kind


def ordered(spans: str):
    """Spans by start, then kind as listed (term last), each as kind:start:end."""
    rank = F.create_map(*[x for i, k in enumerate((*KINDS, "term")) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(F.col(spans), lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))


MASK = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


def sanitised(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Findings replaced by their kind; disclosing terms generalised to their shape if they hold digits, else removed.

    Overlapping findings (a card within a phone) become one, named by the first.
    """
    out, at = [], 0
    for s, e, kind in sorted(spans):
        if s >= at:
            out += [text[at:s], MASK[kind] if kind in MASK else (DIGITS.sub("0", text[s:e]) if DIGITS.search(text[s:e]) else "")]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _sanitise(text_at: int, spans_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [
                t if not s else sanitised(t, [(x["start"], x["end"], x["kind"]) for x in s])
                for t, s in zip(batch.column(text_at).to_pylist(), batch.column(spans_at).to_pylist())
            ]
            cols = [c for i, c in enumerate(batch.columns) if i != spans_at]
            cols[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, [n for i, n in enumerate(batch.schema.names) if i != spans_at])

    return run


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with findings masked and disclosing terms generalised or removed; same columns, same rows.

    Only rows with findings meet their spans in a join; a row's spans depend on its id and text alone, so repeated rows share them.
    """
    names = docs.columns
    doc, text, key, every = unused(docs, "span_doc", "span_text", "row_text", "every_span")
    spans = findings(docs, **options).select("doc_id", "text_key", F.concat("spans", "terms").alias(every)).where(F.size(every) > 0)
    spans = stored(spans.dropDuplicates(["doc_id", "text_key"]), "spans", thin=True).select(F.col("doc_id").alias(doc), F.col("text_key").alias(text), every)
    keyed = whole_texts(docs).withColumn(key, text_key())
    joined = keyed.join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(text)), "left")
    joined = joined.select(*[f"`{c}`" for c in names], every)
    return joined.mapInArrow(_sanitise(names.index("text"), len(names)), docs.schema)
