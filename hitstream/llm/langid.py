"""Language identification by hierarchical discrimination.

First the language family is predicted by linear support vector machines, one family against the rest; then
one-versus-one machines vote between the closely related languages of that family. Features are counts of
byte n-grams (1 to 3 bytes of the lower-cased text) hashed into a fixed number of columns, square-rooted and
scaled to length one, so a text of any length is one short vector.

Only the training sample is bounded (``SAMPLE`` labelled texts in all, an equal share for each language,
drawn by a hash of the text so that copies count as one draw); prediction reads every whole text.

Defined cases: a null text, or one without any letter, is ``und`` with score 0; rows without a label are
predicted but never learned from; without any labelled text everything is ``und``; repeated rows get the same
answer; a corpus with one language predicts it with score 1; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitstream.llm.common import unused, whole_texts

#: Labelled texts that a model is fitted on, in all; a documented bound.
SAMPLE = 4000
#: Columns that byte n-grams hash into.
COLUMNS = 2048
#: A prediction scoring less is rejected by ``accepted``. Undecided at both levels is 0.25; short clean texts score 0.3 and more.
LEAST_SCORE = 0.3

#: Families of common languages by ISO 639-1 code. Others are families of their own.
FAMILIES = {
    "germanic": "af da de en is nb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indic": "bn gu hi mr ne pa si ur",
    "turkic": "az kk ky tk tr tt ug uz",
    "uralic": "et fi hu",
    "semitic": "am ar he mt",
    "austronesian": "id jv ms su tl",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return FAMILY.get(lang.lower().split("-")[0].split("_")[0], lang)


def features(text: str, columns: int = COLUMNS) -> np.ndarray:
    """Hashed counts of byte 1- to 3-grams, square-rooted, of length one."""
    data = np.frombuffer(text.lower().encode(), dtype=np.uint8)
    counts = np.zeros(columns, dtype=np.float32)
    for at in range(0, len(data), 1 << 20):  # bounded memory for texts of any length
        b = data[at : at + (1 << 20) + 2].astype(np.uint32)
        n = min(len(b), 1 << 20)
        for size in (1, 2, 3):
            if len(b) >= size:
                code = b[: len(b) - size + 1] * np.uint32(size)
                for k in range(1, size):
                    code = code * np.uint32(0x01000193) + b[k : len(b) - size + 1 + k]
                code = code[:n] * np.uint32(0x9E3779B1)
                counts += np.bincount(code >> np.uint32(32 - (columns.bit_length() - 1)), minlength=columns)
    np.sqrt(counts, out=counts)
    norm = np.linalg.norm(counts)
    return counts / norm if norm else counts


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 25) -> np.ndarray:
    """Linear machine with squared hinge loss (weights and, last, a bias) by Newton steps on its support.

    y holds 1 and -1; both sides weigh the same in total.
    """
    cost = np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y < 0).sum())) * c * len(y) / 2
    w = np.zeros(x.shape[1] + 1)
    # the bias stands apart, so that the sample is never copied
    at = lambda v: (x @ v[:-1].astype(x.dtype)).astype(np.float64) + v[-1]
    back = lambda u: np.append((u.astype(x.dtype) @ x).astype(np.float64), u.sum())
    value = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - y * at(v)) ** 2).sum()
    now = value(w)
    for _ in range(rounds):
        out = at(w)
        on = np.where(y * out < 1, cost, 0.0)
        grad = w + 2 * back(on * (out - y))
        if np.linalg.norm(grad) < 1e-6 * max(1, now):
            break
        step = -_solve(at, back, on, grad)
        t = 1.0
        while (new := value(w + t * step)) > now + 1e-4 * t * (grad @ step) and t > 1e-6:
            t /= 2
        if now - new < 1e-9 * max(1, now):
            break
        w, now = w + t * step, new
    return w.astype(np.float32)


def _solve(at, back, on: np.ndarray, grad: np.ndarray, rounds: int = 60) -> np.ndarray:
    """(I + 2 X'CX) d = grad by conjugate gradients; ``on`` holds the costs of the support and 0 elsewhere."""
    d, r = np.zeros_like(grad), grad.copy()
    p, rr = r.copy(), r @ r
    stop = 1e-8 * rr
    for _ in range(rounds):
        q = p + 2 * back(on * at(p))
        a = rr / (p @ q)
        d += a * p
        r -= a * q
        new = r @ r
        if new <= stop:
            break
        p, rr = r + new / rr * p, new
    return d


@dataclass
class Model:
    """Weights of every machine as one matrix; small: languages times COLUMNS floats, whatever the corpus."""

    families: list[str] = field(default_factory=list)
    members: list[list[str]] = field(default_factory=list)
    heads: np.ndarray | None = None
    pairs: list[list[tuple[int, int, np.ndarray]]] = field(default_factory=list)

    @staticmethod
    def fit(x: np.ndarray, langs: list[str]) -> Model:
        if not langs:
            return Model()
        lang, fam = np.array(langs), np.array([family(v) for v in langs])
        model = Model(sorted(set(fam.tolist())))
        model.members = [sorted(set(lang[fam == f].tolist())) for f in model.families]
        heads = [svm(x, np.where(fam == f, 1.0, -1.0)) for f in model.families] if len(model.families) > 1 else []
        model.heads = np.stack(heads) if heads else None
        for names in model.members:
            own = []
            for i, a in enumerate(names):
                for j in range(i + 1, len(names)):
                    on = (lang == a) | (lang == names[j])
                    own.append((i, j, svm(x[on], np.where(lang[on] == a, 1.0, -1.0))))
            model.pairs.append(own)
        return model

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score in 0..1: how sure the family is, times how sure the pairwise votes are."""
        x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
        sure = np.ones(len(x))
        pick = np.zeros(len(x), dtype=int)
        if self.heads is not None:
            value = x @ self.heads.T
            pick = value.argmax(axis=1)
            two = np.sort(value, axis=1)[:, -2:]
            sure = 1 / (1 + np.exp(-4 * (two[:, 1] - two[:, 0]) / 2))
        names = [""] * len(x)
        for f, own in enumerate(self.pairs):
            rows = np.flatnonzero(pick == f)
            if not len(rows):
                continue
            votes = np.zeros((len(rows), len(self.members[f])))
            margin = np.zeros_like(votes)
            for i, j, w in own:
                v = x[rows] @ w
                votes[:, i] += v >= 0
                votes[:, j] += v < 0
                margin[:, i] += v
                margin[:, j] -= v
            best = (votes + 1e-6 * np.tanh(margin)).argmax(axis=1)
            if own:
                mean = margin[np.arange(len(rows)), best] / (len(self.members[f]) - 1)
                sure[rows] *= 1 / (1 + np.exp(-4 * mean))
            for r, b in zip(rows, best):
                names[r] = self.members[f][b]
        return names, sure


def _feature_rows(columns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py(), columns).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], ["lang", "x"])

    return run


def fit(labelled: DataFrame, sample: int = SAMPLE, columns: int = COLUMNS) -> Model:
    """Fit on at most about ``sample`` labelled texts (columns text and lang).

    One aggregation counts the labels; texts whose hash falls below their language's share are turned into
    feature vectors where they lie, and only those (8 kB each) reach the driver.
    """
    usable = whole_texts(labelled).select("text", "lang").where("lang is not null and text rlike '\\\\p{L}'")
    counts = {r.lang: r.n for r in labelled.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model()
    share = max(1, sample // len(counts))
    rate = F.lit(0.0)
    for lang, n in counts.items():
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, share / n))).otherwise(rate)
    draw = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = usable.where(draw < rate).select("lang", "text").dropDuplicates(["lang", "text"])
    rows = drawn.mapInArrow(_feature_rows(columns), "lang string, x binary").collect()
    rows.sort(key=lambda r: (r.lang, bytes(r.x)))
    langs, x = [r.lang for r in rows], np.empty((len(rows), columns), np.float32)
    for i in range(len(rows) - 1, -1, -1):  # the collected rows go as the matrix fills
        x[i] = np.frombuffer(rows.pop().x, np.float32)
    return Model.fit(x, langs)


def _predictions(model: Model, columns: int, text: str, drop: bool, out: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, step = batch.num_rows, 256
            names, scores = ["und"] * n, np.zeros(n)
            texts = batch.column(batch.schema.get_field_index(text))
            for at in range(0, n, step):
                part = [(k, t) for k in range(at, min(n, at + step)) if model.families and (t := texts[k].as_py()) and any(map(str.isalpha, t))]
                if part:
                    found, sure = model.predict(np.stack([features(t, columns) for _, t in part]))
                    for (k, _), name, s in zip(part, found, sure):
                        names[k], scores[k] = name, s
            rest = [c for c in batch.schema.names if not (drop and c == text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(names, pa.string()), pa.array(scores)], [*rest, *out])

    return run


def predict(docs: DataFrame, model: Model, columns: int = COLUMNS, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default doc_id) with lang_pred and score; texts are read where they lie, nothing shuffles."""
    keep = keep or ["doc_id"]
    (text,) = unused(docs, "text_")
    thin = whole_texts(docs).select(*keep, F.col("text").cast("string").alias(text))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string", "score double"])
    return thin.mapInArrow(_predictions(model, columns, text, True, ["lang_pred", "score"]), schema)


def held_out(doc_id: str = "doc_id"):
    """True for the fold that is not learned from: CRC-32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def accepted(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """Rows of ``docs`` whose language is recognised: not ``und`` and scored ``least`` or more."""
    names = whole_texts(docs).columns
    lang, score = unused(docs, "lang_pred", "score")
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names), f"`{lang}` string", f"`{score}` double"])
    out = docs.mapInArrow(_predictions(model, COLUMNS, "text", False, [lang, score]), schema)  # the text goes through Python once
    return out.where((F.col(lang) != "und") & (F.col(score) >= least)).select(*[f"`{c}`" for c in names])
