import math
import re
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from hitstream.llm import langid, mixing, packing, pii, simhash
from hitstream.llm.common import stored
from hitstream.llm.queries import table, tokenizer_path
from tests.llm.test_pii import slow_spans


def as_rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def stages(spark, small):
    """Rows into and out of every stage."""
    docs, out = table(spark, small, "documents"), []
    for name, f in corpus_pipeline.STAGES:
        after = stored(f(spark, docs, small), name)
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def test_names_and_columns(stages):
    assert list(stages) == ["language", "simhash", "pii", "mixing", "packing"]
    for name, (before, after) in stages.items():
        assert name == "packing" or (after.columns == before.columns and after.schema == before.schema)


def test_language_against_single_predictions(spark, stages):
    before, after = stages["language"]
    model = langid.fit(before.where(~langid.held_out()))
    want = []
    for r in before.collect():
        if r.text and any(c.isalpha() for c in r.text):
            name, score = model.predict(langid.features(r.text)[None, :])
            if name[0] != "und" and score[0] >= langid.LEAST_SCORE:
                want.append(tuple(r))
    assert sorted(as_rows(after)) == sorted(want) and len(want) > 190


def test_simhash_against_brute_force(stages):
    """Jaccard similarity of five-word shingles of all pairs: one document of each group, up to the width of the estimate."""
    before, after = stages["simhash"]
    docs = sorted(before.collect(), key=lambda r: r.doc_id)
    kept = {r.doc_id for r in after.collect()}
    assert sorted(as_rows(after)) == sorted(tuple(r) for r in docs if r.doc_id in kept)
    sets = {r.doc_id: shingles(r.text) for r in docs}
    surely, maybe = grouped(sets, 0.85), grouped(sets, 0.7)
    assert len(set(maybe.values())) <= len(kept) <= len(set(surely.values())) < len(docs)
    for group in set(maybe.values()):  # a text that is alone stays
        assert any(maybe[i] == group for i in kept)
    for a in kept:
        assert not any(a != b and surely[a] == surely[b] for b in kept)


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def grouped(sets, least):
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both, any_ = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if (both / any_ if any_ else 1) >= least and top(a) != top(b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in ids}


def test_simhash_recall_at_given_similarities(spark):
    """Pairs of texts of 400 words with words substituted at random places until their shingles are that similar."""
    rng, rows, cases = np.random.default_rng(12), [], {0.8: [], 0.83: [], 0.9: [], 0.95: [], 0.7: []}
    for least, made in cases.items():
        for _ in range(60):
            a = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
            b, was = list(a), list(a)
            while len(shingles(" ".join(a)) & shingles(" ".join(b))) / len(shingles(" ".join(a)) | shingles(" ".join(b))) >= least:
                was = list(b)
                b[rng.integers(0, 400)] = f"v{rng.integers(0, 10**6)}"
            made.append(len(rows))
            rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(was))]
    kept = {r.doc_id for r in simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(i in kept for made in cases.values() for i in made)
    caught = {least: np.mean([i + 1 not in kept for i in made]) for least, made in cases.items()}
    print(caught)
    assert caught[0.8] >= 0.75 and caught[0.83] >= 0.95 and caught[0.9] == caught[0.95] == 1 and caught[0.7] <= 0.05


def test_pii_against_brute_force(stages):
    before, after = stages["pii"]
    new = {r.doc_id: r for r in after.collect()}
    terms = {r.doc_id: r for r in pii.findings(before).collect()}
    assert len(new) == before.count()
    for r in before.collect():
        text, at = [], 0
        for s, e, kind in sorted([*slow_spans(r.text), *((t.start, t.end, "term") for t in terms[r.doc_id].terms)]):
            if s >= at:
                word = r.text[s:e]
                shape = "".join("0" if c in "0123456789" else c for c in word)
                text += [r.text[at:s], f"[{kind.upper()}]" if kind != "term" else (shape if shape != word else "")]
            at = max(at, e)
        text = "".join([*text, r.text[at:]])
        assert new[r.doc_id].text == text and new[r.doc_id].n_chars == len(text)
        assert (new[r.doc_id].lang, new[r.doc_id].source) == (r.lang, r.source)
        assert not [s for s in slow_spans(text) if s[2] == "email"]


def test_mixing_against_brute_force(stages):
    before, after = stages["mixing"]
    docs, got = before.collect(), Counter(as_rows(after))
    n = Counter()
    for r in docs:
        n[r.source] += max(1, len(r.text.split()))
    top = max(n.values())
    assert set(got) == {tuple(r) for r in docs}
    for source, tokens in n.items():
        part = sum(c * max(1, len(r[1].split())) for r, c in got.items() if r[3] == source)
        # the smallest exponent with repetition within the limit: the smallest source is seen MAX_EPOCHS times
        a = 1 - math.log(mixing.MAX_EPOCHS) / math.log(top / min(n.values()))
        want = tokens * (top / tokens) ** (1 - max(0, a))
        assert want - 2 <= part <= want + max(len(r.text.split()) for r in docs if r.source == source) + 2


def test_mixing_writes_blocks_one_after_the_other(spark):
    """Each stretch of the result holds the sources in proportion, in the order of ranks within its block."""
    docs = spark.createDataFrame([(i, f"w{i} " * 6000, "en", "abc"[min(2, i % 5)], 1, 0) for i in range(400)], "doc_id long, text string, lang string, source string, n_chars long, spark_part int")
    order = [(r.mix_block, r.mix_rank, r.doc_id) for r in mixing.mix(docs).select("doc_id", "mix_block", "mix_rank").collect()]
    assert len({b for b, _, _ in order}) > 2
    got = [r.doc_id for r in corpus_pipeline.mixture(spark, docs, "").select("doc_id").collect()]
    assert got == [i for *_, i in sorted(order)]


def test_packing_against_brute_force(stages):
    before, after = stages["packing"]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for r in before.collect():
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids + [2]
        at = 0
        for n in packing.lengths(len(ids)):
            want[r.doc_id, at, n, np.array(ids[at : at + n], "<u4").tobytes()] += 1
            at += n
    assert Counter((r.doc_id, r.start, r.length, bytes(r.ids)) for r in after.collect()) == want


def test_run_is_the_stages(spark, small, stages):
    got = corpus_pipeline.run(spark, small).select("doc_id", "start", "length", "ids")
    assert Counter(as_rows(got)) == Counter(as_rows(stages["packing"][1].select("doc_id", "start", "length", "ids")))


def test_odd_rows_and_empty(spark, odd, empty, small):
    for docs, least in ((odd, 4), (empty, 0)):
        for name, f in corpus_pipeline.STAGES:
            before, docs = docs, stored(f(spark, docs, small), name)
            assert name == "packing" or docs.columns == before.columns
            if name != "packing" and least:
                assert docs.count() >= least
    one = corpus_pipeline.STAGES[1][1](spark, odd, small).collect()
    assert sorted(r.doc_id for r in one if r.doc_id in (1, 2)) == [1] and len([r for r in one if r.doc_id in (3, 4, 5)]) == 1


def test_clashing_columns(spark, small):
    """Columns named like anything that stages add to a row on its way."""
    names = "lang_pred score __score __lang_pred __text text_ spans every_span span_doc span_text row_text row kept_doc kept_key row_key first root fp sketch id mix_epoch mix_block mix_rank __key doc tokens n".split()
    text = "this is a short text of some words that anyone can read without any trouble at all"
    rows = [(i, f"{text} number {i} mail a{i}@example.org" if i % 3 else text, "en", "ab"[i % 2], 10, *[f"own {i}"] * len(names)) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for name, f in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stored(f(spark, docs, small), name)
        assert docs.columns == before.columns
        assert docs.count() and all(r[n] == f"own {r.doc_id}" for r in docs.collect() for n in names)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count()
