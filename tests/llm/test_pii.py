import hashlib
import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hitstream.llm import pii
from hitstream.llm.queries import op8_pii, table


def slow_spans(text):
    """The contract read literally."""
    pats = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    out = [(m.start(), k, m.end(), kind) for k, (kind, p, ok) in enumerate(pats) for m in re.finditer(p, text) if ok(m[0])]
    return [(s, e, kind) for s, _, e, kind in sorted(out)]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab1240+@.- ()é\n", max_size=60))
def test_base_spans_are_the_contracts(text):
    assert pii.base_spans(text) == slow_spans(text)


@pytest.mark.parametrize("text", ["a@b@c.com x@y.z@w.q", "4111 1111 1111 1111", "1.2.3.4.5.6.7.8", "+1 (955) 555-0330", "é a@b.c", "0" * 50 + ".1.1.1", "@@a.b@c.d", "a" * 9 + "@"])
def test_examples(text):
    assert pii.base_spans(text) == slow_spans(text)


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()


def test_query_against_brute_force(spark, medium):
    rows = {r.doc_id: r for r in op8_pii(spark, medium).collect()}
    docs = table(spark, medium, "documents").collect()
    assert len(rows) == len(docs)
    for d in docs:
        spans, r = slow_spans(d.text or ""), rows[d.doc_id]
        assert r.base_sha256 == digest(spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for *_, k in spans) for x in pii.KINDS]
        assert {f"{k}:{s}:{e}" for s, e, k in spans} <= set(r.spans.split(","))
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows.values()) > 50


def brute_terms(texts):
    """Terms that give away 0.9 of an entity's information on three different lines, counted over all different lines."""
    word = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
    holds, near, own = {}, {}, {}
    for text in texts:
        spans = slow_spans(text)
        at = 0
        for line in text.split("\n"):
            if line:
                holds[line] = {m[0].lower() for m in word.finditer(line)}
            free = [(at + m.start(), m[0].lower()) for m in word.finditer(line) if not any(s < at + m.end() and at + m.start() < e for s, e, _ in spans)]
            for s, e, kind in spans:
                if at <= s < at + len(line):
                    value = text[s:e].lower() if kind == "email" else re.sub(r"[^0-9.]" if kind == "ip" else r"[^0-9]", "", text[s:e])
                    before, after = [w for p, w in free if p < s], [w for p, w in free if p >= s]
                    for w in before[-8:] + after[:8]:
                        near.setdefault(((kind, value), w), set()).add(line)
                        own.setdefault((kind, value), set()).add(line)
            at += len(line) + 1
    total, found = len(holds), set()
    for (entity, term), lines in near.items():
        of_entity, of_term = len(own[entity]), sum(term in h for h in holds.values())
        if len(lines) >= 3 and of_entity < total:
            share = math.log(len(lines) * total / (of_entity * of_term)) / math.log(total / of_entity)
            if share >= 0.9:
                found.add(term)
    return found, word


def test_term_spans_against_brute_force(spark, small):
    """The query over its table, with more documents in which some terms reveal some values, a third of them copies."""
    lines = [f"{w} agent {a} writes from {m} now {w}" for k, (a, m) in enumerate([("brzlt", "b.z@x.org"), ("krzlt", "10.1.2.3"), ("the", "c@x.org")]) for w in "one two three four five".split()]
    added = [(10_000 + i, lines[i % len(lines)] + "\n" + ("brzlt rests" if i % 4 else "rest")) for i in range(60)]
    docs = table(spark, small, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(added, "doc_id long, text string"))
    rows = {r.doc_id: r for r in pii.findings(docs).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    terms, word = brute_terms(texts.values())
    assert {"brzlt", "krzlt"} <= terms and "the" not in terms
    for i, text in texts.items():
        spans = slow_spans(text)
        want = {(m.start(), m.end()) for m in word.finditer(text) if m[0].lower() in terms and not any(s < m.end() and m.start() < e for s, e, _ in spans)}
        assert {(t.start, t.end) for t in rows[i].terms} == want


LINES = [f"{a} {b} wrote zorblatt{'' if i % 2 else ''} the {a} report mail qx.7@mail.example.com about {b} {c}" for i, (a, b, c) in enumerate([("red", "fox", "one"), ("blue", "hen", "two"), ("green", "cow", "three"), ("black", "cat", "four")])]


def test_terms_that_reveal_an_entity_are_found_and_others_are_not(spark):
    noise = [f"the report about a {w} wrote mail to nobody number{i}" for i, w in enumerate("red blue green black fox hen cow cat".split() * 30)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*LINES, *noise, "zorblat is another word", None, ""])], "doc_id long, text string")
    out = {r.doc_id: r for r in pii.findings(docs).collect()}
    for i, line in enumerate(LINES):
        assert {line[t.start : t.end] for t in out[i].terms} == {"zorblatt"}
    assert all(not out[i].terms and not out[i].spans for i in range(len(LINES), len(out)))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert all("zorblatt" not in clean[i] and "[EMAIL]" in clean[i] and "qx.7" not in clean[i] for i in range(len(LINES)))
    assert all(clean[i + len(LINES)] == t for i, t in enumerate(noise)) and clean[len(out) - 2] is None


def test_copies_are_no_evidence(spark):
    docs = spark.createDataFrame([(i, LINES[0]) for i in range(40)], "doc_id long, text string")
    assert not [r for r in pii.findings(docs).collect() if r.terms]


def test_copies_of_every_document_change_no_term(spark):
    texts = [*LINES, *(f"the report wrote mail about number{i} by nobody" for i in range(60))]
    few = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    many = spark.createDataFrame([(100 * i + k, t) for i, t in enumerate(texts) for k in range(50 if i < len(LINES) else 1)], "doc_id long, text string")
    flagged = [{(r.entity, r.term) for r in pii.disclosing(d, pii.detect(d)).collect()} for d in (few, many)]
    assert flagged[0] == flagged[1] == {("email:qx.7@mail.example.com", "zorblatt")}


def test_disclosing_terms_go_wherever_they_stand(spark):
    far = "qx.7@mail.example.com " + "so it went on " * 4 + "Zorblatt said\nand zorblatt went"
    lines = [f"note{i} zorblatt qx.7@mail.example.com item{i}" for i in range(20)]
    texts = [*lines, far, "nobody else but zorblatt", "a@zorblatt.org", *(f"the report wrote mail about number{i} by nobody" for i in range(900))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r.doc_id: [texts[r.doc_id][t.start : t.end] for t in sorted(r.terms)] for r in pii.findings(docs).collect()}
    assert out[20] == ["Zorblatt", "zorblatt"] and out[21] == ["zorblatt"] and out[22] == []
    assert all(out[i] == ["zorblatt"] for i in range(20)) and not any(out[i] for i in range(23, len(texts)))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert not any("zorblatt" in t.lower() for t in clean.values())


def test_sanitised_spans_overlap():
    text = "+14111 1111 1111 1112 x1y"
    assert pii.sanitised(text, [(0, 21, "phone"), (1, 21, "card"), (22, 25, "term")]) == "[PHONE] x0y"


def test_odd_rows_and_empty(spark, odd, empty):
    assert pii.findings(odd).count() == 10 and pii.findings(empty).count() == 0
    assert sorted(pii.sanitise(odd).collect(), key=str) == sorted(odd.collect(), key=str)
    assert pii.sanitise(empty).columns == empty.columns
