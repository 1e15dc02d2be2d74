"""License scans by canonical digest lookup.

A text is brought to a canonical form line by line (case, copyright notices, list marks, equivalent spellings, then punctuation and white
space, which go) and known licences are a small table of digests of such forms. What can be a licence is a whole run of lines: the document, or
some consecutive lines of it, however they are wrapped and whatever stands before and behind them. A run can only be a known text if it begins as one does
and ends, as many characters later, at the end of a line; such runs are hashed whole, and a hash join finds the licence.

Only DataFrame functions run on the texts. The registry is made of this module's notices and of the files in ``licence_texts``, a few hundred rows,
which bounds its broadcast. Long texts are registered with and without their first paragraph (the title) and what follows their terms.

Defined cases: null and empty texts have no licence; repeated rows each get their rows; a licence that stands in a document
more than once is one finding with a count, and of known texts of one licence that begin on the same line the longest counts; a line that begins
with "copyright" and neither a sign, a digit nor a name in brackets behind it is text; a word cut in two by a hyphen at a line's end is whole, but if it
has an equivalent spelling, that isn't seen; documents without licences give no finding rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that licence matching guidelines treat as equal, word by word.
EQUIVALENT = {
    "licence": "license", "licenced": "licensed", "licences": "licenses", "sublicence": "sublicense", "acknowledgement": "acknowledgment", "analogue": "analog",
    "authorisation": "authorization", "authorised": "authorized", "cancelled": "canceled", "centre": "center", "favour": "favor", "holder": "owner", "holders": "owners",
    "https": "http", "organisation": "organization", "recognise": "recognize", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}

#: Short public notices, by SPDX identifier. {v} stands for a version of the list behind it.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "GPL-2.0-only": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "ISC": ["Licensed under the ISC License.", "Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "MPL-2.0": ["Licensed under the Mozilla Public License, Version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "CC0-1.0": ["Licensed under CC0 1.0.", "Dedicated to the public domain under CC0 1.0."],
}
#: Creative Commons notices follow a rule: "Licensed under CC <terms> <version>."
COMMONS = [(f"CC-{t}-{v}", f"{lead} CC {t} {v}.") for t in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND") for v in ("2.0", "3.0", "4.0") for lead in ("Licensed under", "This work is licensed under")]

#: The canonical form of a line as a list of (pattern, replacement), applied in order to the lower-cased line; the same in Python, Java and RE2.
STEPS = [
    (r"^[^a-z0-9]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]|\[|<|\{)|\(c\)[ \t]*[0-9]|©|all rights reserved[^a-z0-9]*$).*$", ""),  # copyright notices
    (r"^[^a-z0-9(]*\(?(?:[0-9]{1,2}|[a-z])[.)][ \t]+", ""),  # list marks
    *((rf"\b{a}\b", b) for a, b in EQUIVALENT.items()),
    (r"[^a-z0-9]+", ""),  # punctuation and white space
]
#: Ends of lines.
BREAK = r"\r\n|\r|\n"
#: Canonical characters by which a run is recognised as a possible beginning of a known text.
HEAD = 16
#: Words of which every known text holds one in its canonical form; nothing that the form removes can stand inside a word.
MARK = r"(?i)licen[cs]e|permission|permitted|public[^a-z0-9]+domain|recipients"


def canonical_line(line: str) -> str:
    line = line.lower()
    for pattern, new in STEPS:
        line = re.sub(pattern, new, line, flags=re.ASCII)
    return line


def canonical_text(text: str) -> str:
    return "".join(map(canonical_line, re.split(BREAK, text)))


def canonical(line: Column) -> Column:
    out = F.lower(line)
    for pattern, new in STEPS:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(new))
    return out


@cache
def texts() -> list[tuple[str, str]]:
    """(licence, text) of all known texts: notices, whole texts, and these without title and without what follows the terms."""
    known = [*((k, t) for k, ts in NOTICES.items() for t in ts), *COMMONS]
    for path in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
        text = path.read_text().strip("\n\f")
        for whole in (text, re.split(r"(?i)end of terms and conditions", text)[0]):
            blocks = re.split(r"\n\s*\n", whole, maxsplit=1)
            known += [(path.stem, whole), *((path.stem, x) for x in blocks[1:])]
    return known


@cache
def registry() -> list[tuple[str, str, str, int]]:
    """(digest, licence, head, characters) of every known text; texts with the same digest share the first licence."""
    known: dict[str, tuple[str, str, str, int]] = {}
    for name, text in texts():
        form = canonical_text(text)
        known.setdefault(digest := hashlib.sha256(form.encode()).hexdigest(), (digest, name, form[:HEAD], len(form)))
    return sorted(known.values())


def registry_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(registry(), "digest string, license string, head string, size int")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, license, unit (document, block of lines, line), occurrences: known licences found as whole runs of lines."""
    known = registry_table(docs.sparkSession)
    heads = sorted({r[2] for r in registry()})
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike(MARK))
    lines = F.filter(F.transform(F.split("text", BREAK), canonical), lambda x: x != "")
    # the beginnings of all runs, each from as many lines as it can take; lines are not empty, so HEAD of them are enough
    head = lambda i: F.substring(F.concat_ws("", F.slice("lines", i, F.lit(HEAD))), 1, HEAD)
    begins = F.filter(F.transform(F.sequence(F.lit(1), F.size("lines")), lambda i: F.struct(i.alias("at"), head(i).alias("head"))), lambda x: x["head"].isin(heads))
    sizes = F.create_map(*[x for h in heads for x in (F.lit(h), F.array(*[F.lit(n) for n in sorted({r[3] for r in registry() if r[2] == h})]))])
    # the row's own number keeps repeated rows apart
    held = marked.select(F.monotonically_increasing_id().alias("row"), "doc_id", lines.alias("lines")).where(F.size("lines") > 0)
    starts = held.withColumn("b", F.explode(begins)).select("row", "doc_id", "lines", F.col("b.at").alias("at"), F.col("b.head").alias("head"))
    rest = F.slice("lines", F.col("at"), F.size("lines"))
    ends = F.aggregate(rest, F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars"), F.lit(0).alias("upto")), lambda s, x: F.struct(
        (s["n"] + 1).alias("n"), (s["chars"] + F.length(x)).alias("chars"), F.when(s["chars"] + F.length(x) == F.col("size"), s["n"] + 1).otherwise(s["upto"]).alias("upto")))
    runs = starts.withColumn("size", F.explode(sizes[F.col("head")])).withColumn("n", ends["upto"]).where("n > 0")
    body = F.concat_ws("", F.slice("lines", F.col("at"), F.col("n")))
    unit = F.when(F.col("n") == F.size("lines"), "document").when(F.col("n") == 1, "line").otherwise("block")
    runs = runs.select("row", "doc_id", "at", "n", unit.alias("unit"), F.sha2(body, 256).alias("digest"))
    found = runs.join(F.broadcast(known.select("digest", "license")), "digest")
    longest = found.groupBy("row", "doc_id", "license", "at").agg(F.max_by("unit", "n").alias("unit"))
    return longest.groupBy("row", "doc_id", "license", "unit").agg(F.count("*").alias("occurrences")).drop("row")


def oracle_sql() -> str:
    """DuckDB SQL of ``find`` over ``documents``: every run of lines as long as a known text is hashed, wherever it begins."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    form = "lower(line)"
    for pattern, new in STEPS:
        form = f"regexp_replace({form}, {quoted(pattern)}, {quoted(new)}, 'g')"
    values = ", ".join(f"({quoted(d)}, {quoted(n)}, {size})" for d, n, _, size in registry())
    return rf"""WITH known(digest, license, size) AS (VALUES {values}),
split_ AS (SELECT doc_id, row_number() OVER () AS row_, unnest(regexp_split_to_array(text, '{BREAK}')) AS line, generate_subscripts(regexp_split_to_array(text, '{BREAK}'), 1) AS i
           FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, row_, row_number() OVER (PARTITION BY row_ ORDER BY i) AS i, form FROM (SELECT doc_id, row_, i, {form} AS form FROM split_) WHERE form <> ''),
placed AS (SELECT *, sum(length(form)) OVER (PARTITION BY row_ ORDER BY i)::BIGINT AS upto, count(*) OVER (PARTITION BY row_) AS n FROM lines),
whole AS (SELECT row_, string_agg(form, '' ORDER BY i) AS body FROM lines GROUP BY row_),
ends AS (
  SELECT a.doc_id, a.row_, a.i, b.i - a.i + 1 AS many, a.n, a.upto - length(a.form) AS skip, size
  FROM placed a, (SELECT DISTINCT size FROM known) s JOIN placed b ON b.row_ = a.row_ AND b.upto = a.upto - length(a.form) + size),
found AS (
  SELECT doc_id, row_, i, license, max_by(CASE WHEN many = n THEN 'document' WHEN many = 1 THEN 'line' ELSE 'block' END, many) AS unit
  FROM ends JOIN whole USING (row_) JOIN known ON digest = sha256(substr(body, (skip + 1)::INT, ends.size)) GROUP BY ALL)
SELECT doc_id, license, unit, count(*) AS occurrences FROM found GROUP BY row_, doc_id, license, unit"""
