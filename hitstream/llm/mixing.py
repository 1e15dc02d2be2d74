"""Temperature mixing of sources.

Source token shares p become weights proportional to p**alpha. The exponent is bisected over [0, 1]: the
largest one whose weights reach a target entropy (given as a share of the greatest possible, log of the number of
sources), or, without a target, the smallest; it is raised until no source is repeated more than ``max_epochs``
times. Weights become budgets, and each source's budget is met by passes over a fresh permutation of its
documents, all of them dealt into blocks that each hold the sources in proportion.

The repetition limit holds for a budget of the caller's too; one beyond ``max_epochs`` times all tokens is an error. Without a budget in tokens the smallest one is taken at which every source is seen whole at least once, so that
mixing repeats small sources and leaves no document out.

Tokens are words between ASCII white space, at least 1 a document, or a column of the caller's (``tokens``, such as counts by a tokenizer). Only a table with one row a
source reaches the solver, and it is aggregated there, not collected. A source of any size is cut into hash ranges of
about ``RANGE`` documents; running totals within a range and over the ranges' totals give each document
its place, so no task orders a whole source.

Defined cases: a null source is a source of its own; null and empty texts have one token, so that every row has a place;
rows that agree in id, source and text (null differs from empty) are repeats and travel together; a document belongs to a pass if it begins
within the budget; an empty table gives an empty mixture; other columns are carried along, but those named like a column of the result give way to it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hitstream.llm.common import stored

MAX_EPOCHS = 2.0
SEED = 17
#: Documents that a hash range of a source holds on average.
RANGE = 4096
#: Tokens of one block of the mixture.
BLOCK_TOKENS = 1 << 20
#: The exponent is a multiple of 2**-STEPS.
STEPS = 20
#: Bisections made in one pass over the source table (2**GROUP - 1 inner points at once).
GROUP = 5


def words(text: str = "text") -> Column:
    """Words between ASCII white space, at least 1."""
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")


def source_totals(docs: DataFrame, source: str = "source", tokens: str = "tokens") -> DataFrame:
    """source, n (tokens), docs: one row a source; partial sums are combined before the shuffle."""
    return docs.groupBy(F.col(source).alias("source")).agg(F.sum(tokens).cast("long").alias("n"), F.count("*").alias("docs"))


def _grid_fits(totals: DataFrame, grid: list[int], target: float | None, max_epochs: float, budget: int | None = None) -> tuple[list[bool], list[bool]]:
    """For each exponent of the grid: is the entropy at least the target, are repetitions within the limit.

    With Z the sum of n**a, entropy is log Z - a * sum(n**a log n) / Z; with a budget that sees each source at
    least once, a source is repeated (N / n)**(1 - a) times, N the largest source's tokens; with a budget B it is B * n**(a - 1) / Z times.
    """
    n, logn = F.col("n").cast("double"), F.log(F.col("n").cast("double"))
    parts = [x for i, g in enumerate(grid) for x in (F.sum(F.pow(n, F.lit(g / 2**STEPS))).alias(f"z{i}"), F.sum(F.pow(n, F.lit(g / 2**STEPS)) * logn).alias(f"l{i}"))]
    r = totals.agg(F.count("*").alias("k"), F.max("n").alias("top"), F.min("n").alias("low"), *parts).first()
    entropy, epochs = [], []
    for i, g in enumerate(grid):
        a, z, spread = g / 2**STEPS, r[f"z{i}"], r[f"l{i}"]
        entropy.append(target is None or math.log(z) - a * spread / z >= target * math.log(max(r.k, 1)) - 1e-12)
        times = (r.top / r.low) ** (1 - a) if budget is None else budget * r.low ** (a - 1) / z
        epochs.append(times <= max_epochs + 1e-9)
    return entropy, epochs


def solve_exponent(totals: DataFrame, target_entropy: float | None = None, max_epochs: float = MAX_EPOCHS, budget: int | None = None) -> float:
    """The exponent, by bisection in groups: each pass over the totals tests 2**GROUP - 1 points at once.

    Entropy falls and repetition falls as the exponent grows. Target: the largest exponent with enough entropy
    (0 if none). Limit: the smallest exponent within it. The limit wins where both can't hold.
    """

    def search(test, want_last: bool) -> int:
        low, width = 0, 1 << STEPS  # the answer is in [low, low + width]
        if test([1 << STEPS])[0] if want_last else test([0])[0]:
            return width if want_last else 0
        while width > 1:
            step = max(1, width >> GROUP)
            grid = list(range(low + step, low + width, step))
            held = test(grid)
            k = sum(held) if want_last else len(held) - sum(held)  # monotone: points before the change
            low, width = low + k * step, step
        return low if want_last else low + 1

    best = 0
    if target_entropy is not None:
        best = search(lambda g: _grid_fits(totals, g, target_entropy, max_epochs)[0], True)
    if budget is not None and not _grid_fits(totals, [1 << STEPS], None, max_epochs, budget)[1][0]:
        raise ValueError(f"a budget of {budget} tokens repeats every source more than {max_epochs} times")
    least = search(lambda g: _grid_fits(totals, g, target_entropy, max_epochs, budget)[1], False)
    return max(best, least) / 2**STEPS


def weigh(totals: DataFrame, exponent: float, budget: int | None = None) -> DataFrame:
    """totals with weight (sums to 1) and budget (tokens of the mixture from this source)."""
    power = F.pow(F.col("n").cast("double"), F.lit(exponent))
    r = totals.agg(F.sum(power).alias("z"), F.max(F.col("n") / power).alias("most")).first()
    z = r.z or 1.0
    # the smallest budget at which each source's part is its own size at least
    total = float(budget) if budget is not None else (r.most or 0.0) * z
    part = F.round(power * F.lit(total / z)).cast("long")
    return totals.withColumn("weight", power / F.lit(z)).withColumn("budget", part if budget is not None else F.greatest(part, F.col("n")))


def row_key() -> Column:
    """Digest of id, source and text, each behind its length (null: a mark); rows that agree in all three are repeats and share it."""
    parts = [F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in ("doc_id", "source", "text")]
    return F.md5(F.concat(*parts).cast("binary"))


def _number(digest: Column) -> Column:
    """The first 60 bits of a hex digest as a long."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def mixed_rows(
    docs: DataFrame,
    target_entropy: float | None = None,
    max_epochs: float = MAX_EPOCHS,
    budget: int | None = None,
    tokens: Column | None = None,
    seed: int = SEED,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """``docs`` in mixture: each row whole (a struct ``row``) with mix_epoch, mix_block and mix_rank (the order within a block).

    A row appears once for each pass that takes it. Only digests and token counts are ordered; the texts meet
    their passes at the end in one join on the row's key.
    """
    keyed = docs.select(row_key().alias("__key"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    plan = schedule(docs, target_entropy, max_epochs, budget, tokens, seed, block_tokens)
    return keyed.join(plan.select("__key", *PLACE), "__key").select("row", *PLACE)


#: What a mixture adds to a row.
PLACE = ("mix_epoch", "mix_block", "mix_rank")


def mix(docs: DataFrame, **options) -> DataFrame:
    """Columns of ``docs`` with mix_epoch, mix_block and mix_rank; options as of ``mixed_rows``."""
    names = [c for c in docs.columns if c.lower() not in PLACE]
    return mixed_rows(docs, **options).select(*[F.col("row").getField(c).alias(c) for c in names], *PLACE)


def schedule(
    docs: DataFrame,
    target_entropy: float | None = None,
    max_epochs: float = MAX_EPOCHS,
    budget: int | None = None,
    tokens: Column | None = None,
    seed: int = SEED,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """__key, doc_id, source, copies, tokens, mix_epoch, mix_block, mix_rank: one row a distinct row and pass.

    Repeats of a row travel together: ``tokens`` counts all ``copies`` of them.
    """
    thin = docs.select(row_key().alias("__key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), (words() if tokens is None else tokens).alias("t"))
    rows = thin.groupBy("__key", "doc_id", "source").agg(F.count("*").alias("copies"), F.sum("t").cast("long").alias("tokens"))
    rows = stored(rows, "mix", thin=True)
    totals = stored(source_totals(rows), "totals", thin=True)
    if not totals.take(1):
        return rows.select("*", *[F.lit(0).cast("long").alias(c) for c in ("mix_epoch", "mix_block", "mix_rank")])
    weights = stored(weigh(totals, solve_exponent(totals, target_entropy, max_epochs, budget), budget), "weights", thin=True)
    blocks = max(1, math.ceil(weights.agg(F.sum("budget").alias("b")).first().b / block_tokens))
    per = weights.select(
        F.col("source").alias("s"), "n", F.col("budget").alias("part"), F.greatest(F.lit(1), F.ceil(F.col("docs") / RANGE)).cast("long").alias("ranges")
    )
    joined = rows.join(per, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    last = F.greatest(F.ceil(F.col("part") / F.col("n")).cast("long") - 1, F.lit(0))
    each = joined.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    each = each.withColumn("draw", _number(F.md5(F.concat_ws(":", F.lit(seed), "mix_epoch", "__key").cast("binary"))))
    each = each.withColumn("range", F.floor(F.col("draw") / F.lit(float(1 << 60)) * F.col("ranges")).cast("long"))
    own = ["source", "mix_epoch", "range"]
    ranges = each.groupBy(*own).agg(F.sum("tokens").alias("t"))
    before = Window.partitionBy("source", "mix_epoch").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = ranges.select(*[F.col(c).alias(f"_{c}") for c in own], F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*own).orderBy("draw", "__key").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn("ahead", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    on = F.col("source").eqNullSafe(F.col("_source")) & (F.col("mix_epoch") == F.col("_mix_epoch")) & (F.col("range") == F.col("_range"))
    placed = placed.join(base, on).withColumn("start", F.col("mix_epoch") * F.col("n") + F.col("base") + F.col("ahead"))
    kept = placed.where(F.col("start") < F.col("part"))
    block = F.floor(F.col("start").cast("double") * F.lit(blocks) / F.col("part")).cast("long")
    rank = _number(F.md5(F.concat_ws(":", F.lit(seed), F.lit("rank"), "mix_epoch", "__key").cast("binary")))
    return kept.select("__key", "doc_id", "source", "copies", "tokens", "mix_epoch", block.alias("mix_block"), rank.alias("mix_rank"))


def oracle_sql(target_entropy: float, max_epochs: float = MAX_EPOCHS, seed: int = SEED, block_tokens: int = BLOCK_TOKENS) -> str:
    """DuckDB SQL of the schedule of ``documents`` with a target entropy and a repetition limit; the exponent from a grid of all its values."""
    unit = 1 << STEPS
    return rf"""WITH rows_ AS (
  SELECT key, doc_id, source, count(*) AS copies, sum(t)::BIGINT AS tokens FROM (
    SELECT md5(concat(coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-'), coalesce(strlen(source)::VARCHAR || ':' || source, '-'),
           coalesce(strlen(text)::VARCHAR || ':' || text, '-'))) AS key, doc_id, source,
           greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))) AS t FROM documents) GROUP BY ALL),
totals AS (SELECT source, sum(tokens)::BIGINT AS n FROM rows_ GROUP BY source),
spread AS (SELECT max(n)::DOUBLE / min(n) AS r FROM totals),
grid AS (SELECT hi.i * 1024 + lo.i AS g FROM range(0, 1024) AS hi(i), range(0, 1024) AS lo(i) UNION ALL SELECT {unit}),
entropies AS (
  SELECT g, ln(sum(pow(n::DOUBLE, g / {unit}.0::DOUBLE))) - g / {unit}.0::DOUBLE * sum(pow(n::DOUBLE, g / {unit}.0::DOUBLE) * ln(n::DOUBLE)) / sum(pow(n::DOUBLE, g / {unit}.0::DOUBLE)) AS h,
         ln(count(*)) AS most FROM grid, totals GROUP BY g),
solved AS (
  SELECT greatest((SELECT coalesce(max(g), 0) FROM entropies WHERE h >= {target_entropy}::DOUBLE * most - 1e-12),
                  (SELECT min(g) FROM grid, spread WHERE pow(r, 1 - g / {unit}.0::DOUBLE) <= {max_epochs}::DOUBLE + 1e-9)) / {unit}.0::DOUBLE AS a),
powers AS (SELECT source, n, pow(n::DOUBLE, a) AS w FROM totals, solved),
sums AS (SELECT sum(w) AS z, max(n / w) AS most FROM powers),
budgets AS (SELECT source AS s, n, greatest(n, round(w * (most * z / z))::BIGINT) AS part FROM powers, sums),
blocks AS (SELECT greatest(1, ceil(sum(part) / {block_tokens}.0))::BIGINT AS b FROM budgets),
passes AS (
  SELECT r.*, n, part, e.i AS mix_epoch, ('0x' || substr(md5(concat_ws(':', '{seed}', e.i::VARCHAR, key)), 1, 15))::BIGINT AS draw
  FROM rows_ r JOIN budgets ON source IS NOT DISTINCT FROM s, range(0, {math.ceil(max_epochs) + 1}) AS e(i) WHERE e.i * n < part),
placed AS (
  SELECT *, mix_epoch * n + coalesce(sum(tokens) OVER (
    PARTITION BY source, mix_epoch ORDER BY draw, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM passes)
SELECT doc_id, source, copies::BIGINT AS copies, tokens, mix_epoch::BIGINT AS mix_epoch, floor(start::DOUBLE * b / part)::BIGINT AS mix_block,
       ('0x' || substr(md5(concat_ws(':', '{seed}', 'rank', mix_epoch::VARCHAR, key)), 1, 15))::BIGINT AS mix_rank
FROM placed, blocks WHERE start < part"""
