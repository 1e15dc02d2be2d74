"""Filters of a coincidence window: causality, template score, duplicates.

A window's hits come in order of (t, du). Pairs are the unit of two of the filters: their time differences against light
travel times decide causality, and their time differences against those of earlier events decide duplication.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Speed of light in air (m/s), score scale on read, DUs from which causality is not searched unless a configuration says otherwise.
LIGHT_M_S = 299_702_547.0
SCORE_SCALE = 65_536.0
BYPASS_DUS = 20
#: The longest time difference, and the cells of a block of compatibilities.
_LONGEST = (1 << 63) - 1
_CELLS = 1 << 20

Pairs = dict[tuple[int, int], int]


@dataclass
class FilterConfig:
    """All parameters stated; nothing is defaulted from elsewhere."""

    window: int
    nhit: int
    causal: bool = False
    tolerance: float = 0.0
    template: bool = False
    coefficient: float = 0.0
    duplicate: bool = False
    history: int = 10
    time_diff: int = 100
    min_pairs: int = 2
    canonical_sign: bool = False
    first_only: bool = False
    seed: list[Pairs] = field(default_factory=list)
    bypass: int | None = BYPASS_DUS  # from as many DUs a window is kept whole; None: every window is searched

    def __post_init__(self) -> None:
        if self.window < 0 or self.nhit < 1 or self.history < 0 or self.min_pairs < 1:
            raise ValueError("window and history must not be negative; nhit and min_pairs must be positive")


def light_ns(metres: float) -> float:
    return metres / LIGHT_M_S * 1e9


def pair_differences(du, t, canonical_sign: bool = False) -> Pairs:
    """Time differences by unordered DU pair; a pair that occurs again overwrites.

    The sign follows list order (earlier minus later); ``canonical_sign`` makes it smaller id minus larger.
    """
    du, t = np.asarray(du, dtype=np.int64), np.asarray(t, dtype=np.int64)
    back = np.arange(len(du))[::-1]
    ids, at = np.unique(du[back], return_index=True)
    last = back[at]  # of two DUs the last pair in list order joins the last hits of both, however many there are
    i, j = np.triu_indices(len(ids), 1)
    i, j = np.minimum(last[i], last[j]), np.maximum(last[i], last[j])
    again = np.delete(back, at)  # and of one DU its last two hits
    twice, at = np.unique(du[again], return_index=True)
    i, j = np.r_[i, again[at]], np.r_[j, last[np.searchsorted(ids, twice)]]
    diff = t[i] - t[j]
    if canonical_sign:
        diff = np.where(du[i] > du[j], -diff, diff)
    return dict(zip(zip(np.minimum(du[i], du[j]).tolist(), np.maximum(du[i], du[j]).tolist()), diff.tolist()))


def adjacency(du, t, distances: dict[tuple[int, int], float], tolerance: float) -> list[int]:
    """Bit sets: hits of different DUs with a known distance and a time difference light can explain."""
    bits = [0] * len(du)
    for i in range(len(du)):
        for j in range(i + 1, len(du)):
            a, b = int(du[i]), int(du[j])
            far = distances.get((a, b), distances.get((b, a)))
            if a != b and far is not None and abs(int(t[i]) - int(t[j])) <= far + tolerance:
                bits[i] |= 1 << j
                bits[j] |= 1 << i
    return bits


def _members(nodes: int) -> Iterator[int]:
    """Members of a bit set, lowest first."""
    while nodes:
        yield (nodes & -nodes).bit_length() - 1
        nodes &= nodes - 1


def clique_of(near: list[int], nodes: int, size: int) -> int | None:
    """A clique of ``size`` of the nodes as a bit set, None if there is none.

    Sets of nodes none of which are near each other are taken out, one fewer than the clique needs; only the nodes that are left have to be tried,
    as the clique has one node of each set at most. Subproblems wait on a stack, so nothing recurses.
    """

    def left(nodes: int, sets: int) -> int:
        while nodes and sets:
            apart, sets = nodes, sets - 1
            while apart:
                first = apart & -apart
                nodes ^= first
                apart = (apart ^ first) & ~near[first.bit_length() - 1]
        return nodes

    if not size:
        return 0
    waiting = [(0, nodes, left(nodes, size - 1))]
    while waiting:
        clique, open_, try_ = waiting.pop()
        if not try_:
            continue
        v = try_.bit_length() - 1
        open_ ^= 1 << v
        waiting.append((clique, open_, try_ ^ 1 << v))
        clique, open_ = clique | 1 << v, open_ & near[v]
        more = size - clique.bit_count()
        if not more:
            return clique
        if open_.bit_count() >= more:
            waiting.append((clique, open_, left(open_, more - 1)))
    return None


def _greedy(near: list[int], nodes: int) -> int:
    """The size of a clique that takes the node near most of those left, again and again."""
    size = 0
    while nodes:
        nodes &= near[max(_members(nodes), key=lambda v: (near[v] & nodes).bit_count())]
        size += 1
    return size


def _reach(ids: np.ndarray, distances: dict[tuple[int, int], float], tolerance: float) -> np.ndarray:
    """The longest whole time difference that light can explain between each two DUs, the earlier listed one first; -1 for none."""
    reach = np.full((len(ids), len(ids)), -1, dtype=np.int64)
    for i, a in enumerate(ids.tolist()):
        for j, b in enumerate(ids.tolist()):
            far = distances.get((a, b), distances.get((b, a)))
            if a != b and far is not None and far + tolerance >= 0:
                reach[i, j] = int(min(far + tolerance, _LONGEST))
    return reach


def _colours(reach: np.ndarray) -> np.ndarray:
    """A number for each DU; hits of DUs with the same number are never compatible."""
    apart, colour, n = (reach < 0) & (reach.T < 0), np.full(len(reach), -1), 0
    for first in range(len(reach)):
        if colour[first] < 0:
            fit = apart[first] & (colour < 0)
            fit[first] = False
            colour[first] = n
            while fit.any():
                x = int(fit.argmax())
                colour[x] = n
                fit &= apart[x]
                fit[x] = False
            n += 1
    return colour


@dataclass
class _Field:
    """Hits of three neighbouring strips of time, each as long as light times reach: all partners of the middle strip's hits.

    ``at`` are their places among all hits, in order of (colour, time), which numbers the bits; ``mid`` the middle strip's bits and ``later`` the last one's.
    """

    at: np.ndarray
    near: list[int]
    colours: list[int]
    mid: list[int]
    later: int

    def most(self, nodes: int) -> int:
        """No clique of the nodes is larger."""
        return sum(1 for c in self.colours if nodes & c)


def _bits(flags: np.ndarray) -> int:
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def _fields(du: np.ndarray, t: np.ndarray, count: np.ndarray, reach: np.ndarray) -> tuple[list[_Field], np.ndarray, np.ndarray]:
    """Fields over all hits (``du`` as places in ``reach``), each hit's field (where it is a middle one), and its number of compatible hits."""
    colour, same = _colours(reach)[du], bool((reach == reach.T).all())
    in_time = np.argsort(t, kind="stable")
    strip = (t[in_time] - t.min()) // max(int(reach.max()), 1)
    fields, home, degree = [], np.zeros(len(t), dtype=np.int64), np.zeros(len(t), dtype=np.int64)
    for k in np.unique(strip).tolist():
        ends = np.searchsorted(strip, [k - 1, k, k + 1, k + 2])
        at = in_time[ends[0] : ends[3]]
        part = np.repeat([0, 1, 2], np.diff(ends))
        order = np.lexsort((t[at], colour[at]))
        at, part = at[order], part[order]
        near = []
        rows = max(1, _CELLS // len(at))
        for i in range(0, len(at), rows):
            own = at[i : i + rows, None]
            far = reach[du[own], du[at]]
            if not same:  # the earlier listed hit's DU is looked up first
                far = np.where(own < at, far, reach[du[at], du[own]])
            close = np.abs(t[own] - t[at]) <= far
            degree[own[:, 0]] = np.where(part[i : i + rows] == 1, close @ count[at], degree[own[:, 0]])
            near += [int.from_bytes(x.tobytes(), "little") for x in np.packbits(close, axis=1, bitorder="little")]
        home[at[part == 1]] = len(fields)
        mid = np.flatnonzero(part == 1)
        fields.append(_Field(at, near, [_bits(colour[at] == c) for c in np.unique(colour[at])], mid[np.argsort(t[at[mid]], kind="stable")].tolist(), _bits(part == 2)))
    return fields, home, degree


def _largest(fields: list[_Field]) -> int:
    """The size of a largest clique. Each hit is tried as the earliest one, with those behind it."""
    size = 1
    middle = [sum(1 << v for v in f.mid) for f in fields]
    for i in sorted(range(len(fields)), key=lambda i: -fields[i].most(middle[i] | fields[i].later)):
        f, behind = fields[i], fields[i].later
        if f.most(middle[i] | behind) <= size:
            break
        size = max(size, _greedy(f.near, middle[i] | behind))  # so that few sizes have to be tried one by one
        for v in reversed(f.mid):
            nodes = f.near[v] & behind
            behind |= 1 << v
            while f.most(nodes) >= size and clique_of(f.near, nodes, size) is not None:
                size += 1
    return size


def maximum_causal_subset(du, t, distances: dict[tuple[int, int], float], tolerance: float = 0.0) -> list[int]:
    """Indices of a largest set of mutually compatible hits; hits are searched by (compatible ones descending, time, id).

    Of the largest cliques it is the one that the search order reaches first. The rule: from a set of open nodes, those not near the pivot are
    tried, lowest first; the pivot is the first node, of the open ones and then of those already tried, that is near most open ones. Where a
    subproblem holds no clique of the largest size, which is known before, it is passed over, so the search never turns back. Listed one behind the other, hits
    of a DU at one time are one node that counts as many: the first of them stands for all.
    """
    du, t = np.asarray(du, dtype=np.int64), np.asarray(t, dtype=np.int64)
    if not len(du):
        return []
    heads = np.flatnonzero(np.r_[True, (du[1:] != du[:-1]) | (t[1:] != t[:-1])])
    count = np.diff(np.r_[heads, len(du)])
    ids, own = np.unique(du[heads], return_inverse=True)
    fields, home, degree = _fields(own, t[heads], count, _reach(ids, distances, tolerance))
    size = _largest(fields)
    order = np.lexsort((heads, du[heads], t[heads], -degree))
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))

    f = fields[home[order[0]]]
    tried_first = np.ones(len(heads), dtype=bool)  # the first pivot is the node with most compatible hits
    tried_first[f.at[list(_members(f.near[int(np.flatnonzero(f.at == order[0])[0])]))]] = False
    for node in order[tried_first[order]].tolist():
        f = fields[home[node]]
        v = int(np.flatnonzero(f.at == node)[0])
        before = _bits(tried_first[f.at] & (rank[f.at] < rank[node]))
        open_ = f.near[v] & ~before
        rest = clique_of(f.near, open_, size - 1) if f.most(open_) >= size - 1 else None
        if rest is not None:
            return sorted(heads[f.at[[v, *_first_clique(f, rank[f.at].tolist(), count[f.at], open_, f.near[v] & before, rest)]]].tolist())
    raise AssertionError("no clique of the largest size")


def _first_clique(f: _Field, rank: list[int], count: np.ndarray, open_: int, tried: int, known: int) -> list[int]:
    """The clique as large as ``known`` among the open nodes that the search order reaches first; nodes come by ``rank`` and count as many as ``count`` says."""
    near, clique, levels = f.near, [], [tried]
    digits = [(1 << k, _bits(count >> k & 1)) for k in range(int(count.max()).bit_length())]
    ranked = lambda nodes: sorted(_members(nodes), key=rank.__getitem__)
    while known:
        here = [(k, open_ & d) for k, d in digits]
        pivot = max((v for nodes in (open_, *levels) for v in ranked(nodes)), key=lambda v: sum(k * (near[v] & d).bit_count() for k, d in here))
        done, more = 0, known.bit_count() - 1
        for v in ranked(open_ & ~near[pivot]):
            nodes = open_ & near[v]
            if known >> v & 1:
                known ^= 1 << v
            else:
                found = clique_of(near, nodes, more) if f.most(nodes) >= more else None
                if found is None:
                    open_, done = open_ ^ 1 << v, done | 1 << v
                    continue
                known = found
            clique.append(v)
            open_, levels = nodes, [x & near[v] for x in (*levels, done) if x & near[v]]
            break
    return clique


class TriggerFilter:
    """The filter chain with its duplicate history: duplicates enter the history, other events replace the previous one."""

    def __init__(self, config: FilterConfig, distances: dict[tuple[int, int], float] | None = None) -> None:
        if config.causal and not distances:
            raise ValueError("the causal filter needs antenna distances")
        self.config, self.distances = config, distances or {}
        self.history: deque[Pairs] = deque((p for p in config.seed if p), maxlen=config.history)
        self.previous: Pairs = {}

    def duplicate(self, pairs: Pairs) -> bool:
        c = self.config
        for known in [*self.history, self.previous]:
            if sum(abs(d - known[k]) < c.time_diff for k, d in pairs.items() if k in known) >= c.min_pairs:
                self.history.append(pairs)
                return True
        self.previous = pairs
        return False

    def decide(self, du: np.ndarray, t: np.ndarray, score: np.ndarray) -> tuple[list[int], str]:
        """(indices kept, reason of rejection or empty)."""
        c, kept = self.config, list(range(len(du)))
        if c.causal:
            if c.bypass is None or len(set(du.tolist())) < c.bypass:
                kept = maximum_causal_subset(du, t, self.distances, c.tolerance)
            if len(kept) < c.nhit:
                return kept, "causal_subset_too_small"
        if c.template and not (kept and float(np.mean(score[kept])) / SCORE_SCALE > c.coefficient):
            return kept, "template_below_threshold"
        if c.duplicate and self.duplicate(pair_differences(du[kept], t[kept], c.canonical_sign)):
            return kept, "duplicate"
        return kept, ""


def pairs_of(hits: DataFrame, key: str, du: str = "du", t: str = "t", order: str = "i") -> DataFrame:
    """key, a, b, dt: time differences of all unordered DU pairs of an event; the last pair in list order wins.

    An event's hits are few (one trigger window), so the pairs are expanded from its own list and never joined across events.
    """
    item = F.struct(F.col(order).alias("i"), F.col(du).alias("du"), F.col(t).alias("t"))
    lists = hits.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("h"))
    first = lists.select(key, "h", F.posexplode("h").alias("p", "x"))
    each = first.select(key, "x", F.explode(F.expr("slice(h, p + 2, size(h))")).alias("y"))
    a, b = F.least("x.du", "y.du").alias("a"), F.greatest("x.du", "y.du").alias("b")
    each = each.select(key, a, b, (F.col("x.t") - F.col("y.t")).alias("dt"), F.struct("x.i", "y.i").alias("at"))
    return each.groupBy(key, "a", "b").agg(F.max_by("dt", "at").alias("dt"))


def causal_pairs(pairs: DataFrame, distances: DataFrame, tolerance: float) -> DataFrame:
    """Pairs with the light time of their distance (columns a, b, light in ticks) that it and ``tolerance`` can explain.

    Unknown distances and pairs of one DU are incompatible. Distances are keyed once by (smaller, larger).
    """
    known = distances.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "light").dropDuplicates(["a", "b"])
    return pairs.where("a <> b").join(known, ["a", "b"]).where(F.abs("dt") <= F.col("light") + F.lit(tolerance))


def duplicate_events(current: DataFrame, history: DataFrame, time_diff: float, min_pairs: int, key: str = "event", known: str = "hist") -> DataFrame:
    """(event, hist, matches): events with at least ``min_pairs`` pairs whose time differences agree within ``time_diff``.

    Differences are binned by ``time_diff`` and history rows reach the bins beside their own, so the band is part of the
    join's key and a common DU pair is spread over its bins.
    """
    bin_of = F.floor(F.col("dt") / F.lit(time_diff)).cast("long")
    here = current.withColumn("__bin", bin_of)
    other = history.select(F.col(known), "a", "b", F.col("dt").alias("dt_known"), F.explode(F.array(bin_of - 1, bin_of, bin_of + 1)).alias("__bin"))
    close = here.join(other, ["a", "b", "__bin"]).where(F.abs(F.col("dt") - F.col("dt_known")) < time_diff)
    return close.groupBy(key, known).agg(F.count("*").alias("matches")).where(F.col("matches") >= min_pairs)
