"""The event-time gate: hits gather in buckets that close by arrival-time deadlines.

``Gate`` is the logic with an explicit clock. ``replay`` runs it over a table with an arrival column, ``stream`` over a Structured
Streaming query; both key by antenna array, since capacity and guards reach across buckets. Rows carry one hit time (``t``), which is added
unless it is known, or a whole batch of a DU's times (``ticks``), which replaces what the DU had in those buckets.
"""

from __future__ import annotations

import pickle
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame

#: What a gate counts: closed buckets by reason and how long they waited, hits and batches that came too late, buckets seen complete before their deadline.
STATS = ("closed", "wait_sum", "wait_max", "timeouts", "forced", "late", "late_guard", "late_ingress", "late_age_max", "late_age_sum", "shadow")
MODES = ("last_arrival", "first_arrival", "bounded_sliding")


@dataclass
class GateConfig:
    """Ticks throughout; ``cut`` is the bucket length."""

    cut: int
    timeout: int
    cap: int
    idle_gap: int
    retention: int
    mode: str = "bounded_sliding"
    extend_on_progress_only: bool = True
    max_pending: int = 1024
    expected: tuple[int, ...] = ()

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        if min(self.cut, self.timeout, self.max_pending) <= 0:
            raise ValueError("cut, timeout and max_pending must be positive")
        if self.mode == "bounded_sliding" and self.cap < self.timeout:
            raise ValueError("in bounded mode the cap must not be below the timeout")
        self.cap, self.retention = max(self.cap, self.timeout), max(self.retention, 1)


@dataclass
class Bucket:
    tm_id: int
    first: int
    progress: int
    hits: dict[int, list[int]] = field(default_factory=dict)
    seen: dict[int, set[int]] = field(default_factory=dict)
    close_at: int = 0
    shadow: int | None = None


@dataclass
class Closed:
    """One closed bucket; ``reason`` is timeout, forced (capacity) or drain."""

    tm_id: int
    closed_at: int
    reason: str
    waited: int
    du_count: int
    hit_count: int
    du_ids: list[int]
    shadow_at: int | None


class Gate:
    def __init__(self, config: GateConfig) -> None:
        self.config = config
        self.pending: dict[int, Bucket] = {}
        self.guard: dict[int, int] = {}
        self.ready: set[int] = set()
        self.forced: set[int] = set()
        self.last_tm: dict[int, int] = {}
        # heaps of (tick, bucket); entries that no longer hold are passed over when they come up
        self.deadlines: list[tuple[int, int]] = []
        self.guards: list[tuple[int, int]] = []
        self.arrivals: list[tuple[int, int]] = []
        self.unseen: list[int] = []  # buckets that not every expected DU has moved past, least first
        self.stats = dict.fromkeys(STATS, 0)

    def _deadline(self, b: Bucket) -> int:
        c = self.config
        if c.mode == "last_arrival":
            return b.progress + c.timeout
        if c.mode == "first_arrival":
            return b.first + c.timeout
        return min(b.first + c.cap, max(b.first + c.timeout, b.progress + c.idle_gap))

    def _late(self, kind: str, age: int) -> None:
        self.stats["late"] += 1
        self.stats[f"late_{kind}"] += 1
        self.stats["late_age_max"] = max(self.stats["late_age_max"], age)
        self.stats["late_age_sum"] += age

    def _remember(self, b: Bucket) -> None:
        self.guard[b.tm_id] = b.close_at + self.config.retention
        heappush(self.guards, (self.guard[b.tm_id], b.tm_id))

    def _due_at(self, b: Bucket) -> None:
        b.close_at = self._deadline(b)
        heappush(self.deadlines, (b.close_at, b.tm_id))

    def arrive(self, now: int, du: int, ticks: Iterable[int], replace: bool = True) -> None:
        """A batch of hit times of one DU, which may belong to several buckets."""
        by: dict[int, list[int]] = {}
        for t in ticks:
            by.setdefault(t // self.config.cut, []).append(t)
        for tm_id, own in by.items():
            self._arrive(now, tm_id, du, list(dict.fromkeys(own)), replace)

    def _arrive(self, now: int, tm_id: int, du: int, ticks: list[int], replace: bool) -> None:
        self._forget(now)
        if tm_id in self.guard:
            return self._late("guard", max(0, now - (self.guard[tm_id] - self.config.retention)))
        b = self.pending.get(tm_id)
        if b and now >= b.close_at:
            self.ready.add(tm_id)
            self._remember(b)
            return self._late("ingress", now - b.close_at)
        if du in self.config.expected:
            self.last_tm[du] = max(tm_id, self.last_tm.get(du, tm_id))
        if b is None:
            b = self.pending[tm_id] = Bucket(tm_id, now, now)
            self._due_at(b)
            heappush(self.arrivals, (now, tm_id))
            heappush(self.unseen, tm_id)
        seen = b.seen.setdefault(du, set())
        fresh = [t for t in ticks if t not in seen]
        seen.update(fresh)
        b.hits[du] = ticks if replace else [*b.hits.get(du, []), *fresh]
        if fresh or self.config.mode == "last_arrival" or not self.config.extend_on_progress_only:
            b.progress = now
            self._due_at(b)
        self._shadow(now)
        if len(self.pending) > self.config.max_pending:
            while self.arrivals[0][1] not in self.pending or self.pending[self.arrivals[0][1]].first != self.arrivals[0][0]:
                heappop(self.arrivals)
            oldest = self.arrivals[0][1]
            self.ready.add(oldest)
            self.forced.add(oldest)
            self.stats["forced"] += 1

    def _shadow(self, now: int) -> None:
        """Observed only: buckets that every expected DU has moved past."""
        if not self.config.expected or any(du not in self.last_tm for du in self.config.expected):
            return
        passed = min(self.last_tm[du] for du in self.config.expected)
        while self.unseen and self.unseen[0] < passed:
            b = self.pending.get(heappop(self.unseen))
            if b and b.shadow is None:
                b.shadow = now
                self.stats["shadow"] += 1

    def _forget(self, now: int) -> None:
        while self.guards and self.guards[0][0] <= now:
            until, tm_id = heappop(self.guards)
            if self.guard.get(tm_id) == until:
                del self.guard[tm_id]

    def _close(self, b: Bucket, now: int, reason: str) -> Closed:
        del self.pending[b.tm_id]
        self.ready.discard(b.tm_id)
        self.forced.discard(b.tm_id)
        waited = now - b.first
        self.stats["closed"] += 1
        self.stats["wait_sum"] += waited
        self.stats["wait_max"] = max(self.stats["wait_max"], waited)
        return Closed(b.tm_id, now, reason, waited, len(b.hits), sum(map(len, b.hits.values())), sorted(b.hits), b.shadow)

    def _overdue(self, now: int) -> set[int]:
        out = set()
        while self.deadlines and self.deadlines[0][0] <= now:
            at, tm_id = heappop(self.deadlines)
            if (b := self.pending.get(tm_id)) and b.close_at == at:
                out.add(tm_id)
        return out

    def poll(self, now: int) -> list[Closed]:
        """Buckets that are due, by bucket id."""
        out = []
        for tm_id in sorted(self._overdue(now) | self.ready):
            b = self.pending.get(tm_id)
            if b is None or (tm_id not in self.forced and now < b.close_at):
                continue
            timed_out = now >= b.close_at
            if timed_out:
                self.stats["timeouts"] += 1
                self._remember(b)
            out.append(self._close(b, now, "timeout" if timed_out else "forced"))
        self.ready.clear()
        self._forget(now)
        return out

    def next_deadline(self) -> int | None:
        while self.deadlines and ((b := self.pending.get(self.deadlines[0][1])) is None or b.close_at != self.deadlines[0][0]):
            heappop(self.deadlines)
        return self.deadlines[0][0] if self.deadlines else None

    def drain(self, now: int) -> list[Closed]:
        """Shutdown: everything pending, oldest arrival first."""
        return [self._close(b, now, "drain") for b in sorted(self.pending.values(), key=lambda b: (b.first, b.tm_id))]


CLOSED = "tm_id long, closed_at long, reason string, waited long, du_count long, hit_count long, du_ids array<long>, shadow_at long"
COLUMNS = [f.split()[0] for f in CLOSED.split(", ")]


def _advance(gate: Gate, now: int, prompt: bool) -> list[Closed]:
    """Deadlines up to now, each at its own time if the scheduler is prompt."""
    out = []
    while prompt and (at := gate.next_deadline()) is not None and at <= now:
        out += gate.poll(at)
    return out


def _rows(arrivals: DataFrame, array: str) -> tuple[DataFrame, bool]:
    """(the columns that the gate reads, whether rows are batches)."""
    batches = "ticks" in arrivals.columns
    return arrivals.select(array, "arrival", "seq", "du", "ticks" if batches else "t"), batches


def _of(value: object, batches: bool) -> list[int]:
    return [int(x) for x in value] if batches else [int(value)]


def _replayed(arrivals: DataFrame, config: GateConfig, array: str, prompt: bool, result: Callable[[object, Gate, list[Closed], bool], list[list]], schema: str) -> DataFrame:
    """``result`` of every step and, with its last argument set, of an array's end."""
    rows, batches = _rows(arrivals, array)
    names, what = [f.split()[0] for f in schema.split(", ")], "ticks" if batches else "t"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gate, current, last = Gate(config), None, 0

        def flushed() -> list[list]:
            return [] if current is None else result(current, gate, _advance(gate, 1 << 62, True) if prompt else gate.drain(last), True)

        for frame in frames:
            out: list[list] = []
            for key, now, du, value in frame[[array, "arrival", "du", what]].itertuples(index=False):
                if key != current:
                    out += flushed()
                    gate, current = Gate(config), key
                last = now
                closed = _advance(gate, now, prompt)
                gate.arrive(now, du, _of(value, batches), replace=batches)
                out += result(key, gate, closed + gate.poll(now), False)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(flushed(), columns=names)

    return rows.repartition(array).sortWithinPartitions(array, "arrival", "seq").mapInPandas(run, schema)


def replay(arrivals: DataFrame, config: GateConfig, array: str = "array", prompt: bool = True) -> DataFrame:
    """Closed buckets of each array, from rows (array, arrival, seq, du, t or ticks) in order of arrival.

    An array's rows stream through one task; only its pending buckets are held.
    """
    kind = arrivals.schema[array].dataType.simpleString()
    return _replayed(arrivals, config, array, prompt, lambda key, gate, closed, end: [[key, *vars(c).values()] for c in closed], f"{array} {kind}, {CLOSED}")


def statistics(arrivals: DataFrame, config: GateConfig, array: str = "array", prompt: bool = True) -> DataFrame:
    """What the gate of each array has counted by the end of a replay."""
    kind = arrivals.schema[array].dataType.simpleString()
    return _replayed(arrivals, config, array, prompt, lambda key, gate, closed, end: [[key, *gate.stats.values()]] if end else [], ", ".join([f"{array} {kind}", *(f"{x} long" for x in STATS)]))


def wall_ms() -> int:
    return time.time_ns() // 1_000_000


def stream(arrivals: DataFrame, config: GateConfig, array: str = "array", wake_ms: int | None = None, ticks_per_ms: int = 1_000_000, now_ms: Callable[[], int] = wall_ms) -> DataFrame:
    """The gate over a streaming DataFrame: state per array, the arrival column as its clock.

    A row with a null ``t`` (or ``ticks``) carries time alone (a tick of the clock, or the flush at the end of a replay). With ``wake_ms`` an array
    that falls silent wakes up after that time, its clock goes on with the wall clock, and buckets that are due close; so an idle array closes all its buckets.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    rows, batches = _rows(arrivals, array)
    what = "ticks" if batches else "t"

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gate, clock, since = pickle.loads(state.get[0]) if state.exists else (Gate(config), 0, now_ms())
        out = []
        if state.hasTimedOut:
            clock, since = clock + max(0, now_ms() - since) * ticks_per_ms, now_ms()
            out += _advance(gate, clock, True)
        else:
            got = pd.concat(list(frames)).sort_values(["arrival", "seq"], kind="stable")
            for now, du, value in got[["arrival", "du", what]].itertuples(index=False):
                clock, since = int(now), now_ms()
                out += _advance(gate, clock, True)
                if value is not None and (batches or pd.notna(value)):
                    gate.arrive(clock, int(du), _of(value, batches), replace=batches)
                    out += gate.poll(clock)
        state.update((pickle.dumps((gate, clock, since)),))
        if wake_ms and gate.pending:
            state.setTimeoutDuration(wake_ms)
        yield pd.DataFrame([[key[0], *vars(r).values()] for r in out], columns=[array, *COLUMNS])

    kind = arrivals.schema[array].dataType.simpleString()
    timeout = GroupStateTimeout.ProcessingTimeTimeout if wake_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy(array).applyInPandasWithState(run, f"{array} {kind}, {CLOSED}", "gate binary", "append", timeout)
