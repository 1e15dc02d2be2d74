"""The event builder: fragments gather under registered events until they are complete or time runs out."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame

from hitstream.streaming.gate import wall_ms


@dataclass
class Pending:
    tag: int
    expected: frozenset[int]
    deadline: int
    attached: list[int] = field(default_factory=list)


@dataclass
class Outcome:
    """``kind``: complete, partial, timeout (nothing attached), stop, rejected, or a refused fragment's reason."""

    tag: int
    at: int
    kind: str
    attached: list[int]
    missing: list[int]


class Builder:
    def __init__(self, timeout: int, max_pending: int = 1 << 30, known: frozenset[int] | None = None) -> None:
        if timeout <= 0 or max_pending <= 0:
            raise ValueError("timeout and max_pending must be positive")
        self.timeout, self.max_pending, self.known = timeout, max_pending, known
        self.pending: dict[int, Pending] = {}
        self.deadlines: list[tuple[int, int]] = []  # a heap; entries of events that have ended are passed over

    def advance(self, now: int) -> list[Outcome]:
        """Events whose time has run out, by deadline."""
        out = []
        while self.deadlines and self.deadlines[0][0] <= now:
            deadline, tag = heappop(self.deadlines)
            if (e := self.pending.get(tag)) and e.deadline == deadline:
                out.append(self._end(e, deadline, "partial" if e.attached else "timeout"))
        return out

    def _end(self, e: Pending, at: int, kind: str) -> Outcome:
        del self.pending[e.tag]
        return Outcome(e.tag, at, kind, sorted(e.attached), sorted(e.expected - set(e.attached)))

    def begin(self, now: int, tag: int, expected: list[int]) -> list[Outcome]:
        out = self.advance(now)
        if not expected or tag in self.pending:
            return out
        if len(self.pending) >= self.max_pending:
            return [*out, Outcome(tag, now, "rejected", [], sorted(set(expected)))]
        self.pending[tag] = Pending(tag, frozenset(expected), now + self.timeout)
        heappush(self.deadlines, (now + self.timeout, tag))
        return out

    def fragment(self, now: int, tag: int, du: int, size: int = 1) -> list[Outcome]:
        out = self.advance(now)
        refused = lambda why: [*out, Outcome(tag, now, why, [du], [])]
        if size <= 0 or (self.known is not None and du not in self.known):
            return refused("invalid_fragment")
        e = self.pending.get(tag)
        if e is None:
            return refused("no_pending_event")
        if du not in e.expected:
            return refused("not_expected")
        if du in e.attached:
            return refused("duplicate_fragment")
        e.attached.append(du)
        return [*out, self._end(e, now, "complete")] if len(e.attached) == len(e.expected) else out

    def stop(self, now: int) -> list[Outcome]:
        return [*self.advance(now), *(self._end(e, now, "stop") for e in sorted(self.pending.values(), key=lambda e: e.tag))]


OUTCOME = "tag long, at long, kind string, attached array<long>, missing array<long>"
COLUMNS = [f.split()[0] for f in OUTCOME.split(", ")]


FOREVER = 1 << 62


def _message(builder: Builder, at: int, tag: int, expected, du, size) -> list[Outcome]:
    if expected is not None:
        return builder.begin(int(at), int(tag), [int(x) for x in expected])
    if pd.notna(du):
        return builder.fragment(int(at), int(tag), int(du), int(size))
    return builder.advance(int(at))


def _frame(rows: list[Outcome]) -> pd.DataFrame:
    return pd.DataFrame([list(vars(r).values()) for r in rows], columns=COLUMNS)


def replay(messages: DataFrame, timeout: int, by: str = "tag", max_pending: int = 1 << 30) -> DataFrame:
    """Outcomes from messages (tag, at, seq, expected or null, du or null, size): begin rows have ``expected``, fragments ``du``.

    Without an admission limit tags are independent of each other. With ``max_pending`` the builders are those of ``by``, a column that all messages
    of a tag agree in, and each admits so many events at a time. A partition streams its builders one after the other.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        builder, current = Builder(timeout, max_pending), None
        for batch in batches:
            out: list[Outcome] = []
            for key, tag, at, expected, du, size in zip(batch[by], *(batch[c] for c in ("tag", "at", "expected", "du", "size"))):
                if key != current:
                    out += builder.advance(FOREVER)
                    builder, current = Builder(timeout, max_pending), key
                out += _message(builder, at, tag, expected, du, size)
            yield _frame(out)
        yield _frame(builder.advance(FOREVER))

    return messages.repartition(by).sortWithinPartitions(by, "at", "seq").mapInPandas(run, OUTCOME)


def stream(messages: DataFrame, timeout: int, by: str = "tag", max_pending: int = 1 << 30, wake_ms: int | None = None, ticks_per_ms: int = 1, now_ms: Callable[[], int] = wall_ms) -> DataFrame:
    """The builder over a streaming DataFrame, state per tag (or per ``by``, for an admission limit).

    A row with neither ``expected`` nor ``du`` moves the clock. With ``wake_ms`` a builder that gets no messages wakes up after that time and its clock goes
    on with the wall clock, so events that are never completed end too, and their state goes.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        builder, clock, since = pickle.loads(state.get[0]) if state.exists else (Builder(timeout, max_pending), 0, now_ms())
        if state.hasTimedOut:
            clock, since = clock + max(0, now_ms() - since) * ticks_per_ms, now_ms()
            out = builder.advance(clock)
        else:
            rows = pd.concat(list(frames)).sort_values(["at", "seq"], kind="stable")
            out = [o for tag, at, expected, du, size in rows[["tag", "at", "expected", "du", "size"]].itertuples(index=False) for o in _message(builder, at, tag, expected, du, size)]
            clock, since = int(rows["at"].max()), now_ms()
        if builder.pending:
            state.update((pickle.dumps((builder, clock, since)),))
            if wake_ms:
                state.setTimeoutDuration(wake_ms)
        elif state.exists:
            state.remove()
        yield _frame(out)

    kind = GroupStateTimeout.ProcessingTimeTimeout if wake_ms else GroupStateTimeout.NoTimeout
    return messages.groupBy(by).applyInPandasWithState(run, OUTCOME, "builder binary", "append", kind)
