"""Research runs as a keyed stream: events move a run through its states, stale artifacts and idle gates roll it back.

The same fold serves a stream, whose state is one small row a run with a timer, and a batch of all events.  Every
change of state is an entry of the run's hash-chained journal, so that what a stream emits is checked like any journal.

Events (run, event_id, at, kind, artifact, digest): ``verified`` takes the run to its next state, ``failed`` leaves it where it
is, ``artifact`` tells an artifact's present digest.  States that rest on an artifact freeze its digest; when it is
another, the run goes back to where facts are collected.  A run that may write loses its gate after ``idle`` without an event.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vellumspark.functions.markdown import canonical_line
from vellumspark.operators.runs import REVOCABLE, ROLLBACK, STATES

#: What each state freezes when it is reached.
FREEZES = {"FACTS_FROZEN": "facts", "CLAIMS_VERIFIED": "claims", "MECHANISMS_VERIFIED": "mechanisms"}
ARTIFACTS = tuple(FREEZES.values())
_COLUMNS = ["run", "seq", "state", "previous", "entry", "reason", "at"]


@dataclass
class LiveRun:
    """A run between events; times are microseconds."""

    state: str = ""
    seq: int = -1
    entry: str = ""
    at: int = 0
    now: dict = field(default_factory=lambda: dict.fromkeys(ARTIFACTS, ""))
    frozen: dict = field(default_factory=lambda: dict.fromkeys(ARTIFACTS, ""))

    def row(self) -> tuple:
        return self.state, self.seq, self.entry, self.at, *self.now.values(), *self.frozen.values()

    @classmethod
    def of(cls, row: tuple) -> LiveRun:
        return cls(*row[:4], dict(zip(ARTIFACTS, row[4:7])), dict(zip(ARTIFACTS, row[7:10])))

    def _enter(self, state: str, reason: str, at: int) -> tuple:
        previous, self.seq, self.state = self.entry, self.seq + 1, state
        self.entry = hashlib.sha256(canonical_line({"seq": self.seq, "state": state, "previous_sha256": previous}).encode()).hexdigest()
        if state == ROLLBACK:
            self.frozen = dict.fromkeys(ARTIFACTS, "")
        elif name := FREEZES.get(state):
            self.frozen[name] = self.now[name]
        return self.seq, state, previous, self.entry, reason, at

    def expire(self, at: int, idle: int) -> Iterator[tuple]:
        """The gate is taken back if nothing came for ``idle`` before ``at``."""
        if self.state in REVOCABLE and at - self.at > idle:
            yield self._enter(ROLLBACK, "gate expired", self.at + idle)

    def take(self, at: int, kind: str, artifact: str | None, digest: str | None, idle: int) -> Iterator[tuple]:
        """The journal entries that an event makes."""
        yield from self.expire(at, idle)
        if not self.state:
            yield self._enter(STATES[0], "created", at)
        self.at = max(self.at, at)
        if kind == "artifact" and artifact in self.now:
            self.now[artifact] = digest or ""
            stale = any(f and f != self.now[name] for name, f in self.frozen.items())
            if stale and self.state != STATES[-1]:
                yield self._enter(ROLLBACK, f"{artifact} changed", at)
        elif kind == "verified" and self.state != STATES[-1]:
            yield self._enter(STATES[STATES.index(self.state) + 1], "verified", at)


_FIELDS = ["event_id", "at", "kind", "artifact", "digest"]


def _prepared(events: DataFrame) -> DataFrame:
    return events.select("run", "event_id", F.col("at").cast("timestamp").alias("at"), "kind", "artifact", "digest")


def _micros(at: pd.Series) -> pd.Series:
    return at.astype("datetime64[us]").astype("int64")


def _entries(run, rows: list[tuple]) -> pd.DataFrame:
    found = pd.DataFrame([(run, *r) for r in rows], columns=_COLUMNS)
    found["at"] = pd.to_datetime(found["at"].astype("int64"), unit="us")
    return found


def live_journals(events: DataFrame, idle_hours: int = 24, late: str = "1 hour") -> DataFrame:
    """The journal entries of a stream of events, appended as they arise; (run, seq, state, previous, entry, reason, at).

    Events of one run count in the order of their times and ids inside a trigger; a gate that nobody uses is revoked
    by a timer when the watermark passes its end."""
    idle = idle_hours * 3_600_000_000

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, made = LiveRun.of(state.get) if state.exists else LiveRun(), []
        if state.hasTimedOut:
            made += run.expire(run.at + idle + 1, idle)
        else:
            rows = pd.concat(list(batches))
            rows["at"] = _micros(rows["at"])
            for _, at, kind, artifact, digest in rows.sort_values(["at", "event_id"])[_FIELDS].itertuples(index=False):
                made += run.take(int(at), kind, artifact, digest, idle)
        state.update(run.row())
        if run.state in REVOCABLE:
            state.setTimeoutTimestamp(max((run.at + idle) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield _entries(key[0], made)

    timed = _prepared(events).withWatermark("at", late)
    kind = events.schema["run"].dataType.simpleString()
    kept = "state string, seq bigint, entry string, at bigint, " + ", ".join(f"{when}_{a} string" for when in ("now", "frozen") for a in ARTIFACTS)
    return timed.groupBy("run").applyInPandasWithState(fold, f"run {kind}, seq bigint, state string, previous string, entry string, reason string, at timestamp", kept, "append", GroupStateTimeout.EventTimeTimeout)


def journals(events: DataFrame, idle_hours: int = 24) -> DataFrame:
    """The same entries from all events at once; a run's events are folded one after another and never held together.

    A gate counts as expired only if an event of its run comes later."""
    idle = idle_hours * 3_600_000_000

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, run = None, LiveRun()
        for batch in batches:
            batch["at"], out = _micros(batch["at"]), []
            for key, _, at, kind, artifact, digest in batch[["run", *_FIELDS]].itertuples(index=False):
                if key != name:
                    name, run = key, LiveRun()
                out += [(key, *e) for e in run.take(int(at), kind, artifact, digest, idle)]
            found = pd.DataFrame(out, columns=_COLUMNS)
            found["at"] = pd.to_datetime(found["at"].astype("int64"), unit="us")
            yield found

    ordered = _prepared(events).repartition("run").sortWithinPartitions("run", "at", "event_id")
    kind = events.schema["run"].dataType.simpleString()
    return ordered.mapInPandas(fold, f"run {kind}, seq bigint, state string, previous string, entry string, reason string, at timestamp")
