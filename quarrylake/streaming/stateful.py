"""Stateful streams on timers: an outbox that loses no event, and leases that guard snapshots.

Both use transformWithState with timers on event time. The event-time column is called clock here and must not go back from one
micro-batch to the next (arrival time, or the greatest timestamp of a file): rows behind the watermark would be dropped.
Timers are at rest in Spark's state store with the rest of the state, so a query that is started again on its checkpoint goes on
where it was. Start such queries within timer_state().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def timer_state(spark: SparkSession):
    """The state store that timers need, for queries that start within; the session's own settings afterwards."""
    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def backoff_ms(attempts: int) -> int:
    """Milliseconds from the attempts-th failure to the next try."""
    return min(6 * 3_600_000, 60_000 * 2 ** (attempts - 1))


OUTBOX_ROWS = "share string, event_id string, generation long, created_at long, payload string, kind string, clock timestamp"
OUTCOMES = "share string, event_id string, generation long, attempts int, outcome string, at long"


class _Outbox(StatefulProcessor):
    """Pending, dead and lately handled events of a share."""

    EVENT = "generation long, created_at long, payload string, attempts int, due long"

    def __init__(self, handle: Callable[[pd.DataFrame], pd.Series], attempts: int, remember_ms: int):
        self.handle_events, self.attempts, self.remember_ms = handle, attempts, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.timers = handle
        self.pending = handle.getMapState("pending", "event_id string", self.EVENT)
        self.dead = handle.getMapState("dead", "event_id string", self.EVENT)
        self.handled = handle.getMapState("handled", "event_id string", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            for r in frame.itertuples(index=False):
                at = (r.event_id,)
                if r.kind == "event" and not any(m.containsKey(at) for m in (self.pending, self.dead, self.handled)):
                    self.pending.updateValue(at, (int(r.generation), int(r.created_at), r.payload, 0, 0))
                elif r.kind == "retry":  # dead letters of the share, or the one named
                    for (event,), (generation, created, payload, _, _) in list(self.dead.iterator()):
                        if r.event_id is None or r.event_id == event:
                            self.dead.removeKey((event,))
                            self.pending.updateValue((event,), (generation, created, payload, 0, now))
        yield from self._drain(key[0], now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._drain(key[0], timerValues.getCurrentWatermarkInMs())

    def _drain(self, share: str, now: int) -> Iterator[pd.DataFrame]:
        """Tries all events that are due, in order of generation; one that fails waits and lets later ones pass."""
        every = [(*k, *v) for k, v in self.pending.iterator()]
        due = sorted((e for e in every if e[5] <= now or not e[5]), key=lambda e: (e[1], e[2], e[0]))
        waits = [e[5] for e in every if e[5] > now]
        if due:
            events = pd.DataFrame(due, columns=["event_id", "generation", "created_at", "payload", "attempts", "due"]).assign(share=share)
            told = []
            for e, done in zip(due, self.handle_events(events)):
                event, generation, created, payload, tries, _ = e
                tries += 1
                if done:
                    self.pending.removeKey((event,))
                    self.handled.updateValue((event,), (now,))
                    waits.append(now + self.remember_ms)
                elif tries >= self.attempts:
                    self.pending.removeKey((event,))
                    self.dead.updateValue((event,), (generation, created, payload, tries, 0))
                else:
                    waits.append(now + backoff_ms(tries))
                    self.pending.updateValue((event,), (generation, created, payload, tries, waits[-1]))
                told.append((share, event, generation, tries, "handled" if done else "dead" if tries >= self.attempts else "retry", now))
            yield pd.DataFrame(told, columns=[c.split()[0] for c in OUTCOMES.split(", ")])
        for (event,), (at,) in list(self.handled.iterator()):
            if at + self.remember_ms <= now:
                self.handled.removeKey((event,))
        for t in list(self.timers.listTimers()):
            self.timers.deleteTimer(t)
        if waits:
            self.timers.registerTimer(max(min(waits), now + 1))


def outbox(rows: DataFrame, handle: Callable[[pd.DataFrame], pd.Series], attempts: int = 5, remember: str = "7 days") -> DataFrame:
    """What became of each event of rows (OUTBOX_ROWS) at each try: OUTCOMES. Append this to a table.

    Each share's events are tried once they are there, by (generation, created_at, event_id). handle gets those that are due and
    tells of each whether it went well; it runs again if a task does. A failed event is tried again after backoff_ms; after attempts
    failures it is a dead letter, until a row of kind "retry" names it (or no event: all of its share). An event that comes again
    within remember is one event. Rows of any other kind only move the clock.
    """
    clerk = _Outbox(handle, attempts, int(pd.Timedelta(remember).total_seconds() * 1000))
    return rows.withWatermark("clock", "0 seconds").groupBy("share").transformWithStateInPandas(clerk, OUTCOMES, "Append", "EventTime")


LEASE_ROWS = "snapshot_id string, token string, op string, expires_at timestamp, clock timestamp"
LEASE_ENDS = "snapshot_id string, token string, ended string, expires_at long, live int"


class _Leases(StatefulProcessor):
    """Live leases of a snapshot, each ended by its timer or a release."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.timers = handle
        self.leases = handle.getMapState("leases", "token string", "expires_at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ended, now = [], timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            for r in frame.sort_values("clock", kind="stable").itertuples(index=False):
                if r.op == "release" and self.leases.containsKey((r.token,)):
                    ended.append((r.token, "released", *self.leases.getValue((r.token,))))
                    self.leases.removeKey((r.token,))
                elif r.op == "take":  # a token taken again is renewed
                    self.leases.updateValue((r.token,), (int(r.expires_at.timestamp() * 1000),))
        yield from self._swept(key[0], now, ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._swept(key[0], timerValues.getCurrentWatermarkInMs(), [])

    def _swept(self, snapshot: str, now: int, ended: list) -> Iterator[pd.DataFrame]:
        live = {t: at for (t,), (at,) in self.leases.iterator()}
        for token, at in sorted(live.items()):
            if at <= now:
                self.leases.removeKey((token,))
                ended.append((token, "expired", at))
        left = [at for at in live.values() if at > now]
        for t in list(self.timers.listTimers()):
            self.timers.deleteTimer(t)
        if left:
            self.timers.registerTimer(min(left))
        if ended:
            yield pd.DataFrame([(snapshot, *e, len(left)) for e in ended], columns=[c.split()[0] for c in LEASE_ENDS.split(", ")])


def lease_ends(rows: DataFrame) -> DataFrame:
    """Ends of leases (LEASE_ENDS) of a stream of LEASE_ROWS, op "take" or "release"; live counts what else pins the snapshot then."""
    return rows.withWatermark("clock", "0 seconds").groupBy("snapshot_id").transformWithStateInPandas(_Leases(), LEASE_ENDS, "Append", "EventTime")


def live_leases(rows: DataFrame, now) -> DataFrame:
    """(snapshot_id, token, expires_at) at a time: the last row of each token, where it is no release and has not run out. The batch twin of lease_ends."""
    last = rows.where(F.col("clock") <= now).groupBy("snapshot_id", "token").agg(F.max_by(F.struct("op", "expires_at"), F.struct("clock", "op")).alias("x"))
    return last.where((F.col("x.op") == "take") & (F.col("x.expires_at") > now)).select("snapshot_id", "token", "x.expires_at")


def retirable(snapshots: DataFrame, leases: DataFrame, keep: int) -> DataFrame:
    """Snapshots (key, snapshot_id, created_at) that may go: not among the keep newest of their key, and pinned by no live lease."""
    from pyspark.sql import Window

    newest = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("created_at"), F.desc("snapshot_id")))
    return snapshots.withColumn("place", newest).where(F.col("place") > keep).join(leases, "snapshot_id", "left_anti").select("key", "snapshot_id", "place")
