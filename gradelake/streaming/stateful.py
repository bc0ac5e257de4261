"""Event processors with state of a key: revisions, leases, timers, one-shot submissions, phases. All state expires.

Each processor gets the events of a key in the order of their times, however they are cut into batches, and keeps a few
values. Timers in event time end the state of a key that has been still for `keep`; events later than the watermark are
dropped, so `keep` is to be longer than the watermark's delay. They need the RocksDB state store: see with_state_store().
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from itertools import groupby
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> None:
    """Have streams that start in this session from now on keep their state in RocksDB."""
    spark.conf.set(STORE, ROCKS)


#: Keys are dealt into so many slots, and a slot's keys share one entry of the state store.
SLOTS = 2048


class Ordered(StatefulProcessor):
    """Events of a key one after the other. A subclass says what it keeps (state, as DDL), what it yields (columns, the key
    first), and what an event does: step(key, values, event, out) returns the new values (None: nothing is kept) and may
    append rows to out.

    What is grouped are slots of keys: reading, writing and arming a timer is a talk with the JVM each, and takes longer than
    the few events that a key has in a batch. A batch reads and writes the slots that it has events for.
    """

    state: str
    columns: tuple[str, ...]
    key_kind = "long"

    def __init__(self, keep: timedelta) -> None:
        self.keep = int(keep.total_seconds() * 1000)

    def init(self, handle) -> None:
        self.handle = handle
        self.values = handle.getValueState("slot", f"entries array<struct<key {self.key_kind}, {self.state}, last long>>, armed long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # at: microseconds; of equal times the smaller event_id, what has no time comes last, as of the epoch
        events = pd.concat(list(rows)).sort_values([self.columns[0], "at", "event_id"]).drop(columns=["slot", "ts"])
        events["ms"] = events.pop("at").fillna(0).astype("int64") // 1000
        kept, armed = self._kept()
        out: list[tuple] = []
        for k, of_key in groupby(events.itertuples(index=False), lambda e: None if key[0] < 0 else getattr(e, self.columns[0])):
            now, last = kept.pop(k, (None, 0))
            for e in of_key:
                now, last = self.step(k, now, e, out), e.ms
            self.finish(k, now, out)
            if now is not None:
                kept[k] = self.packed(now), int(last)
        self._keep(kept, armed, timerValues)
        yield pd.DataFrame(out, columns=list(self.columns))

    def _kept(self) -> tuple[dict[Any, tuple[tuple, int]], int | None]:
        """Values and last time of each key of the slot, and when its timer goes off."""
        entries, armed = self.values.get() or ((), None)
        return {k: (tuple(now), last) for k, *now, last in entries}, armed

    def _due(self, now: tuple, last: int) -> int:
        return self.due(now) or last + self.keep

    def _keep(self, kept: dict[Any, tuple[tuple, int]], armed: int | None, timers) -> None:
        """Store the slot. A timer is set only if none will go off in time: one that goes off early sets the next."""
        if not kept:
            if armed is not None:
                self.values.clear()  # its timer finds nothing
            return
        at = min(self._due(now, last) for now, last in kept.values())
        if armed is None or at < armed:
            armed = max(at, timers.getCurrentWatermarkInMs() + 1)  # a time that has passed would never come
            self.handle.registerTimer(armed)
        self.values.update(([(k, *now, last) for k, (now, last) in kept.items()], armed))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """What is due by now is through, whichever key the timer was set for."""
        out: list[tuple] = []
        kept, armed = self._kept()
        by = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        over = [k for k, (now, last) in kept.items() if self._due(now, last) <= by]
        for k in over:
            self.expired(k, kept.pop(k)[0], out)
        if armed is not None and (over or armed <= by):
            self._keep(kept, None if armed <= by else armed, timerValues)
            if not kept:
                self.values.clear()
        yield pd.DataFrame(out, columns=list(self.columns))

    def close(self) -> None:
        pass

    def step(self, key: Any, now: tuple | None, e: Any, out: list[tuple]) -> tuple | None:
        raise NotImplementedError

    def finish(self, key: Any, now: tuple | None, out: list[tuple]) -> None:
        """What is yielded once a batch's events are through."""

    def packed(self, now: tuple) -> tuple:
        """The values as they are stored."""
        return now

    def due(self, now: tuple) -> int:
        """When something is to happen (in ms); 0: when the key has been still for `keep`."""
        return 0

    def expired(self, key: Any, now: tuple, out: list[tuple]) -> None:
        """What is yielded when the timer goes off."""


class LatestRevisions(Ordered):
    """Of each item of a key the event of the highest revision; of equal ones the first. Yields those that have changed.

    The items of a key (the questions of an attempt) are few: they are kept together, as one value of their key.
    """

    state = "items array<long>, revisions array<long>, events array<long>"

    def __init__(self, keep: timedelta, key: str, item: str) -> None:
        super().__init__(keep)
        self.item, self.columns = item, (key, "item", "revision", "event_id")

    def step(self, key, now, e, out):
        if now is None:
            self.best: dict[int, tuple[int, int]] = {}
            self.changed: set[int] = set()
        elif now != ((),):
            self.best = {i: (r, n) for i, r, n in zip(*now)}
            self.changed = set()
        item = int(getattr(e, self.item))
        if item not in self.best or e.revision > self.best[item][0]:
            self.best[item] = (int(e.revision), int(e.event_id))
            self.changed.add(item)
        return ((),)  # put together when the batch is through

    def finish(self, key, now, out):
        out += [(key, i, *self.best[i]) for i in sorted(self.changed)]

    def packed(self, now):
        return (list(self.best), [r for r, _ in self.best.values()], [n for _, n in self.best.values()])


class Lease(Ordered):
    """Claims, granted if no lease runs; a lease lasts `seconds` or until a release. attempts counts the granted ones."""

    state = "until long, attempts int"
    columns = ("job_id", "event_id", "granted", "attempts")

    def __init__(self, keep: timedelta, seconds: int) -> None:
        super().__init__(keep)
        self.seconds = seconds

    def step(self, key, now, e, out):
        until, attempts = now or (0, 0)
        if e.kind == "release":
            return (0, attempts)
        at = int(e.ms)
        granted = at >= until
        if granted:
            until, attempts = at + self.seconds * 1000, attempts + 1
        out.append((key, int(e.event_id), granted, attempts))
        return (until, attempts)


#: How long a quiz may be in a state, and what is done then.
PATIENCE = {"queued": (180, "requeue"), "generating": (1200, "fail"), "ready": (300, "rescore")}


class Stuck(Ordered):
    """What is stuck and what to do, once for each time that a quiz enters a state: at the moment it has been there too
    long. Scores and states without a limit end the watch; after `tries` an unscored quiz is left alone."""

    state = "status string, since long, tries int"
    columns = ("quiz_id", "action", "at_ms")

    def __init__(self, keep: timedelta, tries: int) -> None:
        super().__init__(keep)
        self.tries = tries

    def due(self, now):
        return now[1] + PATIENCE[now[0]][0] * 1000

    def step(self, key, now, e, out):
        at = int(e.ms)
        if now and self.due(now) < at:  # its timer would have gone off between the two events
            self.expired(key, now, out)
        if e.status not in PATIENCE or (e.status == "ready" and e.scoring_attempts >= self.tries):
            return None
        return (e.status, at, int(e.scoring_attempts))

    def expired(self, key, now, out):
        out.append((key, PATIENCE[now[0]][1], self.due(now)))


class SubmitOnce(Ordered):
    """The first submission of an attempt counts; later ones are replays of it."""

    state = "event_id long, score double, replays int"
    columns = ("attempt_id", "submitted_by", "score", "replays")

    def step(self, key, now, e, out):
        return (int(e.event_id), float(e.score), 0) if now is None else (now[0], now[1], now[2] + 1)

    def finish(self, key, now, out):
        out.append((key, *now))


class Phases(Ordered):
    """Progress of a quiz, counted only while it is being generated: what comes after `ready` or `failed` is ignored."""

    state = "finished string, steps int, ignored int"
    columns = ("quiz_id", "status", "steps", "ignored")

    def step(self, key, now, e, out):
        finished, steps, ignored = now or ("", 0, 0)
        if finished:
            return (finished, steps, ignored + 1)
        return (e.kind, steps, ignored) if e.kind in ("ready", "failed") else ("", steps + 1, ignored)

    def finish(self, key, now, out):
        out.append((key, now[0] or "generating", *now[1:]))


def process(stream: DataFrame, key: str, processor: Ordered, schema: str, late: str) -> DataFrame:
    """A stream's events by key through a processor; ts is their time. See Ordered for slots."""
    with_state_store(stream.sparkSession)
    processor.key_kind = stream.schema[key].dataType.simpleString()
    # keys that are null have a slot of their own, as pandas turns whole numbers among nulls to floating ones
    slot = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(SLOTS))).cast("int").alias("slot")
    rows = stream.withWatermark("ts", late).select(slot, "*", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return rows.groupBy("slot").transformWithStateInPandas(processor, schema, "Append", "EventTime")
