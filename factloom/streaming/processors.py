"""Stateful processors: sessions with idle seals and controls, file changes with a baseline, time groups with late rows.

Rows wait in state until the watermark has passed them and are then taken in event-time order, so the order in which they
arrive within the delay plays no part. One event-time timer a key wakes it for the next waiting row or deadline. They need
the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``), which keeps state on disk.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.events import CAP, IDLE

_IDLE_US = int(IDLE.total_seconds() * 1_000_000)
#: Reasons for which controls seal what is open; a branch switch discards it.
_REASONS = {"commit": "git", "manual": "manual"}


class InOrder(StatefulProcessor):
    """Hands a key's rows (tuples that begin with us, later, seq) to ``step`` in order, once the watermark has passed them."""

    row = "us long, later int, seq long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.begin(handle)

    def begin(self, handle: StatefulProcessorHandle) -> None:
        """Set up further state."""

    def step(self, due: list[tuple], now: int) -> list[tuple]:
        """Output rows (without the key) for rows that are due, and for deadlines up to ``now`` (microseconds)."""
        raise NotImplementedError

    def deadline(self) -> int | None:
        """The time in microseconds at which something happens without another row."""
        return None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        given = [tuple(None if pd.isna(x) else x for x in r) for pdf in rows for r in pdf.iloc[:, 1:].itertuples(index=False, name=None)]  # numbers are never null
        if given:
            self.waiting.appendList(given)
        yield self._advance(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance(key, timerValues)

    def close(self) -> None:
        pass

    def _advance(self, key, timers) -> pd.DataFrame:
        now = max(0, timers.getCurrentWatermarkInMs()) * 1000
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:3])
        due = [r for r in rows if r[0] <= now]
        if due:
            rows = rows[len(due) :]
            self.waiting.put(rows) if rows else self.waiting.clear()
        out = self.step(due, now)
        wake = [t for t in (rows[0][0] if rows else None, self.deadline()) if t is not None]
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if wake:
            self.handle.registerTimer(max(-(-min(wake) // 1000), now // 1000 + 1))
        return pd.DataFrame([(key[0], *r) for r in out], columns=self.names)


class SessionProcessor(InOrder):
    """Sessions of a key: sealed at CAP distinct identities, after IDLE time, by a commit or by hand; discarded by a branch switch.

    Rows of one ``batch`` that follow each other are added as one: the cap is looked at behind them, so such a session may pass it.
    """

    row = "us long, later int, seq long, name string, kind string, batch string"

    def __init__(self, names: list[str]):
        self.names = names

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", "seq long, name string")
        self.meta = handle.getValueState("meta", "number long, last long")

    def deadline(self) -> int | None:
        return self.meta.get()[1] + _IDLE_US if self.meta.exists() and self.meta.get()[1] is not None else None

    def step(self, due: list[tuple], now: int) -> list[tuple]:
        number, last = self.meta.get() if self.meta.exists() else (0, None)
        held, out = [tuple(r) for r in self.open.get()] if last is not None else [], []

        def seal(reason: str) -> None:
            nonlocal number, last
            number += 1
            out.extend((seq, number, reason) for seq, _ in held)
            held.clear()
            last = None

        for _, rows in groupby(enumerate(due), key=lambda p: ("batch", p[1][5]) if p[1][5] is not None and p[1][4] is None else ("row", p[0])):
            rows = [r for _, r in rows]
            us, kind = rows[0][0], rows[0][4]
            if held and us - last >= _IDLE_US:
                seal("idle")
            if kind is not None:
                if held and kind in _REASONS:
                    seal(_REASONS[kind])
                elif kind == "branch-switch":
                    held.clear()
                    last = None
                continue
            held.extend((r[2], r[3]) for r in rows)
            last = rows[-1][0]
            if len({name for _, name in held}) >= CAP:
                seal("cap")
        if held and last + _IDLE_US <= now:
            seal("idle")
        self.meta.update((number, last))
        self.open.put(held) if held else self.open.clear()
        return out


def watched_sessions(stream: DataFrame, key: str, identity: str, batch: str | None = None) -> DataFrame:
    """key, seq, session, sealed_by of the events of every session that has ended, when it has.

    ``stream`` has key, ts (with a watermark), seq, the identity and kind: null for events; commit, manual and branch-switch for
    controls, which come after the events of their time. What ``operators.events.watched_sessions`` calls open is still in
    state; an idle session ends when the watermark passes its deadline, without another event of its key.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(identity).cast("string")), F.lit(""))
    rows = stream.select(key, F.unix_micros("ts").alias("us"), F.col("kind").isNotNull().cast("int").alias("later"), F.coalesce(F.col("seq").cast("long"), F.lit(-1)).alias("seq"), name.alias("name"), "kind", (F.col(batch).cast("string") if batch else F.lit(None).cast("string")).alias("batch"), "ts")
    kind = stream.schema[key].dataType.simpleString()
    names = [key, "seq", "session", "sealed_by"]
    return rows.groupBy(key).transformWithStateInPandas(_WithoutTime(SessionProcessor(names)), f"{key} {kind}, seq long, session int, sealed_by string", "Append", "EventTime")


class _WithoutTime(StatefulProcessor):
    """A processor whose rows end in the event-time column, which only Spark needs."""

    def __init__(self, inner: InOrder):
        self.inner = inner

    def init(self, handle) -> None:
        self.inner.init(handle)

    def handleInputRows(self, key, rows, timerValues):
        yield from self.inner.handleInputRows(key, (pdf.iloc[:, :-1] for pdf in rows), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self.inner.handleExpiredTimer(key, timerValues, expiredTimerInfo)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.inner.handleInitialState(key, initialState, timerValues)

    def close(self) -> None:
        self.inner.close()


def differences(old: dict[str, str], new: dict[str, str]) -> list[tuple[str, str]]:
    """(identity, type) of what was added, deleted or changed between two states of a file, by identity."""
    return [(i, "added" if i not in old else "deleted" if i not in new else "changed") for i in sorted({*old, *new}) if old.get(i) != new.get(i)]


class FileProcessor(InOrder):
    """Changes of a file: saves count once quiet for the delay, a removal at once, and it cancels the save that waits.

    State is a save that waits, the last signature, the last declarations that were seen, and the baseline's. A save is
    compared with the declarations seen before it, at first with the baseline; a removal with the baseline, whose
    declarations it deletes, if there are any. What was seen before a removal stays what a later save is compared with.
    """

    row = "us long, later int, seq long, op string, facts string"

    def __init__(self, names: list[str], delay_us: int):
        self.names, self.delay = names, delay_us

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.base = handle.getValueState("base", "facts string")
        self.seen = handle.getValueState("seen", "signature string, facts string")
        self.pending = handle.getValueState("pending", "us long, seq long, facts string")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for row in initialState.itertuples(index=False):
            self.base.update((row.facts,))

    def deadline(self) -> int | None:
        return self.pending.get()[0] + self.delay if self.pending.exists() else None

    def step(self, due: list[tuple], now: int) -> list[tuple]:
        base = json.loads(self.base.get()[0]) if self.base.exists() else {}
        signature, seen = self.seen.get() if self.seen.exists() else (None, None)
        waits, out = tuple(self.pending.get()) if self.pending.exists() else None, []

        def observe(us: int, seq: int, facts: str | None) -> None:
            nonlocal signature, seen
            new = json.loads(facts) if facts else {}
            told = json.dumps(new, sort_keys=True)
            if facts is None and not base or told == signature:
                return
            old = base if facts is None or seen is None else json.loads(seen)
            signature, seen = told, seen if facts is None else told
            out.extend((seq, us, identity, kind) for identity, kind in differences(old, new))

        for us, _, seq, op, facts in due:
            if waits and us - waits[0] >= self.delay:
                observe(*waits)
            waits = None
            if op == "unlink":
                observe(us, seq, None)
            else:
                waits = (us, seq, facts or "{}")
        if waits and waits[0] + self.delay <= now:
            observe(*waits)
            waits = None
        if signature is not None:
            self.seen.update((signature, seen))
        self.pending.update(waits) if waits else self.pending.clear()
        return out


def file_changes(stream: DataFrame, baseline: DataFrame, delay_seconds: float) -> DataFrame:
    """file, seq, ts, identity, type of the changes that a feed of file events makes, when they are sure.

    ``stream`` has file, ts (with a watermark), seq, op (add, change, unlink) and facts (identity to signature, a map), as
    ``baseline`` has by file. ``operators.events.file_changes`` is the same over a whole feed.
    """
    rows = stream.select("file", F.unix_micros("ts").alias("us"), F.lit(0).alias("later"), F.col("seq").cast("long").alias("seq"), "op", F.to_json("facts").alias("facts"), "ts")
    first = baseline.select("file", F.to_json("facts").alias("facts")).groupBy("file")
    processor = _WithoutTime(FileProcessor(["file", "seq", "us", "identity", "type"], int(delay_seconds * 1_000_000)))
    out = rows.groupBy("file").transformWithStateInPandas(processor, "file string, seq long, us long, identity string, type string", "Append", "EventTime", initialState=first)
    return out.select("file", "seq", F.timestamp_micros("us").alias("ts"), "identity", "type")


class GroupProcessor(StatefulProcessor):
    """Time groups of a key with its own watermark: the latest time seen, less the delay. Rows behind it are late, and only told."""

    def __init__(self, names: list[str], gap_us: int, delay_us: int):
        self.names, self.gap, self.delay = names, gap_us, delay_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "us long, seq long")
        self.meta = handle.getValueState("meta", "latest long, passed long, grp long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        latest, passed, group, last = self.meta.get() if self.meta.exists() else (None, None, 0, None)
        held, out = {tuple(r) for r in self.waiting.get()}, []
        given = [(int(us), int(seq)) for pdf in rows for us, seq in pdf.iloc[:, 1:].itertuples(index=False, name=None)]
        for us, seq in given:  # against the watermark of the batches before, as the order within one is not known
            if passed is not None and us <= passed:
                out.append((seq, us, None, True))
            else:
                held.add((us, seq))  # a repeated row that still waits is one
            latest = us if latest is None else max(latest, us)
        passed = max(latest - self.delay, passed) if passed is not None else latest - self.delay
        for us, seq in sorted(r for r in held if r[0] <= passed):
            group += last is None or us - last >= self.gap
            last = us
            out.append((seq, us, group, False))
        left = sorted(r for r in held if r[0] > passed)
        self.waiting.put(left) if left else self.waiting.clear()
        self.meta.update((latest, passed, group, last))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=self.names).astype({"grp": "Int64"})

    def close(self) -> None:
        pass


def time_groups(stream: DataFrame, gap_minutes: int, key: str, delay_seconds: float) -> DataFrame:
    """key, seq, ts, grp, late: the groups of ``operators.events.time_groups``, told as soon as no earlier row can come within the delay.

    Rows that come later than the delay have ``late`` and no group; a sink keeps them in a table of their own (``split_late``).
    Rows that are repeated while they wait count once. ``stream`` needs no watermark, as each key has its own.
    """
    rows = stream.select(key, F.unix_micros("ts").alias("us"), F.col("seq").cast("long").alias("seq"))
    kind = stream.schema[key].dataType.simpleString()
    processor = GroupProcessor([key, "seq", "us", "grp", "late"], gap_minutes * 60_000_000, int(delay_seconds * 1_000_000))
    out = rows.groupBy(key).transformWithStateInPandas(processor, f"{key} {kind}, seq long, us long, grp long, late boolean", "Append", "None")
    return out.select(key, "seq", F.timestamp_micros("us").alias("ts"), "grp", "late")


def split_late(groups: DataFrame, path: str, late_path: str, checkpoint: str):
    """A started query that appends groups to ``path`` and late rows to ``late_path``; each micro-batch once, by its number."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        kept.where("not late").drop("late").write.mode("overwrite").parquet(f"{path}/batch={number}")
        kept.where("late").drop("late", "grp").write.mode("overwrite").parquet(f"{late_path}/batch={number}")
        kept.unpersist()

    return groups.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
