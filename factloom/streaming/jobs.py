"""Structured Streaming counterparts of the order-dependent log operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.events import SessionFold


def sessions(stream: DataFrame, key: str, identity: str) -> DataFrame:
    """key, seq, session of every event: the batch fold, with its state kept per key.

    Events of a key have to arrive in order between micro-batches; within one they are sorted.
    """
    kind = stream.schema[key].dataType.simpleString()

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = SessionFold()
        if state.exists:
            number, last, names = state.get
            fold = SessionFold(number, pd.Timestamp(last), names)
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        numbers = [fold.place(t, i) for t, i in zip(rows["ts"], rows[identity], strict=True)]
        state.update((fold.number, str(fold.last), [str(x) for x in fold.identities]))
        yield pd.DataFrame({key: [group[0]] * len(rows), "seq": rows["seq"].to_numpy(), "session": numbers})

    keyed = stream.select(key, "seq", "ts", F.col(identity).cast("string").alias(identity)).groupBy(key)
    return keyed.applyInPandasWithState(step, f"{key} {kind}, seq long, session long", "number long, last string, identities array<string>", "append", GroupStateTimeout.NoTimeout)


def debounced(stream: DataFrame, key: str, delay_seconds: float) -> DataFrame:
    """key, seq, ts of events that no other of the key follows within the delay; the last waits for the watermark.

    ``stream`` needs a watermark on ts.
    """
    kind = stream.schema[key].dataType.simpleString()
    delay = pd.Timedelta(seconds=delay_seconds)

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        pending = state.get if state.exists else None
        if state.hasTimedOut:
            out.append(pending)
            state.remove()
        else:
            for row in pd.concat(list(batches)).sort_values(["ts", "seq"]).itertuples(index=False):
                if pending is not None and row.ts - pd.Timestamp(pending[1]) >= delay:
                    out.append(pending)
                pending = (int(row.seq), str(row.ts))
            state.update(pending)
            due = int((pd.Timestamp(pending[1]) + delay).timestamp() * 1000)
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [group[0]] * len(out), "seq": [x[0] for x in out], "ts": pd.to_datetime([x[1] for x in out])})

    keyed = stream.select(key, "seq", "ts").groupBy(key)
    return keyed.applyInPandasWithState(step, f"{key} {kind}, seq long, ts timestamp", "seq long, ts string", "append", GroupStateTimeout.EventTimeTimeout)


def changed_signatures(stream: DataFrame, key: str, signature: str, baseline: DataFrame | None = None) -> DataFrame:
    """key, seq, signature of observations that differ from the key's last seen one, at first from the baseline's (key, signature).

    The baseline is a static table, one row a key, that every micro-batch is joined with.
    """
    if baseline is not None:
        stream = stream.join(baseline.select(key, F.col(signature).alias("_base")), key, "left")
    else:
        stream = stream.withColumn("_base", F.lit(None).cast("string"))
    kind = stream.schema[key].dataType.simpleString()

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq")
        last = state.get[0] if state.exists else rows["base"].iloc[0]
        out = []
        for row in rows.itertuples(index=False):
            if row.sig != last:
                out.append((group[0], int(row.seq), row.sig))
                last = row.sig
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, "seq", signature])

    keyed = stream.select(key, "seq", F.col(signature).alias("sig"), F.col("_base").alias("base")).groupBy(key)
    return keyed.applyInPandasWithState(step, f"{key} {kind}, seq long, {signature} string", "sig string", "append", GroupStateTimeout.NoTimeout)
