"""What several corpus operators share: lineage cuts, `let` bindings and vectorised word hashing."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a local session gets a temporary folder; on a cluster that would be one machine's, so it is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp())
    return df.checkpoint()


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the ``wanted`` ones that ``df`` has not, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """The column of just this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


#: Bytes of an Arrow batch that goes to Python at most, besides a single longer row.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> None:
    """Lower the session's Arrow batch size to BATCH_BYTES, which bounds the memory of Python workers; never raises it.

    Spark reads it when a frame runs, and the operators' frames run after they return, so it stays.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key).rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def splitmix(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser over unsigned 64-bit values."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = splitmix(np.arange(256, dtype=np.uint64) + np.uint64(77))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
#: Texts are hashed in slices of about this many bytes, cut between documents, which bounds the memory of a batch.
SLICE_BYTES = 500_000


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    out = _POWERS.get(base, np.ones(1, dtype=np.uint64))
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    if len(out) <= 2 * SLICE_BYTES:
        _POWERS[base] = out
    return out[:n]


def hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of documents laid end to end, with A-Z lower-cased.

    ``data`` holds the UTF-8 bytes, ``offsets`` the n + 1 document borders. Words are maximal runs of bytes other than
    space and 0x09-0x0D. Returns the hashes in order and the n + 1 borders of the documents among them.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = _LOWER[data]
    inside = ~_SPACE[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[(offsets < n)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[1:][(offsets[1:] > 0)] - 1
    last[ends] = inside[ends]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[low] * _powers(_BASE, n), out=total[1:])
        words = splitmix((total[stops] - total[starts]) * _powers(_INVERSE, n)[starts] + (stops - starts).astype(np.uint64))
    return words, np.searchsorted(starts, offsets).astype(np.int64)


def slices(texts: pa.Array, budget: int = SLICE_BYTES):
    """(first index, bytes, offsets) for runs of documents of about ``budget`` bytes; a longer document is a run of its own."""
    raw = texts.fill_null("").cast(pa.large_binary())
    if not len(raw):
        return
    _, ends, data = raw.buffers()
    ends = np.frombuffer(ends, np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(raw):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + budget, side="right")) - 1)
        yield at, data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words that start at each position (borders between documents are the caller's)."""
    n = max(0, len(words) - width + 1)
    out = np.full(n, np.uint64(width))
    with np.errstate(over="ignore"):
        for i in range(width):
            out = splitmix(out * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n])
    return out
