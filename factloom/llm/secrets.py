"""Secrets in texts: strict patterns, and weak parts of a credential that count only beside their counterparts.

A credential has parts: an access identifier, a secret and an endpoint. Strict matches (assign, access, hex) are always
reported. Weak parts (a user name, a short password, an opaque token, a host) are found at ``label: value`` and ``label = value``
places and in URLs, and are reported only if parts that complete them lie in the same scope: a block of lines without an empty
line between them, at most REACH characters apart. That is an interval join of the parts' surroundings with the parts of the
other roles; a scope lies within one text, so it joins sorted arrays in the task that holds the texts, and nothing is shuffled.
Only the nearest counterpart on each side is looked at, so a text of nothing but parts costs no more than its sort.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, small_batches

#: Kinds in the order in which spans of one start are listed: the strict ones, then the weak parts.
STRICT, WEAK = ("assign", "access", "hex"), ("identifier", "secret", "endpoint")
IDENTIFIER, SECRET, ENDPOINT = range(3)
#: Characters between two parts of a credential at most.
REACH = 300
#: Characters of a label at most, and of a weak value.
LABEL, VALUE = 48, 256

# The strict patterns; a match that is too short is dropped and not tried again.
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
_ASSIGN_LABELS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN_VALUE, _ACCESS_LENGTH = 12, 18
# Endings of labels, in lower case and without - and _, by role; the longest that fits decides.
_LABELS = {
    IDENTIFIER: "user username userid login account accountid clientid appid tenantid accesskey accesskeyid keyid".split(),
    SECRET: "password passwd passphrase pass pwd secret token apikey privatekey secretkey secretaccesskey authkey credential".split(),
    ENDPOINT: "host hostname server endpoint url uri dsn".split(),
}
_ROLE = {label: role for role, labels in _LABELS.items() for label in labels}
_LONGEST_FIRST = sorted(_ROLE, key=len, reverse=True)
_SEPARATOR = re.compile("[:=]")
_LABEL = re.compile(r"([A-Za-z][A-Za-z0-9_-]*)[\"']?\x20*\Z")
_OPENING = re.compile(r"\x20*[\"']?")
_VALUES = {
    IDENTIFIER: re.compile(rf"[A-Za-z0-9@._+-]{{3,{VALUE}}}"),
    SECRET: re.compile(rf"[^\s\"',;<>]{{6,{VALUE}}}"),
    ENDPOINT: re.compile(rf"(?:[a-z][a-z0-9+.-]*://[^\s\"'<>]{{3,{VALUE}}}|localhost(?::[0-9]+)?|[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?)"),
}
_URL = re.compile(r"//(?:([^\s\"'<>/?#:@]{2,}):([^\s\"'<>/?#@]{4,})@)?[^\s\"'<>@]{3,}")
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}={0,2}")
_BLANK = re.compile(r"\n[\x20\t\r]*\n")
_MIXED = [re.compile(x) for x in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")]


def _mixed(value: str) -> int:
    return sum(bool(x.search(value)) for x in _MIXED)


def strict_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, place in STRICT) of the strict matches, leftmost and non-overlapping within their kind."""
    out = []
    low = text.lower()
    if any(x in low for x in _ASSIGN_LABELS):
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= _ASSIGN_VALUE]
    out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if len(m[0]) >= _ACCESS_LENGTH]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def _role(label: str) -> int | None:
    bare = label.lower().replace("_", "").replace("-", "")
    return next((_ROLE[x] for x in _LONGEST_FIRST if bare.endswith(x)), None)


def weak_parts(text: str, strict: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bool]]:
    """(start, end, role, opaque) of the weak parts, none of which touches a strict span; empty if no rule can need them."""
    out = []
    for m in _SEPARATOR.finditer(text):
        before = _LABEL.search(text, max(0, m.start() - LABEL), m.start())
        if not before:
            continue
        if text.startswith("//", m.end()):
            if url := _URL.match(text, m.end()):
                out.append((before.start(1), url.end(), ENDPOINT, False))
                if url[1]:
                    out += [(*url.span(1), IDENTIFIER, False), (*url.span(2), SECRET, False)]
            continue
        role = _role(before[1])
        if role is None:
            continue
        value = _VALUES[role].match(text, _OPENING.match(text, m.end()).end())
        if value and (role != SECRET or _mixed(value[0]) >= 2):
            out.append((*value.span(), role, False))
    known = any(kind == 1 for *_, kind in strict) or any(role == IDENTIFIER for _, _, role, _ in out)
    if not known and all(role != SECRET for _, _, role, _ in out):
        return []
    if known:
        out += [(*m.span(), SECRET, True) for m in _OPAQUE.finditer(text) if all(x.search(m[0]) for x in _MIXED[:3])]
    if strict and out:
        starts, ends = np.array([s[0] for s in strict]), np.maximum.accumulate([s[1] for s in strict])
        at = np.searchsorted(starts, [p[1] for p in out]) - 1  # the last strict span that starts before the part ends
        out = [p for p, i in zip(out, at, strict=True) if i < 0 or ends[i] <= p[0]]
    return sorted(set(out))


class _Nearest:
    """Parts of one role, sorted by both ends, to be joined with the surroundings of others."""

    def __init__(self, start: np.ndarray, end: np.ndarray, block: np.ndarray):
        by_start, by_end = np.argsort(start, kind="stable"), np.argsort(end, kind="stable")
        self.next_start, self.next_block = start[by_start], block[by_start]
        self.last_end, self.last_start, self.last_block = end[by_end], start[by_end], block[by_end]

    def of(self, start: np.ndarray, end: np.ndarray, block: np.ndarray) -> np.ndarray:
        """The start of the nearest part that does not touch, in the same block and within REACH; -1 without one."""
        found, gap = np.full(len(start), -1), np.full(len(start), REACH + 1)
        if len(self.next_start) and len(start):
            at = np.searchsorted(self.last_end, start, side="right") - 1
            fits = (at >= 0) & (self.last_block[at] == block) & (start - self.last_end[at] <= REACH)
            found[fits], gap[fits] = self.last_start[at[fits]], (start - self.last_end[at])[fits]
            at = np.minimum(np.searchsorted(self.next_start, end), len(self.next_start) - 1)
            away = self.next_start[at] - end
            fits = (away >= 0) & (self.next_block[at] == block) & (away < gap)
            found[fits] = self.next_start[at[fits]]
        return found


def linked_parts(start: np.ndarray, end: np.ndarray, block: np.ndarray, role: np.ndarray, weak: np.ndarray, opaque: np.ndarray) -> np.ndarray:
    """For every part the start of the nearest counterpart if the part is weak and completed in its scope, else -1.

    A weak identifier needs a secret; a labelled secret an identifier or an endpoint, an opaque one an identifier; an
    endpoint both an identifier and a secret.
    """
    near = [_Nearest(start[role == r], end[role == r], block[role == r]).of(start, end, block) for r in range(3)]
    from_secret = np.where(near[IDENTIFIER] >= 0, near[IDENTIFIER], np.where(opaque, -1, near[ENDPOINT]))
    from_endpoint = np.where(near[SECRET] >= 0, near[IDENTIFIER], -1)
    partner = np.choose(role, [near[SECRET], from_secret, from_endpoint])
    return np.where(weak, partner, -1)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("partner", pa.int32())])
_ROLE_OF_STRICT = (SECRET, IDENTIFIER, SECRET)


def spans_of(texts: list[str]) -> list[list[tuple]]:
    """(kind, start, end, base, partner) of every text's spans, by start and kind; all texts' parts are joined at once."""
    found, parts, blocks, first = [], [], [], 0
    for i, text in enumerate(texts):
        strict = strict_spans(text)
        found.append([(start, kind, end, None) for start, end, kind in strict])
        weak = weak_parts(text, strict)
        if weak:
            blocks += [first, *(first + m.end() for m in _BLANK.finditer(text))]
            parts += [(i, first, start + first, end + first, _ROLE_OF_STRICT[kind], False, False) for start, end, kind in strict]
            parts += [(i, first, start + first, end + first, role, True, opaque) for start, end, role, opaque in weak]
        first += len(text) + 1
    if parts:
        doc, base, start, end, role, is_weak, opaque = (np.array(x) for x in zip(*parts, strict=True))
        partner = linked_parts(start, end, np.searchsorted(np.array(blocks), start, side="right"), role, is_weak, opaque)
        for k in np.flatnonzero(partner >= 0):
            found[doc[k]].append((int(start[k] - base[k]), len(STRICT) + int(role[k]), int(end[k] - base[k]), int(partner[k] - base[k])))
    kinds = STRICT + WEAK
    return [[(kinds[k], start, end, k < len(STRICT), partner) for start, k, end, partner in sorted(x, key=lambda s: s[:3])] for x in found]


def _masked(text: str | None, spans: list[tuple]) -> str | None:
    out, at = [], 0
    for kind, start, end, *_ in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def _run(docs: DataFrame, text_col: str, fields: list[T.StructField], made) -> DataFrame:
    """``docs`` without the columns that ``fields`` name, and those of ``made(texts)`` behind them."""
    small_batches(docs)
    named = {f.name.lower() for f in fields}
    kept = [c for c in docs.columns if c.lower() not in named]
    shape = T.StructType([*(docs.schema[c] for c in kept), *fields])
    read = docs.select(*[col(c) for c in kept], col(text_col).cast("string").alias("_read"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = made(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=shape.names)

    return read.mapInArrow(run, shape)


def find_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns and ``spans``: kind, start, end (code points, end exclusive), base, and of weak parts the start of their partner.

    Spans are ordered by start and kind; strict ones stay whatever the weak parts are. A null or empty text has none; rows
    are judged each by itself, so repeated rows and ids fare alike; an empty table gives no rows; a column that is already
    called ``spans`` is replaced.
    """
    shown = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType()), T.StructField("partner", T.IntegerType())]))

    def made(texts: list) -> list[pa.Array]:
        rows = [[dict(zip(_SPAN.names, s, strict=True)) for s in spans] for spans in spans_of([x or "" for x in texts])]
        return [pa.array(rows, pa.list_(_SPAN))]

    return _run(docs, text_col, [T.StructField("spans", shown)], made)


def mask_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind, as <ASSIGN>; where spans overlap, the first one stands for all. Null texts stay."""
    order = docs.columns

    def made(texts: list) -> list[pa.Array]:
        return [pa.array([_masked(t, s) for t, s in zip(texts, spans_of([x or "" for x in texts]), strict=True)], pa.string())]

    return _run(docs, text_col, [T.StructField(text_col, T.StringType())], made).select(*[col(c) for c in order])


def span_list(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
