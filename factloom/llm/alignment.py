"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often over the corpus.

Every text is tokenised once by both; what is kept are the ids, packed. Links (token pairs with a common byte) are segments
between neighbouring token ends of either side, so they follow from two sorted arrays. A pair of ids is one packed 64-bit key,
a * 2**32 + b. Tasks count the documents that hold a key by ``np.unique``; the partial counts are range-partitioned into a
global sort, and every partition sums its runs and writes a sorted shard, keys and counts, into the folder that all machines
share. Documents then look their keys up by ``searchsorted`` in the memory-mapped shards, of which only the touched pages are
read. Nothing of the corpus reaches the driver but the shards' borders and the highest count of each id of the first
vocabulary.
"""

from __future__ import annotations

import contextlib
import functools
import json
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, small_batches

#: Tokens of both sides that are aligned at a time (a longer text alone), and keys that a task holds before it hands its counts on.
SLICE_TOKENS, HELD_KEYS = 400_000, 1_000_000
#: Partial counts that go to a shard, and shards at most: sums shrink as they stream, so a shard holds only its own distinct keys.
SHARD_KEYS, MOST_SHARDS = 1_000_000, 4096
# The split pattern of byte-level BPE, a fixed value.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.lru_cache(maxsize=2)
def byte_level(path: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    """An encoder of a byte-level BPE file whose ids are in merge order, and the bytes of every id; specials are plain text."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters, vocabulary = _byte_letters(), spec["model"]["vocab"]
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[x] for x in token): i for token, i in vocabulary.items() if token not in special}
    merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    if merged != sorted(merged):
        raise ValueError(f"ids of {path} are not in merge order")
    pieces = [b""] * (1 + max([*ranks.values(), *(t["id"] for t in spec["added_tokens"])]))
    for token, i in ranks.items():
        pieces[i] = token
    return tiktoken.Encoding("byte_level", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}), pieces


@functools.lru_cache(maxsize=2)
def piece_model(path: str) -> tuple[sentencepiece.SentencePieceProcessor, list[bytes]]:
    """A sentencepiece model and the bytes of every id; unknown and control pieces have none, so texts that need them differ."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = []
    for i in range(len(model)):
        piece = model.id_to_piece(i)
        named = model.is_unknown(i) or model.is_control(i)
        pieces.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else b"" if named else piece.replace("▁", " ").encode())
    return model, pieces


def _width(pieces: list) -> str:
    """The packed form of an id: two bytes if all ids of the vocabulary fit, else four."""
    return "<u2" if len(pieces) <= 1 << 16 else "<u4"


def _packed(lists: list, width: str) -> pa.Array:
    return pa.array([np.asarray(x, dtype=width).tobytes() for x in lists], pa.binary())


def tokenise(docs: DataFrame, byte_level_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, a_ids and b_ids (packed little-endian unsigned integers of ``_width``) of every row.

    Side a is byte-level BPE over a space and the text, side b the piece model, which adds the space itself. A text that is
    null or empty, or that either side does not give back byte by byte, has no tokens. Repeated rows and ids are rows of
    their own, a null id stays; other columns are left out.
    """
    small_batches(docs)
    most = SLICE_TOKENS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (a, a_bytes), (b, b_bytes) = byte_level(byte_level_path), piece_model(piece_path)
        for batch in batches:
            texts, at = batch.column(1).fill_null("").to_pylist(), 0
            while at < len(texts):
                to, size = at + 1, len(texts[at])
                while to < len(texts) and size + len(texts[to]) < most:
                    size += len(texts[to])
                    to += 1
                left, right = [], []
                for text, y in zip(texts[at:to], b.encode(texts[at:to], num_threads=1), strict=True):
                    x, whole = a.encode_ordinary(" " + text) if text else [], (" " + text).encode()
                    same = bool(text) and b"".join(map(b_bytes.__getitem__, y)) == whole and b"".join(map(a_bytes.__getitem__, x)) == whole
                    left.append(x if same else [])
                    right.append(y if same else [])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), _packed(left, _width(a_bytes)), _packed(right, _width(b_bytes))], names=["id", "a_ids", "b_ids"])
                at = to

    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, a_ids binary, b_ids binary").withColumnRenamed("id", id_col)


@dataclass
class _Slice:
    """The tokens of some documents laid end to end, with their links; ``*_at`` are the documents' borders among them."""

    at: int
    n: int
    a: np.ndarray
    b: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    a_end: np.ndarray
    b_end: np.ndarray
    common: np.ndarray
    keys: np.ndarray
    doc: np.ndarray


def _flat(column: pa.Array, width: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows end to end, and the rows' n + 1 borders."""
    raw, size = column.cast(pa.large_binary()), np.dtype(width).itemsize
    _, ends, data = raw.buffers()
    ends = np.frombuffer(ends, np.int64)[raw.offset : raw.offset + len(raw) + 1]
    ids = np.frombuffer(data, width, count=int(ends[-1]) // size) if data is not None and ends[-1] else np.zeros(0, width)
    return ids[ends[0] // size :], (ends - ends[0]) // size


def _slices(a_column: pa.Array, b_column: pa.Array, a_size: np.ndarray, b_size: np.ndarray, most: int) -> Iterator[_Slice]:
    if not len(a_column):
        return
    (a, a_at), (b, b_at) = _flat(a_column, _width(a_size)), _flat(b_column, _width(b_size))
    total, at, n = a_at + b_at, 0, len(a_column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
        x, y = a[a_at[at] : a_at[to]], b[b_at[at] : b_at[to]]
        x_at, y_at = a_at[at : to + 1] - a_at[at], b_at[at : to + 1] - b_at[at]
        x_end, y_end = np.cumsum(a_size[x]), np.cumsum(b_size[y])
        cuts = np.concatenate([x_end, y_end])
        cuts.sort(kind="stable")  # two sorted runs: one merge
        again = np.zeros(len(cuts), bool)
        again[1:] = cuts[1:] == cuts[:-1]
        common, cuts = cuts[again], cuts[~again]
        keys = x[np.searchsorted(x_end, cuts)].astype(np.int64) << 32 | y[np.searchsorted(y_end, cuts)].astype(np.int64)
        borders = np.concatenate([[0], x_end])[x_at[1:]]
        yield _Slice(at, to - at, x, y, x_at, y_at, x_end, y_end, common, keys, np.searchsorted(borders, cuts))
        at = to


def _sizes(byte_level_path: str, piece_path: str) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array([len(x) for x in side(path)[1]], dtype=np.int64) for side, path in ((byte_level, byte_level_path), (piece_model, piece_path)))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run-length sums of the counts of equal keys, sorted by key."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def partial_counts(tokens: DataFrame, byte_level_path: str, piece_path: str) -> DataFrame:
    """key, n: in how many of some documents a pair of ids is linked; a key comes once for about every HELD_KEYS keys of a task."""
    most, most_keys = SLICE_TOKENS, HELD_KEYS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_size, b_size = _sizes(byte_level_path, piece_path)
        held, size = [], 0

        def out(parts):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in parts], names=["key", "n"])

        for batch in batches:
            for s in _slices(batch.column(0), batch.column(1), a_size, b_size, most):
                known, code = np.unique(s.keys, return_inverse=True)
                if not len(known):
                    continue
                in_docs = np.unique(s.doc * len(known) + code) % len(known)
                held.append((known, np.bincount(in_docs, minlength=len(known)).astype(np.int64)))
                size += len(known)
                if size > 2 * most_keys:
                    held = [_summed(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))]
                    size = len(held[0][0])
                    if size > most_keys:
                        yield out(held[0])
                        held, size = [], 0
        if held:
            yield out(_summed(*(np.concatenate([h[i] for h in held]) for i in (0, 1))))

    return tokens.select("a_ids", "b_ids").mapInArrow(run, "key long, n long")


@dataclass(frozen=True)
class PairCounts:
    """Sorted shards of (key, count): per shard its first and last key, number of keys and place; the highest count of every id of side a."""

    shards: list[tuple[int, int, int, str]]
    best: np.ndarray


def _filed(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def _write(uri: str, keys: np.ndarray, counts: np.ndarray) -> None:
    """Write under a name of this attempt, then move: a retried or doubled task leaves one whole file."""
    store, path = _filed(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        out.write(keys.tobytes())
        out.write(counts.tobytes())
    store.move(own, path)


def count_pairs(tokens: DataFrame, byte_level_path: str, piece_path: str) -> PairCounts:
    """Count, over all rows of ``tokenise``, the documents in which each pair of ids is linked; shards go to the checkpoint folder.

    ``tokens`` should be checkpointed, as it is read again for the lookup. No rows give no shards.
    """
    partial = checkpointed(partial_counts(tokens, byte_level_path, piece_path))
    n = partial.count()
    folder = f"{tokens.sparkSession.sparkContext.getCheckpointDir()}/pairs-{uuid.uuid4().hex}"
    shards = max(1, min(MOST_SHARDS, -(-n // SHARD_KEYS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for batch in batches:  # sorted, so the runs of a batch are summed at once; keys on a border between batches are summed below
            parts.append(_summed(np.asarray(batch.column(0)), np.asarray(batch.column(1))))
        keys, counts = _summed(*(np.concatenate([p[i] for p in parts]) for i in (0, 1)))
        if len(keys):
            place = f"{folder}/{TaskContext.get().partitionId():06d}"
            _write(place, keys, counts)
            ids = keys >> 32
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            yield pa.RecordBatch.from_pydict({"first": keys[:1], "last": keys[-1:], "n": [len(keys)], "place": [place], "ids": [ids[first]], "best": [np.maximum.reduceat(counts, first)]})

    sort = partial.repartitionByRange(shards, "key").sortWithinPartitions("key")
    rows = sort.mapInArrow(run, "first long, last long, n long, place string, ids array<long>, best array<long>").collect()  # a row a shard, an id of the vocabulary in all
    best = np.zeros(max([0, *(r["ids"][-1] + 1 for r in rows)]), np.int64)
    for r in rows:
        np.maximum.at(best, np.asarray(r["ids"]), np.asarray(r["best"]))
    return PairCounts(sorted((r["first"], r["last"], r["n"], r["place"]) for r in rows), best)


_MAPPED: dict[str, np.ndarray] = {}


def _shard(place: str, n: int) -> np.ndarray:
    """keys and counts of a shard, memory-mapped; from a store that is no file system, through an unnamed file of this worker."""
    if place not in _MAPPED:
        for old in [x for x in _MAPPED if os.path.dirname(x) != os.path.dirname(place)]:
            del _MAPPED[old]
        store, path = _filed(place)
        if isinstance(store, arrow_fs.LocalFileSystem):
            _MAPPED[place] = np.memmap(path, np.int64, mode="r", shape=(2, n))
        else:
            with tempfile.TemporaryFile() as file, contextlib.closing(store.open_input_stream(path)) as stream:
                while piece := stream.read(1 << 22):
                    file.write(piece)
                file.flush()
                _MAPPED[place] = np.memmap(file, np.int64, mode="r", shape=(2, n))
    return _MAPPED[place]


def look_up(counts: PairCounts, keys: np.ndarray) -> np.ndarray:
    """The counts of sorted ``keys``; 0 for a key that no document holds."""
    out = np.zeros(len(keys), np.int64)
    low, high = np.searchsorted(keys, [s[0] for s in counts.shards]), np.searchsorted(keys, [s[1] for s in counts.shards], side="right")
    for i in np.flatnonzero(low < high):
        shard, asked = _shard(counts.shards[i][3], counts.shards[i][2]), keys[low[i] : high[i]]
        at = np.searchsorted(shard[0], asked)
        out[low[i] : high[i]] = np.where(shard[0][at] == asked, shard[1][at], 0)
    return out


@functools.lru_cache(maxsize=2)
def _written(n: int, last: str) -> np.ndarray:
    """The decimal forms of the ids below n: that of id i at 2 i with a comma, at 2 i + 1 with ``last``."""
    return np.array([f"{i}{end}" for i in range(n) for end in (",", last)], dtype=object)


def _groups(s: _Slice, a_written: np.ndarray, b_written: np.ndarray) -> list[str]:
    """a1,a2|b1;a3|b2,b3 of every document: groups end where tokens of both sides end."""
    a_group, b_group = np.searchsorted(s.common, s.a_end), np.searchsorted(s.common, s.b_end)
    is_last = lambda group: np.concatenate([group[1:] != group[:-1], [True]]) if len(group) else np.zeros(0, bool)
    words = np.concatenate([a_written[s.a * np.int64(2) + is_last(a_group)], b_written[s.b * np.int64(2) + is_last(b_group)]])
    order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
    words, at = words[order], s.a_at + s.b_at
    return ["".join(words[at[i] : at[i + 1]])[:-1] for i in range(s.n)]


def link_tokens(tokens: DataFrame, counts: PairCounts, byte_level_path: str, piece_path: str, id_col: str = "doc_id") -> DataFrame:
    """The id column, n_a, n_b, n_groups, n_links, n_best, count_sum and groups (decimal ids) of every row of ``tokenise``."""
    most, sent = SLICE_TOKENS, tokens.sparkSession.sparkContext.broadcast(counts)  # shard borders, and a number an id of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_size, b_size = _sizes(byte_level_path, piece_path)
        a_written, b_written, best = _written(len(a_size), "|"), _written(len(b_size), ";"), sent.value.best
        for batch in batches:
            for s in _slices(batch.column(1), batch.column(2), a_size, b_size, most):
                known, code = np.unique(s.keys, return_inverse=True)
                n = look_up(sent.value, known)
                top = n == best[known >> 32] if len(known) else np.zeros(0, bool)
                per_doc = lambda weights: np.bincount(s.doc, weights, minlength=s.n).astype(np.int64)  # noqa: B023, E731
                wholes = np.concatenate([[0], s.a_end])[s.a_at[1:]]
                figures = [np.diff(s.a_at), np.diff(s.b_at), np.bincount(np.searchsorted(wholes, s.common), minlength=s.n), np.bincount(s.doc, minlength=s.n), per_doc(top[code])]
                sums = np.zeros(s.n, np.int64)
                np.add.at(sums, s.doc, n[code])
                arrays = [batch.column(0).slice(s.at, s.n), *(pa.array(np.asarray(x, np.int64)) for x in [*figures, sums]), pa.array(_groups(s, a_written, b_written), pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    kind = tokens.schema[id_col].dataType.simpleString()
    shape = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    return tokens.select(F.col(id_col).alias("id"), "a_ids", "b_ids").mapInArrow(run, shape).withColumnRenamed("id", id_col)


def pair_table(spark: SparkSession, counts: PairCounts) -> DataFrame:
    """a_id, b_id, n, is_best: every linked pair of ids with its number of documents, read shard by shard."""
    best = spark.sparkContext.broadcast(counts.best)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = _shard(row["place"], row["n"])
                for at in range(0, row["n"], 100_000):
                    keys, n = np.array(shard[0][at : at + 100_000]), np.array(shard[1][at : at + 100_000])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys >> 32, keys & 0xFFFFFFFF, n, n == best.value[keys >> 32])], names=["a_id", "b_id", "n", "is_best"])

    rows = spark.createDataFrame([(n, place) for _, _, n, place in counts.shards], "n long, place string")
    return rows.repartition(max(1, len(counts.shards))).mapInArrow(run, "a_id long, b_id long, n long, is_best boolean")


def align(docs: DataFrame, byte_level_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, n_a, n_b, n_groups, n_links, n_best, count_sum and groups of every row of ``docs``.

    Groups end where tokens of both sides end. A link is a pair of tokens with a common byte; its count is the number of
    rows in which its pair of ids is linked. n_best counts links whose count is the highest of their id of side a (ties
    included), count_sum adds the counts of all links. Texts that are null, empty or not given back by a side have zeros and
    an empty ``groups``. Repeated rows count each; an empty table gives no rows; other columns are left out.
    """
    tokens = checkpointed(tokenise(docs, byte_level_path, piece_path, id_col, text_col))
    return link_tokens(tokens, count_pairs(tokens, byte_level_path, piece_path), byte_level_path, piece_path, id_col)
