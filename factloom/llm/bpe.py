"""Byte-level BPE by per-prefix dynamic programming.

For every prefix of a piece exactly one token can come last in the piece's encoding: a vocabulary entry that is a suffix
of the prefix and is compatible with the unique last token of what stands before it. An Aho-Corasick automaton yields the
suffix matches, a walk down both tokens' merge trees tests a pair's compatibility, and back-pointers spell out the ids.
Work is linear in the text; nothing is learned or merged greedily at run time.
"""

from __future__ import annotations

import json
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import small_batches

# The pre-tokeniser's public pattern, with white space by its Unicode property.
_SPACE = r"\t-\r \x85\xa0  -     　"
_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Distinct pieces (in either of two halves) and token pairs that a worker remembers before it starts afresh, and the longest piece remembered.
PIECES, PAIRS, PIECE_CHARS = 100_000, 200_000, 48
#: Characters of text encoded between two batches handed to Spark.
BATCH_CHARS = 2_000_000
_NEVER = 1 << 60


def _printable() -> list[str]:
    """The public one-to-one map from bytes to printable characters."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class Bpe(dict):
    """A vocabulary file as an encoder; the mapping itself remembers pieces with their ids as little-endian 32-bit words."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab: dict[str, int] = spec["model"]["vocab"]
        shown = _printable()
        self.to_shown = str.maketrans({b: shown[b] for b in range(256)})
        raw = {c: b for b, c in enumerate(shown)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.rank, self.left, self.right, self.pair = [-1] * size, [0] * size, [0] * size, {}
        for order, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            made, a, b = vocab[a + b], vocab[a], vocab[b]
            self.rank[made], self.left[made], self.right[made] = order, a, b
            self.pair[a * size + b] = order
        self.size, self.fits, self.older = size, {}, {}
        self.bytes = [b""] * size
        self.automaton = ahocorasick.Automaton()
        for text, token in vocab.items():
            self.bytes[token] = bytes(raw[c] for c in text)
            self.automaton.add_word(text, (token, len(text)))
        self.automaton.make_automaton()
        for text, token in self.special.items():
            self.bytes[token] = text.encode()
        self.pieces = regex.compile(_PIECES).findall
        self.specials = regex.compile("|".join(f"({regex.escape(x)})" for x in sorted(self.special, key=len, reverse=True))) if self.special else None

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of token ``a`` followed by those of ``b`` encode to just these two tokens.

        Both tokens are taken apart along their common border, latest merge first. At each moment the border has one
        part on either side; if those two would merge before the part's own next merge (at equal rank, the leftmost goes
        first), the border does not survive.
        """
        rank, pair, size = self.rank, self.pair, self.size
        a_next = b_next = _NEVER
        while True:
            joined = pair.get(a * size + b)
            if joined is not None and joined < a_next and joined <= b_next:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                a_next, a = ra, self.right[a]
            else:
                b_next, b = rb, self.left[b]

    def encode_piece(self, piece: str) -> list[int]:
        shown = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.to_shown)
        last, width, fits, size = [-1] * len(shown), [0] * len(shown), self.fits, self.size
        for end, (token, length) in self.automaton.iter(shown):
            if last[end] >= 0:  # found, and there is only one
                continue
            before = end - length
            if before >= 0:
                if (first := last[before]) < 0:
                    continue
                key = first * size + token
                good = fits.get(key)
                if good is None:
                    if len(fits) >= PAIRS:
                        fits.clear()
                    good = fits[key] = self.compatible(first, token)
                if not good:
                    continue
            last[end], width[end] = token, length
        ids, at = [], len(shown) - 1
        while at >= 0:
            ids.append(last[at])
            at -= width[at]
        ids.reverse()
        return ids

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            found = self.encode_piece(piece)
            ids = struct.pack(f"<{len(found)}I", *found)
            if len(piece) > PIECE_CHARS:
                return ids
        if len(self) >= PIECES:  # what is still in use moves on from the older half
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.specials is None or not self.specials.search(text):
            return b"".join(map(self.__getitem__, self.pieces(text)))
        out, at = [], 0
        for found in self.specials.finditer(text):
            out += map(self.__getitem__, self.pieces(text[at : found.start()]))
            out.append(np.array([self.special[found[0]]], dtype="<u4").tobytes())
            at = found.end()
        return b"".join([*out, *map(self.__getitem__, self.pieces(text[at:]))])

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The vocabulary at ``path``, read once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``ids`` array<int>: the whole text of each row encoded with the vocabulary file at that path.

    The path must exist wherever tasks run. A null or empty text gives an empty array; the vocabulary's special tokens in
    a text become their ids; repeated rows are encoded each; a null id stays; other columns are ignored.
    """

    def run(batches):
        bpe = load(vocabulary)
        for batch in batches:
            column, at, held, chars = batch.column(1), 0, [], 0
            for i in range(len(column)):
                text = column[i].as_py() or ""
                held.append(bpe.encode(text))
                chars += len(text)
                if chars >= BATCH_CHARS or i + 1 == len(column):
                    offsets = np.cumsum([0, *(len(x) // 4 for x in held)], dtype=np.int32)
                    ids = pa.array(np.frombuffer(b"".join(held), dtype="<i4"), pa.int32())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(held)), pa.ListArray.from_arrays(pa.array(offsets), ids)], names=[id_col, "ids"])
                    at, held, chars = i + 1, [], 0

    small_batches(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, ids and ``decoded``: the text of each array of ids; special tokens are kept, malformed UTF-8 is replaced.

    Null or empty ids give an empty text. An id outside the vocabulary is an error.
    """

    def run(batches):
        bpe = load(vocabulary)
        for batch in batches:
            column = batch.column(1)
            flat, offsets = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            step = 256
            for at in range(0, len(column), step):
                rows = range(at, min(at + step, len(column)))
                texts = [bpe.decode(flat[offsets[i] : offsets[i + 1]].tolist()) for i in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), column.slice(at, len(texts)), pa.array(texts, pa.string())], names=[id_col, "ids", "decoded"])

    small_batches(encoded)
    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``packed`` (ids as little-endian unsigned 32-bit integers) and ``decoded`` in one pass over the texts.

    The same as ``decode(encode(docs))`` with the ids packed, but a task needs only one Python worker for both.
    """

    def run(batches):
        bpe = load(vocabulary)
        for batch in batches:
            column, at, packed, texts, chars = batch.column(1), 0, [], [], 0
            for i in range(len(column)):
                text = column[i].as_py() or ""
                packed.append(bpe.encode(text))
                texts.append(bpe.decode(np.frombuffer(packed[-1], "<u4").tolist()))
                chars += len(text)
                if chars >= BATCH_CHARS or i + 1 == len(column):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(packed)), pa.array(packed, pa.binary()), pa.array(texts, pa.string())], names=[id_col, "packed", "decoded"])
                    at, packed, texts, chars = i + 1, [], [], 0

    small_batches(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, packed binary, decoded string")
