"""Benchmark decontamination: word-pair seeds with an exact bound, then Smith-Waterman alignment of words.

An alignment of k matches and e errors (mismatches and gaps) that reaches the score s = THRESHOLD of a verbatim copy's has
2k - e >= s. Its k - 1 steps from match to match hold at most these errors, so with weight 2 for a step without an error and 1
for a step with one the steps weigh s - 2 at least, and it spans 3k - s words of the document at most. Both kinds of step are
shared pairs of words that are adjacent or have one word between them. So a document's passage is aligned with an item where
their shared pairs weigh that much within that span, which no copy can miss. Document frequencies only tell which pairs of an item
are left out of the search, and the bound is lowered by all that these could weigh. Items too short for the bound are sought by
single words. The score is the alignment's share of a verbatim copy's (linear gaps). Documents are scanned where they lie and never
shuffled; items are handed to the tasks in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, slices, small_batches, splitmix, window_hashes

#: Words of the runs that ``seed_hits`` counts; least score that counts as a copy.
SEED, THRESHOLD = 3, 0.5
#: Alignment scores per word (the bound on pairs rests on these), and bytes of item texts in a block.
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_BYTES = 8_000_000
#: Cells of alignment tables computed at once.
CELLS = 2_000_000
#: Bits of a hash that a table of the seeds looks at first.
SIEVE = 1 << 20


def _pairs(words: np.ndarray, gap: int) -> np.ndarray:
    """Hashes of each word with the one ``gap`` words on; with gap 0 of the word alone."""
    if not gap:
        return words
    with np.errstate(over="ignore"):
        return splitmix(words[:-gap] * np.uint64(0xD6E8FEB86659FD93) + words[gap:])


@dataclass
class Block:
    """A block of items: their words, and the sorted seed hashes, each with a run of (item, offset, gap) places from ``first`` on.

    ``gaps`` are those of the seeds that the items use. An item's seeds within ``span`` words have to weigh ``needed``.
    """

    ids: list
    words: list[np.ndarray]
    gaps: tuple[int, ...]
    keys: np.ndarray
    first: np.ndarray
    places: np.ndarray
    needed: np.ndarray
    span: np.ndarray

    @classmethod
    def of(cls, ids: list, texts: list[str]) -> tuple[Block, Block]:
        """The items that pairs find, and those so short that only single words are sure to."""
        words = []
        for _, data, offsets in slices(pa.array(texts, pa.string())):
            every, borders = hash_words(data, offsets)
            words += [every[a:b] for a, b in zip(borders[:-1], borders[1:], strict=True)]
        least = [math.ceil(THRESHOLD * MATCH * len(own)) for own in words]
        paired = [score > MATCH for score in least]
        return tuple(cls._of([(i, w, s) for i, w, s, p in zip(ids, words, least, paired, strict=True) if p == kind and len(w)], gaps) for kind, gaps in ((True, (1, 2)), (False, (0,))))

    @classmethod
    def _of(cls, items: list[tuple], gaps: tuple[int, ...]) -> Block:
        words = [w for _, w, _ in items]
        found = [(n, gap, _pairs(own, gap)) for n, own in enumerate(words) for gap in gaps if len(own) > gap]
        seeds = np.concatenate([np.zeros(0, np.uint64), *(x for _, _, x in found)])
        places = np.concatenate([np.zeros((0, 3), np.int64), *(np.column_stack([np.full(len(x), n), np.arange(len(x)), np.full(len(x), gap)]) for n, gap, x in found)])
        needed = np.array([max(1, s - MATCH) for _, _, s in items], np.int64)
        span = np.array([3 * len(w) - s for _, w, s in items], np.int64)
        return cls([i for i, _, _ in items], words, gaps, *cls._sorted(seeds, places), needed, span)

    @staticmethod
    def _sorted(seeds: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(seeds, kind="stable")
        keys, first = np.unique(seeds[order], return_index=True)
        return keys, np.append(first, len(seeds)), places[order]

    def with_counts(self, counts: dict[int, int]) -> Block:
        """The same without the seeds at a quarter of the offsets of each item that can be missed, the commonest.

        ``counts`` has the documents with each seed. What is left out can weigh 2 an offset, so the bound goes down by that.
        """
        if self.gaps == (0,) or not len(self.keys):
            return self
        seen = np.repeat([counts.get(n, 0) for n in range(len(self.keys))], np.diff(self.first))
        seeds = np.repeat(self.keys, np.diff(self.first))
        starts = np.concatenate([[0], np.cumsum([len(own) for own in self.words])])  # the items' words end to end
        code = starts[self.places[:, 0]] + self.places[:, 1]
        most = np.zeros(starts[-1], np.int64)
        np.maximum.at(most, code, seen)
        spared = self.needed // 4
        out = np.zeros(len(most), bool)
        for item, own in enumerate(self.words):
            at = starts[item]
            out[at + np.argsort(-most[at : at + len(own) - 1], kind="stable")[: spared[item]]] = True
        keep = ~out[code]
        keys, first, places = self._sorted(seeds[keep], self.places[keep])
        return replace(self, keys=keys, first=first, places=places, needed=self.needed - MATCH * spared)

    @property
    def sieve(self) -> np.ndarray:
        if "_sieve" not in self.__dict__:
            table = np.zeros(SIEVE, bool)
            table[self.keys & np.uint64(SIEVE - 1)] = True
            self.__dict__["_sieve"] = table
        return self.__dict__["_sieve"]

    def hits(self, words: np.ndarray, borders: np.ndarray):
        """(gap, seed numbers, positions, documents) of the seeds that occur in a slice of documents."""
        owner = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
        for gap in self.gaps if len(self.keys) else ():
            if len(words) > gap:
                every = _pairs(words, gap)
                at = np.flatnonzero(self.sieve[every & np.uint64(SIEVE - 1)])
                number = np.minimum(np.searchsorted(self.keys, every[at]), len(self.keys) - 1)
                true = (self.keys[number] == every[at]) & (owner[at] == owner[at + gap])
                yield gap, number[true], at[true], owner[at[true]]


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each item with its passage, and the passage word where it ends (exclusive)."""
    m, n = max(map(len, items)), max(map(len, passages))
    a, b = np.zeros((len(items), m), np.uint64), np.ones((len(items), n), np.uint64)
    some_a, some_b = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    for i, (x, y) in enumerate(zip(items, passages, strict=True)):
        a[i, : len(x)], b[i, : len(y)], some_a[i, : len(x)], some_b[i, : len(y)] = x, y, True, True
    slope = -GAP * np.arange(n + 1, dtype=np.int32)
    above, best, end = np.zeros((len(items), n + 1), np.int32), np.zeros(len(items), np.int32), np.zeros(len(items), np.int64)
    for j in range(m):
        row = np.zeros_like(above)
        same = (a[:, j : j + 1] == b) & some_a[:, j : j + 1] & some_b
        np.maximum(above[:, :-1] + np.where(same, MATCH, MISMATCH), above[:, 1:] + GAP, out=row[:, 1:])
        np.maximum(row, 0, out=row)
        above = np.maximum.accumulate(row + slope, axis=1) - slope
        top = above.argmax(1)
        value = above[np.arange(len(items)), top]
        end, best = np.where(value > best, top, end), np.maximum(best, value)
    return best, end


def _seeded(block: Block, words: np.ndarray, borders: np.ndarray) -> dict[tuple[int, int], tuple[list[int], list[list[int]]]]:
    """For each (document, item) whose seeds reach the bound: possible starts of a verbatim copy, and passages with all copies."""
    parts = [np.zeros((0, 5), np.int64)]
    for gap, number, at, own in block.hits(words, borders):
        n = block.first[number + 1] - block.first[number]
        place = np.repeat(block.first[number] - np.cumsum(n) + n, n) + np.arange(n.sum())
        item, offset, apart = block.places[place].T
        weight = np.where((gap == 1) & (apart == 1), MATCH, 1)
        parts.append(np.column_stack([np.repeat(own, n), item, np.repeat(at, n), offset, weight]))
    own, item, at, offset, weight = np.concatenate(parts).T
    if not len(own):
        return {}
    far = len(words) + int(block.span.max()) + 1
    pair = own * len(block.words) + item
    order = np.lexsort((-weight, pair * far + at))
    pair, item, at, offset, weight = pair[order], item[order], at[order], offset[order], weight[order]
    code = pair * far + at
    # Steps of one alignment start at different words, so each word counts with its heaviest seed.
    fresh = np.append(True, code[1:] != code[:-1])
    total = np.append(0, np.cumsum(np.where(fresh, weight, 0)))
    end = np.searchsorted(code, code + block.span[item])
    full = np.flatnonzero(fresh & (total[end] - total[:-1] >= block.needed[item]))
    inside = np.zeros(len(code) + 1, np.int64)
    np.add.at(inside, full, 1)
    np.add.at(inside, end[full], -1)
    keep = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    out: dict[tuple[int, int], tuple[list[int], list[list[int]]]] = {}
    for number, position, shift in zip(pair[keep].tolist(), at[keep].tolist(), offset[keep].tolist(), strict=True):
        own_item = divmod(number, len(block.words))
        starts, passages = out.setdefault(own_item, ([], []))
        starts.append(position - shift)
        span = int(block.span[own_item[1]])
        low, high = max(int(borders[own_item[0]]), position - span), min(int(borders[own_item[0] + 1]), position + span)
        if passages and low <= passages[-1][1]:
            passages[-1][1] = high
        else:
            passages.append([low, high])
    return out


def _runs(item: np.ndarray, document: np.ndarray) -> int:
    """Pairs of equal runs of SEED words (of all words, in a shorter item) in an item and a document."""
    width = min(SEED, len(item))
    sought, every = np.sort(window_hashes(item, width)), window_hashes(document, width)
    return int((np.searchsorted(sought, every, side="right") - np.searchsorted(sought, every)).sum())


def matches(blocks: tuple[Block, ...], words: np.ndarray, borders: np.ndarray) -> list[tuple[int, object, float, int, int]]:
    """(document, item id, score, seed hits, end word) of each document's best passage for each item that reaches THRESHOLD."""
    return [found for block in blocks for found in _matches(block, words, borders)]


def _matches(block: Block, words: np.ndarray, borders: np.ndarray) -> list[tuple[int, object, float, int, int]]:
    out, work = {}, []
    for (own, item), (starts, passages) in _seeded(block, words, borders).items():
        asked, low, high = block.words[item], int(borders[own]), int(borders[own + 1])
        size = len(asked)
        verbatim = next((s for s in dict.fromkeys(starts) if s >= low and s + size <= high and np.array_equal(words[s : s + size], asked)), None)
        if verbatim is not None:
            out[own, item] = (1.0, verbatim + size - low)
        else:
            work += [(own, item, *passage) for passage in passages]
    work.sort(key=lambda w: (len(block.words[w[1]]), w[3] - w[2]))
    at = 0
    while at < len(work):
        count = max(1, min(len(work) - at, 512))
        while count > 1 and count * max(w[3] - w[2] for w in work[at : at + count]) > CELLS:
            count //= 2
        part = work[at : at + count]
        at += count
        scores, ends = align([block.words[w[1]] for w in part], [words[w[2] : w[3]] for w in part])
        for (own, item, low, _), score, end in zip(part, scores.tolist(), ends.tolist(), strict=True):
            share = score / (MATCH * len(block.words[item]))
            if share >= THRESHOLD and share > out.get((own, item), (0.0,))[0]:
                out[own, item] = (share, low + end - int(borders[own]))
    return [(own, block.ids[item], share, _runs(block.words[item], words[borders[own] : borders[own + 1]]), end) for (own, item), (share, end) in sorted(out.items())]


def _blocks(docs: DataFrame, items: DataFrame, text_col: str, item_id: str, item_text: str):
    """Broadcast blocks of items; how common each block's seeds are comes from a pass over all documents."""
    small_batches(docs)
    items = items.where(F.col(item_id).isNotNull() & F.coalesce(F.col(item_text), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    total = items.agg(F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0))).first()[0]
    n = -(-total // BLOCK_BYTES)
    context = docs.sparkSession.sparkContext
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64(item_id), F.lit(n)) == k).select(item_id, item_text).orderBy(item_id, item_text).toArrow()
        blocks = Block.of(rows.column(0).to_pylist(), rows.column(1).to_pylist())
        sent = context.broadcast(blocks[0])

        def count(batches, sent=sent):
            totals = defaultdict(int)
            for batch in batches:
                for _, data, offsets in slices(batch.column(0)):
                    words, borders = hash_words(data, offsets)
                    met = [numbers.astype(np.int64) * len(offsets) + owners for _, numbers, _, owners in sent.value.hits(words, borders)]
                    if met:
                        numbers = np.unique(np.concatenate(met)) // len(offsets)
                        for number, c in zip(*(x.tolist() for x in np.unique(numbers, return_counts=True)), strict=True):
                            totals[number] += c
            yield pa.RecordBatch.from_arrays([pa.array([*totals], pa.int64()), pa.array([*totals.values()], pa.int64())], names=["number", "n"])

        # One row a seed of the block at most.
        counted = docs.select(text_col).mapInArrow(count, "number long, n long").groupBy("number").agg(F.sum("n")).toArrow()
        counts = dict(zip(*(counted.column(x).to_pylist() for x in range(2)), strict=True))
        yield context.broadcast((blocks[0].with_counts(counts), blocks[1]))


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """id, item_id, ``score`` (0 to 1, 1 verbatim), ``seed_hits`` and ``end_word`` for each document that copies an item.

    Words are those of the Jaccard join. Every pair whose score reaches THRESHOLD is found, whatever the tables' sizes; an item of
    two words reaches it with one. ``seed_hits`` counts equal runs of SEED words and may be 0. Null, empty and wordless texts and
    items, and items with a null id, match nothing; a null document id stays; repeated rows each match; several equal items
    each match. Empty tables give no rows; other columns are ignored.
    """
    kinds = [docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()]
    schema = f"`{id_col}` {kinds[0]}, `{item_id}` {kinds[1]}, score double, seed_hits long, end_word long"
    item_kind = items.select(item_id).limit(0).toArrow().schema.field(0).type
    out = docs.sparkSession.createDataFrame([], schema)
    for sent in _blocks(docs, items, text_col, item_id, item_text):

        def run(batches, sent=sent):
            for batch in batches:
                for at, data, offsets in slices(batch.column(1)):
                    found = matches(sent.value, *hash_words(data, offsets))
                    ids = batch.column(0).take(pa.array([at + f[0] for f in found], pa.int64()))
                    columns = [pa.array([f[i] for f in found], t) for i, t in ((2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]
                    yield pa.RecordBatch.from_arrays([ids, pa.array([f[1] for f in found], item_kind), *columns], names=[id_col, item_id, "score", "seed_hits", "end_word"])

        out = out.unionByName(docs.select(id_col, text_col).mapInArrow(run, schema))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that copy no item, as ``find_contamination`` has it; all columns stay."""
    out = docs
    for sent in _blocks(docs, items, text_col, item_id, item_text):

        def run(batches, sent=sent):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for at, data, offsets in slices(batch.column(batch.schema.names.index(text_col))):
                    keep[[at + f[0] for f in matches(sent.value, *hash_words(data, offsets))]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, out.schema)
    return out
