"""Hard negatives by product quantisation with stored residual norms.

Vectors are cut into short pieces; a codebook per piece, learned from a bounded sample, turns a vector into one byte a piece,
and the length of what the code leaves over is stored beside it, rounded up. For an anchor, a table of its products with all
codewords gives the score of a code by look-ups, and by the inequality of Cauchy and Schwarz the exact score lies within the sum
over the pieces of the anchor's length times the residual's. These bounds rule rows out with certainty, whatever the sample was;
what is left is ranked by exact integer products.

The index covers every row and is written once. Anchors and rows are dealt on a grid of equal sides, as for exact search: a task
gets some anchors and some rows of one dimension, so neither a frequent label nor a frequent vector gathers anywhere, and a
block hands on a few rows for each anchor. Positives come first, from rows of the anchor's label; the windows below their scores
are then searched among the other rows, all windows of an anchor at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small_batches
from .topk import _matrix, _products, _side

#: Components of a piece, codewords of a piece at most, rounds of k-means.
PIECE, CODEWORDS, ROUNDS = 2, 256, 5
#: Vectors, and their bytes, from which the codebooks are learned at most.
SAMPLE, SAMPLE_BYTES = 4096, 8 << 20
#: Anchors whose scores with a block are held at once.
AT_ONCE = 64


def usable_rows(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """id, label (string), v (array<long>), dim of every row whose id and label are not null and whose vector is whole and finite."""
    finite = F.forall(vec_col, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x.cast("double")))
    ints = F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale))
    taking_part = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce(finite, F.lit(False))
    rows = vectors.where(taking_part).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), ints.alias("v"))
    return rows.withColumn("dim", F.size("v"))


class Codebook:
    """Codewords of every piece of vectors of one dimension, and the step in which residual norms of a piece are stored."""

    def __init__(self, sample: np.ndarray):
        self.edges = list(range(0, sample.shape[1], PIECE))
        self.words, self.steps = [], []
        seed = np.random.default_rng(0)
        for at in self.edges:
            piece = sample[:, at : at + PIECE].astype(float)
            words = np.unique(piece, axis=0)
            if len(words) > CODEWORDS:
                words = words[np.sort(seed.choice(len(words), CODEWORDS, replace=False))]
                for _ in range(ROUNDS):
                    near = self._near(piece, words)
                    n = np.bincount(near, minlength=len(words))
                    for k in range(piece.shape[1]):
                        words[:, k] = np.where(n > 0, np.bincount(near, piece[:, k], len(words)) / np.maximum(n, 1), words[:, k])
            self.words.append(words)
            left = np.sqrt(((piece - words[self._near(piece, words)]) ** 2).sum(1).max())
            self.steps.append(max(left, 1.0) / 128)

    @staticmethod
    def _near(piece: np.ndarray, words: np.ndarray) -> np.ndarray:
        return ((words**2).sum(1)[None] - 2 * (piece @ words.T)).argmin(1)

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (a byte a piece) and residual norms (float32, rounded up) of every vector."""
        codes = np.zeros((len(v), len(self.edges)), np.uint8)
        norms = np.zeros((len(v), len(self.edges)), np.float32)
        for m, at in enumerate(self.edges):
            piece = v[:, at : at + PIECE].astype(float)
            codes[:, m] = self._near(piece, self.words[m])
            length = np.sqrt(((piece - self.words[m][codes[:, m]]) ** 2).sum(1))
            norms[:, m] = np.nextafter((np.ceil(length / self.steps[m]) * self.steps[m]).astype(np.float32), np.float32(np.inf))
        return codes, norms

    def bounds(self, q: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows and anchors the look-up score and how far the exact one can be from it (both rows x anchors)."""
        score, q_norms = np.zeros((len(codes), len(q))), np.zeros((len(self.edges), len(q)))
        for m, at in enumerate(self.edges):
            piece = q[:, at : at + PIECE].astype(float)
            score += np.take(self.words[m] @ piece.T, codes[:, m], axis=0)
            q_norms[m] = np.sqrt((piece**2).sum(1))
        return score, (norms.astype(float) @ q_norms) * (1 + 1e-9) + 1e-6 + 1e-9 * np.abs(score)


def _codebooks(rows: DataFrame, sizes: dict[int, int]) -> dict[int, Codebook]:
    """A codebook for every dimension in a bounded sample: the rows of the least hashes. Other dimensions go without pruning."""
    if not sizes:
        return {}
    n = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(1, *sizes))))
    sample = rows.select("v", "dim", F.xxhash64("id", "v").alias("h")).orderBy("h", "v").limit(n).toArrow()
    dims = np.asarray(sample.column("dim"))
    return {int(d): Codebook(_matrix(sample.filter(pa.array(dims == d)).column("v"), int((dims == d).sum()), int(d))) for d in np.unique(dims) if d}


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score first, ties by smaller id."""
    return np.lexsort((ids, -scores))[:k]


def positives_of_block(a_id, a_label, q, book, c_id, c_label, c, codes, norms, k: int) -> list[tuple[int, int, int]]:
    """(row of the anchor, id, score) of each anchor's k best rows of its own label in the block."""
    out = []
    for label in np.unique(a_label):
        mine, rows = np.flatnonzero(a_label == label), np.flatnonzero(c_label == label)
        for at in range(0, len(mine) if len(rows) else 0, AT_ONCE):
            some = mine[at : at + AT_ONCE]
            score, slack = book.bounds(q[some], codes[rows], norms[rows]) if book else (None, None)
            for i, a in enumerate(some):
                near = np.flatnonzero(c_id[rows] != a_id[a])
                if book and len(near) > k:
                    low, high = (score[near, i] + sign * slack[near, i] for sign in (-1, 1))
                    near = near[high >= np.partition(low, len(low) - k)[len(low) - k]]
                if len(near):
                    exact = _products(q[a : a + 1], c[rows[near]])[0]
                    best = _top(exact, c_id[rows[near]], k)
                    out += zip([a] * len(best), c_id[rows[near[best]]].tolist(), exact[best].tolist(), strict=True)
    return out


def negatives_of_block(a_label, q, windows, book, c_id, c_label, c, codes, norms, k: int) -> list[tuple[int, int, int, int]]:
    """(row of the anchor, window, id, score) of the k best rows of another label in each of the anchor's windows [low, high]."""
    out = []
    for at in range(0, len(q), AT_ONCE):
        score, slack = book.bounds(q[at : at + AT_ONCE], codes, norms) if book else (None, None)
        for a in range(at, min(at + AT_ONCE, len(q))):
            mine = [(w, low, high) for w, (low, high) in enumerate(windows[a]) if low <= high]
            near = np.flatnonzero(c_label != a_label[a])
            if not mine or not len(near):
                continue
            if book:
                low, high = (score[near, a - at] + sign * slack[near, a - at] for sign in (-1, 1))
                kept = np.zeros(len(near), bool)
                for _, least, most in mine:
                    sure = low[(low >= least) & (high <= most)]  # in the window for certain: the k-th of them is a bar for all
                    bar = max(least, np.partition(sure, len(sure) - k)[len(sure) - k]) if len(sure) > k else least
                    kept |= (high >= bar) & (low <= most)
                near = near[kept]
            exact = _products(q[a : a + 1], c[near])[0]
            for w, least, most in mine:
                inside = np.flatnonzero((exact >= least) & (exact <= most))
                best = inside[_top(exact[inside], c_id[near[inside]], k)]
                out += zip([a] * len(best), [w] * len(best), c_id[near[best]].tolist(), exact[best].tolist(), strict=True)
    return out


def _bytes_matrix(column: pa.ChunkedArray, rows: int, kind: type) -> np.ndarray:
    """A matrix from binary values of one length (none at all without a codebook)."""
    whole = b"".join(column.to_pylist())
    return np.frombuffer(whole, kind).reshape(rows, -1) if whole else np.zeros((rows, 0), kind)


def _meet(asked: DataFrame, index: DataFrame, sizes: DataFrame, found, shape: str) -> DataFrame:
    """``found(anchors, rows)`` for every pair of a group of anchors and a block of rows of a dimension."""
    key = ["dim", "salt", "turn"]
    left = asked.join(sizes, "dim").withColumn("turn", F.expr("cast(pmod(xxhash64(id), turns) as int)")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("turns", "blocks")
    right = index.join(sizes, "dim").withColumn("salt", F.expr("cast(pmod(xxhash64(id, v), blocks) as int)")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).drop("turns", "blocks")
    right = right.select(*[F.col(c).alias(f"c_{c}") for c in right.columns])
    return left.groupBy(*key).cogroup(right.groupBy(*[f"c_{c}" for c in key])).applyInArrow(found, shape)


def build_index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = 256) -> tuple[DataFrame, dict[int, Codebook], DataFrame]:
    """The index (id, label, v, dim, codes, norms; checkpointed), the codebooks by dimension, and the number of rows of each dimension."""
    small_batches(vectors)
    rows = usable_rows(vectors, id_col, vec_col, label_col, scale)
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row a dimension
    books = _codebooks(rows, sizes)
    sent = vectors.sparkSession.sparkContext.broadcast(books)  # no larger than the sample

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            dims = np.asarray(table.column("dim"))
            codes, norms = [b""] * len(dims), [b""] * len(dims)
            for dim in np.unique(dims):
                if book := sent.value.get(int(dim)):
                    mine = np.flatnonzero(dims == dim)
                    c, r = book.encode(_matrix(table.take(pa.array(mine)).column("v"), len(mine), int(dim)))
                    for i, x, y in zip(mine, c, r, strict=True):
                        codes[i], norms[i] = x.tobytes(), y.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary()), pa.array(norms, pa.binary())], names=[*batch.schema.names, "codes", "norms"])

    index = checkpointed(rows.mapInArrow(encode, "id long, label string, v array<long>, dim int, codes binary, norms binary"))
    spark = vectors.sparkSession
    return index, books, spark.createDataFrame(list(sizes.items()), "dim int, n long")


def hard_negatives(vectors: DataFrame, is_anchor, positives: int = 5, negatives: int = 5, percent: int = 80, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Components become floor(scale * x). An anchor's positives are its best other rows of the same label by integer inner
    product, ties by smaller id. For each, the best rows of other labels with percent * positive <= 100 * negative <= 100 *
    positive. ``is_anchor`` is a function of the id column. Rows with a null id or label, a null vector or a null or
    non-finite component take no part; vectors meet only those of their dimension. Rows with an anchor's id are its own; of
    anchors with one id the least row asks; repeated rows count each, as positives too. An empty table gives no rows; other
    columns are ignored.
    """
    index, books, sizes = build_index(vectors, id_col, vec_col, label_col, scale)
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    asked = index.where(is_anchor(F.col("id"))).groupBy("id").agg(F.min(F.struct("label", "v", "dim")).alias("a")).select("id", "a.*")
    asked = checkpointed(asked)
    anchors = asked.groupBy("dim").agg(F.count("*").alias("asked"))
    grid = sizes.join(anchors, "dim").select("dim", F.ceil(F.col("n") / _side(F.col("dim"))).cast("int").alias("blocks"), F.ceil(F.col("asked") / _side(F.col("dim"))).cast("int").alias("turns"))
    grid = F.broadcast(grid)  # a row a dimension

    def block(left: pa.Table, right: pa.Table):
        dim, n, m = left.column("dim")[0].as_py(), left.num_rows, right.num_rows
        labels = [np.array(t.column(c).to_pylist(), dtype=object) for t, c in ((left, "label"), (right, "c_label"))]
        kinds, code = np.unique(np.concatenate(labels), return_inverse=True)
        own = (np.asarray(left.column("id")), code[:n], _matrix(left.column("v"), n, dim))
        rows = (np.asarray(right.column("c_id")), code[n:], _matrix(right.column("c_v"), m, dim), _bytes_matrix(right.column("c_codes"), m, np.uint8), _bytes_matrix(right.column("c_norms"), m, np.float32))
        return own, sent.value.get(dim), rows

    def find_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            (a_id, a_label, q), book, rows = block(left, right)
            out = [(int(a_id[a]), i, s) for a, i, s in positives_of_block(a_id, a_label, q, book, *rows, positives)]
        return pa.table([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], names=["anchor_id", "vec_id", "score"])

    def find_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            (a_id, a_label, q), book, rows = block(left, right)
            scores = left.column("scores").to_pylist()
            windows = [[(-(-percent * s // 100), s) for s in x] for x in scores]
            out = [(int(a_id[a]), w, i, s) for a, w, i, s in negatives_of_block(a_label, q, windows, book, *rows, negatives)]
        return pa.table([pa.array([o[i] for o in out], pa.int64()) for i in range(4)], names=["anchor_id", "place", "negative_id", "negative_score"])

    found = _meet(asked, index, grid, find_positives, "anchor_id long, vec_id long, score long")
    best = found.selectExpr("*", "row_number() over (partition by anchor_id order by score desc, vec_id) - 1 as place").where(F.col("place") < positives)
    best = checkpointed(best.select("anchor_id", F.col("place").cast("long").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    lists = best.groupBy(F.col("anchor_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    found = _meet(asked.join(lists, "id"), index, grid, find_negatives, "anchor_id long, place long, negative_id long, negative_score long")
    ranked = found.selectExpr("*", "row_number() over (partition by anchor_id, place order by negative_score desc, negative_id) as rank").where(F.col("rank") <= negatives)
    return ranked.join(best, ["anchor_id", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
