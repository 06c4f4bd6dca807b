"""Exact top-k inner products by norm buckets.

Vectors are grouped by length into geometric bands, and large bands are cut into salted blocks. Queries are dealt to groups of the
same number of bytes, so that blocks and groups form a grid on which both sides are copied equally often; for a given work
that copies least. A query goes only to bands where its k-th best score so far can still be reached at the band's greatest
length, and a band only to groups that have such a query. The first thresholds come from a
bounded set of the longest vectors. Inside a block, buckets of falling length are scanned; each bucket has, per query, a
local cosine threshold that decides between scanning the bucket's length-sorted prefix and looking only at the feasible
interval of the query's strongest coordinate. Whatever remains is verified by exact integer products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small_batches

#: Bytes of a side of a task (its queries and its candidates alike), rows of a bucket in a block, and of the longest vectors that
#: give the first thresholds.
SIDE_BYTES, BUCKET, SEEDS = 16 << 20, 256, 4096
#: Queries whose products with a bucket are held at once.
AT_ONCE = 2048
#: A bucket whose local cosine threshold reaches this is searched by coordinate.
COORDINATE_COSINE = 0.5
_RESULT = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id, v (array<long>) of every usable row: id not null, vector not null and without null or non-finite components."""
    usable = F.col(id_col).isNotNull() & F.forall(vec_col, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x.cast("double")))
    ints = F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale))
    out = vectors.where(F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), ints.alias("v"))
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return out.withColumn("dim", F.size("v")).withColumn("norm", F.sqrt(squares))


def _side(dim: Column) -> Column:
    """Vectors of this dimension (of 64-bit components) that a side of a task holds."""
    return F.greatest(F.floor(F.lit(SIDE_BYTES) / (8 * F.greatest(dim, F.lit(1)))), F.lit(16))


def _matrix(column: pa.ChunkedArray, rows: int, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False) if rows else np.zeros(0, np.int64)
    return np.asarray(flat, dtype=np.int64).reshape(rows, dim)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products; by floating point where 53 bits hold every sum."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores), axis=-1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


_NONE = np.iinfo(np.int64).min // 2


def search_block(qid, q, floor, cid, c, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's up to k best candidates of the block among those that reach its ``floor``: rows of queries, ids, scores."""
    q_len, c_len = np.sqrt((q.astype(float) ** 2).sum(1)), np.sqrt((c.astype(float) ** 2).sum(1))
    order = np.lexsort((cid, -c_len))
    cid, c, c_len = cid[order], c[order], c_len[order]
    ids, scores = np.full((len(q), k), np.iinfo(np.int64).max), np.full((len(q), k), _NONE)
    for at in range(0, len(c), BUCKET):
        b_id, b, b_len = cid[at : at + BUCKET], c[at : at + BUCKET], c_len[at : at + BUCKET]
        theta = np.maximum(floor, scores[:, -1]).astype(float)
        bound = q_len * b_len[0]
        alive = np.flatnonzero(theta <= bound * (1 + 1e-9) + 1e-6)
        if not len(alive):
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(bound[alive] > 0, theta[alive] / bound[alive], -1.0)
        by_coordinate = (cosine >= COORDINATE_COSINE) & (q_len[alive] > 0)
        wide = alive[~by_coordinate]
        if len(wide):  # by length: the prefix of the bucket that is long enough for the least demanding of these queries
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(q_len[wide] > 0, theta[wide] / q_len[wide], -1.0).min()
            end = int(np.searchsorted(-b_len, -(least * (1 - 1e-9) - 1e-6), side="right"))
            if end:
                found = _products(q[wide], b[:end])
                found[(found < floor[wide, None]) | (qid[wide, None] == b_id[None, :end])] = _NONE
                rows = wide[(found > _NONE).any(1)]
                keep = found[(found > _NONE).any(1)]
                ids[rows], scores[rows] = _best(np.hstack([ids[rows], np.broadcast_to(b_id[:end], keep.shape)]), np.hstack([scores[rows], keep]), k)
        if by_coordinate.any():
            unit = b / np.maximum(b_len, 1e-300)[:, None]
            sorts: dict[int, np.ndarray] = {}
            for row, t in zip(alive[by_coordinate], np.minimum(cosine[by_coordinate], 1.0), strict=True):
                f = int(np.abs(q[row]).argmax())
                x = q[row, f] / q_len[row]
                if f not in sorts:
                    sorts[f] = np.argsort(unit[:, f], kind="stable")
                slack = np.sqrt(max(0.0, (1 - t * t) * (1 - x * x))) + 1e-9
                low, high = (x * t - slack if x > -t else -1.0), (x * t + slack if x < t else 1.0)
                line = unit[sorts[f], f]
                near = sorts[f][np.searchsorted(line, low - 1e-9) : np.searchsorted(line, high + 1e-9, side="right")]
                near = near[b_id[near] != qid[row]]
                if len(near):
                    found = _products(q[row : row + 1], b[near])
                    found[found < floor[row]] = _NONE
                    ids[row : row + 1], scores[row : row + 1] = _best(np.hstack([ids[row : row + 1], b_id[near][None]]), np.hstack([scores[row : row + 1], found]), k)
    rows, columns = np.nonzero(scores > _NONE)
    return rows, ids[rows, columns], scores[rows, columns]


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best integer inner products among all other rows.

    Components become floor(scale * x); ties go to the smaller id. Rows with a null id, and vectors that are null or hold
    null or non-finite components, take no part; vectors meet only those of their own dimension. Rows with a query's id are
    its own and no candidates; if a query id repeats, its least vector asks; repeated candidates each count. Zero vectors
    score 0. An empty table gives no rows; other columns are ignored.
    """
    small_batches(vectors)
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vec_col, scale)
    band = F.when(F.col("norm") > 0, F.floor(F.log2(F.col("norm")) * 16)).otherwise(F.lit(-1)).cast("int")
    rows = rows.withColumn("band", band)
    asked = quantised(vectors.where(is_query), id_col, vec_col, scale).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    # A handful of lengths' bands for each dimension, whatever the number of rows.
    bands = rows.groupBy("dim", "band").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).withColumn("blocks", F.ceil(F.col("n") / _side(F.col("dim"))).cast("int"))
    seeds = rows.select("id", "v", "dim", "norm").orderBy(F.desc("norm"), "id").limit(SEEDS).toArrow()
    by_dim = {}
    if seeds.num_rows:
        dims = np.asarray(seeds.column("dim"))
        for dim in np.unique(dims):
            part = seeds.filter(pa.array(dims == dim))
            by_dim[int(dim)] = (np.asarray(part.column("id")), _matrix(part.column("v"), part.num_rows, int(dim)))
    known = spark.sparkContext.broadcast(by_dim)

    def thresholds(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            dims, ids, floors = np.asarray(table.column("dim")), np.asarray(table.column("id")), np.full(table.num_rows, _NONE)
            for dim in np.unique(dims):
                if int(dim) in known.value:
                    s_id, s = known.value[int(dim)]
                    mine = np.flatnonzero(dims == dim)
                    for at in range(0, len(mine), 256):
                        part = mine[at : at + 256]
                        found = _products(_matrix(table.take(pa.array(part)).column("v"), len(part), int(dim)), s)
                        found[ids[part, None] == s_id[None]] = _NONE
                        if found.shape[1] >= k:
                            floors[part] = -np.partition(-found, k - 1, axis=1)[:, k - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors)], names=["id", "v", "dim", "floor"])

    asked = asked.mapInArrow(thresholds, "id long, v array<long>, dim int, floor long")
    n_asked = vectors.where(is_query).count()
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    asked = asked.withColumn("turn", F.pmod(F.xxhash64("id"), F.greatest(F.ceil(F.lit(n_asked) / _side(F.col("dim"))), F.lit(1))).cast("int")).withColumn("length", length)
    reach = F.col("floor").cast("double") <= F.col("length") * F.col("longest") * (1 + 1e-9) + 1e-6
    asked = checkpointed(asked)
    reaching = asked.join(F.broadcast(bands), "dim").where(reach)
    # For every band the groups that have to see it: a few numbers for each of a handful of bands, as are the bands themselves.
    turns = reaching.groupBy("dim", "band", "blocks").agg(F.collect_set("turn").alias("turns"))
    asked = reaching.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = rows.join(F.broadcast(turns), ["dim", "band"]).withColumn("salt", F.expr("cast(pmod(xxhash64(id, v), blocks) as int)")).withColumn("turn", F.explode("turns"))
    key = ["dim", "band", "salt", "turn"]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        dim = left.column("dim")[0].as_py()
        qid, cid = np.asarray(left.column("id")), np.asarray(right.column("c_id"))
        q, floor, c = _matrix(left.column("v"), len(qid), dim), np.asarray(left.column("floor")), _matrix(right.column("c_v"), len(cid), dim)
        parts = []
        for at in range(0, len(qid), AT_ONCE):
            some = slice(at, at + AT_ONCE)
            row, ids, scores = search_block(qid[some], q[some], floor[some], cid, c, k)
            parts.append(pa.table({"query_id": qid[some][row], "vec_id": ids, "score": scores}))
        return pa.concat_tables(parts)

    found = asked.select(*key, "id", "v", "floor").groupBy(*key).cogroup(held.select(*[F.col(x).alias(f"c_{x}") for x in [*key, "id", "v"]]).groupBy(*[f"c_{x}" for x in key])).applyInArrow(search, _RESULT)
    ranked = found.selectExpr("*", "row_number() over (partition by query_id order by score desc, vec_id) as rank").where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
