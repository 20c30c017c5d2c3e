"""Exact top-k search by inner product with MaxScore.

A vector is a document whose terms are its dimensions; a shard keeps one posting row a dimension, with its least and
greatest value. Times a query's own value these bound what the dimension can add to any score. Dimensions in order of that
bound are split where all that the lesser ones could add together no longer beats the query's k-th best
score so far: the essential postings are traversed (as rows of a dense matrix, since a vector has a value in nearly every dimension), and only vectors that the rest could still lift into the top k are probed in
the others, a few dimensions at a time. Each task keeps its best k for each query, and these are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartolina.llm.common import staged

#: Queries are taken in blocks of about this many, so that what is broadcast has a fixed size.
BLOCK = 1024
SHARD = 8192
STEP = 8


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id and parts (longs); vectors that are null or hold null, NaN or an infinity are left out."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vectors.where(v.isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale)).alias("parts"))


def _matrix(lists: list, width: int) -> np.ndarray:
    """One row a dimension; shorter vectors end in zeros."""
    out = np.zeros((width, len(lists)), np.int64)
    for i, x in enumerate(lists):
        out[: len(x), i] = x
    return out


class Shard:
    """Postings of some vectors, one row a dimension, with bounds."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.lo, self.hi = (rows.min(axis=1), rows.max(axis=1)) if rows.size else (np.zeros(len(rows), np.int64),) * 2
        self.top = float(np.abs(rows.astype(np.float64)).max(initial=0))

    def best(self, own: int, query: np.ndarray, k: int, least: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of vectors that reach `least` (all, if None), the query's own left out; a superset of the shard's part of the top k."""
        d = min(len(query), len(self.rows))
        q, rows = query[:d], self.rows[:d]
        most = self.top * float(np.abs(q.astype(np.float64)).max(initial=0)) * max(d, 1)
        if most < 2**53:  # products and sums are exact in doubles, for which there are fast kernels
            q, rows = q.astype(np.float64), rows.astype(np.float64, copy=False)
        elif most >= 2**62:
            q, rows = q.astype(object), rows.astype(np.int64).astype(object)
        else:
            rows = rows.astype(np.int64, copy=False)
        upper = np.maximum(q * self.lo[:d], q * self.hi[:d])
        order = np.argsort(-(upper - np.minimum(q * self.lo[:d], q * self.hi[:d])).astype(np.float64), kind="stable")
        rest = np.append(np.cumsum(upper[order][::-1])[::-1], 0)  # what the dimensions from here on can add
        essential = d if least is None else next((i for i in range(d) if rest[i] < least), d)
        essential = max(essential, min(d, STEP))
        at = np.flatnonzero(self.ids != own)
        score = q[order[:essential]] @ rows[order[:essential]] if essential else np.zeros(len(self.ids), q.dtype)
        score = score[at]
        i = essential
        while True:
            if least is not None:
                alive = score + rest[i] >= least
                at, score = at[alive], score[alive]
            if i >= d or not len(at):
                break
            more = order[i : i + STEP]
            score = score + q[more] @ rows[np.ix_(more, at)]
            i = min(i + STEP, d)
        if len(at) > 4 * k:
            cut = np.partition(score.astype(np.float64), len(score) - k)[len(score) - k]
            keep = score >= cut
            at, score = at[keep], score[keep]
        return self.ids[at], np.array([min(max(int(s), -(2**63)), 2**63 - 1) for s in score], np.int64)


def _merge(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores.astype(object) if len(scores) and scores.min() == -(2**63) else -scores))[:k]
    return ids[order], scores[order]


_HITS = "query_id long, vec_id long, score long"


def _block_hits(rows: DataFrame, block: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """Each shard's best for the block's queries, written before the next block is broadcast, so that one block at a time is held."""
    held = rows.sparkSession.sparkContext.broadcast(block)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {i: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for i, _ in held.value}
        for b in batches:
            for lo in range(0, b.num_rows, SHARD):
                part = b.slice(lo, SHARD)
                lists = part.column(1).to_pylist()
                shard = Shard(np.array(part.column(0).to_pylist(), np.int64), _matrix(lists, max(map(len, lists), default=0)))
                if shard.top < 2**53:  # each value is exact in doubles, which the shard then keeps
                    shard.rows = shard.rows.astype(np.float64)
                for i, q in held.value:
                    ids, scores = best[i]
                    got = shard.best(i, q, k, int(scores[-1]) if len(scores) == k else None)
                    best[i] = _merge(np.concatenate([ids, got[0]]), np.concatenate([scores, got[1]]), k)
        for i, (ids, scores) in best.items():
            if len(ids):
                yield pa.record_batch([pa.array([i] * len(ids), pa.int64()), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])

    hits = staged(rows.mapInArrow(search, _HITS), "topk-hits", narrow=True)
    held.unpersist()
    return hits


def top_k(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is_query holds for, the k rows with the greatest integer inner product.

    Components become floor(scale * x); ties go to the smaller id; fewer than k rows are all returned. Rows with the query's id are its own and left out;
    a query id that is repeated is asked once, with its least vector, while repeated candidates all count. Vectors that are null or hold
    null, NaN or an infinity take no part; rows with a null id neither; a shorter vector ends in zeros; an empty table gives no rows; other columns are ignored.
    The query set is taken in blocks, each against all rows.
    """
    rows = quantised(vectors, id_col, vector_col, scale).where("vec_id is not null")
    asked = staged(quantised(vectors.where(is_query), id_col, vector_col, scale).where("vec_id is not null").groupBy("vec_id").agg(F.min("parts").alias("parts")), "topk-queries")
    blocks = max(1, -(-asked.count() // block))
    found = None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()
        hits = _block_hits(rows, [(r["vec_id"], np.array(r["parts"], np.int64)) for r in own], k)
        found = hits if found is None else found.unionByName(hits)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
