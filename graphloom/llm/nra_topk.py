"""Exact top-k by inner product with no-random-access list aggregation.

Vectors become integers floor(scale * x). Candidates are dealt by a hash of their id to blocks of
about `block_rows`; a block keeps, for each component, its rows sorted by that component. For a
query the lists are read from the end that adds most, all in step. Every row has a lower bound
(read parts, and each unread list's worst value) and an upper bound (read parts, and each unread
list's current value). Reading stops when rows that could still enter the k best by their upper
bound are few; their scores are then resolved exactly, and the blocks' bests merged. Queries go in
blocks to every candidate block: a stated query set against all rows. A step reads the next part of
all lists for all queries of the block at once and adds it to what is known of each row.

How much is saved depends on the vectors: where a few components decide, lists are left early; with
many components of even weight a row's bounds stay apart until most of every list is read, as for any
method without random access (`Block.tops` returns the depths).

Sums of products below 2**53 are exact in double precision; a block and queries beyond that are
scored whole in integers of any size, and scores beyond 63 bits count as the end of that range.
Vectors that are null or hold null or non-finite components take no part; neither do null ids.
Vectors are compared with those of the same length. Ties go to the smaller id. A query's own id is
no candidate of it; repeated candidate rows each count; equal query rows are answered once. An empty
table gives an empty result; other columns are not looked at, whatever their names."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import _shared


class Block:
    """Candidates with their sorted lists; values are whole numbers as doubles."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], np.asarray(values[order], np.float64)
        lists = np.argsort(-self.values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.values, lists, 0)
        self.place = np.empty_like(lists)  # of each row in each list, from the largest
        np.put_along_axis(self.place, lists, np.broadcast_to(np.arange(len(ids))[:, None], lists.shape), 0)

    def whole(self, q_id, query, k: int):
        """The k best by integers of any size."""
        ends = (1 << 63) - 1
        rows = [(-max(-ends - 1, min(ends, sum(int(x) * int(y) for x, y in zip(v, query, strict=True)))), i)
                for v, i in zip(self.values.tolist(), self.ids.tolist(), strict=True) if i != q_id]
        best = sorted(rows)[:k]
        return np.array([i for _, i in best], np.int64), np.array([-x for x, _ in best], np.int64), len(self.ids)

    def tops(self, q_ids: np.ndarray, queries: np.ndarray, k: int):
        """For each query (ids, scores, depth): the k best, and how deep its lists were read.

        Queries read in step: a list from its largest entry where the query's component is positive,
        else from its smallest."""
        n, queries = len(self.ids), np.asarray(queries, np.float64)
        out: list = [None] * len(q_ids)
        with np.errstate(over="ignore"):
            largest = np.abs(self.values).max(initial=0) * np.abs(queries).max(initial=0) * max(1, self.values.shape[1])
        if not largest < 2.0**52:
            return [self.whole(i, q, k) for i, q in zip(q_ids.tolist(), queries.tolist(), strict=True)]
        left, depth = np.arange(len(q_ids)), 0
        known = np.zeros((n, len(left)))
        while len(left):
            before, depth = depth, min(n, max(4 * k, depth + depth // 3))
            up, down = np.maximum(queries[left], 0), np.minimum(queries[left], 0)
            # the next part of each list, from both ends; a row is new in a list only once
            known += np.where((self.place >= before) & (self.place < depth), self.values, 0) @ up.T
            known += np.where((self.place < n - before) & (self.place >= n - depth), self.values, 0) @ down.T
            top, bottom = self.place >= depth, self.place < n - depth  # unread from above, from below
            unread = lambda x, y: top @ (up * x).T + bottom @ (down * y).T
            low = known + unread(self.sorted[-1], self.sorted[0])
            high = known + unread(self.sorted[depth - 1], self.sorted[n - depth])
            own = self.ids[:, None] == q_ids[left][None, :]
            low[own], high[own] = -np.inf, -np.inf
            bar = np.partition(low, n - k, axis=0)[n - k] if n > k else np.full(len(left), -np.inf)
            alive = (high >= bar) & ~own
            stop = (alive.sum(0) <= 2 * k) | (depth >= n)
            for x in np.flatnonzero(stop):
                rows = np.flatnonzero(alive[:, x])
                exact = self.values[rows] @ queries[left[x]]
                first = np.lexsort((self.ids[rows], -exact))[:k]
                out[left[x]] = (self.ids[rows][first], exact[first].astype(np.int64), depth)
            left, known = left[~stop], known[:, ~stop]
        return out


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, size, ints binary) of the vectors that take part: floor(scale * x) as doubles."""

    def run(batches):
        import pyarrow as pa

        most = np.finfo(np.float64).max
        for batch in batches:
            ids, sizes, out = [], [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is None or x is None or None in x:
                    continue
                v = np.array(x, np.float64)
                if np.isfinite(v).all():
                    ids.append(i)
                    sizes.append(len(v))
                    with np.errstate(over="ignore"):
                        out.append(np.clip(np.floor(scale * v), -most, most).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(out, pa.binary())],
                                             names=["vec_id", "size", "ints"])

    rows = _shared.columns(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(run, "vec_id long, size int, ints binary")


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, block_rows: int = 1024, query_rows: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): queries are the rows whose id is divisible by `every`."""
    _shared.small_batches(vectors.sparkSession, 1024)
    rows = integers(vectors, scale)
    count = vectors.count()
    blocks, groups = max(1, math.ceil(count / block_rows)), max(1, math.ceil(count / every / query_rows))
    cands = rows.select("vec_id", "size", "ints", F.expr(f"pmod(xxhash64(vec_id), {blocks})").alias("block"),
                        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("asks"))
    asked = rows.where(F.col("vec_id") % every == 0).distinct()
    asked = asked.select("vec_id", "size", "ints", F.expr(f"cast(pmod(xxhash64(vec_id, 3), {groups}) as int)").alias("asks"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def answer(asks, table):
        import pyarrow as pa

        out: list[list] = [[], [], [], []]
        if asks.num_rows and table.num_rows:
            matrix = lambda t: np.frombuffer(b"".join(t.column("ints").to_pylist()), np.float64).reshape(t.num_rows, -1)
            block = Block(table.column("vec_id").to_numpy(), matrix(table))
            q_ids, queries = asks.column("vec_id").to_numpy(), matrix(asks)
            for q_id, q, (ids, scores, _) in zip(q_ids.tolist(), queries, block.tops(q_ids, queries, k), strict=True):
                out[0] += [q_id] * len(ids)
                out[1] += [q.tobytes()] * len(ids)
                out[2] += ids.tolist()
                out[3] += scores.tolist()
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["query_id", "query", "vec_id", "score"])

    key = ("size", "block", "asks")
    near = asked.groupBy(*key).cogroup(cands.groupBy(*key)).applyInArrow(answer, "query_id long, query binary, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
