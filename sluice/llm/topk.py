"""Exact top-k inner products by no-random-access aggregation.

Vectors become integers (floor of ``scale`` times each component). They are dealt into shards
of about ``SHARD`` rows and the queries into blocks of ``QUERIES``; every (shard, block) pair is one
group, so both sides grow without one task growing. A group sorts its shard once per dimension.
All queries of a block read the lists in step, each from the end that raises its score, one stretch after the
other. Entries of a stretch are read once and change the scores and bounds of the rows they belong to: a row's lower
bound is what was read of it plus the worst that each unread list holds, its upper bound what was read plus the value
at which each unread list stands. A query stops reading when no row outside its k best lower bounds, and no unseen
row, can reach the k-th of them; then the rest of the lists is read for the rows that still can, and no row is looked
up by itself. The k best of all shards are merged per query. A stretch is a matrix product, queries by entries, with
zeros for entries outside it; the numbers of entries read, not of multiplications, are those of the method.

Defined cases: vectors that are null, or hold null or non-finite components, take part in
nothing; a null id neither. Vectors of another length than the query's are no candidates of it.
Equal scores prefer the smaller id. Repeated ids are separate rows: a row is left out only for
queries of its own id. With fewer than k candidates all are returned. Only ``vec_id`` and
``embedding`` are read. An empty table gives no rows. Scores are exact as long as they fit 53 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.base import stage

K = 5
EVERY = 50
SCALE = 256
SHARD = 4096
QUERIES = 256
#: shares of the lists at which the bounds are compared; after the last, all is read
STEPS = (0.5, 0.8)


def integer_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, v`` of the rows that take part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return (embeddings.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & x.isNotNull() & fine)
            .select("vec_id", F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v")))


class SortedLists:
    """One shard: its rows, and for each dimension a list of them by value, read from either end in stretches.

    Stretch ``i`` of a list holds the rows in places ``depths[i] .. depths[i + 1]`` from the end that a query
    reads it from: the top for a positive weight, the bottom for a negative one."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, steps=STEPS) -> None:
        n = len(ids)
        self.ids, self.rows = ids, rows.astype(np.float64)
        order = np.argsort(rows, axis=0, kind="stable")
        place = np.empty(order.shape, dtype=np.int32)
        np.put_along_axis(place, order, np.broadcast_to(np.arange(n, dtype=np.int32)[:, None], order.shape), 0)
        line = np.take_along_axis(self.rows, order, axis=0)
        self.least, self.most = line[0], line[-1]
        self.depths = [0, *(int(n * s) for s in steps), n]
        #: for each depth but the last, the values at which the lists stand, from the top and from the bottom
        self.fronts = [(line[n - t], line[t - 1]) if t else (self.most, self.least) for t in self.depths[1:-1]]
        self.place = place

    def stretch(self, i: int, top: bool, rows=slice(None)) -> np.ndarray:
        """Which entries of the rows stretch ``i`` holds."""
        place = self.place[rows]
        away = len(self.ids) - 1 - place if top else place
        return (away >= self.depths[i]) & (away < self.depths[i + 1])

    def best(self, query_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and scores of the k best rows other than its own."""
        n, m = len(self.ids), len(q)
        up, down = np.maximum(q, 0.0), np.minimum(q, 0.0)
        other = self.ids[None, :] != query_ids[:, None]
        out: list = [None] * m
        live = np.arange(m)
        # what is known of every score, and the worst that its unread entries can be
        known, worst = np.zeros((m, n)), np.repeat((up @ self.least + down @ self.most)[:, None], n, axis=1)
        read_top, read_bottom = np.zeros(self.rows.shape), np.zeros(self.rows.shape)
        for i in range(len(self.depths) - 1):
            top, bottom = self.stretch(i, True), self.stretch(i, False)
            # only entries new in this stretch change a score or a bound
            known += up[live] @ np.where(top, self.rows, 0.0).T + down[live] @ np.where(bottom, self.rows, 0.0).T
            worst -= (up[live] * self.least) @ top.T + (down[live] * self.most) @ bottom.T
            read_top += top
            read_bottom += bottom
            if i == len(self.depths) - 2:
                alive = other[live]
            else:
                low, high = self.fronts[i]
                fu, fd = up[live] * low, down[live] * high
                upper = known + (fu.sum(axis=1) + fd.sum(axis=1))[:, None] - fu @ read_top.T - fd @ read_bottom.T
                lower = np.where(other[live], known + worst, -np.inf)
                kth = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(live), -np.inf)
                # an unseen row has the sum of the fronts as its upper bound, which the formula gives it
                alive = other[live] & (upper >= kth[:, None])
            ends = (alive.sum(axis=1) <= max(4 * k, n // 16)) | (i == len(self.depths) - 2)
            for at in np.flatnonzero(ends):
                # the lists are read on for the rows that can still qualify, and for no other
                rows, j = np.flatnonzero(alive[at]), live[at]
                score = known[at, rows]
                if i < len(self.depths) - 2:
                    score = score + (np.where(read_top[rows] > 0, 0.0, self.rows[rows]) @ up[j]
                                     + np.where(read_bottom[rows] > 0, 0.0, self.rows[rows]) @ down[j])
                pick = np.lexsort((self.ids[rows], -score))[:k]
                out[j] = self.ids[rows][pick], score[pick].astype(np.int64)
            live, known, worst = live[~ends], known[~ends], worst[~ends]
            if not len(live):
                break
        return out


def _group(k: int):
    def run(key, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            width = rows["v"].map(len)
            for size, part in rows.groupby(width, sort=True):
                if size == 0:
                    continue
                asked = queries[queries["v"].map(len) == size]
                if asked.empty:
                    continue
                shard = SortedLists(part["vec_id"].to_numpy(), np.stack(part["v"].to_numpy()))
                q = np.stack(asked["v"].to_numpy()).astype(np.float64)
                for qid, (ids, scores) in zip(asked["vec_id"], shard.best(asked["vec_id"].to_numpy(), q, k)):
                    out += [(qid, i, s) for i, s in zip(ids, scores)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score`` for ``vectors(vec_id, v)`` and ``queries(vec_id, v)``."""
    vectors, queries = stage(vectors, "vectors"), stage(queries, "queries")
    shards = max(1, -(-vectors.count() // SHARD))
    blocks = max(1, -(-queries.count() // QUERIES))
    kind = vectors.schema["vec_id"].dataType.simpleString()
    deal = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select("vec_id", "v", deal(shards).alias("shard"), every(blocks).alias("block"))
    right = queries.select("vec_id", "v", deal(blocks).alias("block"), every(shards).alias("shard"))
    # little data but much work a group: a task each, which a size-based merge would undo
    left, right = (side.repartition(shards * blocks, "shard", "block") for side in (left, right))
    found = (left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block"))
             .applyInPandas(_group(k), f"query_id {kind}, vec_id {kind}, score long"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k_embeddings(embeddings: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """The queries are the rows whose id is divisible by ``every``; each id asks once for each
    of its rows' vectors only if they differ (repeated equal rows ask once)."""
    v = integer_vectors(embeddings, scale)
    return top_k(v, v.where(F.col("vec_id") % every == 0).distinct(), k)


def oracle(k: int = K, every: int = EVERY, scale: int = SCALE) -> str:
    return f"""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(c::DOUBLE * {scale})::BIGINT) AS v
                   FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
                   AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                     list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
              FROM v q, v c WHERE q.vec_id % {every} = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
