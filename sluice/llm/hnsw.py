"""Approximate nearest neighbours by hierarchical navigable small-world graphs, one a shard.

Equal vectors form a class that keeps its smallest ``k + 1`` ids: no query can need more of them. Classes
are dealt by hash into shards of about ``SHARD``. Each shard builds one graph and stores it as flat arrays:
vectors, member ids, and for every layer its nodes and a table of neighbour numbers. Largest inner product
becomes nearness in a metric space by one more component, which gives every vector the same length.

A layer holds the nodes whose geometric level reaches it. Layers are built from the top down; nodes enter in
batches, each searching the layer as it stands (and its own batch) from where the layers above lead to. Of the
candidates a node keeps those nearer to it than to one already kept, then the nearest of the rest; links back
are chosen in the same way where a node's row is full. Searches run for a whole batch of queries in step.

Every query goes to every shard; a shard scores what its beam found in double precision on the original
vectors and returns its best ``k``, and the best of all shards are merged by query. A beam that cannot fill itself
(the graph fell apart there) is replaced by a scan of the shard, so that no candidate is missing when there are few.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor
do rows without id. Vectors of another length than the query's are no candidates of it. Equal scores prefer
the smaller id. Repeated ids are separate rows, except that a query never finds a row of its own id; repeated
equal rows of an id ask once and are found once each. An empty table gives no rows. Only ``vec_id`` and
``embedding`` are read.
"""

from __future__ import annotations

from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.base import sized, stage

K = 20
EVERY = 20
SHARD = 8192
QUERIES = 8192
LINKS = 16
BUILD_BEAM = 96
BEAM = 128
#: nodes that a layer starts from, all compared; largest batch that enters at once
FIRST, BATCH = 256, 512
#: candidates expanded at a time, and queries that are searched in step
STRIDE, TOGETHER = 4, 256


# ---- one graph ----------------------------------------------------------------------

def level_space(x: np.ndarray) -> np.ndarray:
    """Vectors scaled by the longest, with one more component that makes all of length one."""
    x = x / np.abs(x).max()
    x = x / np.sqrt((x * x).sum(axis=1).max())
    rest = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))
    return np.concatenate([x, rest[:, None]], axis=1).astype(np.float32)


def _best_first(ids: np.ndarray, near: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's ``keep`` nearest, nearest first, and the columns they come from."""
    if near.shape[1] > keep:
        part = np.argpartition(-near, keep - 1, axis=1)[:, :keep]
        order = np.take_along_axis(part, np.argsort(-np.take_along_axis(near, part, 1), axis=1, kind="stable"), 1)
    else:
        order = np.argsort(-near, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1), order


def _beam(q: np.ndarray, x: np.ndarray, links: np.ndarray, place: np.ndarray, start: np.ndarray,
          beam: int, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Nodes nearest to each query by a beam search over one layer, nearest first (-1: none).

    ``links[place[node]]`` are a node's neighbours (-1: none); ``start`` are nodes of the layer."""
    n, width = len(q), links.shape[1]
    ids = np.full((n, beam), -1, dtype=np.int32)
    near = np.full((n, beam), -np.inf, dtype=np.float32)
    done = np.ones((n, beam), dtype=bool)
    # the step that met a node, by query; a node met twice in a step counts for the last column only
    met = np.full((n, len(x)), -1, dtype=np.int32)
    first = start[:, :beam]
    rows = np.arange(n)
    met[rows[:, None], first] = np.arange(first.shape[1])
    once = met[rows[:, None], first] == np.arange(first.shape[1])
    ids[:, :first.shape[1]] = np.where(once, first, -1)
    near[:, :first.shape[1]] = np.where(once, np.einsum("ij,ikj->ik", q, x[first]), -np.inf)
    done[:, :first.shape[1]] = ~once
    live = rows
    wide = np.arange(stride * width)
    while len(live):
        # the nearest nodes not yet expanded (rows are ordered)
        todo = ~done[live]
        todo &= np.cumsum(todo, axis=1) <= stride
        todo_rows, todo_cols = np.nonzero(todo)
        done[live[todo_rows], todo_cols] = True
        slot = np.cumsum(todo, axis=1)[todo_rows, todo_cols] - 1
        found = np.full((len(live), stride, width), -1, dtype=np.int32)
        found[todo_rows, slot] = links[place[ids[live[todo_rows], todo_cols]]]
        found = found.reshape(len(live), -1)
        r, c = np.nonzero(found >= 0)
        node = found[r, c]
        fresh = met[live[r], node] < 0
        r, c, node = r[fresh], c[fresh], node[fresh]
        met[live[r], node] = wide[c]
        once = met[live[r], node] == wide[c]
        r, c, node = r[once], c[once], node[once]
        new_near = np.full(found.shape, -np.inf, dtype=np.float32)
        new_near[r, c] = np.einsum("ij,ij->i", q[live[r]], x[node])
        new_ids = np.where(np.isneginf(new_near), -1, found)
        both_ids, both_near, order = _best_first(np.concatenate([ids[live], new_ids], 1),
                                                 np.concatenate([near[live], new_near], 1), beam)
        both_done = np.concatenate([done[live], np.isneginf(new_near)], 1)
        ids[live], near[live], done[live] = both_ids, both_near, np.take_along_axis(both_done, order, 1)
        live = live[~done[live].all(axis=1)]
    return ids, near


def _choose(ids: np.ndarray, near: np.ndarray, x: np.ndarray, keep: int) -> np.ndarray:
    """Of each row's candidates (nearest first, -1: none) up to ``keep`` neighbours: those nearer to the
    node than to any kept before, then the nearest others."""
    rows, width = ids.shape
    among = x[np.maximum(ids, 0)]
    between = among @ among.transpose(0, 2, 1)
    kept = np.zeros((rows, width), dtype=bool)
    count = np.zeros(rows, dtype=np.int64)
    for c in range(width):
        covered = (kept[:, :c] & (between[:, c, :c] >= near[:, c, None])).any(axis=1)
        kept[:, c] = (ids[:, c] >= 0) & ~covered & (count < keep)
        count += kept[:, c]
    # kept ones first, then by nearness; none last
    rank = np.where(ids < 0, 2 * width, np.where(kept, 0, width)) + np.arange(width)
    order = np.argsort(rank, axis=1, kind="stable")[:, :keep]
    out = np.take_along_axis(ids, order, 1)
    if out.shape[1] < keep:
        out = np.concatenate([out, np.full((rows, keep - out.shape[1]), -1, dtype=out.dtype)], 1)
    return out


class Layer:
    """The nodes of one layer and their neighbour numbers, as flat tables."""

    def __init__(self, nodes: np.ndarray, links: np.ndarray, size: int) -> None:
        self.nodes, self.links = nodes, links
        self.place = np.full(size, -1, dtype=np.int32)
        self.place[nodes] = np.arange(len(nodes))


class Graph:
    def __init__(self, x: np.ndarray, layers: list[Layer]) -> None:
        self.x, self.layers = x, layers     # the top layer first

    @classmethod
    def build(cls, x: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 13) -> "Graph":
        """The graph of the rows of ``x`` (in level space)."""
        n = len(x)
        levels = (-np.log(1.0 - np.random.default_rng(seed).random(n)) / log(links)).astype(np.int64)
        order = np.argsort(-levels, kind="stable")
        graph = cls(x, [])
        for level in range(int(levels.max(initial=0)), -1, -1):
            nodes = order[:int((levels >= level).sum())].astype(np.int32)
            graph.layers.append(graph._layer(nodes, links * (1 if level else 2), links, beam))
        return graph

    def _layer(self, nodes: np.ndarray, width: int, links: int, beam: int) -> Layer:
        """A new lowest layer of ``nodes``; those of the layer above come first among them."""
        x = self.x
        layer = Layer(nodes, np.full((len(nodes), width), -1, dtype=np.int32), len(x))
        at = 0
        while at < len(nodes):
            # the first nodes are those that upper layers lead to, so that searches can start there
            size = FIRST if at == 0 else min(BATCH, max(64, at // 2))
            batch = nodes[at:at + size]
            own = x[batch] @ x[batch].T
            np.fill_diagonal(own, -np.inf)
            ids, near, _ = _best_first(np.broadcast_to(batch, own.shape), own, min(beam, len(batch)))
            ids = np.where(np.isneginf(near), -1, ids)
            if at:
                start = self._descend(x[batch], layer, at)
                met, met_near = _beam(x[batch], x, layer.links, layer.place, start, beam)
                ids, near, _ = _best_first(np.concatenate([met, ids], 1), np.concatenate([met_near, near], 1), beam)
            chosen = _choose(ids, near, x, links)
            layer.links[at:at + len(batch), :links] = chosen
            self._link_back(layer, batch, chosen)
            at += len(batch)
        return layer

    def _descend(self, q: np.ndarray, lowest: Layer, known: int) -> np.ndarray:
        """A start for each query in the lowest layer: what the layers above lead to."""
        start = np.broadcast_to(self.layers[0].nodes[:1] if self.layers else lowest.nodes[:1], (len(q), 1))
        for layer in self.layers:
            ids, _ = _beam(q, self.x, layer.links, layer.place, start, 4)
            start = np.where(ids >= 0, ids, ids[:, :1])
        # nodes of upper layers enter a layer first, but not all of them in its first batch
        entered = lowest.place[start] < known
        return np.where(entered, start, lowest.nodes[0])

    def _link_back(self, layer: Layer, batch: np.ndarray, chosen: np.ndarray) -> None:
        x, width = self.x, layer.links.shape[1]
        source, target = np.repeat(batch, chosen.shape[1]), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        near = np.einsum("ij,ij->i", x[source], x[target])
        order = np.lexsort((-near, target))
        source, target = source[order], target[order]
        begins = np.flatnonzero(np.append(True, target[1:] != target[:-1])) if len(target) else np.zeros(0, np.int64)
        rank = np.arange(len(target)) - np.repeat(begins, np.diff(np.append(begins, len(target))))
        stays = rank < width
        row = np.cumsum(rank == 0) - 1
        to = target[begins]
        for s in range(0, len(to), 1024):
            part = to[s:s + 1024]
            mine = stays & (row >= s) & (row < s + 1024)
            new = np.full((len(part), width), -1, dtype=np.int32)
            new[row[mine] - s, rank[mine]] = source[mine]
            old = layer.links[layer.place[part]]
            # a node of the same batch may have chosen this one already
            new[(new[:, :, None] == old[:, None, :]).any(axis=2)] = -1
            free = (old < 0).sum(axis=1) >= (new >= 0).sum(axis=1)
            both = np.concatenate([old, new], 1)
            packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
            out = packed[:, :width].copy()
            full = np.flatnonzero(~free)
            if len(full):
                ids = both[full]
                near = np.einsum("ij,ikj->ik", x[part[full]], x[np.maximum(ids, 0)])
                near[ids < 0] = -np.inf
                ids, near, _ = _best_first(ids, near, ids.shape[1])
                out[full] = _choose(ids, near, x, width)
            layer.links[layer.place[part]] = out

    def search(self, q: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Node numbers nearest to each query (rows of level space with a zero last), -1 where none."""
        out = np.full((len(q), min(beam, len(self.x))), -1, dtype=np.int32)
        for s in range(0, len(q), TOGETHER):
            part = q[s:s + TOGETHER]
            start = np.broadcast_to(self.layers[0].nodes[:1], (len(part), 1))
            for layer in self.layers[:-1]:
                ids, _ = _beam(part, self.x, layer.links, layer.place, start, 4)
                start = np.where(ids >= 0, ids, ids[:, :1])
            low = self.layers[-1]
            out[s:s + TOGETHER] = _beam(part, self.x, low.links, low.place, start, out.shape[1])[0]
        return out

    def flat(self) -> tuple[bytes, bytes, list[int]]:
        """All layers' nodes, all their neighbour tables, and the number of nodes of each layer."""
        return (np.concatenate([a.nodes for a in self.layers]).astype(np.int32).tobytes(),
                np.concatenate([a.links.ravel() for a in self.layers]).astype(np.int32).tobytes(),
                [len(a.nodes) for a in self.layers])

    @classmethod
    def read(cls, x: np.ndarray, nodes: bytes, links: bytes, sizes: list[int], width: int) -> "Graph":
        all_nodes, all_links = np.frombuffer(nodes, np.int32), np.frombuffer(links, np.int32)
        layers, a, b = [], 0, 0
        for i, n in enumerate(sizes):
            w = width * (2 if i == len(sizes) - 1 else 1)
            layers.append(Layer(all_nodes[a:a + n], all_links[b:b + n * w].reshape(n, w), len(x)))
            a, b = a + n, b + n * w
        return cls(x, layers)


# ---- Spark ------------------------------------------------------------------------------

def usable(embeddings: DataFrame) -> DataFrame:
    """``vec_id, v`` of the rows that take part."""
    x = F.col("embedding")
    fine = (F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
            & F.exists(x, lambda c: c != 0))
    return (embeddings.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & x.isNotNull() & fine)
            .select("vec_id", F.transform(x, lambda c: c.cast("double")).alias("v")))


_INDEX = ("dim long, shard long, vectors binary, ids binary, counts binary, nodes binary, links binary, "
          "sizes array<int>")


def _build(links: int, beam: int):
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("mark", kind="stable")
        x = np.stack(rows["v"].to_numpy()).astype(np.float64)
        nodes, table, sizes = Graph.build(level_space(x), links, beam).flat()
        ids = [np.sort(np.asarray(i, dtype=np.int64)) for i in rows["ids"]]
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "vectors": [x.tobytes()], "ids": [np.concatenate(ids).tobytes()],
                             "counts": [np.array([len(i) for i in ids], np.int32).tobytes()],
                             "nodes": [nodes], "links": [table], "sizes": [sizes]})
    return run


def build_index(vectors: DataFrame, k: int = K, shard: int = SHARD, links: int = LINKS, beam: int = BUILD_BEAM) -> DataFrame:
    """One row a shard of ``vectors(vec_id, v)``: its graph as flat arrays (staged)."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    # a class of copies keeps the k + 1 smallest of its ids, an exact top of equal scores
    classes = stage(vectors.withColumn("place", place).where(F.col("place") <= k + 1)
                    .groupBy("v").agg(F.collect_list(F.col("vec_id").cast("long")).alias("ids")).withColumn("dim", F.size("v").cast("long")), "classes")
    shards = stage(classes.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(shard)).cast("long").alias("shards")), "shards")
    dealt = classes.join(sized(shards), "dim").withColumn("mark", F.xxhash64("v", F.lit(13)))
    dealt = dealt.select("dim", F.pmod("mark", "shards").alias("shard"), "mark", "v", "ids")
    return stage(dealt.groupBy("dim", "shard").applyInPandas(_build(links, beam), _INDEX), "graphs")


def _search(k: int, beam: int, links: int):
    def run(key, shards: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        asked, met, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for s in shards.itertuples() if len(queries) else ():
            x = np.frombuffer(s.vectors, np.float64).reshape(-1, key[0])
            counts = np.frombuffer(s.counts, np.int32)
            ids, offsets = np.frombuffer(s.ids, np.int64), np.append(0, np.cumsum(counts))
            graph = Graph.read(level_space(x), s.nodes, s.links, [int(n) for n in s.sizes], links)
            q = np.stack(queries["v"].to_numpy()).astype(np.float64)
            unit = q / np.abs(q).max(axis=1, keepdims=True)
            unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
            level = np.concatenate([unit, np.zeros((len(q), 1))], axis=1).astype(np.float32)
            near = graph.search(level, max(beam, 2 * (k + 1)))
            for qid, vector, nodes in zip(queries["vec_id"].to_numpy(), q, near):
                # a beam with room left has not seen the whole graph
                nodes = nodes if (nodes >= 0).all() else np.arange(len(x))
                score = (x[nodes] * vector).sum(axis=1)
                best = np.lexsort((ids[offsets[nodes]], -score))[:k + 1]
                nodes, score = nodes[best], score[best]
                rows = np.concatenate([ids[offsets[n]:offsets[n + 1]] for n in nodes])
                score = np.repeat(score, counts[nodes])
                other = rows != qid
                rows, score = rows[other], score[other]
                top = np.lexsort((rows, -score))[:k]
                asked.append(np.full(len(top), qid, np.int64))
                met.append(rows[top])
                scores.append(score[top])
        return pd.DataFrame({"query_id": np.concatenate(asked), "vec_id": np.concatenate(met), "score": np.concatenate(scores)})
    return run


def nearest(index: DataFrame, queries: DataFrame, k: int = K, beam: int = BEAM, links: int = LINKS,
            block: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score`` of ``queries(vec_id, v)`` in an index of :func:`build_index`."""
    queries = stage(queries.withColumn("dim", F.size("v").cast("long")), "queries")
    blocks = max(1, -(-queries.count() // block))
    known = index.groupBy("dim").agg((F.max("shard") + 1).alias("shards"))
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = (queries.join(sized(known), "dim")
             .withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int"))
             .select(F.col("dim").alias("dim2"), F.explode(F.expr("sequence(0L, shards - 1)")).alias("shard2"), F.col("block").alias("block2"), "vec_id", "v"))
    parts = max(1, index.count() * blocks)
    found = (left.repartition(parts, "dim", "shard", "block").groupBy("dim", "shard", "block")
             .cogroup(right.repartition(parts, "dim2", "shard2", "block2").groupBy("dim2", "shard2", "block2"))
             .applyInPandas(_search(k, beam, links), "query_id long, vec_id long, score double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_embeddings(embeddings: DataFrame, k: int = K, every: int = EVERY, shard: int = SHARD,
                       beam: int = BEAM, links: int = LINKS, build_beam: int = BUILD_BEAM) -> DataFrame:
    """The queries are the rows whose id is divisible by ``every``; every row is indexed."""
    v = stage(usable(embeddings), "vectors")
    return nearest(build_index(v, k, shard, links, build_beam), v.where(F.col("vec_id") % every == 0).distinct(), k, beam, links)
