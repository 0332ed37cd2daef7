"""Embedding near-dedup by collision-counting projections.

Only vectors of equal, non-null label are compared. Equal vectors of a label form a class with a
member count. Unit vectors are projected on ``PROJECTIONS`` fixed random directions; two vectors at
the threshold cosine differ by N(0, d) on each, d being their distance. Around each query a window
of half-width ``WIDTH * d`` holds the threshold pair's mate with a known chance p, so the number of
windows two such vectors share is binomial, and the smallest count asked for is the largest that
keeps the wanted recall of pairs right at the threshold (closer pairs collide more often). Pairs
that reach the count are verified by cosine in double precision.

A label is cut into blocks of about ``BLOCK`` classes (a hot label into many); each pair of blocks
is one group. In a group each projection is sorted, windows are found by binary search, and hits
are counted per pair in a small byte table; pairs too far behind after a first part of the
projections are not counted on. A group returns the links of each class as a number, and a forest of the
verified pairs, at most one row a class each.

Defined cases: null, zero, empty vectors and those with null or non-finite components link with
nothing (n_links 0, component_id their own id), as do rows of null label. Vectors of different
lengths never link. Repeated rows are members of one class and link with each other. A null
vec_id stays null and is ignored in the smallest id. An empty table gives no rows. Only ``vec_id, label,
embedding`` are read, so other columns may have any name.
"""

from __future__ import annotations

from math import comb, sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.base import components, sized, stage

COSINE = 0.93
PROJECTIONS = 64
FIRST = 24
WIDTH = 1.6
RECALL = 0.999
BLOCK = 1024


def count_needed(projections: int, width: float = WIDTH, recall: float = RECALL) -> int:
    """Largest collision count that a pair at the threshold reaches with chance ``recall``."""
    p = 2 * NormalDist().cdf(width) - 1
    tail, need = 0.0, projections
    while need > 0:
        tail += comb(projections, need) * p ** need * (1 - p) ** (projections - need)
        if tail >= recall:
            return need
        need -= 1
    return 0


def directions(dim: int, projections: int) -> np.ndarray:
    return np.random.default_rng(93).standard_normal((dim, projections))


def collisions(a: np.ndarray, b: np.ndarray, half: float, counts: np.ndarray) -> None:
    """Add one to ``counts[i, j]`` for every projection that has b_j in the window of a_i.

    A window is a stretch of the sorted line; whether a place lies in it is one subtraction and one comparison
    of 16-bit places (a block has fewer than 65,536 vectors)."""
    rank = np.empty(len(b), dtype=np.uint16)
    away = np.empty(counts.shape, dtype=np.uint16)
    hit = np.empty(counts.shape, dtype=bool)
    for k in range(a.shape[1]):
        order = np.argsort(b[:, k], kind="stable")
        line = b[order, k]
        lo = np.searchsorted(line, a[:, k] - half, side="left")
        hi = np.searchsorted(line, a[:, k] + half, side="right")
        rank[order] = np.arange(len(order), dtype=np.uint16)
        # places before the window wrap round to large numbers
        np.subtract(rank[None, :], lo.astype(np.uint16)[:, None], out=away)
        np.less(away, (hi - lo).astype(np.uint16)[:, None], out=hit)
        counts += hit


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fewer links with the same components: each node's link to the smallest node it can reach."""
    low = np.arange(n)
    while len(i):
        before = low.copy()
        least = np.minimum(low[i], low[j])
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        low = low[low]
        if (low == before).all():
            break
    moved = np.flatnonzero(low != np.arange(n))
    return moved, low[moved]


def _pairs(threshold: float, projections: int, first: int, recall: float):
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        same = key[2] == key[3]
        met_i, met_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        idx = idy = np.zeros(0, np.int64)
        half = WIDTH * sqrt(2 - 2 * threshold)
        early, late = count_needed(first, recall=1 - (1 - recall) / 2), count_needed(projections, recall=1 - (1 - recall) / 2)
        if len(left) and len(right):
            dim = key[1]
            x, y = (np.stack(v.to_numpy()).astype(np.float64) for v in (left["v"], right["v2"]))
            nx, ny = (np.sqrt((m * m).sum(axis=1, keepdims=True)) for m in (x, y))
            ux, uy = x / nx, y / ny
            r = directions(dim, projections)
            px, py = ux @ r, uy @ r
            idx, idy = left["node"].to_numpy(), right["node2"].to_numpy()
            for s in range(0, len(ux), 256):
                counts = np.zeros((len(ux[s:s + 256]), len(uy)), dtype=np.uint8)
                collisions(px[s:s + 256, :first], py[:, :first], half, counts)
                i, j = np.nonzero(counts >= early)
                if same:
                    i, j = i[i + s < j], j[i + s < j]
                total = counts[i, j] + (np.abs(px[i + s, first:] - py[j, first:]) <= half).sum(axis=1)
                i, j = i[total >= late] + s, j[total >= late]
                cosine = (ux[i] * uy[j]).sum(axis=1)
                near = cosine >= threshold
                # right at the threshold, decide as dot / (|x| |y|)
                edge = np.abs(cosine - threshold) < 1e-9
                if edge.any():
                    exact = (x[i] * y[j]).sum(axis=1) / (nx[i, 0] * ny[j, 0])
                    near = np.where(edge, exact >= threshold, near)
                met_i.append(i[near])
                met_j.append(j[near])
        i, j = np.concatenate(met_i), np.concatenate(met_j)
        # the links of each class, counted, and a forest of them: the pairs themselves stay here
        nodes = idx if same else np.concatenate([idx, idy])
        at = j if same else j + len(idx)
        size = np.concatenate([left["members"], right["members2"][:0 if same else None]]).astype(np.int64)
        others = np.zeros(len(nodes), dtype=np.int64)
        np.add.at(others, i, size[at])
        np.add.at(others, at, size[i])
        some = np.flatnonzero(others)
        x, y = forest(i, at, len(nodes))
        return pd.DataFrame({"a": np.concatenate([nodes[some], nodes[x]]), "b": np.concatenate([nodes[some], nodes[y]]),
                             "others": np.concatenate([others[some], np.zeros(len(x), np.int64)])})
    return run


def near_dedup(embeddings: DataFrame, threshold: float = COSINE, projections: int = PROJECTIONS,
               first: int = FIRST, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    x = F.col("embedding")
    fine = (F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0)
            & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
            & F.exists(x, lambda c: c != 0))
    rows = stage(embeddings.select("vec_id", "label", "embedding", F.coalesce(fine, F.lit(False)).alias("fine")),
                 "vectors")
    usable = rows.where("fine").withColumn("v", F.transform("embedding", lambda c: c.cast("double")))
    classes = stage(usable.groupBy("label", "v").agg(F.min("vec_id").alias("low"), F.count("*").alias("members"))
                    .withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "classes")
    blocks = stage(classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks")), "blocks")
    cut = (classes.join(sized(blocks), ["label", "dim"])
           .withColumn("at", F.pmod(F.xxhash64("v", F.lit(11)), "blocks").cast("int"))
           .select("label", "dim", "node", "members", "v", "at", "blocks"))
    keys = ["label", "dim", "i", "j"]
    left = cut.select("label", "dim", F.col("at").alias("i"), F.explode(F.expr("sequence(at, blocks - 1)")).alias("j"), "node", "members", "v")
    right = cut.select(F.col("label").alias("label2"), F.col("dim").alias("dim2"),
                       F.explode(F.expr("sequence(0, at)")).alias("i2"), F.col("at").alias("j2"),
                       F.col("node").alias("node2"), F.col("members").alias("members2"), F.col("v").alias("v2"))
    pairs = stage(left.groupBy(*keys).cogroup(right.groupBy("label2", "dim2", "i2", "j2"))
                  .applyInPandas(_pairs(threshold, projections, first, recall), "a long, b long, others long"), "pairs")

    # links of a class: members of linked classes, and its own other members
    linked = pairs.where("others > 0").groupBy(F.col("a").alias("node")).agg(F.sum("others").alias("others"))
    named = (classes.join(linked, "node", "left").join(components(pairs.where("a <> b").select("a", "b")), "node", "left")
             .withColumn("comp", F.coalesce("comp", "node")))
    lows = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = stage(named.join(lows, "comp").select(
        "label", "v", (F.coalesce("others", F.lit(0)) + F.col("members") - 1).alias("n_links"), "component_id"), "named")
    found = usable.join(named, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                          F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
