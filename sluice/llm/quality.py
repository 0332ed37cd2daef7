"""Quality classifier: regularised quadratic discriminant over document statistics.

Each whole text becomes a short vector of transformed statistics (lengths, shares of character
classes, sentence marks, repeated neighbours, distinct words). From labelled rows Spark sums
counts, vectors and outer products per class in one aggregation; the driver holds two small
covariance matrices, shrinks each towards the pooled diagonal, and keeps the inverse Cholesky
factors. A document's raw score is the difference of the two Gaussian log densities (squared
Mahalanobis lengths by the cached factors) plus the log prior ratio; a logistic curve fitted to
a histogram of training scores turns it into a probability.

Defined cases: null text counts as empty; an empty text has the vector of zero lengths and gets
a score like any other. Rows that repeat a doc_id all train and are all scored. Null labels and
ids do not train, and an empty table gives no rows. Texts of any length count whole; equal scores need no rule. With no labelled row of some class every score is the share of label 1 (0.5
without labels). Only ``doc_id`` and ``text`` are read; labels must have unique ids or agree -
each label row trains once per document row it matches.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import words as W
from sluice.llm.base import SLICE, give_back, sized, slices, stage

#: share of the pooled diagonal in each class covariance
SHRINK = 0.05
THRESHOLD = 0.7
#: folds of crc32(doc_id): rows with this remainder never train
FOLDS, HELD_OUT = 4, 2

_CLASSES = {
    "upper": range(65, 91), "digit": range(48, 58), "stop": b".,;:", "bang": b"!?", "pipe": b"|",
    "sign": b"#$%&*@^~=+<>\\/{}[]_`", "line": b"\n",
}
_MASKS = np.zeros((len(_CLASSES), 256), dtype=bool)
for _i, _bytes in enumerate(_CLASSES.values()):
    _MASKS[_i, list(_bytes)] = True
NAMES = ["words", "word_size", *_CLASSES, "short", "next_same", "distinct", "distinct_pairs"]


def document_statistics(col: pa.Array) -> np.ndarray:
    """One transformed row per text, in the order of ``NAMES``."""
    raw, offsets = W.string_buffers(col)
    out = np.zeros((len(offsets) - 1, len(NAMES)))
    for c in W.chunks(col):
        rows = slice(c.row0, c.row0 + c.docs)
        off = offsets[c.row0:c.row0 + c.docs + 1]
        buf = raw[off[0]:off[-1]]
        size = np.diff(off)
        n = np.diff(c.first)
        for k, mask in enumerate(_MASKS):
            total = np.concatenate([[0], np.cumsum(mask[buf])])
            out[rows, 2 + k] = np.diff(total[off - off[0]])
        out[rows, 2:2 + len(_MASKS)] = np.log((out[rows, 2:2 + len(_MASKS)] + 0.1) / (n + 5.0)[:, None])
        out[rows, 0] = np.log1p(n)
        out[rows, 1] = np.log1p((size - n) / np.maximum(n, 1))
        sizes = np.concatenate([[0], np.cumsum(c.sizes <= 3)])
        same = np.concatenate([[0], np.cumsum(np.concatenate([[False], c.hashes[1:] == c.hashes[:-1]]))]) \
            if len(c.hashes) else np.zeros(1)
        short = np.diff(sizes[c.first])
        pairs = W.grams(c.hashes, 2)
        k = 2 + len(_MASKS)
        for d in range(c.docs):
            a, b = c.first[d], c.first[d + 1]
            m = b - a
            i = c.row0 + d
            out[i, k] = (short[d] + 1) / (m + 4)
            out[i, k + 1] = math.log(((same[b] - same[a + 1] if m else 0) + 0.1) / (m + 5))
            out[i, k + 2] = math.log((len(np.unique(c.hashes[a:b])) + 1) / (m + 1))
            out[i, k + 3] = math.log((len(np.unique(pairs[a:b - 1])) + 1) / (max(m, 1) + 0.0)) if m > 1 else 0.0
    return out


def _statistics_batches(batches):
    for batch in slices(batches):
        rows = document_statistics(batch.column("text"))
        values = pa.ListArray.from_arrays(
            pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), values], names=["doc_id", "x"])


class Discriminant:
    """Class means, inverse Cholesky factors, and the logistic curve of the score."""

    def __init__(self, sums: dict[int, tuple[int, np.ndarray, np.ndarray]], shrink: float = SHRINK) -> None:
        self.curve = (1.0, 0.0)
        self.total = sum(s[0] for s in sums.values())
        self.share = sums[1][0] / self.total if 1 in sums and self.total else 0.0 if self.total else 0.5
        self.ready = all(c in sums and sums[c][0] > 1 for c in (0, 1))
        if not self.ready:
            return
        cov = {c: (xx - np.outer(x, x) / n) / n for c, (n, x, xx) in sums.items()}
        pooled = np.diag(sum(cov[c] * sums[c][0] for c in (0, 1)) / self.total) + 1e-6
        self.mean, self.factor, self.const = {}, {}, {}
        for c in (0, 1):
            n, x, _ = sums[c]
            low = np.linalg.cholesky((1 - shrink) * cov[c] + shrink * np.diag(pooled))
            self.mean[c], self.factor[c] = x / n, np.linalg.inv(low)
            self.const[c] = math.log(n / self.total) - np.log(np.diag(low)).sum()

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 minus that of class 0, priors included."""
        part = {c: self.const[c] - 0.5 * (((x - self.mean[c]) @ self.factor[c].T) ** 2).sum(axis=1) for c in (0, 1)}
        return part[1] - part[0]

    def fit_curve(self, mid: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> None:
        """Newton steps for P(label 1) = 1 / (1 + exp(-(a z + b))) over histogram bins."""
        a, b = 0.1, 0.0
        n = ones + zeros
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * mid + b, -30, 30)))
            g = np.array([((ones - n * p) * mid).sum() - 1e-3 * a, (ones - n * p).sum()])
            w = n * p * (1 - p) + 1e-9
            h = np.array([[(w * mid * mid).sum() + 1e-3, (w * mid).sum()], [(w * mid).sum(), w.sum()]])
            step = np.linalg.solve(h, g)
            a, b = a + step[0], b + step[1]
            if np.abs(step).max() < 1e-9:
                break
        if a > 0 and math.isfinite(a) and math.isfinite(b):
            self.curve = (float(a), float(b))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), self.share)
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * squash(self.raw(x)) + b, -30, 30)))


def squash(z: np.ndarray) -> np.ndarray:
    """Signed logarithm: keeps the order, tames far tails."""
    return np.sign(z) * np.log1p(np.abs(z))


def in_fold(doc_id, folds: int, rest: int):
    """``crc32(doc_id as text) mod folds = rest``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == rest, F.lit(False))


def fit(statistics: DataFrame, labels: DataFrame, column: str = "quality", shrink: float = SHRINK,
        folds: int = FOLDS, held_out: int = HELD_OUT) -> Discriminant:
    """Fit on all labelled rows outside the held-out fold."""
    known = (labels.select(F.col("doc_id").alias("_id"), F.col(column).cast("int").alias("_y"))
             .where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull()
                    & ~in_fold(F.col("_id"), folds, held_out)))
    train = statistics.join(sized(stage(known, "labels")), F.col("doc_id") == F.col("_id")).select("x", "_y")
    d = len(NAMES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    rows = train.groupBy("_y").agg(
        F.count("*").alias("n"), F.array(*[F.sum(F.col("x")[i]) for i in range(d)]).alias("sx"),
        F.array(*[F.sum(F.col("x")[i] * F.col("x")[j]) for i, j in pairs]).alias("sxx")).collect()
    sums = {}
    for r in rows:
        xx = np.zeros((d, d))
        for (i, j), v in zip(pairs, r["sxx"]):
            xx[i, j] = xx[j, i] = v
        sums[r["_y"]] = (r["n"], np.array(r["sx"]), xx)
    model = Discriminant(sums, shrink)
    if model.ready:
        bins = train.mapInArrow(_histogram(model), "bin int, y int, n long").groupBy("bin", "y").agg(
            F.sum("n").alias("n")).collect()
        mid = sorted({r["bin"] for r in bins})
        counts = {(r["bin"], r["y"]): r["n"] for r in bins}
        model.fit_curve(np.array(mid) / 10.0, *(np.array([counts.get((b, y), 0) for b in mid], float) for y in (1, 0)))
    return model


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), len(NAMES))


def _histogram(model: Discriminant):
    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            at = np.round(np.clip(squash(model.raw(_matrix(batch.column("x")))), -20, 20) * 10).astype(np.int64)
            y = batch.column("_y").to_numpy(zero_copy_only=False)
            keys, n = np.unique(at * 2 + y, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array((keys // 2).astype(np.int32)), pa.array((keys % 2).astype(np.int32)), pa.array(n.astype(np.int64))],
                names=["bin", "y", "n"])
    return run


def _score_batches(model: Discriminant):
    def run(batches):
        for batch in batches:
            s = model.score(_matrix(batch.column("x"))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], names=["doc_id", "score"])
    return run


def score_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    x = stage(documents.select("doc_id", "text").mapInArrow(
        _statistics_batches, f"doc_id {kind}, x array<double>"), "statistics")
    scored = x.mapInArrow(_score_batches(fit(x, labels)), f"doc_id {kind}, score double")
    return scored.select("doc_id", in_fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents`` without the rows predicted to be of low quality, all columns kept; every
    row is judged by its own text."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    x = stage(documents.select("doc_id", "text").mapInArrow(
        _statistics_batches, f"doc_id {kind}, x array<double>"), "statistics")
    model = fit(x, labels)

    @F.arrow_udf("double")
    def good(text: pa.Array) -> pa.Array:
        # texts stay in their buffer, a slice of them at a time has its statistics
        scores = [model.score(document_statistics(text.slice(a, SLICE))) for a in range(0, len(text), SLICE)]
        give_back()
        return pa.array(np.concatenate(scores) if scores else np.zeros(0))
    return documents.where(good("text") >= THRESHOLD)
