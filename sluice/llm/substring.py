"""Substring dedup with suffix automata of reference shards.

Every word covered by a run of ``window`` consecutive words that also starts anywhere else (the
same document included) is removed; runs are judged on the input.

A corpus-wide automaton, or streaming every document past every shard, would cost the square
of the corpus, so the shards are keyed: each window belongs to its minimizer, the smallest hash
among its eight-word grams, and equal windows have equal minimizers. The windows of one
minimizer occurrence are a run of up to 28 starts; the words under them form a segment, and
each physical window lies in exactly one segment. Only minimizers seen twice or more go on
(a count over one hash in about 14 words). Per minimizer:

* one distinct segment seen twice or more: everything under it repeats;
* several distinct segments: each is trimmed to the words it shares with another to the left and
  right of the minimizer, and equal remains are added up; their suffix automaton, with occurrence
  counts weighted by how often each was seen, is built where they meet; streaming each segment through
  it gives matching statistics (longest suffix at each word that occurs twice or more), and
  spans of ``window`` words or more are removed;
* more than ``SHARD`` distinct segments (a passage copied into very many contexts): the group
  is split by its single windows, counted with partial aggregation, so no task gets a hot shard.

Automata thus reach documents by key (shuffled) and not by broadcast, whose size would grow with
the data. Documents of equal word sequence form a class; a class of two or more with at least
one window loses every word, and one member stands for it in everything else.

Defined cases: null, empty or short texts lose nothing (null: n_words 0, the digest is of the
empty text). Repeated rows repeat each other, whatever their ids. Only ``doc_id`` and ``text``
are read by :func:`repeated_spans` and :func:`substring_report`; :func:`remove_repeats` keeps all
columns. An empty table gives no rows. Words are compared by 64-bit hashes throughout. Texts of any
length are whole; ids play no part.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import words as W
from sluice.llm.base import SLICE, give_back, sized, slices, stage, text_key
from sluice.llm.bloom import Filter, filter_of

WINDOW = 35
GRAM = 8
#: distinct segments that one automaton may hold
SHARD = 4000
#: segment fingerprints (and texts) a scan task remembers, so as to send each segment's words once
SEEN = 60_000
#: segments of one task of shards
BUCKET = 5000


def _minimizers(gram_hashes: np.ndarray, span: int) -> np.ndarray:
    """For each window (its first ``span`` grams): the position of the leftmost smallest gram."""
    view = np.lib.stride_tricks.sliding_window_view(gram_hashes, span)
    return view.argmin(axis=1) + np.arange(len(view))


def _class_batches(window: int, gram: int):
    def run(batches):
        for batch in slices(batches):
            n, s1, s2, mins, times = [], [], [], [], []
            for c in W.chunks(batch.column("text")):
                g = W.grams(c.hashes, gram)
                for d in range(c.docs):
                    a, b = c.first[d], c.first[d + 1]
                    x, y = W.whole(c.hashes[a:b])
                    n.append(int(b - a))
                    s1.append(x)
                    s2.append(y)
                    mine = g[a:b - gram + 1]
                    at = np.unique(_minimizers(mine, window - gram + 1)) if b - a >= window else slice(0)
                    value, often = np.unique(mine[at], return_counts=True)
                    mins.append(value)
                    times.append(often.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("tk1"), batch.column("tk2"), pa.array(n, pa.int64()),
                 pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), W.list_column(mins), W.list_column(times)],
                names=["tk1", "tk2", "n", "s1", "s2", "mins", "times"])
    return run


def _segment_batches(window: int, gram: int, path: str, parts: int):
    """Segments of the minimizers that a Bloom filter lets through; any too many count once and drop out."""
    def run(batches):
        repeated = Filter.at(path, parts)
        seen: set[bytes] = set()
        copies: Counter = Counter()
        for batch in slices(batches):
            tk1, tk2 = batch.column("tk1").to_pylist(), batch.column("tk2").to_pylist()
            row = -1
            for c in W.chunks(batch.column("text")):
                # handed on chunk by chunk, so that a task never holds the segments of more than one
                out = defaultdict(list)
                g = W.grams(c.hashes, gram)
                for d in range(c.docs):
                    a, b = c.first[d], c.first[d + 1]
                    row += 1
                    if b - a < window:
                        continue
                    # two copies make every count 2; more of one text add nothing to it
                    if len(copies) >= SEEN:
                        copies.clear()
                    text = tk1[row] << 32 | tk2[row] & 0xFFFFFFFF
                    copies[text] += 1
                    if copies[text] > 2:
                        continue
                    mine = g[a:b - gram + 1]
                    at = _minimizers(mine, window - gram + 1)
                    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                    last = np.r_[first[1:], len(at)] - 1
                    hit = np.flatnonzero(repeated.passes(mine[at[first]]))
                    for i in hit:
                        s, e = int(first[i]), int(last[i])
                        blob = c.hashes[a + s:a + e + window].tobytes()
                        sig = hashlib.blake2b(blob, digest_size=16).digest()
                        out["m"].append(W.signed(int(mine[at[s]])))
                        out["f1"].append(int.from_bytes(sig[:8], "little", signed=True))
                        out["f2"].append(int.from_bytes(sig[8:], "little", signed=True))
                        out["tk1"].append(tk1[row])
                        out["tk2"].append(tk2[row])
                        out["start"].append(s)
                        out["size"].append(e + window - s)
                        out["at"].append(int(at[s]) - s)
                        if sig in seen:
                            out["words"].append(None)
                        else:
                            out["words"].append(blob)
                            if len(seen) >= SEEN:
                                seen.clear()
                            seen.add(sig)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[k], t) for k, t in SEGMENT], names=[k for k, _ in SEGMENT])
    return run


SEGMENT = [("m", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("tk1", pa.int64()), ("tk2", pa.int32()),
           ("start", pa.int32()), ("size", pa.int32()), ("at", pa.int32()), ("words", pa.binary())]


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences with weighted occurrence counts."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len, self.count = [-1], [0], [0]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.len.append(length)
        self.count.append(0)
        return len(self.len) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """State for the longest word sequence of p followed by w, taken out of q if need be."""
        if self.len[q] == self.len[p] + 1:
            return q
        twin = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def add(self, sequence: list[int], weight: int) -> None:
        at = 0
        for w in sequence:
            q = self.next[at].get(w)
            if q is not None:
                at = self._split(at, q, w)
            else:
                new = self._state(self.len[at] + 1, {}, 0)
                p = at
                while p >= 0 and w not in self.next[p]:
                    self.next[p][w] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, self.next[p][w], w)
                at = new
            self.count[at] += weight

    def settle(self) -> None:
        """Add up occurrence counts along suffix links; find each state's repeated suffix."""
        order = sorted(range(1, len(self.len)), key=self.len.__getitem__)
        for v in reversed(order):
            if self.link[v] > 0:
                self.count[self.link[v]] += self.count[v]
        self.repeat = [0] * len(self.len)
        for v in order:
            self.repeat[v] = v if self.count[v] >= 2 else self.repeat[self.link[v]]

    def spans(self, sequence: list[int], least: int) -> list[tuple[int, int]]:
        """Maximal spans of an added sequence, of ``least`` words or more, that occur twice."""
        found: list[tuple[int, int]] = []
        at = 0
        for i, w in enumerate(sequence, 1):
            at = self.next[at][w]
            r = self.repeat[at]
            size = i if r == at else self.len[r]
            if size >= least:
                a = i - size
                while found and found[-1][1] >= a:
                    a = min(a, found.pop()[0])
                found.append((a, i))
        return found


def _common(rows: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For each row of words (its group first, cut at ``stop`` words): the longest beginning,
    group excluded, that it shares with another row of its group. Sorting puts the row that
    shares most next to it."""
    n, width = rows.shape
    order = np.argsort(np.ascontiguousarray(rows).view(f"V{8 * width}").ravel(), kind="stable")
    line = rows[order]
    differ = np.ones((n - 1, width + 1), dtype=bool)
    differ[:, :width] = line[1:] != line[:-1]
    same = differ.argmax(axis=1) - 1
    best = np.full(n, -1)
    best[:-1] = same
    best[1:] = np.maximum(best[1:], same)
    out = np.empty(n, dtype=np.int64)
    out[order] = best
    return np.minimum(out, stop)


def _trim(m: np.ndarray, blobs: list, at: np.ndarray, seen: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of each segment, as ``[a, b)``, outside which it cannot repeat: to the left and right
    of its minimizer it must agree with some other segment of the minimizer."""
    size = np.array([len(b) // 8 for b in blobs])
    left, right = at, size - at - gram
    owner = m.view(np.uint64)
    sides = []
    for length, cut in ((left, lambda w, i: w[:i][::-1]), (right, lambda w, i: w[i + gram:])):
        table = np.zeros((len(m), 1 + int(length.max(initial=0)) + 1), dtype=np.uint64)
        table[:, 0] = owner
        for k, (blob, i) in enumerate(zip(blobs, at)):
            words = cut(np.frombuffer(blob, dtype=np.uint64), i)
            table[k, 1:1 + len(words)] = words
        # words after the end are zeros that may match zeros: the cut at the length undoes that
        sides.append(np.where(seen > 1, length, np.maximum(_common(table, length), -1)))
    near = (sides[0] >= 0) & (sides[1] >= 0)
    return np.where(near, at - sides[0], 0), np.where(near, at + gram + sides[1], 0)


def _shards(least: int, gram: int):
    """Matching statistics of all segments of some minimizers, one automaton for each."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf["m"].to_numpy()
        blobs, seen = pdf["words"].tolist(), pdf["seen"].to_numpy()
        a, b = _trim(m, blobs, pdf["at"].to_numpy().astype(np.int64), seen, gram)
        groups: dict[int, dict[bytes, int]] = defaultdict(lambda: defaultdict(int))
        cut: list[bytes | None] = []
        for k in range(len(m)):
            blob = blobs[k][8 * a[k]:8 * b[k]] if b[k] - a[k] >= least else None
            cut.append(blob)
            if blob is not None:
                groups[m[k]][blob] += int(seen[k])
        found: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
        for key, weights in groups.items():
            if len(weights) == 1:
                (blob, weight), = weights.items()
                found[key, blob] = [(0, len(blob) // 8)] if weight > 1 else []
                continue
            auto = SuffixAutomaton()
            sequences = {blob: np.frombuffer(blob, dtype=np.uint64).tolist() for blob in weights}
            for blob, weight in weights.items():
                auto.add(sequences[blob], weight)
            auto.settle()
            for blob, sequence in sequences.items():
                found[key, blob] = auto.spans(sequence, least)
        rows = [(m[k], f1, f2, int(a[k]) + x, int(a[k]) + y)
                for k, (f1, f2) in enumerate(zip(pdf["f1"], pdf["f2"])) if cut[k] is not None
                for x, y in found[m[k], cut[k]]]
        return pd.DataFrame(rows, columns=["m", "f1", "f2", "a", "b"])

    def freed(pdf: pd.DataFrame) -> pd.DataFrame:
        spans = run(pdf)
        give_back()
        return spans
    return freed


def _window_batches(window: int):
    """Single windows of the segments of oversized groups."""
    def run(frames):
        for pdf in frames:
            rows = [(m, f1, f2, j, int.from_bytes(h[:8], "little", signed=True),
                     int.from_bytes(h[8:], "little", signed=True), seen)
                    for m, f1, f2, words, seen in zip(pdf["m"], pdf["f1"], pdf["f2"], pdf["words"], pdf["seen"])
                    for j in range(len(words) // 8 - window + 1)
                    for h in (hashlib.blake2b(words[8 * j:8 * (j + window)], digest_size=16).digest(),)]
            yield pd.DataFrame(rows, columns=["m", "f1", "f2", "j", "w1", "w2", "seen"])
        give_back()
    return run


def repeated_spans(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """``tk1, tk2, spans``: for each text that loses words, its spans ``[a, b)`` in words.

    ``tk1, tk2`` is :func:`sluice.llm.base.text_key`; texts without repeats have no row. Texts are read twice
    where they lie and never shuffled: a Bloom filter tells the second reading which minimizers repeat."""
    docs = documents.select("text", *text_key())
    base = stage(docs.mapInArrow(_class_batches(window, gram),
                                 "tk1 long, tk2 int, n long, s1 long, s2 long, mins array<long>, times array<long>")
                 .where(F.col("n") >= window).withColumn("node", F.monotonically_increasing_id()), "sequences")
    classes = stage(base.groupBy("s1", "s2", "n").agg(F.min("node").alias("node"), F.count("*").alias("c")), "classes")
    many = classes.where("c > 1").select("s1", "s2", "n", F.col("node").alias("first"))
    spare = stage(base.select("s1", "s2", "n", "node").join(many, ["s1", "s2", "n"]).where("node <> first")
                  .select("node"), "spare")
    posts = (base.select("node", "mins", "times").join(sized(spare), "node", "left_anti")
             .select(F.explode(F.arrays_zip("mins", "times")).alias("z")).select("z.mins", "z.times"))
    twice = stage(posts.groupBy(F.col("mins").alias("m")).agg(F.sum("times").alias("c")).where("c > 1").select("m"), "twice")

    # segments of the repeated minimizers, from the texts where they are
    path, parts = filter_of(twice, "minimizers")
    segments = stage(docs.mapInArrow(
        _segment_batches(window, gram, path, parts),
        "m long, f1 long, f2 long, tk1 long, tk2 int, start int, size int, at int, words binary"), "segments")
    distinct = segments.groupBy("m", "f1", "f2").agg(F.count("*").alias("seen"), F.max("size").alias("size"))
    distinct = stage(distinct, "distinct")
    groups = stage(distinct.groupBy("m").agg(F.count("*").alias("kinds"), F.sum("seen").alias("total"))
                   .where("total > 1"), "groups")

    lone = (distinct.join(groups.where("kinds = 1").select("m"), "m")
            .select("m", "f1", "f2", F.lit(0).alias("a"), F.col("size").alias("b")))
    texts_of = (segments.where("words is not null").groupBy("m", "f1", "f2")
                .agg(F.first("words").alias("words"), F.max("at").alias("at")))
    mixed = (texts_of.join(groups.where("kinds > 1").select("m", "kinds"), "m")
             .join(distinct.select("m", "f1", "f2", "seen"), ["m", "f1", "f2"]))
    mixed = stage(mixed, "mixed")
    tame = mixed.where(F.col("kinds") <= shard)
    buckets = max(1, -(-tame.count() // BUCKET))
    shards = (tame.withColumn("bucket", F.pmod(F.xxhash64("m"), F.lit(buckets))).groupBy("bucket")
              .applyInPandas(_shards(window, gram), "m long, f1 long, f2 long, a int, b int"))
    singles = stage(mixed.where(F.col("kinds") > shard).select("m", "f1", "f2", "words", "seen").mapInPandas(
        _window_batches(window), "m long, f1 long, f2 long, j int, w1 long, w2 long, seen long"), "windows")
    twice = (singles.groupBy("m", "w1", "w2").agg(F.sum("seen").alias("c")).where("c > 1").select("m", "w1", "w2"))
    hot = (singles.join(twice, ["m", "w1", "w2"])
           .select("m", "f1", "f2", F.col("j").alias("a"), (F.col("j") + window).alias("b")))
    found = stage(lone.unionByName(shards).unionByName(hot), "found")

    spans = (segments.select("m", "f1", "f2", "tk1", "tk2", "start").join(found, ["m", "f1", "f2"])
             .groupBy("tk1", "tk2").agg(F.collect_set(F.struct((F.col("start") + F.col("a")).alias("a"),
                                                               (F.col("start") + F.col("b")).alias("b"))).alias("spans")))
    copied = (base.select("tk1", "tk2", "s1", "s2", "n").join(sized(stage(many, "copied")), ["s1", "s2", "n"])
              .select("tk1", "tk2", F.array(F.struct(F.lit(0).alias("a"), F.col("n").cast("int").alias("b"))).alias("all")).distinct())
    return (spans.join(copied, ["tk1", "tk2"], "full").select("tk1", "tk2", F.coalesce("all", "spans").alias("spans"))
            .mapInArrow(_merge_batches, "tk1 long, tk2 int, spans array<struct<a: int, b: int>>"))


def _merge_batches(batches):
    """Overlapping and touching spans of a text as one: the segments of neighbouring minimizers overlap."""
    for batch in slices(batches):
        out = []
        for spans in batch.column("spans").to_pylist():
            merged: list[dict] = []
            for s in sorted(spans, key=lambda s: s["a"]):
                if merged and s["a"] <= merged[-1]["b"]:
                    merged[-1]["b"] = max(merged[-1]["b"], s["b"])
                else:
                    merged.append(dict(s))
            out.append(merged)
        yield pa.RecordBatch.from_arrays(
            [batch.column("tk1"), batch.column("tk2"), pa.array(out, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))],
            names=["tk1", "tk2", "spans"])


def _kept(text: str | None, spans) -> tuple[int, int, bytes]:
    """Words, words removed, and the kept words joined by one space."""
    words = (text or "").encode().split()
    if spans is None or len(spans) == 0:
        return len(words), 0, b" ".join(words)
    keep = np.ones(len(words), dtype=bool)
    for s in spans:
        keep[s["a"]:s["b"]] = False
    left = int(keep.sum())
    return len(words), len(words) - left, b" ".join([words[i] for i in np.flatnonzero(keep)])


def _report_batches(batches):
    for whole in slices(batches):
        # a few texts at a time: their words are objects here
        for at in range(0, max(whole.num_rows, 1), 500):
            batch = whole.slice(at, 500)
            got = [_kept(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([g[0] for g in got], pa.int64()),
                 pa.array([g[1] for g in got], pa.int64()),
                 pa.array([hashlib.sha256(g[2]).hexdigest() for g in got], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _kept_text(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for text, spans in texts:
        parts = []
        for a in range(0, len(text), SLICE):
            # texts stay in their buffer, a slice of them at a time is cut
            both = zip(text.slice(a, SLICE).to_pylist(), spans.slice(a, SLICE).to_pylist())
            parts.append(pa.array([t if s is None else _kept(t, s)[2].decode() for t, s in both], pa.string()))
        yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())
    give_back()


def _with_spans(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """``documents`` with a ``spans`` column, null where nothing is removed."""
    spans = stage(spans, "spans").withColumnsRenamed({"tk1": "_k1", "tk2": "_k2", "spans": "_spans"})
    size = spans.agg(F.count("*") + F.coalesce(F.sum(F.size("_spans")), F.lit(0))).first()[0]
    k1, k2 = text_key()
    return documents.join(F.broadcast(spans) if size <= 2_000_000 else spans,
                          (k1 == F.col("_k1")) & (k2 == F.col("_k2")), "left").drop("_k1", "_k2")


def substring_report(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    docs = documents.select("doc_id", "text")
    return (_with_spans(docs, repeated_spans(docs, window)).select("doc_id", "text", F.col("_spans").alias("spans"))
            .mapInArrow(_report_batches, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string"))


def remove_repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """``documents`` with the repeated spans cut out of ``text``: the words that stay are joined
    by one space; a text that loses nothing stays as it is. Every row is kept."""
    rows = documents.select("doc_id", "text", F.struct(*documents.columns).alias("row"))
    both = _with_spans(rows, repeated_spans(documents, window))
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(
        F.arrow_udf(_kept_text, "string")("text", "_spans"))
    return both.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in documents.columns])
