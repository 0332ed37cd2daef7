"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Fit. A bounded sample of labelled rows outside the held-out fold (``EXAMPLES`` per class, the
smallest hashes of doc_id) gives the examples. Terms are lower-case words between ASCII
separators and the first 4, 6 and 8 bytes of longer words, each also as "twice", "three times" and
"five times or more". Every term of the examples, of either class and however rare, is a dimension
of the vector space; none is dropped. A dimension counts by its idf, taken from the document
frequencies of the whole corpus, times ``FLOOR`` plus the size of its standardised log-odds between the
classes, so words that tell the classes apart, toxic or clean, weigh more. A third of the sample
is kept out of all this to calibrate the votes. Vectors have unit length over these dimensions
(terms of no example would scale all cosines of a document alike). The examples' vectors form an
inverted index: frequent terms as a dense matrix, the others as postings cut into blocks of
``LANES`` examples with the largest weight of each term per block. The number of examples is a
parameter; the index holds their postings and nothing of the corpus. One task builds it from the staged
sample and writes it to the shared folder, where each worker loads it once.

Search. Per batch of documents the frequent terms' exact part and the block maxima of the others
give an upper bound for every block; a block is scored (exactly, in double precision) only for
documents whose bound reaches their current k-th cosine. The k nearest vote with their cosines,
each class weighted by how thinly it was sampled; a monotone curve fitted to the votes of the
examples kept out turns the vote into a probability, and the neighbours are returned as evidence.

Defined cases: null text counts as empty. A text with none of the terms has no neighbours; its
score is the weighted share of toxic examples among those without terms (0 if there are none).
Equal cosines (to 12 digits) prefer the example with the smaller doc_id. Null labels and ids do
not train; without examples of both classes, or without a term in them, the score
is the labels' toxic share (0 without labels). Repeated rows are scored alike, an empty table gives no rows; of several texts of one labelled
id the smallest trains. Texts of any length are whole. Only ``doc_id`` and ``text`` are read, so other columns may
have any name. ``evidence.cosine`` is the cosine over the examples' terms: words of no example are not part of its
norms, which lifts all cosines of a document by one factor and leaves their order and the votes as they are.
"""

from __future__ import annotations

import pickle
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import words as W
from sluice.llm.base import stage
from sluice.llm.quality import in_fold
from sluice.session import qualified, scratch_path

EXAMPLES = 1500
LANES = 64
NEIGHBOURS = 15
STEMS = (4, 6, 8)
#: a term met so often in a text counts as another term as well
LEVELS = (2, 3, 5)
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.5
#: weight of a term that says nothing about the classes, beside the size of its log-odds in standard errors
FLOOR = 0.1
#: terms of at least this share of the examples are held dense
FREQUENT = 0.06
#: blocks of a document that are scored before its bounds are tested
AHEAD = 4
#: block maxima that are looked at together
ENTRIES = 1 << 19

#: bytes between words: ASCII other than letters and digits
_BETWEEN = np.zeros(256, dtype=bool)
_BETWEEN[:128] = True
_BETWEEN[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = False


def _occurring(col: pa.Array):
    """``(documents, document, hash)`` of every term occurrence in consecutive texts."""
    for c in W.chunks(col, lower=True, between=_BETWEEN, stems=STEMS):
        at = np.searchsorted(c.first, np.arange(len(c.hashes)), side="right") - 1
        doc = np.concatenate([at, *[at[h != 0] for h in c.stems]])
        yield c.docs, doc, np.concatenate([c.hashes, *[h[h != 0] for h in c.stems]])


def _term_batches(batches):
    """Distinct term hashes of each text and how often they occur."""
    for batch in batches:
        terms, often = [], []
        for docs, doc, h in _occurring(batch.column("text")):
            order = np.argsort(doc, kind="stable")
            split = np.searchsorted(doc[order], np.arange(1, docs))
            for part in np.split(h[order], split):
                t, n = np.unique(part, return_counts=True)
                terms.append(t)
                often.append(n)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("toxic"), batch.column("aside"), W.list_column(terms),
             W.list_column([n.astype(np.int64) for n in often])], names=["doc_id", "toxic", "aside", "terms", "often"])


def _expand(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges ``[begin, end)``, and the range each comes from."""
    n = end - begin
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) + np.repeat(begin - (np.cumsum(n) - n), n), of


class Vocabulary:
    """Numbers of the (term, level) entries that some example has."""

    def __init__(self, terms: np.ndarray, often: np.ndarray) -> None:
        self.known = np.unique(terms)
        self.entry = np.full((len(self.known), 1 + len(LEVELS)), -1, np.int32)
        pos = np.searchsorted(self.known, terms)
        for j, k in enumerate((1, *LEVELS)):
            self.entry[pos[often >= k], j] = 0
        met = self.entry == 0
        self.size = int(met.sum())
        self.entry[met] = np.arange(self.size)

    def entries(self, doc: np.ndarray, term: np.ndarray, often: np.ndarray, docs: int):
        """``(first, entries, tf)`` of the documents; ``term`` numbers ``known``. Higher levels have tf 1."""
        at, e, tf = [], [], []
        for j, k in enumerate((1, *LEVELS)):
            got = self.entry[term, j]
            hit = np.flatnonzero((often >= k) & (got >= 0))
            at.append(doc[hit])
            e.append(got[hit])
            tf.append(often[hit] if k == 1 else np.ones(len(hit), np.int64))
        at = np.concatenate(at)
        order = np.argsort(at, kind="stable")
        return (np.searchsorted(at[order], np.arange(docs + 1)), np.concatenate(e)[order].astype(np.int64),
                np.concatenate(tf)[order])

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are known, and their numbers."""
        pos = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        hit = np.flatnonzero(self.known[pos] == h)
        return hit, pos[hit]

    def texts(self, col: pa.Array):
        """:meth:`entries` of consecutive texts of a column."""
        for docs, doc, h in _occurring(col):
            hit, term = self.find(h)
            keys, often = np.unique(doc[hit] * len(self.known) + term, return_counts=True)
            yield self.entries(keys // len(self.known), keys % len(self.known), often, docs)


def _df_batches(vocabulary_at: str):
    """One row a task: documents of its rows, and document frequencies of the entries met."""
    def run(batches):
        vocabulary = _load(vocabulary_at)
        df, docs = np.zeros(vocabulary.size, np.int64), 0
        for batch in batches:
            docs += batch.num_rows
            for _, e, _ in vocabulary.texts(batch.column("text")):
                df += np.bincount(e, minlength=vocabulary.size)
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), W.list_column([met]), W.list_column([df[met]])],
                                         names=["docs", "terms", "df"])
    return run


class Vectors:
    """Sparse rows: row ``i`` has ``value[first[i]:first[i + 1]]`` at ``term[...]``."""

    def __init__(self, first: np.ndarray, term: np.ndarray, value: np.ndarray, width: int) -> None:
        self.first, self.term, self.value, self.width = first, term, value, width
        self.row = np.repeat(np.arange(len(first) - 1), np.diff(first))

    def __len__(self) -> int:
        return len(self.first) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        out = np.zeros(self.width)
        out[self.term[self.first[i]:self.first[i + 1]]] = self.value[self.first[i]:self.first[i + 1]]
        return out

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * x[self.term], len(self))

    def take(self, rows: np.ndarray) -> Vectors:
        at, _ = _expand(self.first[rows], self.first[rows + 1])
        first = np.concatenate([[0], np.cumsum(self.first[rows + 1] - self.first[rows])])
        return Vectors(first, self.term[at], self.value[at], self.width)


class BlockMaxIndex:
    """Example vectors in blocks, with per-block largest weights of every term."""

    def __init__(self, worth: np.ndarray, ids: list, toxic: np.ndarray, terms: list, tf: list, weight: np.ndarray,
                 neighbours: int = NEIGHBOURS, lanes: int = LANES) -> None:
        self.worth, self.k, self.lanes = worth, neighbours, lanes
        vectors = self.vectors(terms, tf)
        # similar examples share blocks: order by heaviest term, then id
        heavy = np.zeros(len(ids), np.int64)
        rising = np.lexsort((-vectors.term, vectors.value, vectors.row))
        heavy[vectors.row[rising]] = vectors.term[rising]
        order = np.lexsort((np.arange(len(ids)), heavy))
        self.ids = np.array([ids[i] for i in order], dtype=np.int64)
        self.toxic, self.weight = toxic[order].astype(float), weight[order]
        self.rows = vectors.take(order)
        self.blocks = -(-len(ids) // lanes)
        self._post()
        self.blank = 0.0
        self.knots: tuple[np.ndarray, np.ndarray] | None = None

    def _post(self) -> None:
        """Frequent terms as a dense matrix, the others as postings in segments of a term and block."""
        rows, width = self.rows, len(self.worth)
        df = np.bincount(rows.term, minlength=width)
        often = np.flatnonzero(df >= max(1, FREQUENT * len(rows)))
        self.place = np.full(width, -1, np.int32)
        self.place[often] = np.arange(len(often))
        at = self.place[rows.term]
        self.dense = np.zeros((self.blocks * self.lanes, len(often)))
        self.dense[rows.row[at >= 0], at[at >= 0]] = rows.value[at >= 0]
        term, row, value = rows.term[at < 0], rows.row[at < 0], rows.value[at < 0]
        order = np.lexsort((row, term))
        term, self.post_row, self.post = term[order], row[order].astype(np.int16 if len(rows) < 1 << 15 else np.int32), value[order]
        block = self.post_row // self.lanes
        new = np.ones(len(term), dtype=bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        begin = np.flatnonzero(new)
        self.cut = np.append(begin, len(term)).astype(np.int32)
        self.block = block[begin].astype(np.int32)
        self.top = np.maximum.reduceat(self.post, begin) if len(begin) else np.zeros(0)
        self.first = np.searchsorted(term[begin], np.arange(width + 1)).astype(np.int32)

    def vectors(self, terms: list, tf: list) -> Vectors:
        """Unit vectors of (1 + log tf) * worth; no entries where a text has none of the terms."""
        first = np.concatenate([[0], np.cumsum([len(t) for t in terms], dtype=np.int64)]).astype(np.int64)
        flat = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)
        return self.unit(first, flat(terms), flat(tf))

    def unit(self, first: np.ndarray, term: np.ndarray, tf: np.ndarray) -> Vectors:
        out = Vectors(first, term, (1 + np.log(tf)) * self.worth[term], len(self.worth))
        out.value = out.value / np.sqrt(np.bincount(out.row, out.value * out.value, len(out)))[out.row]
        return out

    def nearest(self, q: Vectors) -> tuple[np.ndarray, np.ndarray]:
        """Example numbers (-1: none) and cosines of the k nearest rows of the index."""
        who, best = np.full((len(q), self.k), -1, dtype=np.int64), np.zeros((len(q), self.k))
        if not self.blocks:
            return who, best
        load = np.append(0, np.cumsum(self.first[q.term + 1] - self.first[q.term]))[q.first]
        load += np.arange(len(q) + 1) * len(self.dense)
        a = 0
        while a < len(q):
            b = max(a + 1, int(np.searchsorted(load, load[a] + ENTRIES, side="right")) - 1)
            self._search(q.take(np.arange(a, b)), who[a:b], best[a:b])
            a = b
        return who, best

    def _search(self, q: Vectors, who: np.ndarray, best: np.ndarray) -> None:
        n, blocks, width = len(q), self.blocks, len(self.dense)
        at = self.place[q.term]
        often, rest = at >= 0, at < 0
        front = np.zeros((n, self.dense.shape[1]))
        front[q.row[often], at[often]] = q.value[often]
        sims = front @ self.dense.T
        segment, of = _expand(self.first[q.term[rest]], self.first[q.term[rest] + 1])
        row, value = q.row[rest][of], q.value[rest][of]
        cell = row * blocks + self.block[segment]
        bounds = (sims.reshape(n, blocks, self.lanes).max(axis=2)
                  + np.bincount(cell, value * self.top[segment], n * blocks).reshape(n, blocks))
        k = min(self.k, width)
        # the few most promising blocks first, then all others whose bound reaches the k-th cosine
        ahead = bounds >= np.partition(bounds, -min(AHEAD, blocks), axis=1)[:, -min(AHEAD, blocks), None]
        done, least = np.zeros((n, blocks), dtype=bool), np.zeros(n)
        for turn in (ahead, ~ahead):
            live = turn & (bounds > 0) & (bounds + 1e-9 >= least[:, None])
            part = np.flatnonzero(live.ravel()[cell])
            post, of = _expand(self.cut[segment[part]], self.cut[segment[part] + 1])
            part = part[of]
            sims += np.bincount(row[part] * width + self.post_row[post], value[part] * self.post[post],
                                n * width).reshape(n, width)
            done |= live
            shown = np.where(done[:, :, None], sims.reshape(n, blocks, self.lanes), 0.0).reshape(n, width)
            least = np.partition(shown, width - k, axis=1)[:, width - k]
        doc, example = np.nonzero((shown > 0) & (shown + 1e-9 >= least[:, None]))
        cosine = np.round(shown[doc, example], 12)
        order = np.lexsort((self.ids[example], -cosine, doc))
        order = order[cosine[order] > 0]
        doc, example, cosine = doc[order], example[order], cosine[order]
        place = np.arange(len(doc)) - np.searchsorted(doc, doc)
        near = place < self.k
        who[doc[near], place[near]], best[doc[near], place[near]] = example[near], cosine[near]

    def votes(self, who: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        """Cosine-weighted share of toxic neighbours; NaN without neighbours."""
        w = np.where(who >= 0, cosine * self.weight[who], 0.0)
        total = w.sum(axis=1)
        return np.divide((w * self.toxic[who]).sum(axis=1), total, out=np.full(len(who), np.nan), where=total > 0)

    def calibrate(self, q: Vectors, toxic: np.ndarray, w: np.ndarray) -> None:
        """Monotone fit (pool adjacent violators) of toxicity to the votes of other examples."""
        v = self.votes(*self.nearest(q))
        none = np.isnan(v)
        if none.any():
            self.blank = float((w[none] * toxic[none]).sum() / w[none].sum())
        order = np.flatnonzero(~none)[np.argsort(v[~none], kind="stable")]
        pools: list[list[float]] = []
        for i in order:
            pools.append([v[i] * w[i], toxic[i] * w[i], w[i]])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                x = pools.pop()
                pools[-1] = [p + q for p, q in zip(pools[-1], x)]
        if pools:
            self.knots = (np.array([p[0] / p[2] for p in pools]),
                          np.array([(p[1] + 0.5 * w.mean() * 0.01) / (p[2] + w.mean() * 0.01) for p in pools]))

    def score(self, votes: np.ndarray) -> np.ndarray:
        curve = np.interp(np.nan_to_num(votes), *self.knots) if self.knots else np.nan_to_num(votes)
        return np.clip(np.where(np.isnan(votes), self.blank, curve), 0.0, 1.0)


def _in_one_task(spark, work, name: str) -> tuple[str, int, int, int]:
    """A file in the shared folder that holds what ``work()`` makes in one task, and three numbers about it: the
    sample is bounded, and neither it nor the index passes through the driver or the JVM. The file gets its name
    when it is complete, so a second attempt does no harm."""
    path = qualified(spark, scratch_path(spark, f"llm-{name}"))

    def run(batches):
        from sluice.sinks.chunked import _fs_for
        for batch in batches:
            if batch.num_rows:
                made, *numbers = work()
                fs, place = _fs_for(path)
                fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
                part = f"{place}.{uuid.uuid4().hex}.tmp"
                with fs.open_output_stream(part) as out:
                    pickle.dump(made, out, protocol=5)
                fs.move(part, place)
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()) for n in numbers], names=["a", "b", "c"])
    return path, *spark.range(0, 1, 1, 1).mapInArrow(run, "a long, b long, c long").first()


def _table(path: str, columns: list[str] | None = None) -> pa.Table:
    import pyarrow.parquet as pq
    from sluice.sinks.chunked import _fs_for
    fs, root = _fs_for(path)
    return pq.read_table(root, columns=columns, filesystem=fs)


_kept: dict[str, object] = {}


def _load(path: str):
    """What a task made at ``path``, unpickled once a worker."""
    if path not in _kept:
        _kept.clear()
        from sluice.sinks.chunked import _fs_for
        fs, place = _fs_for(path)
        with fs.open_input_file(place) as fh:
            _kept[path] = pickle.loads(fh.read_buffer())
    return _kept[path]


def _sample(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The staged sample by doc_id and class: ids, classes, kept aside; and document, term, count of its terms."""
    rows = _table(path).sort_by([("doc_id", "ascending"), ("toxic", "ascending")]).combine_chunks()
    doc_id, toxic, aside = (rows.column(c).to_numpy() for c in ("doc_id", "toxic", "aside"))
    lists = rows.column("terms").combine_chunks()
    term = lists.flatten().to_numpy().view(np.uint64)
    often = rows.column("often").combine_chunks().flatten().to_numpy()
    doc = np.repeat(np.arange(len(doc_id)), lists.value_lengths().to_numpy().astype(np.int64))
    return doc_id, toxic, aside.astype(bool), doc, term, often


def _make_vocabulary(sample: str):
    def work():
        _, toxic, aside, doc, term, often = _sample(sample)
        inside = ~aside[doc]
        vocabulary = Vocabulary(term[inside], often[inside])
        return vocabulary, vocabulary.size, int(((toxic == 1) & ~aside).sum()), int(((toxic == 0) & ~aside).sum())
    return work


def _make_index(sample: str, vocabulary_at: str, frequencies: str, total: int, share: dict[int, float], neighbours: int):
    def work():
        vocabulary = _load(vocabulary_at)
        doc_id, toxic, aside, doc, term, often = _sample(sample)
        hit, pos = vocabulary.find(term)
        first, entry, tf = vocabulary.entries(doc[hit], pos, often[hit], len(doc_id))
        found = _table(frequencies)
        df = np.zeros(vocabulary.size)
        df[found.column("term").to_numpy()] = found.column("df").to_numpy()
        every = Vectors(first, entry, tf, vocabulary.size)
        inside, kept = (every.take(np.flatnonzero(x)) for x in (~aside, aside))
        del every, first, entry, tf, doc, term, often, hit, pos
        worth = (np.log((1 + total) / (1 + df)) + 1) * (FLOOR + class_marks(inside, toxic[~aside]))
        weigh = lambda t: np.where(t == 1, share[1], share[0])
        lists = lambda v, x: np.split(x, v.first[1:-1])
        index = BlockMaxIndex(worth, doc_id[~aside].tolist(), toxic[~aside], lists(inside, inside.term),
                              lists(inside, inside.value), weigh(toxic[~aside]), neighbours)
        if len(kept):
            index.calibrate(index.unit(kept.first, kept.term, kept.value), toxic[aside], weigh(toxic[aside]))
        index.rows = None       # the postings say it all
        return (vocabulary, index), vocabulary.size, 0, 0
    return work


def fit(documents: DataFrame, labels: DataFrame, examples: int = EXAMPLES, neighbours: int = NEIGHBOURS):
    """``(path, toxic share)``: where the fitted ``(vocabulary, index)`` lies in the shared folder, None without
    examples of both classes or without a term in them.

    Of several texts of a labelled id the smallest (by code points) is its example, null only if all are."""
    spark = documents.sparkSession
    known = (labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
             .where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()
                    & ~in_fold(F.col("doc_id"), FOLDS, HELD_OUT)).distinct())
    mark = F.xxhash64("doc_id", F.lit(7))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    known = known.withColumn("aside", F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(3)) == 0)
    picks = [known.where(F.col("toxic") == c).orderBy(mark, "doc_id").limit(examples) for c in (0, 1)]
    picked = stage(picks[0].unionByName(picks[1]), "examples")
    sample = (documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic", "aside")
              .agg(F.min("text").alias("text")))
    sample_at = scratch_path(spark, "llm-example-terms")
    sample.mapInArrow(_term_batches, f"doc_id {_kind(documents)}, toxic int, aside boolean, terms array<long>, often array<long>").write.parquet(sample_at)
    vocabulary_at, words, toxic, clean = _in_one_task(spark, _make_vocabulary(sample_at), "vocabulary")
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    if not (words and toxic and clean):
        return None, share
    counted = stage(documents.select("text").mapInArrow(_df_batches(vocabulary_at), "docs long, terms array<long>, df array<long>"),
                    "frequencies")
    rows = counted.agg(F.sum("docs")).first()[0] or 0
    found = scratch_path(spark, "llm-entry-frequencies")
    (counted.select(F.explode(F.arrays_zip("terms", "df")).alias("z")).groupBy(F.col("z.terms").alias("term"))
     .agg(F.sum("z.df").alias("df")).write.parquet(found))
    stands_for = {0: counts[0] / clean, 1: counts[1] / toxic}
    return _in_one_task(spark, _make_index(sample_at, vocabulary_at, found, rows, stands_for, neighbours), "index")[0], share


def class_marks(rows: Vectors, toxic: np.ndarray) -> np.ndarray:
    """Size of each term's log-odds between the classes, in standard errors."""
    n1, n0 = float((toxic == 1).sum()), float((toxic == 0).sum())
    a = np.bincount(rows.term[toxic[rows.row] == 1], minlength=rows.width) + 0.5
    b = np.bincount(rows.term[toxic[rows.row] == 0], minlength=rows.width) + 0.5
    odds = np.log(a / (n1 + 1 - a)) - np.log(b / (n0 + 1 - b))
    return np.abs(odds) / np.sqrt(1 / a + 1 / (n1 + 1 - a) + 1 / b + 1 / (n0 + 1 - b))


def score_toxicity(documents: DataFrame, labels: DataFrame, examples: int = EXAMPLES,
                   neighbours: int = NEIGHBOURS) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence`` for every row; evidence lists the
    neighbours as ``struct<doc_id, toxic, cosine>``, nearest first."""
    kind = _kind(documents)
    held = in_fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out")
    evidence = f"array<struct<doc_id: {kind}, toxic: int, cosine: double>>"
    path, share = fit(documents, labels, examples, neighbours)
    if path is None:
        return documents.select("doc_id", held, F.lit(float(share)).alias("score"),
                                F.lit(int(share >= THRESHOLD)).alias("predicted"),
                                F.array().cast(evidence).alias("evidence"))

    def run(batches):
        vocabulary, index = _load(path)
        for batch in batches:
            at = 0
            for first, entry, tf in vocabulary.texts(batch.column("text")):
                who, cosine = index.nearest(index.unit(first, entry, tf))
                told = [[{"doc_id": int(index.ids[w]), "toxic": int(index.toxic[w]), "cosine": float(c)}
                         for w, c in zip(ws, cs) if w >= 0] for ws, cs in zip(who, cosine)]
                ids = batch.column("doc_id").slice(at, len(who))
                at += len(who)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(index.score(index.votes(who, cosine))),
                     pa.array(told, pa.list_(pa.struct([("doc_id", ids.type), ("toxic", pa.int32()),
                                                        ("cosine", pa.float64())])))],
                    names=["doc_id", "score", "evidence"])
    return (documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, evidence {evidence}")
            .select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence"))


def _kind(documents: DataFrame) -> str:
    return documents.schema["doc_id"].dataType.simpleString()
