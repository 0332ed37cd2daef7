"""Phrase collocations by mergeable Misra-Gries summaries and an exact second pass.

Texts are lower-cased (A-Z) and cut into pieces at ``[.,;:!?]`` and line breaks, pieces into words at spaces
and tabs. Runs of one to three words inside a piece are counted per language.

First pass: every task counts the runs of its documents by a 64-bit hash. The hash space is cut into
partitions of about ``PART_CHARS`` characters of text; a task's counts for one partition travel as one row.
Where they meet they merge into a Misra-Gries summary whose capacity exceeds the partition's mass divided
by the threshold: each reduction takes the (capacity + 1)-th largest count off all counters, so all
reductions together take less than the threshold off any, and every run at or above it survives (a hash
collision only adds survivors); counters that the error cannot lift to the threshold are let go. Survivors are written as one Bloom filter segment a partition,
of bounded size in all (:mod:`sluice.llm.bloom`); past that bound the filter lets more through and loses nothing.

Second pass: words become dictionary numbers chunk by chunk (compared by their bytes), runs that the
filter lets through are counted by these numbers, and the counts meet by language and text: exact.

Defined cases: null texts are empty; null languages are ``und`` and join that language. Empty tables,
texts without words and languages without a frequent run give no rows. Repeated rows and ids count
each time. Only ``text`` and ``lang`` are read. A document longer than a chunk is a chunk of its own.
Ties of score and count are ordered by the phrase's bytes; equal cuts prefer the shorter first part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm import bloom
from sluice.llm.base import sized, stage
from sluice.llm.words import mix, string_buffers
from sluice.session import scratch_path

THRESHOLD = 10
LONGEST = 3
TOP = 2000
#: parts in which a language's candidates are ranked before the last ranking, of TOP rows a part at most
SALTS = 128
#: text characters for which one more hash partition is dealt (about 2 million runs)
PART_CHARS = 4_000_000
#: bytes of whole documents that are counted at a time, and counters a task holds before it hands them on
CHUNK = 1 << 20
HELD = 700_000
#: rows handed to the JVM at a time
HANDED = 1 << 16
_PLACE = np.random.default_rng(11).integers(1, 2 ** 63, 5, dtype=np.uint64) | np.uint64(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0 inside a word, 1 between words, 2 between pieces
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


@dataclass
class Runs:
    """Distinct runs of ``n`` words of a chunk: word numbers, language numbers, counts."""

    n: int
    words: list[np.ndarray]
    lang: np.ndarray
    counts: np.ndarray


@dataclass
class Counted:
    vocabulary: pa.Array
    langs: pa.Array
    runs: list[Runs]

    def hashes(self) -> list[np.ndarray]:
        """A 64-bit hash of every run, language and length included."""
        word = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.vocabulary.to_pylist()), np.uint64, len(self.vocabulary))
        lang = np.fromiter((xxhash.xxh64_intdigest(x, seed=1) for x in self.langs.to_pylist()), np.uint64, len(self.langs))
        out = []
        for r in self.runs:
            h = lang[r.lang] * _PLACE[4] + np.uint64(r.n) * _PLACE[3]
            for j, w in enumerate(r.words):
                h = h + word[w] * _PLACE[j]
            out.append(mix(h))
        return out


def count_runs(batch: pa.RecordBatch, longest: int = LONGEST) -> Iterator[Counted]:
    """Counts of all runs of ``batch(lang, text)``, chunk by chunk of whole documents."""
    langs = batch.column("lang").fill_null("und").dictionary_encode()
    lang_of_doc = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    end = np.cumsum(size, dtype=np.int64)
    d, n = 0, len(end)
    while d < n:
        e = max(d + 1, int(np.searchsorted(end, end[d] - size[d] + CHUNK, side="right")))
        # only the chunk's own texts are copied
        raw, off = string_buffers(batch.column("text").slice(d, e - d))
        found = _count_chunk(raw[off[0]:off[-1]], off - off[0], lang_of_doc[d:e], langs.dictionary, longest)
        if found:
            yield found
        d = e


def _count_chunk(raw: np.ndarray, off: np.ndarray, lang_of_doc: np.ndarray, langs: pa.Array,
                 longest: int) -> Counted | None:
    size = len(raw)
    if not size:
        return None
    buf = _LOWER[raw]
    kind = _CLASS[buf]
    word = kind == 0
    edge = np.zeros(size + 1, dtype=bool)
    edge[off] = True
    begins = word & edge[:size]
    begins[1:] |= word[1:] & ~word[:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return None
    doc = np.searchsorted(off, starts, side="right") - 1
    # piece numbers grow at every break and at every document
    piece = np.cumsum(kind == 2)[starts] + doc
    # words one after the other without what stands between them
    at = np.append((np.cumsum(word) - 1)[starts], word.sum()).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(buf[word])])
    coded = column.dictionary_encode()
    ids, many = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
    ones, code, counts = np.unique(lang_of_doc[doc] * many + ids, return_inverse=True, return_counts=True)
    lang, of = ones // many, ones % many
    runs = [Runs(1, [of], lang, counts)]
    # a run of n words starts where one of n - 1 does whose next word is in the same piece
    begin, dense, base, words = np.arange(len(starts)), code, len(ones), [np.arange(len(ones))]
    for n in range(2, longest + 1):
        stays = np.flatnonzero(begin + n - 1 < len(starts))
        stays = stays[piece[begin[stays] + n - 1] == piece[begin[stays]]]
        begin = begin[stays]
        if not len(begin):
            break
        keys, next_dense, counts = np.unique(dense[stays] * base + code[begin + n - 1], return_inverse=True, return_counts=True)
        words = [w[keys // base] for w in words] + [keys % base]
        runs.append(Runs(n, [of[w] for w in words], lang[words[0]], counts))
        dense = next_dense
    return Counted(coded.dictionary, langs, runs)


# ---- first pass: summaries ----------------------------------------------------------

def _add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], (np.add.reduceat(counts, first) if len(first) else counts[:0])


def merge_summaries(parts: Iterable[tuple[np.ndarray, np.ndarray]], capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Merge summaries ``(keys, counts)`` into one of at most ``capacity`` counters. Returns it and
    what was taken off every counter in all, at most the mass divided by ``capacity + 1``."""
    keys, counts, error = np.zeros(0, np.uint32), np.zeros(0, np.int64), 0
    wait, waiting = [], 0

    def fold():
        nonlocal keys, counts, error, wait, waiting
        keys, counts = _add_up(np.concatenate([keys, *(k for k, _ in wait)]), np.concatenate([counts, *(c for _, c in wait)]))
        wait, waiting = [], 0
        if len(keys) > capacity:
            cut = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
            counts = counts - cut
            keys, counts = keys[counts > 0], counts[counts > 0]
            error += cut

    for k, c in parts:
        wait.append((k, c.astype(np.int64)))
        waiting += len(k)
        if waiting > max(capacity, 1 << 20):
            fold()
    fold()
    return keys, counts, error


def _hand_on(hashes: np.ndarray, counts: np.ndarray, parts: int) -> pa.RecordBatch:
    """One row for each hash partition met: its mass, keys and counts."""
    part, keys = bloom.split(hashes, parts)
    order = np.argsort(part, kind="stable")
    part, keys, counts = part[order], keys[order].astype(np.uint32), counts[order]
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    cuts = list(zip(first, np.append(first[1:], len(part))))
    return pa.RecordBatch.from_arrays(
        [pa.array(part[first]), pa.array([int(counts[a:b].sum()) for a, b in cuts], pa.int64()),
         pa.array([keys[a:b].tobytes() for a, b in cuts], pa.binary()),
         pa.array([np.minimum(counts[a:b], 0xFFFFFFFF).astype(np.uint32).tobytes() for a, b in cuts], pa.binary())],
        names=["part", "mass", "ks", "cs"])


def _summaries(parts: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for found in count_runs(batch, longest):
                for h, r in zip(found.hashes(), found.runs):
                    held.append((h, r.counts))
                    size += len(h)
                if size > HELD:
                    h, c = _add_up(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
                    held, size = [(h, c)], len(h)
                    if size > HELD // 2:
                        yield _hand_on(h, c, parts)
                        held, size = [], 0
        if held:
            yield _hand_on(*_add_up(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])), parts)
    return run


def _segment(threshold: int, parts: int):
    """Merge the summaries of a partition; its survivors as a Bloom filter segment."""
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        mass = int(rows["mass"].sum())
        pairs = ((np.frombuffer(k, np.uint32), np.frombuffer(c, np.uint32)) for k, c in zip(rows["ks"], rows["cs"]))
        keys, counts, error = merge_summaries(pairs, mass // threshold + 1)
        # a run occurs at most as often as its counter and the error together say
        keys = keys[counts + error >= threshold]
        return pd.DataFrame({"part": [key[0]], "bits": [bloom.segment(keys, parts)], "survivors": [len(keys)],
                             "mass": [mass], "error": [error]})
    return run


# ---- second pass: exact counts -------------------------------------------------------

def _exact(path: str, parts: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        survivors = bloom.Filter.at(path, parts)
        for batch in batches:
            for found in count_runs(batch, longest):
                words, langs = found.vocabulary.cast(pa.large_string()), found.langs.cast(pa.large_string())
                total = np.bincount(found.runs[0].lang, weights=found.runs[0].counts, minlength=len(langs)).astype(np.int64)
                yield _rows(langs, pa.nulls(len(langs), pa.large_string()), 0, total)
                for h, r in zip(found.hashes(), found.runs):
                    passed = np.flatnonzero(survivors.passes(h))
                    for at in range(0, len(passed), HANDED):
                        stays = passed[at:at + HANDED]
                        # one space between words: no word holds one
                        text = words.take(pa.array(r.words[0][stays]))
                        if r.n > 1:
                            text = pc.binary_join_element_wise(text, *(words.take(pa.array(w[stays])) for w in r.words[1:]), pa.scalar(" ", pa.large_string()))
                        yield _rows(langs.take(pa.array(r.lang[stays])), text, r.n, r.counts[stays])
    return run


def _rows(lang: pa.Array, phrase: pa.Array, words: int, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [lang.cast(pa.string()), phrase.cast(pa.string()), pa.array(np.full(len(counts), words, np.int32)),
         pa.array(counts.astype(np.int64))], names=["lang", "phrase", "words", "c"])


def frequent_runs(documents: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST,
                  part_chars: int = PART_CHARS) -> DataFrame:
    """``lang, phrase, words, a`` of all runs of up to ``longest`` words that occur ``threshold`` times
    or more, exactly counted; a row of null phrase and 0 words holds each language's word count."""
    docs = documents.select("lang", "text")
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = int(chars // part_chars) + 1
    met = docs.mapInArrow(_summaries(parts, longest), "part long, mass long, ks binary, cs binary")
    path = scratch_path(docs.sparkSession, "survivors")
    met.groupBy("part").applyInPandas(
        _segment(threshold, parts), "part long, bits binary, survivors long, mass long, error long").write.parquet(path)
    counted = docs.mapInArrow(_exact(path, parts, longest), "lang string, phrase string, words int, c long")
    return (counted.groupBy("lang", "phrase", "words").agg(F.sum("c").alias("a"))
            .where((F.col("words") == 0) | (F.col("a") >= threshold)))


# ---- scores ---------------------------------------------------------------------------

def collocations(documents: DataFrame, threshold: int = THRESHOLD, top: int = TOP,
                 part_chars: int = PART_CHARS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first ``top`` phrases."""
    runs = stage(frequent_runs(documents, threshold, LONGEST, part_chars), "runs")
    known = runs.where("words > 0").select("lang", "phrase", "a")
    many = runs.where("words > 1")
    first, last = F.substring_index("phrase", " ", 1), F.substring_index("phrase", " ", -1)
    head = F.substring_index("phrase", " ", 2)
    tail = F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)")
    cut = lambda k, left, right: F.struct(F.lit(k).alias("k"), left.alias("left"), right.alias("right"))
    cuts = many.select("lang", "phrase", "words", "a", F.explode(
        F.when(F.col("words") == 2, F.array(cut(1, first, last)))
        .otherwise(F.array(cut(1, first, tail), cut(2, head, last)))).alias("cut")).select("lang", "phrase", "words", "a", "cut.*")
    part = lambda name, count: known.select(F.col("lang"), F.col("phrase").alias(name), F.col("a").alias(count))
    scored = (cuts.join(sized(part("left", "l")), ["lang", "left"]).join(sized(part("right", "r")), ["lang", "right"])
              .withColumn("score", F.expr(
                  "(cast(a as decimal(15, 0)) * cast(a as decimal(15, 0)) * cast(1000000 as decimal(7, 0)))"
                  " div (cast(l as decimal(15, 0)) * cast(r as decimal(15, 0)))"))
              .groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low")))
    inside = (many.where("words = 3").select("lang", F.explode(F.array(head, tail)).alias("phrase"), F.col("a").alias("longer"))
              .groupBy("lang", "phrase").agg(F.max("longer").alias("longer")))
    left = (scored.join(inside, ["lang", "phrase"], "left")
            .where((F.col("words") == 3) | F.col("longer").isNull() | (100 * F.col("longer") < 50 * F.col("a")))
            .select("lang", "phrase", "a", "low.l", "low.r", "low.score"))
    # a language's candidates are ranked in SALTS parts first, so no task gets them all
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    total = runs.where("words = 0").select("lang", F.col("a").alias("n"))
    return best.join(sized(total), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle(threshold: int = THRESHOLD, top: int = TOP) -> str:
    return rf"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
        w AS (SELECT lang, regexp_extract_all(piece, '[^ \x09]+') AS w FROM p),
        g AS (SELECT lang, 1 AS words, unnest(w) AS phrase FROM w
              UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
              UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i:
                                                              w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
        f AS MATERIALIZED (SELECT lang, words, phrase, count(*) AS a FROM g GROUP BY ALL),
        n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang),
        c AS (SELECT *, string_split(phrase, ' ') AS s FROM f WHERE words > 1 AND a >= {threshold}),
        v AS (SELECT lang, phrase, words, a, s, unnest(range(1, words)) AS k FROM c),
        k AS MATERIALIZED (SELECT lang, phrase, words, a, k, array_to_string(s[1:k], ' ') AS head,
                                  array_to_string(s[k + 1:words], ' ') AS tail FROM v),
        x AS (SELECT b.lang, b.phrase, b.words, b.a, b.k, e.a AS l, z.a AS r,
                     (1000000::HUGEINT * b.a * b.a) // (e.a::HUGEINT * z.a) AS score
              FROM k b JOIN f e ON e.lang = b.lang AND e.phrase = b.head JOIN f z ON z.lang = b.lang AND z.phrase = b.tail),
        y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        h AS (SELECT lang, unnest([s[1] || ' ' || s[2], s[2] || ' ' || s[3]]) AS phrase, a FROM c WHERE words = 3),
        m AS (SELECT lang, phrase, max(a) AS longer FROM h GROUP BY ALL),
        j AS (SELECT y.* FROM y LEFT JOIN m ON m.lang = y.lang AND m.phrase = y.phrase
              WHERE words = 3 OR longer IS NULL OR 100 * longer < 50 * a),
        q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM j)
        SELECT q.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM q JOIN n ON n.lang = q.lang WHERE rank <= {top}"""
