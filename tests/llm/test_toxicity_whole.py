"""The whole toxicity query against a plain version, and layouts of one table against each other."""
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluice.llm import toxicity as T


def _table(spark, seed=4):
    rng = np.random.default_rng(seed)
    common = [f"word{i}" for i in range(120)]
    bad = [f"nasty{i}" for i in range(25)]
    rows, marks = [], []
    for i in range(260):
        toxic = i % 3 == 0
        words = [common[int(x)] for x in rng.integers(0, 120, int(rng.integers(3, 60)))]
        if toxic:
            words += [bad[int(x)] for x in rng.integers(0, 25, int(rng.integers(1, 5)))]
        text = " ".join(words)
        rows.append((i, text if i % 50 else None))
        if i % 7 == 0:
            rows.append((i, text + " again and another text of the id"))
        if i % 4:
            marks.append((i, 1, int(toxic)))
    rows += [(900, ""), (901, "!!! ???"), (902, "unseen vocabulary only"), (None, "nasty1 nasty2"), (903, "word1 " * 20_000 + "nasty3"), (904, None)]
    docs = spark.createDataFrame([(i, t, "x", 7, 1, b"b") for i, t in rows], "doc_id long, text string, aside string, toxic int, terms int, blob binary")
    labels = spark.createDataFrame([(i, q, t, "x") for i, q, t in marks] + [(None, 1, 1, "x"), (5, None, None, "x")],
                                   "doc_id long, quality int, toxic int, text string")
    return rows, marks, docs, labels


def _terms(text):
    """Counts of words, of the beginnings of longer ones, and of repeated terms, as keys of any kind."""
    count = Counter()
    for w in re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())):
        count[w, 0] += 1
        for k in T.STEMS:
            if len(w) > k:
                count[w[:k], k] += 1
    return count


def _entries(text):
    out = {}
    for t, n in _terms(text).items():
        out[t, 1] = n
        for k in T.LEVELS:
            if n >= k:
                out[t, k] = 1
    return out


def _plain_scores(spark, rows, marks):
    """The same model by dictionaries and full cosines: scores by text."""
    known = {i: t for i, _, t in marks if zlib.crc32(str(i).encode()) % 5 != 0}
    hashes = {r["doc_id"]: r for r in spark.createDataFrame([(i,) for i in known], "doc_id long").select(
        "doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(3)) == 0).alias("aside")).collect()}
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    sample = {i: min([t for t in texts[i] if t is not None], default=None) for i in known}
    inside = [i for i in sorted(known) if not hashes[i]["aside"]]
    aside = [i for i in sorted(known) if hashes[i]["aside"]]
    known_entries = set().union(*(_entries(sample[i]) for i in inside))
    df = Counter(e for _, t in rows for e in _entries(t) if e in known_entries)
    odds = {}
    n1, n0 = sum(known[i] == 1 for i in inside), sum(known[i] == 0 for i in inside)
    a, b = Counter(), Counter()
    for i in inside:
        (a if known[i] else b).update(_entries(sample[i]).keys())
    for e in known_entries:
        x, y = a[e] + 0.5, b[e] + 0.5
        odds[e] = abs(np.log(x / (n1 + 1 - x)) - np.log(y / (n0 + 1 - y))) / np.sqrt(1 / x + 1 / (n1 + 1 - x) + 1 / y + 1 / (n0 + 1 - y))
    worth = {e: (np.log((1 + len(rows)) / (1 + df[e])) + 1) * (T.FLOOR + odds[e]) for e in known_entries}

    def vector(text):
        v = {e: (1 + np.log(n)) * worth[e] for e, n in _entries(text).items() if e in worth}
        norm = np.sqrt(sum(x * x for x in v.values()))
        return {e: x / norm for e, x in v.items()} if v else {}

    examples = [(i, known[i], vector(sample[i])) for i in inside]
    weight = {c: sum(t == c for t in known.values()) / (n1 if c else n0) for c in (0, 1)}

    def vote(text):
        q = vector(text)
        near = sorted(((-round(sum(x * v.get(e, 0.0) for e, x in q.items()), 12), i, c) for i, c, v in examples))
        near = [(-s, i, c) for s, i, c in near if s < 0][:T.NEIGHBOURS]
        total = sum(s * weight[c] for s, _, c in near)
        return (sum(s * weight[c] * c for s, _, c in near) / total if total else None), near

    return vote


def _rows_of(df):
    return Counter((r["doc_id"], r["held_out"], r["score"], r["predicted"], tuple((e["doc_id"], e["toxic"], e["cosine"]) for e in r["evidence"]))
                   for r in df.collect())


def test_scores_and_evidence_equal_the_plain_version(spark):
    rows, marks, docs, labels = _table(spark)
    got = T.score_toxicity(docs.repartition(3), labels).withColumn("n", F.lit(1)).collect()
    vote = _plain_scores(spark, rows, marks)
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    by_vote = []
    for i, mine in texts.items():
        want = sorted((vote(t) for t in mine), key=lambda v: str(v[1]))
        found = sorted((r for r in got if r["doc_id"] == i), key=lambda r: str([(e["cosine"], e["doc_id"], e["toxic"]) for e in r["evidence"]]))
        for (v, near), r in zip(want, found):
            assert [(e["doc_id"], e["toxic"]) for e in r["evidence"]] == [(n, c) for _, n, c in near]
            assert np.allclose([e["cosine"] for e in r["evidence"]], [s for s, _, _ in near], atol=1e-9)
            if v is not None:
                by_vote.append((v, r["score"]))
    by_vote.sort()
    # one monotone curve turns votes into scores
    assert all(x[1] <= y[1] + 1e-9 for x, y in zip(by_vote, by_vote[1:]))


def test_layouts_of_one_table_give_one_result(spark):
    _, _, docs, labels = _table(spark, 5)
    first = _rows_of(T.score_toxicity(docs.repartition(1), labels))
    again = _rows_of(T.score_toxicity(docs.repartition(7).orderBy(F.desc("text")), labels.repartition(3)))
    assert first == again
