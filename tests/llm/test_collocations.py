"""Phrase collocations against plain counting."""
import re
from collections import Counter
from fractions import Fraction

import numpy as np


def plain(rows, threshold=10, top=2000):
    f, total = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for n in (1, 2, 3):
                for i in range(len(w) - n + 1):
                    f.setdefault(lang, Counter())[tuple(w[i:i + n])] += 1
    out = []
    for lang, count in f.items():
        found = []
        for p, a in count.items():
            if len(p) < 2 or a < threshold:
                continue
            score, k = min((int(Fraction(1000000 * a * a, count[p[:k]] * count[p[k:]])), k) for k in range(1, len(p)))
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                   for q, b in count.items() if len(q) == 3 and b >= threshold):
                continue
            found.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def some_rows(seed, n):
    rng = np.random.default_rng(seed)
    words = ["Alpha", "beta", "GAMMA", "délta", "日本", "x y", "eps-ilon", "z", "Ä", "'"] + [f"w{i}" for i in range(60)]
    gaps = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", " ;", "\x0b", "\r\n", "!"]
    rows = []
    for i in range(n):
        size = int(rng.integers(0, 120))
        pick = np.minimum(rng.geometric(0.08, size), len(words)) - 1
        text = "".join(words[int(p)] + gaps[int(g)] for p, g in zip(pick, rng.integers(0, len(gaps), size)))
        rows.append((text if i % 17 else None, ["en", "de", None, "und", "en"][i % 5]))
    return rows


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collected(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_equals_plain_counting(spark):
    from sluice.llm.collocations import collocations
    rows = some_rows(1, 400) + [("same pair " * 3000, "en"), ("", "fr"), (" \t\n", "fr"), ("one two", "xx")] + [("again and again.", "de")] * 30
    df = spark.createDataFrame([(i, t, lang, "a", 1, 2) for i, (t, lang) in enumerate(rows)],
                               "doc_id long, text string, lang string, phrase string, a int, words int").repartition(5)
    want = plain(rows)
    assert len(want) > 50
    assert collected(collocations(df)) == want
    # many hash partitions of small mass: every summary is cut, none of the frequent runs is lost
    assert collected(collocations(df, part_chars=4000)) == want
    assert collected(collocations(df, top=5)) == plain(rows, top=5)


def test_a_tight_filter_loses_nothing(spark, monkeypatch):
    from sluice.llm import bloom, collocations as C
    rows = some_rows(2, 150)
    df = spark.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(bloom, "FILTER_BYTES", 64)
    assert collected(C.collocations(df)) == plain(rows)


def test_very_long_text_in_one_piece(spark):
    """A text of 2 million words without any mark, longer than a chunk."""
    from sluice.llm.collocations import collocations
    text = "aa bb cc dd ee ff gg " * 300_000
    got = {r["phrase"]: r for r in collocations(spark.createDataFrame([(text, "en")], "text string, lang string")).collect()}
    assert got["aa bb cc"]["a"] == 300_000 and got["gg aa bb"]["a"] == 299_999 and got["aa bb cc"]["n"] == 2_100_000
    assert len(got) == 7


def test_summaries_keep_every_frequent_key():
    """Whatever the order of merging, keys of the threshold or more survive, within the error bound."""
    from sluice.llm.collocations import merge_summaries
    rng = np.random.default_rng(5)
    for case in range(20):
        keys = rng.zipf(1.3, 30_000).astype(np.uint32) % 5000
        parts = [np.unique(p, return_counts=True) for p in np.array_split(rng.permutation(keys), int(rng.integers(1, 40)))]
        capacity = len(keys) // 10 + 1 if case % 2 else 300
        got, counts, error = merge_summaries(parts, capacity)
        true = Counter(keys.tolist())
        assert len(got) <= capacity and error <= len(keys) // (capacity + 1)
        left = dict(zip(got.tolist(), counts.tolist()))
        assert all(k in left for k, n in true.items() if n > error)
        assert all(true[k] - error <= n <= true[k] for k, n in left.items())


def test_empty_table(spark):
    from sluice.llm.collocations import collocations
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations(none).collect() == []
