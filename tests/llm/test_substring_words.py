"""Words that differ only in the upper half of their hashes, and copies, against plain windows."""
import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa


def _half_equal_words():
    """Pairs of words whose 64-bit hashes agree in the lower 32 bits."""
    from sluice.llm import words as W
    names = np.array([f"word{i}" for i in range(400_000)])
    hashes = np.concatenate([c.hashes for c in W.chunks(pa.array([" ".join(names)]))])
    low = hashes.astype(np.uint32)
    order = np.argsort(low, kind="stable")
    at = np.flatnonzero(low[order][1:] == low[order][:-1])
    return [(names[order[i]], names[order[i + 1]]) for i in at]


def _report(rows, window=35):
    seen = Counter(tuple(w[i:i + window]) for _, t in rows for w in [t.split()] for i in range(len(w) - window + 1))
    out = []
    for i, t in rows:
        w = t.split()
        gone = {j for a in range(len(w) - window + 1) if seen[tuple(w[a:a + window])] > 1 for j in range(a, a + window)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(out)


def test_half_equal_words_are_different_words(spark):
    from sluice.llm.substring import substring_report
    pairs = _half_equal_words()
    assert len(pairs) >= 4
    rows = []
    for k, (a, b) in enumerate(pairs[:8]):
        tail = " ".join(f"t{k}x{j}" for j in range(34))
        rows += [(2 * k, f"{a} {tail}"), (2 * k + 1, f"{b} {tail}")]
    got = substring_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == _report(rows) and all(r["n_removed"] == 0 for r in got)


def test_many_copies_and_shared_passages(spark):
    """A text copied 300 times, its words inside other texts, repeated ids, one very long text."""
    from sluice.llm.substring import substring_report
    rng = np.random.default_rng(12)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 500, n))
    base, part = words(120), words(60)
    rows = [(1, base)] * 150 + [(1000 + i, base) for i in range(150)]
    rows += [(2000 + i, f"{words(30)} {part} {words(int(rng.integers(0, 50)))}") for i in range(40)]
    rows += [(3000, " ".join(base.split()[20:80]) + " " + words(20)), (3001, words(60_000) + " " + part), (3000, words(40))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(tuple(r) for r in substring_report(df).collect()) == _report(rows)
