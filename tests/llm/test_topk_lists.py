"""Bounds and stops of the sorted lists against full scores."""
import numpy as np
import pytest


@pytest.mark.parametrize("n,d,k,steps", [(3, 4, 5, (0.5, 0.8)), (400, 3, 5, (0.05, 0.1, 0.3, 0.6)), (700, 16, 7, (0.5, 0.8)), (1, 2, 1, (0.5,))])
def test_every_query_gets_its_best_rows(n, d, k, steps):
    from sluice.llm.topk import SortedLists
    rng = np.random.default_rng(n + d)
    rows = rng.integers(-40, 40, (n, d))
    rows[::5] = rows[0]
    ids = rng.permutation(n) * 3
    q = np.concatenate([rows[:9], rng.integers(-40, 40, (30, d)), np.zeros((1, d), int)]).astype(float)
    qids = np.concatenate([ids[:9], np.full(31, -1)])[:len(q)]
    shard = SortedLists(ids, rows, steps)
    for i, (got, scores) in enumerate(shard.best(qids, q, k)):
        want = sorted((-int(rows[j] @ q[i].astype(int)), int(ids[j])) for j in range(n) if ids[j] != qids[i])[:k]
        assert [(-s, x) for s, x in want] == list(zip(scores.tolist(), got.tolist()))


def test_reading_stops_before_the_end():
    """Lists that fall off steeply: few entries decide, and rows that cannot qualify are never completed."""
    from sluice.llm.topk import SortedLists
    rng = np.random.default_rng(2)
    rows = (rng.pareto(1.2, (2000, 4)) * 10).astype(int)
    shard = SortedLists(np.arange(2000), rows, (0.02, 0.1, 0.5))
    seen = []
    plain = shard.stretch
    shard.stretch = lambda i, top, rows=slice(None): (seen.append(i), plain(i, top, rows))[1]
    got = shard.best(np.full(5, -1), np.ones((5, 4)), 3)
    assert max(seen) < 3 and sorted(set(seen))[0] == 0
    assert all(list(s) == sorted(rows.sum(axis=1))[::-1][:3] for _, s in got)
