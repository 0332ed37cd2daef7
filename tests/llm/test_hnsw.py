"""Nearest neighbours by small-world graphs against brute force."""
import numpy as np
import pytest


def brute(rows, k, every=20):
    """{query id: [(vec_id, score)]} over rows that take part."""
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = {}
    for qid in sorted({i for i, _ in fine if i % every == 0}):
        found = []
        for q in {tuple(v) for i, v in fine if i == qid}:
            found += [(i, float((v * q).sum())) for i, v in fine if i != qid and len(v) == len(q)]
        out[qid] = sorted(found, key=lambda p: (-p[1], p[0]))[:k]
    return out


def test_graph_recall_and_flat_arrays():
    """A clustered table of varied lengths: recall of the 20 nearest, and the stored graph searches alike."""
    from sluice.llm.hnsw import LINKS, Graph, level_space
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 48))
    x = (centres[rng.integers(0, 30, 3000)] + rng.standard_normal((3000, 48))) * rng.uniform(0.2, 3, (3000, 1))
    g = Graph.build(level_space(x))
    q = x[:200] / np.sqrt((x[:200] ** 2).sum(axis=1, keepdims=True))
    level = np.concatenate([q, np.zeros((200, 1))], axis=1).astype(np.float32)
    found = g.search(level, 128)
    again = Graph.read(level_space(x), *g.flat(), LINKS)
    assert (again.search(level, 128) == found).all()
    near = np.argsort(-(q @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(near, found)]) > 0.95
    assert all(len(set(a[a >= 0])) == (a >= 0).sum() for a in found)


def test_few_and_awkward_rows_are_found_whole(spark):
    """Nulls, zeros, two widths, copies, repeated ids, clashing columns: equal to brute force."""
    from sluice.llm.hnsw import nearest_embeddings
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(c)) for c in rng.standard_normal(6)]) for i in range(1, 90)]
    rows += [(100, None), (None, [1.0] * 6), (101, []), (102, [0.0] * 6), (103, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (104, [float("nan")] * 6),
             (105, [float("inf")] + [1.0] * 5), (120, [1.0, 2.0, 3.0]), (121, [3.0, 2.0, 1.0]), (20, [0.5] * 6), (20, [0.5] * 6)]
    rows += [(200 + i, [1.0, 1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(60)]
    df = spark.createDataFrame([(i, v, 1, 2, "s") for i, v in rows],
                               "vec_id long, embedding array<float>, label int, shard int, dim string").repartition(4)
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    for shard in (4096, 16):
        got = {}
        for r in nearest_embeddings(df, 20, shard=shard).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        want = brute(rows, 20)
        assert set(got) == {q for q, found in want.items() if found}
        for q, found in got.items():
            found.sort()
            assert [f[0] for f in found] == list(range(1, len(found) + 1))
            assert [f[1] for f in found] == [i for i, _ in want[q]]
            assert np.allclose([f[2] for f in found], [s for _, s in want[q]], rtol=1e-12)


def test_recall_over_shards_with_a_hot_vector(spark):
    """A third of the rows are copies, another third nearly so: at least 0.95 of the best scores are found."""
    from sluice.llm.hnsw import nearest_embeddings
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3000, 24))
    x[:1000] = x[0]
    x[1000:2000] = x[1] + 1e-3 * rng.standard_normal((1000, 24))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest_embeddings(df, shard=700).collect():
        got.setdefault(r["query_id"], []).append(r["score"])
    want = {q: sorted(np.delete(x @ x[q], q))[-20:] for q in range(0, 3000, 20)}
    assert set(got) == set(want)
    hits = [sum(s >= want[q][0] - 1e-9 for s in found) / 20 for q, found in got.items()]
    assert np.mean(hits) > 0.95


def test_empty_table(spark):
    from sluice.llm.hnsw import nearest_embeddings
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert nearest_embeddings(none).collect() == []


@pytest.mark.parametrize("beam", [8, 64])
def test_layer_rows_hold_distinct_neighbours(beam):
    from sluice.llm.hnsw import Graph, level_space
    g = Graph.build(level_space(np.random.default_rng(1).standard_normal((1500, 12))), 8, beam)
    assert sorted(g.layers[-1].nodes) == list(range(1500))
    for layer in g.layers:
        for node, row in zip(layer.nodes, layer.links):
            row = row[row >= 0]
            assert len(set(row)) == len(row) and node not in row and (layer.place[row] >= 0).all()
