"""The screens of the n-gram join: what they drop, and the texts they are read again from."""

import numpy as np
from pyspark.sql import functions as F

from sluice.llm import ngram_jaccard as N


def test_texts_with_a_common_passage_are_not_compared(spark, monkeypatch):
    rng = np.random.default_rng(3)
    passage = " ".join(f"p{i}" for i in range(24))
    own = [" ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 24)) for _ in range(300)]
    rows = [(i, f"{t} {passage}") for i, t in enumerate(own)]
    rows += [(1000 + i, f"{t} {passage}") for i, t in enumerate(own[:5])] + [(2000, f"{own[7]} {passage} end")]
    staged, stage = {}, N.stage

    def counted(df, name):
        staged[name] = out = stage(df, name)
        return out
    monkeypatch.setattr(N, "stage", counted)
    found = {r.doc_id: r.component_id for r in N.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert found == {i: i for i in range(300)} | {1000 + i: i for i in range(5)} | {2000: 7}
    # the passage alone put all 301 sets in one cluster, each pair of whose blocks was compared
    assert staged["whole-sets"].count() == 2
    assert staged["cuts"].count() == 0


def test_screen_counts_as_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 3000, rng.integers(1, 40))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(700)]
    sets += [np.array([7], np.uint64)] * 600
    count = {}
    for s in sets:
        for g in s.tolist():
            count[g] = count.get(g, 0) + 1
    rows = [(i, len(s) * 3 // 4 + 1, s.view(np.int64).tolist()) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "node long, least int, grams array<long>").repartition(3)
    want = {i for i, least, _ in rows if sum(count[g] > 1 for g in sets[i].tolist()) >= least}
    monkeypatch.setattr(N, "PART_GRAMS", 2000)
    got = [r.node for r in N._screened(df, sum(map(len, sets)), "screen-test").collect()]
    assert len(got) == len(set(got)) and set(got) == want and 0 < len(want) < len(sets)


def test_many_keys_find_the_same_texts(spark):
    docs = spark.createDataFrame([(i % 50, f"text {i % 60}") for i in range(200)], "doc_id long, text string").select("doc_id", "text", *N.text_key())
    keys = docs.where("doc_id < 20").select("doc_id", "tk1", "tk2").distinct().withColumn("node", F.monotonically_increasing_id())
    keys = N.stage(keys, "test-keys")
    read = lambda rows: sorted(tuple(r) for r in N._texts(docs, keys, True, rows).select("node", "doc_id", "text").collect())
    assert read(0) == read(1_000_000) and len(read(0)) == keys.count()
