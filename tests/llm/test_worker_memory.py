"""What Python workers of keep_good and keep_one hold of memory once they are idle."""
import subprocess
import sys

import pytest

RUN = '''
import re, sys
import numpy as np, pandas as pd, pyarrow as pa
from sluice.llm import ngram_jaccard as N, quality as Q

def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

base = held()

def texts(k):
    rng = np.random.default_rng(k)
    return [" ".join(map(str, rng.integers(0, 999, 900))) for _ in range(5000)]

def batches(n=4):
    for k in range(n):
        zero = pa.array(np.zeros(5000, np.int64))
        yield pa.RecordBatch.from_arrays([zero, pa.array(texts(k)), zero, zero, zero],
                                         names=["doc_id", "text", "tk1", "tk2", "node"])

step = {"statistics": Q._statistics_batches, "prefixes": N._prefix_batches(5), "sets": N._set_batches(5)}[sys.argv[1]]
for _ in step(batches(1)):
    pass
most = max(out.num_rows for out in step(batches()))
print(most, held() - base)
'''


@pytest.mark.parametrize("step", ["statistics", "prefixes", "sets"])
def test_idle_workers_hold_little(step):
    out = subprocess.run([sys.executable, "-c", RUN, step], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) <= 1000
    assert float(out[1]) < 105, out


def test_slices_keep_rows_and_order():
    import pyarrow as pa

    from sluice.llm import ngram_jaccard as N

    words = [None, "", "a b", *[" ".join(f"w{(i * j) % 71}" for j in range(i % 40)) for i in range(2600)]]

    def batch(rows):
        ids = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays([ids, pa.array([words[i] for i in rows], pa.string()), ids, ids, ids],
                                          names=["doc_id", "text", "tk1", "tk2", "node"])
    whole = [batch([]), batch(range(2100)), batch(range(2100, len(words)))]
    single = [batch([i]) for i in range(len(words))]
    for step in (N._prefix_batches(5), N._set_batches(5)):
        together, apart = (pa.Table.from_batches(step(iter(x))) for x in (whole, single))
        assert together.to_pylist() == apart.to_pylist()
