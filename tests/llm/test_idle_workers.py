"""What Python workers of remove_repeats and encode_for_training hold of memory once they are idle, and the
rows they take at a time."""
import subprocess
import sys

import pyarrow as pa
import pytest

RUN = '''
import re, sys
from pathlib import Path
import numpy as np, pyarrow as pa
from sluice.llm import pieces as P, substring as S
from sluice.llm.queries import tokenizer_path

def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

blob = Path(tokenizer_path("piece_bpe_32k.model")).read_bytes()
P._model(blob)
base = held()

def texts(k):
    rng = np.random.default_rng(k)
    return [" ".join(np.char.mod("w%dx", rng.integers(0, 10 ** 7, 60))) for _ in range(5000)]

def batches(n):
    for k in range(n):
        zero = pa.array(np.zeros(5000, np.int64))
        yield pa.RecordBatch.from_arrays([zero, pa.array(texts(k)), zero, zero], names=["doc_id", "text", "tk1", "tk2"])

step = {"classes": S._class_batches(35, 8), "digests": P._digest_batches(blob)}[sys.argv[1]]
most = max(out.num_rows for out in step(batches(3)))
print(most, held() - base)
'''


@pytest.mark.parametrize("step", ["classes", "digests"])
def test_idle_workers_hold_little(step):
    out = subprocess.run([sys.executable, "-c", RUN, step], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) <= 1000
    assert float(out[1]) < 110, out


def test_kept_texts_slice_by_slice():
    """Rows, order and nulls stay where a batch has more rows than a slice."""
    from sluice.llm.base import SLICE
    from sluice.llm.substring import _kept_text
    n = 2 * SLICE + 7
    texts = [None if i % 5 == 0 else f"a{i}  b c" for i in range(n)]
    spans = [None if i % 3 else [{"a": 1, "b": 2}] for i in range(n)]
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    (got,) = _kept_text(iter([(pa.array(texts, pa.string()), pa.array(
        [None if i % 5 == 0 else s for i, s in enumerate(spans)], kind))]))
    assert got.to_pylist() == [None if t is None else t if s is None else f"a{i} c"
                               for i, (t, s) in enumerate(zip(texts, spans))]
    (none,) = _kept_text(iter([(pa.array([], pa.string()), pa.array([], kind))]))
    assert none.to_pylist() == []
