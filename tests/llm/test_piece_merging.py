"""Segments of a slice of texts merge together: results of the library, little work for a new segment."""
import random
import time
from pathlib import Path

import pytest


def _blob():
    from sluice.llm.queries import tokenizer_path
    return Path(tokenizer_path("piece_bpe_32k.model")).read_bytes()


def test_many_texts_as_the_library():
    """Long segments, characters that are no piece, U+2581 in texts, empty texts between others, a table too small."""
    spm = pytest.importorskip("sentencepiece")
    from sluice.llm.pieces import PieceModel
    blob = _blob()
    lib = spm.SentencePieceProcessor(model_proto=blob)
    rng = random.Random(5)
    parts = ["a", "the", " ", "  ", "\n", "▁", "é", "ß", "日本", "😀", "\x01", "\t", "x" * 30, "1234567890", "ing", "中" * 60,
             "ξενοφοβία", "\U0010ffff", "тест", "ab" * 40, "<0x41>", "</s>"]
    texts = [None, "", " ", "▁", "▁▁ ▁", "\n"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(50))) for _ in range(300)]
    for table in (100_000, 20):
        model = PieceModel(blob, table=table)
        for k in range(0, len(texts), 50):
            some = texts[k:k + 50]
            ids, at, begins, ends = model.traces(some)
            for j, text in enumerate(some):
                a, b = at[j], at[j + 1]
                proto = lib.encode(text or "", return_type="proto").pieces
                assert ids[a:b].tolist() == [p.id for p in proto]
                if "😀" not in (text or "") and "\U0010ffff" not in (text or "") and "\x01" not in (text or ""):
                    own = [p for p, i in zip(proto, ids[a:b].tolist()) if i not in model.byte_of]
                    mine = [(x, y) for x, y, i in zip(begins[a:b].tolist(), ends[a:b].tolist(), ids[a:b].tolist())
                            if i not in model.byte_of]
                    assert mine == [(p.begin, p.end) for p in own]
                assert model.trace(text)[0] == [*ids[a:b].tolist(), model.end]


def test_new_segments_cost_little():
    """A batch of words never met takes a few times the work of the same batch again, not many times."""
    from sluice.llm.pieces import _digest_batches
    import pyarrow as pa
    rng = random.Random(3)
    syllables = ["the", "ing", "er", "tion", "on", "re", "ble", "st", "wh", "an", "ou"]
    ratios = []
    for k in range(4):
        # other words each time; the first time the model is read
        words = ["".join(rng.choices(syllables, k=6)).replace("e", "eaio"[k]) for _ in range(20_000)]
        texts = [" ".join(words[a:a + 100]) for a in range(0, len(words), 100)]
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
        run, took = _digest_batches(_blob())(iter([batch, batch])), []
        for _ in range(2):
            t = time.process_time()
            next(run)
            took.append(time.process_time() - t)
        list(run)
        ratios.append(took[0] / took[1])
    assert min(ratios[1:]) < 6, ratios
