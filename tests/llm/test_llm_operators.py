"""The operators of sluice.llm against brute force on a small table with awkward rows."""
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, n string, size string, comp string"


def _prose(seed, n):
    rng = np.random.default_rng(seed)
    return [f"w{int(x)}" for x in rng.integers(0, 4000, n)]


def _texts():
    base, long, shared = _prose(1, 120), _prose(2, 3000), _prose(3, 55)
    edit = [*base[:60], "EDIT", *base[61:]]
    rows = [
        (1, " ".join(base)), (2, " ".join(base).upper()), (3, " ".join(edit)), (4, "\t\n".join(base)),
        (5, None), (6, ""), (7, " \n "), (8, "one two three"), (9, "ONE two three"), (10, "one two"),
        (11, " ".join(long)), (12, " ".join(long[:1500] + shared + long[1500:])),
        (13, " ".join(_prose(4, 40) + shared + _prose(5, 30))), (14, " ".join(_prose(6, 10) + shared)),
        (15, "same " * 90), (16, "under the MIT License, or CC-BY; Apache  License. cc by"),
        (17, "gnu General Public LICENSE and GNU general public license all rights reserved"),
        (18, "café É x  y日本 😀 ##tag 1,2"), (None, "no id here at all"), (None, None),
        (20, " ".join(base)), (20, " ".join(base)), (21, " ".join(_prose(7, 300))), (22, " ".join(_prose(7, 300)[:-20])),
    ]
    rows += [(100 + i, " ".join(base[:110] + [f"x{i}a", f"x{i}b"])) for i in range(40)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if k % 7 == 0 else f"s{k % 3}", len(t or ""), "a", "b", "c", "d")
            for k, (i, t) in enumerate(_texts())]
    return spark.createDataFrame(rows, DOCS).repartition(4)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def _words(text):
    return WORD.findall((text or "").encode())


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _multiset(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def _union(pairs, nodes):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for a, b in pairs:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return {x: root(x) for x in nodes}


@pytest.mark.parametrize("hot", [1, 24])
def test_jaccard(docs, hot):
    from sluice.llm.ngram_jaccard import jaccard_components
    rows = _texts()
    sets = []
    for _, t in rows:
        w = _words(_lower(t))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = [(a, b) for a in range(len(rows)) for b in range(a)
             if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = _union(links, range(len(rows)))
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[comp[k]] = min(low.get(comp[k], i), i)
    want = Counter((i, len(sets[k]), low.get(comp[k]) if sets[k] else i) for k, (i, _) in enumerate(rows))
    assert _multiset(jaccard_components(docs, hot=hot), "doc_id", "n_shingles", "component_id") == want


def test_keep_one(docs):
    from sluice.llm.ngram_jaccard import jaccard_components, keep_one
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    groups = jaccard_components(docs).collect()
    assert set(ids) == {r["component_id"] for r in groups}
    assert all(n == 1 for i, n in ids.items() if i is not None) and ids[None] == 2


def test_block_links_agree_with_pairs():
    import pandas as pd
    from sluice.llm.ngram_jaccard import _block_links
    rng = np.random.default_rng(0)
    base = rng.integers(0, 10**6, 100)
    sets = [np.unique(np.where(rng.random(100) < 0.12, rng.integers(0, 10**6, 100), base)) for _ in range(60)]
    frame = lambda at, s: pd.DataFrame({f"node{s}": at, f"grams{s}": [sets[i] for i in at]})
    for left, right in ((range(60), []), (range(30), range(30, 60))):
        got = _block_links(None, frame(list(left), ""), frame(list(right), "2"))
        want = [(i, j) for i in left for j in (right or left) if i < j
                and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
        assert _union(zip(got["a"], got["b"]), range(60)) == _union(want, range(60))
        assert len(got) <= 60


@pytest.mark.parametrize("shard", [0, 4000])
def test_substrings(docs, shard):
    from sluice.llm import substring as S
    rows = _texts()
    seen = Counter(tuple(w[i:i + 35]) for _, t in rows for w in (_words(t),) for i in range(len(w) - 34))
    want = Counter()
    for i, t in rows:
        w = _words(t)
        gone = {j for a in range(len(w) - 34) if seen[tuple(w[a:a + 35])] > 1 for j in range(a, a + 35)}
        text = b" ".join(x for j, x in enumerate(w) if j not in gone)
        want[(i, len(w), len(gone), hashlib.sha256(text).hexdigest())] += 1
    spans = S.repeated_spans(docs, shard=shard)
    both = S._with_spans(docs.select("doc_id", "text"), spans).select("doc_id", "text", F.col("_spans").alias("spans"))
    got = both.mapInArrow(S._report_batches, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    assert _multiset(got, "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_suffix_automaton_matches_windows():
    from sluice.llm.substring import SuffixAutomaton
    rng = np.random.default_rng(5)
    for _ in range(30):
        seqs = [rng.integers(0, 3, int(rng.integers(1, 40))).tolist() for _ in range(4)]
        weights = [int(x) for x in rng.integers(1, 3, 4)]
        auto = SuffixAutomaton()
        for s, w in zip(seqs, weights):
            auto.add(s, w)
        auto.settle()
        seen = Counter()
        for s, w in zip(seqs, weights):
            for i in range(len(s) - 4):
                seen[tuple(s[i:i + 5])] += w
        for s in seqs:
            want = {j for i in range(len(s) - 4) if seen[tuple(s[i:i + 5])] > 1 for j in range(i, i + 5)}
            assert {j for a, b in auto.spans(s, 5) for j in range(a, b)} == want


def test_remove_repeats_keeps_rows_and_columns(docs):
    from sluice.llm.substring import remove_repeats
    out = remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert {r["doc_id"]: r["text"] for r in out.collect()}[18] == dict(_texts())[18]


def test_mixing(docs):
    from sluice.llm.mixing import mix_documents, mix_plan
    plan = [r.asDict() for r in mix_plan(docs, block=8).collect()]
    again = [r.asDict() for r in mix_plan(docs.repartition(3), block=8).collect()]
    key = lambda r: tuple(map(str, r.values()))
    assert sorted(map(key, plan)) == sorted(map(key, again))
    sizes = Counter()
    for r in plan:
        sizes[r["source"]] += r["size"]
    total = sum(sizes.values())
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, full = {}, set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        live = sum(weight[s] for s in order if s not in full)
        target = {s: 3 * sizes[s] if s in full else rest * weight[s] / live for s in order}
        over = {s for s in order if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    taken = Counter()
    for r in plan:
        assert r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-9)
        taken[r["source"]] += r["taken"]
    short = sorted(r["size"] for r in plan)[len(plan) // 2]
    for s in order:
        assert abs(taken[s] - target[s]) <= 2 * short
    out = mix_documents(docs, block=8)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in plan)


def test_flight_keeps_totals():
    from sluice.llm.mixing import fly
    rng = np.random.default_rng(1)
    prob, size = np.full(500, 0.37), rng.integers(0, 900, 500)
    after = fly(prob, size)
    assert ((after > 0) & (after < 1)).sum() <= 2
    assert math.isclose((after * size).sum(), (prob * size).sum()) and math.isclose(after.sum(), prob.sum())


def test_pieces(docs):
    sentencepiece = pytest.importorskip("sentencepiece")
    from sluice.llm.pieces import decode_documents, encode_documents, encoding_digests
    from sluice.llm.queries import tokenizer_path
    path = tokenizer_path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    more = [(900 + k, t) for k, t in enumerate(["  a  b ", "\n x", "▁▁q", "<s></s><0x41>", "a" * 300, "\x00\x07é́"])]
    extra = docs.sparkSession.createDataFrame(more, "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra)
    want = Counter()
    for i, t in [*_texts(), *more]:
        ids = lib.encode(t or "", add_eos=True)
        want[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
              hashlib.sha256(lib.decode(ids).encode()).hexdigest())] += 1
    assert _multiset(encoding_digests(both, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    enc = encode_documents(extra, path)
    for r in enc.collect():
        raw = dict(more)[r["doc_id"]].encode()
        assert b"".join(raw[a:b] for a, b in zip(r["begins"], r["ends"])) == raw
    back = {r["doc_id"]: r["text"] for r in decode_documents(enc, path).collect()}
    assert back[900] == "  a  b " and back[904] == "a" * 300


def test_charmap_longest_prefix():
    import struct
    from sluice.llm.pieces import CharMap
    assert CharMap(b"").longest("é!".encode(), 0) == ("é".encode(), 2)
    assert CharMap(struct.pack("<I", 0)).longest(b"ab", 1) == (b"b", 1)


def test_token_counts(docs):
    from sluice.llm.token_counts import document_token_counts
    want = Counter((i, len(_words(t))) for i, t in _texts())
    for block in (64, 1 << 20):
        assert _multiset(document_token_counts(docs, block), "doc_id", "n_tokens") == want


def test_licenses(docs):
    from sluice.llm.licenses import BASE, scan_licenses
    got = {}
    for r in scan_licenses(docs).collect():
        got.setdefault(r["doc_id"], r)
    for i, t in _texts():
        w = [x for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(t))]
        hits = sorted((s, label) for p, label in BASE.items() for q in [p.split()]
                      for s in range(len(w)) if w[s:s + len(q)] == q)
        if i is None:
            continue
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(hits))
        assert (r["first_word"], r["last_word"]) == ((hits[0][0], hits[-1][0]) if hits else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in hits})) and 0 <= r["score"] <= 1
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) or not hits


def test_top_k(spark):
    from sluice.llm.topk import top_k_embeddings
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    rows = [(i, v[i].tolist(), i % 3, "x") for i in range(300)]
    rows += [(300, None, 1, "x"), (301, [1.0, None] * 4, 1, "x"), (302, [float("nan")] * 8, 1, "x"),
             (350, v[7].tolist(), 1, "x"), (351, v[7].tolist(), 1, "x"), (None, v[1].tolist(), 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score string")
    live = {i: np.floor(256 * np.array(e, dtype=np.float32).astype(float)).astype(int)
            for i, e, *_ in rows if i is not None and e and None not in e and np.isfinite(e).all()}
    want = set()
    for q in (x for x in live if x % 50 == 0):
        best = sorted((-int(live[q] @ live[c]), c) for c in live if c != q)[:5]
        want |= {(q, r, c, -s) for r, (s, c) in enumerate(best, 1)}
    assert {tuple(r) for r in top_k_embeddings(df).select("query_id", "rank", "vec_id", "score").collect()} == want
    assert top_k_embeddings(df.where("vec_id in (50, 51)")).count() == 1


def test_near_dedup(spark):
    from sluice.llm.embedding_dedup import near_dedup
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(60, 64))
    rows = []
    for i in range(600):
        x = centre[i % 60] + rng.normal(size=64) * (0.05 + 0.3 * (i % 5) / 5)
        rows.append((i, x.astype(np.float32).tolist(), None if i % 97 == 0 else i % 2, "x"))
    rows += [(1000 + k, rows[3][1], 1, "x") for k in range(30)]
    rows += [(2000, [0.0] * 64, 1, "x"), (2001, None, 1, "x"), (2002, [float("inf")] * 64, 1, "x"), (2003, [], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string")
    good = [(i, np.array(e, dtype=float), y) for i, e, y, _ in rows if e and y is not None and np.isfinite(e).all() and any(e)]
    m = np.stack([e / np.linalg.norm(e) for _, e, _ in good])
    lab = np.array([y for *_, y in good])
    near = (m @ m.T >= 0.93) & (lab[:, None] == lab[None])
    np.fill_diagonal(near, False)
    ids = [i for i, *_ in good]
    comp = _union([(ids[a], ids[b]) for a, b in np.argwhere(near)], ids)
    want = {i: (int(near[k].sum()), comp[i]) for k, i in enumerate(ids)}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_dedup(df, block=100).collect()}
    assert set(got) == {r[0] for r in rows}
    found = sum(min(got[i][0], want[i][0]) for i in ids)
    assert found >= 0.99 * sum(n for n, _ in want.values()) and all(got[i][0] <= want[i][0] for i in ids)
    assert np.mean([got[i] == want[i] for i in ids]) > 0.98
    assert got[2000] == (0, 2000) and got[2001] == (0, 2001) and got[0] == (0, 0)


def _sf(spark, table):
    return spark.read.parquet(f"/root/testdata/sf0.01/{table}.parquet")


def test_quality_held_out(spark, docs):
    from sluice.llm.quality import keep_good, score_quality
    d, y = _sf(spark, "documents"), _sf(spark, "labels")
    r = score_quality(d, y).join(y, "doc_id").where("held_out").toPandas()
    assert ((r["score"] >= 0.7) == r["quality"]).mean() > 0.95 and (r["predicted"] == (r["score"] >= 0.7)).all()
    odd = score_quality(docs, y)
    assert odd.count() == docs.count() and odd.where("score is null or score < 0 or score > 1 or isnan(score)").count() == 0
    assert keep_good(docs, y).columns == docs.columns
    assert score_quality(docs, y.where("false")).agg(F.min("score")).first()[0] == 0.5


def test_toxicity_held_out(spark, docs):
    from sluice.llm.toxicity import score_toxicity
    d, y = _sf(spark, "documents"), _sf(spark, "labels")
    r = score_toxicity(d, y).join(y, "doc_id").where("held_out").toPandas()
    assert (r["predicted"] == r["toxic"]).mean() > 0.9
    odd = score_toxicity(docs, y)
    assert odd.count() == docs.count() and odd.where("score is null or score < 0 or score > 1 or isnan(score)").count() == 0
    assert score_toxicity(docs, y.where("false")).agg(F.max("score")).first()[0] == 0.0


def test_block_max_search_is_exact():
    from sluice.llm.toxicity import BlockMaxIndex
    rng = np.random.default_rng(3)
    pick = lambda n: [np.sort(rng.choice(40, int(rng.integers(0, 8)), replace=False)) for _ in range(n)]
    terms, queries = pick(300), pick(80)
    ones = lambda ts: [np.ones(len(t), int) for t in ts]
    index = BlockMaxIndex(rng.random(40) + 1, list(range(300)), rng.integers(0, 2, 300), terms, ones(terms), np.ones(300), lanes=16)
    q = index.vectors(queries, ones(queries))
    who, cosine = index.nearest(q)
    for i in range(80):
        sims = np.round(index.rows @ q[i], 12)
        best = sorted((-s, index.ids[k]) for k, s in enumerate(sims) if s > 0)[:index.k]
        assert [(-c, index.ids[w]) for w, c in zip(who[i], cosine[i]) if w >= 0] == best


def test_empty_tables(none, spark):
    from sluice.llm import embedding_dedup, licenses, mixing, ngram_jaccard, pieces, quality, substring, token_counts, topk, toxicity
    from sluice.llm.queries import tokenizer_path
    y = _sf(spark, "labels")
    e = _sf(spark, "embeddings").where("false")
    path = tokenizer_path("piece_bpe_32k.model")
    for df in (ngram_jaccard.jaccard_components(none), ngram_jaccard.keep_one(none), substring.substring_report(none),
               substring.remove_repeats(none), mixing.mix_plan(none), mixing.mix_documents(none), quality.score_quality(none, y),
               toxicity.score_toxicity(none, y), licenses.scan_licenses(none), token_counts.document_token_counts(none),
               pieces.encoding_digests(none, path), topk.top_k_embeddings(e), embedding_dedup.near_dedup(e)):
        assert df.count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P
    src = _sf(spark, "documents").limit(250)
    folder = str(tmp_path)
    src.write.parquet(f"{folder}/documents.parquet")
    _sf(spark, "labels").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, step in P.STAGES[:-1]:
        docs = spark.createDataFrame(step(spark, docs, folder).collect(), src.schema)
        assert docs.columns == src.columns, name
    out = P.STAGES[-1][1](spark, docs, folder)
    assert out.count() == docs.count() and out.where("not round_trip").count() == 0


def test_toxicity_knows_rare_and_clean_terms(spark):
    """Marks of a few examples each, more of them than any fixed number of terms, and clean wording all count."""
    from sluice.llm.toxicity import score_toxicity
    fill = lambda i: " ".join(f"w{x}" for x in np.random.default_rng(i).integers(0, 30, 6))
    rows = [(i, f"{fill(i)} {i % 150:03d}vile {i % 150:03d}hateful", 1) for i in range(1500)]
    rows += [(i, f"{fill(i)} {i % 150:03d}kind {i % 150:03d}gentle", 0) for i in range(1500, 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = score_toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()
    assert np.mean([r["predicted"] == (r["doc_id"] < 1500) for r in out]) > 0.99
    assert all(len(r["evidence"]) == 15 for r in out)
    assert {e["toxic"] for r in out if r["doc_id"] >= 1500 for e in r["evidence"][:1]} == {0}


def test_spans_of_every_row(docs):
    """The registered query and the pipeline's stage give spans; they cover each text."""
    from sluice.llm.pieces import encode_documents, encode_for_training, encoding_digests
    from sluice.llm.queries import tokenizer_path
    path = tokenizer_path("piece_bpe_32k.model")
    want = Counter()
    for r in encode_documents(docs, path).collect():
        flat = np.stack([r["begins"], r["ends"]], axis=1).astype("<i8").tobytes()
        want[(r["doc_id"], len(r["ids"]), hashlib.sha256(flat).hexdigest())] += 1
    assert _multiset(encoding_digests(docs, path), "doc_id", "n_tokens", "spans_sha256") == want
    texts = Counter((i, (t or "").encode()) for i, t in _texts())
    rows = encode_for_training(docs, path).collect()
    assert all(len(r["begins"]) == len(r["ends"]) == r["n_tokens"] - 1 for r in rows)
    by_id = {r["doc_id"]: r for r in rows}
    for (i, raw), n in texts.items():
        if i is not None:
            assert b"".join(raw[a:b] for a, b in zip(by_id[i]["begins"], by_id[i]["ends"])) == raw


def _compiled_map(rules):
    """A character map as models hold it: a double-array trie of the keys' bytes, then the replacements."""
    texts, at, values = b"", {}, {}
    for key, text in rules.items():
        if text not in at:
            at[text] = len(texts)
            texts += text.encode() + b"\0"
        values[key.encode()] = at[text]
    units, used = {0: 0}, {0}

    def place(keys, node, depth):
        """Units of the children of ``node``: the keys share their first ``depth`` bytes."""
        labels = sorted({k[depth] if len(k) > depth else 0 for k in keys})
        base = next(x for x in range(1, 1 << 20) if all(x ^ c not in used for c in labels))
        used.update(base ^ c for c in labels)
        units[node] |= (node ^ base) << 10
        for c in labels:
            below = [k for k in keys if len(k) > depth and k[depth] == c]
            if c:
                units[base ^ c] = c
                place(below, base ^ c, depth + 1)
            else:
                units[node] |= 1 << 8
                units[base] = values[next(k for k in keys if len(k) == depth)] | 1 << 31
    place(list(values), 0, 0)
    table = np.zeros((max(units) // 256 + 1) * 256, dtype="<u4")
    for i, u in units.items():
        table[i] = u
    trie = table.tobytes()
    return len(trie).to_bytes(4, "little") + trie + texts


def test_compiled_charmap():
    """A model with a compiled character map: ids, spans and decoded texts as the library has them."""
    sentencepiece = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2
    from sluice.llm.pieces import PieceModel
    from sluice.llm.queries import tokenizer_path
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as fh:
        proto = sentencepiece_model_pb2.ModelProto.FromString(fh.read())
    rules = {"ﬁ": "fi", "ﬃ": "ffi", "①": "1", "㎏": "kg", "㍿": "株式会社", "か\u3099": "が", "\u3000": " ", "\u200b": " ", "\t": " ", "\n": " "}
    rules |= {chr(0xFF41 + i): chr(97 + i) for i in range(26)}
    proto.normalizer_spec.precompiled_charsmap = _compiled_map(rules)
    for squeeze in (False, True):
        proto.normalizer_spec.remove_extra_whitespaces = squeeze
        lib = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        model = PieceModel(proto.SerializeToString())
        assert model.map.units and model.map.longest("ﬁx".encode(), 0) == (b"fi", 3)
        assert model.map.longest("か\u3099x".encode(), 0) == ("が".encode(), 6)
        for text in TEXTS_TO_MAP:
            ids, begins, ends = model.trace(text)
            assert ids == lib.encode(text, add_eos=True) and model.decode(ids) == lib.decode(ids)
            pieces = lib.encode(text, return_type="proto").pieces
            assert list(zip(begins.tolist(), ends.tolist())) == [(p.begin, p.end) for p in pieces]


TEXTS_TO_MAP = ["oﬃce ﬁne ① ｗａｆｆｌｅ", "  a  b ", "", "㎏ and ㍿ kilo", "café 日本", "　alpha ​beta  ", "ａ\tｂ\n", "  ", "か\u3099"]


def test_keep_one_decides_by_row(spark):
    """One id on different texts loses only its near copies; copies without an id go but for one."""
    from sluice.llm.ngram_jaccard import keep_one
    a, b, c, d = (" ".join(_prose(40 + i, 80)) for i in range(4))
    rows = [(1, a), (5, a + " x"), (5, b), (7, c), (7, d), (7, d), (None, "null and alone here now"),
            (None, " ".join(_prose(50, 60))), (None, " ".join(_prose(50, 60))), (None, c), (9, ""), (9, ""), (None, None)]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, n int").repartition(3)
    want = Counter([(1, a), (5, b), (7, c), (7, d), (None, "null and alone here now"), (None, " ".join(_prose(50, 60))),
                    (9, ""), (9, ""), (None, None)])
    kept = keep_one(df)
    assert kept.columns == df.columns and _multiset(kept, "doc_id", "text") == want
