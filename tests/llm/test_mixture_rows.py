"""The mix of rows whose ids repeat: the same rows in every layout, each text by its own plan."""
from collections import Counter

from pyspark.sql import functions as F


def _docs(spark):
    rows = []
    for i in range(600):
        source = None if i % 11 == 0 else f"s{i % 4}"
        rows.append((i % 300, " ".join(f"w{(i * 7 + k) % 97}" for k in range(10 + i % 13)), source, i, "x"))
    rows += [(None, None, "s1", k, "y") for k in range(5)] + [(7, "copy of a row", "s2", k, "z") for k in range(6)] + [(8, "", None, 1, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n long, _mark string")


def test_two_texts_an_id_in_two_layouts(spark):
    from sluice.llm.mixing import _plan, mix_documents
    docs = _docs(spark)
    columns = ["doc_id", "text", "source", "n", "_mark"]
    rows = lambda d: Counter(tuple(r[c] for c in columns) for r in d.collect())
    one, other = rows(mix_documents(docs.repartition(1))), rows(mix_documents(docs.repartition(6).orderBy(F.desc("n"), "text")))
    assert one == other
    plan = Counter()
    text_of = docs.select("doc_id", "source", "text", F.xxhash64("doc_id", "text", F.lit(20240105)).alias("mark")).distinct()
    keys = ["doc_id", "source", "mark"]
    p = _plan(docs)
    for r in p.join(text_of, [p[k].eqNullSafe(text_of[k]) for k in keys]).select(p["doc_id"], p["source"], "text", "copies").collect():
        plan[r["doc_id"], r["text"], r["source"]] += r["copies"]
    taken = Counter()
    for (i, t, s, _, _), n in one.items():
        taken[i, t, s] += n
    assert taken == +plan
