from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.operators.columns import (clean_name, make_unique, normalize_names,
                                      normalize_names_df, unique_names_df)


def test_fixture_names():
    got = make_unique(normalize_names([" price ($) ", "2024", "", "姓名", "a.b", "a b"]))
    assert got == ["price____", "col_2024", "column", "姓名", "a_b", "a_b_1"]


def test_second_pass_collisions():
    assert normalize_names(["a", "a", "a_1"]) == ["a", "a_1", "a_1"]
    assert make_unique(normalize_names(["a", "a", "a_1"])) == ["a", "a_1", "a_1_1"]


def test_case_insensitive_unique():
    assert make_unique(["A", "a"]) == ["A", "a_1"]
    assert make_unique(["A", "a"], case_insensitive=False) == ["A", "a"]


@given(st.lists(st.text(max_size=6), max_size=12))
@settings(max_examples=200, deadline=None)
def test_unique_and_valid(names):
    out = make_unique(normalize_names(names))
    assert len(out) == len(names)
    assert len({n.lower() for n in out}) == len(out)
    for n in out:
        assert n and all(ch.isalnum() or ch == "_" for ch in n)
        assert not n[0].isdigit()


def test_many_headers_match_single(spark):
    headers = {1: [" price ($) ", "2024", "", "a.b", "a b"], 2: ["a", "a", "a_1"], 3: ["x", "X"]}
    rows = [(k, i + 1, n) for k, names in headers.items() for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "file int, ordinal int, name string")
    p1 = normalize_names_df(df, ["file"])
    got = {}
    for r in p1.collect():
        got.setdefault(r.file, {})[r.ordinal] = r.normalized
    for k, names in headers.items():
        assert [got[k][i + 1] for i in range(len(names))] == normalize_names(names)
    p2 = unique_names_df(p1.select("file", "ordinal", "normalized"), ["file"])
    got2 = {}
    for r in p2.collect():
        got2.setdefault(r.file, {})[r.ordinal] = r.unique_name
    for k, names in headers.items():
        assert [got2[k][i + 1] for i in range(len(names))] == make_unique(normalize_names(names))


def test_clean_name_rules():
    assert clean_name("  9lives ") == "col_9lives"
    assert clean_name("   ") == "column"


def test_unique_names_of_many_headers_equal_the_sequential_rule(spark):
    """Random headers whose names meet by case, by suffix and by suffixes of suffixes."""
    import random

    from sluice.operators.columns import make_unique, unique_names_df
    rng = random.Random(6)
    stems = ["a", "A", "b", "a_1", "A_1", "a_1_1", "_1", "", "é", "É", "a_01", "x_y", "b_2", "B_2"]
    rows = [(h if h % 9 else None, o, rng.choice(stems), "x") for h in range(60) for o in range(rng.randrange(1, 25))]
    df = spark.createDataFrame(rows, "doc_id long, ordinal int, normalized string, unique_stem string").repartition(4)
    got = {(r["doc_id"], r["ordinal"], r["normalized"]): r["unique_name"] for r in
           unique_names_df(df.where("doc_id is not null"), ["doc_id"]).collect()}
    for h in {r[0] for r in rows if r[0] is not None}:
        mine = sorted((o, n) for d, o, n, _ in rows if d == h)
        assert [got[h, o, n] for o, n in mine] == make_unique([n for _, n in mine])
