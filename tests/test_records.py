"""Records of big CSV files cut into blocks, against Python's csv module over whole files."""
import csv
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.sources.records import Dialect, check_encoding, count_rows, read_records


@pytest.fixture
def small_blocks(spark):
    """Blocks of a few bytes, so that records and quotes cross many of them."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "61")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def some_rows(seed, n, width=3):
    rng = np.random.default_rng(seed)
    cells = ["a", "", "x,y", 'say "hi"', "line\nbreak", "two\n\nbreaks", '"', "\n", "plain text", "日本", "c\r\nd", "é,\n\"", " ", "7"]
    return [[cells[int(i)] for i in rng.integers(0, len(cells), width)] for _ in range(n)]


def text_of(rows, newline="\n", sep=","):
    out = io.StringIO()
    csv.writer(out, delimiter=sep, lineterminator=newline).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("escape", ['"', "\\"])
def test_state_of_every_line(escape):
    """The state after each line of random files, and the states that a file's parser goes through."""
    rng = np.random.default_rng(7)
    d = Dialect(escape=escape)
    for _ in range(300):
        text = "".join(rng.choice(list('ab,"\n' + escape + "x"), int(rng.integers(1, 40))))
        inside = False
        lines = text.split("\n")
        records, open_ = [], []
        for line in lines:
            inside = d.ends_inside(line, inside)
            open_.append(line)
            if not inside:
                records.append("\n".join(open_))
                open_ = []
        if open_:
            records.append("\n".join(open_))
        want = [r for r in csv.reader(io.StringIO(text), escapechar=None if escape == '"' else escape)]
        got = [d.parse(r) for r in records]
        # a backslash at the end of a line outside quotes joins lines for the csv module alone
        if escape == '"':
            assert [r for r in got if r] == [r for r in want if r], repr(text)


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_files_of_many_blocks(spark, tmp_path, small_blocks, newline):
    rows = {f"f{i}.csv": [["id", "b", "c"]] + some_rows(i, 40 * i) for i in range(1, 4)}
    rows["f9.csv"] = [["id", "b", "c"]]
    for name, r in rows.items():
        (tmp_path / name).write_text(text_of(r, newline), encoding="utf-8", newline="")
    got = read_records(spark, str(tmp_path), sep=",", escape='"', na_tokens=None, with_source=True)
    assert got.rows.rdd.getNumPartitions() > 8
    found = sorted(got.rows.collect(), key=lambda r: r["ordinal"])
    want = [tuple(x) for name in sorted(rows) for x in rows[name][1:] if x != [" "]]
    assert [tuple(r)[:3] for r in found] == want
    assert [r["ordinal"] for r in found] == list(range(1, len(want) + 1))
    assert got.rejects.count() == 0 and got.header == ["id", "b", "c"]
    counts = {r["file_path"].split("/")[-1]: r for r in count_rows(spark, str(tmp_path), escape='"').collect()}
    for name, r in rows.items():
        assert counts[name]["logical_rows"] == len(r) - 1
        assert counts[name]["physical_rows"] == text_of(r, newline).count("\n") - 1


def test_one_record_over_all_blocks_and_open_quotes(spark, tmp_path, small_blocks):
    """A field of 200 lines; a quote that never closes; blank lines; a very long text."""
    long = "\n".join(f"line {i}" for i in range(200))
    (tmp_path / "a.csv").write_text(text_of([["id", "t"], ["1", long], ["2", "x"]]) + "\n  \n" + text_of([["3", "é" * 5000]]))
    (tmp_path / "b.csv").write_text('id,t\n4,ok\n5,"never\nclosed\n6,x\n')
    got = {r["id"]: r["t"] for r in read_records(spark, str(tmp_path), sep=",", escape='"').rows.collect()}
    assert got == {"1": long, "2": "x", "3": "é" * 5000, "4": "ok", "5": "never\nclosed\n6,x"}


def test_encodings_policies_and_headers(spark, tmp_path, small_blocks):
    """Files of five encodings, other column orders, short and long rows, and bytes that do not decode."""
    plain = {"utf-8": "日é", "utf-8-sig": "日é", "gb18030": "中文|\\", "gbk": "中文", "latin-1": "é"}
    for i, (enc, word) in enumerate(plain.items()):
        head = ["id", "word", "extra"] if i % 2 else ["word", "id"]
        rows = [head] + [[str(i * 100 + k), word + "\n,", "e"] if i % 2 else [word + "\n,", str(i * 100 + k)] for k in range(30)]
        rows += [[str(i * 100 + 50)] if i % 2 else [word], [str(i * 100 + 51), word, "e", "more"] if i % 2 else [word, str(i * 100 + 51), "more"]]
        (tmp_path / f"{i}.csv").write_bytes(text_of(rows).encode(enc))
    files = spark.createDataFrame([(f"file://{tmp_path}/{i}.csv", e) for i, e in enumerate(plain)], "file_path string, encoding string")
    files = files.withColumn("file_path", F.regexp_replace("file_path", "^file:///", "file:///"))
    got = read_records(spark, str(tmp_path), sep=",", encoding=files, escape='"')
    assert got.names == ["word", "id", "extra"]
    ok = {r["id"]: (r["word"], r["extra"]) for r in got.rows.collect() if r["id"]}
    for i, word in enumerate(plain.values()):
        for k in range(30):
            assert ok[str(i * 100 + k)] == (word + "\n,", "e" if i % 2 else None)
    assert ok["150"] == (None, None) and ok["350"] == (None, None)
    assert sorted(r["n_fields"] for r in got.rejects.collect()) == [3, 3, 3, 4, 4]
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "x.csv").write_bytes(b"a,b\n1,ok\n2,\xff\xfe\n")
    values = lambda errors: [r["b"] for r in read_records(spark, str(bad), sep=",", errors=errors).rows.orderBy("a").collect()]
    assert values("replace") == ["ok", "��"] and values("ignore") == ["ok", None]
    with pytest.raises(Exception, match="is not utf-8"):
        values("strict")


def test_delimiters_headerless_and_empty(spark, tmp_path):
    for i, sep in enumerate(",;\t|"):
        (tmp_path / f"{i}.csv").write_text(f"a{sep}b\n1{sep}x\n")
    r = read_records(spark, str(tmp_path))
    assert sorted(map(tuple, r.rows.collect())) == [("1", "x")] * 4 and r.names == ["a", "b"]
    r = read_records(spark, str(tmp_path), header=False)
    assert r.names == ["Column_1", "Column_2"] and r.rows.count() == 8
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "none.csv").write_text("")
    r = read_records(spark, str(tmp_path / "sub"))
    assert r.names == [] and r.rows.count() == 0


@pytest.mark.parametrize("encoding", ["gb18030", "latin1", "utf-8", "big5"])
def test_the_plain_reader_takes_any_encoding(spark, tmp_path, encoding):
    from sluice.sources.csv import read_csv, read_csv_set
    word = "é" if encoding == "latin1" else "中文"
    (tmp_path / "a.csv").write_bytes(f"id,w\n1,{word}\n2,{word},more\n".encode(encoding))
    for read in (read_csv, read_csv_set):
        r = read(spark, str(tmp_path), encoding=encoding)
        assert [tuple(x) for x in r.rows.collect()] == [("1", word)] and r.rejects.count() == 1


def test_encodings_that_cannot_be_cut():
    assert check_encoding("GB2312") == "gb2312"
    for name in ("utf-16", "utf-32", "iso2022_jp", "hz", "utf-7"):
        with pytest.raises(ValueError):
            check_encoding(name)


def test_fields_of_a_batch_are_those_of_its_records():
    from sluice.sources.records import Dialect, _parsed
    sets = [['a,"b\nc",d', "", "x"], ['a,"open', "b,c"], ["a\rb,c", "d"], ["a\\", "b,c", '"q""r",s'], ['a,"open']]
    for found in sets:
        for escape in ("\\", '"'):
            assert _parsed([","] * len(found), found, '"', escape) == [Dialect(",", '"', escape).parse(r) for r in found]
    assert _parsed([",", ";"], ["a,b", "a;b"], '"', '"') == [["a", "b"], ["a", "b"]]


def test_base_name_without_a_pattern(spark):
    from pyspark.sql import functions as F
    from sluice.functions.humanize import base_name
    paths = ["/a/b.csv", "a\\b\\c", "", "x/", None, "é/中\nz", "plain"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", base_name(F.col("p")).alias("b"))
    assert [r["b"] for r in df.collect()] == ["b.csv", "c", "", "", None, "中\nz", "plain"]
    assert "regexp" not in df._jdf.queryExecution().analyzed().toString()
