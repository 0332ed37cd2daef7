"""Import path: long rows, inferred types, exact numbers, long texts, landing, encodings of paths."""
import pytest
from pyspark.sql import functions as F

from sluice.functions.clean import python_float_text
from sluice.operators.quality import check_types
from sluice.plans.import_file import import_csv
from sluice.sources.csv import count_fields, read_csv


def _write(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(folder)


def test_long_rows_reach_rejects_and_report(spark, tmp_path):
    land = _write(tmp_path / "in", "a.csv", "k,qty,d\n1,5,x\n2,6,y,EXTRA\n3,7,z\n")
    r = read_csv(spark, land, sep=",")
    assert (r.rows.count(), r.rejects.count()) == (2, 1)
    assert spark.conf.get("spark.sql.csv.parser.columnPruning.enabled") == "true"
    res = import_csv(spark, land, str(tmp_path / "out"), 1, enforce_gate=False, sep=",")
    rep = res.report.first()
    assert (rep["total_rows"], rep["error_rows"]) == (3, 1)
    assert spark.read.parquet(res.accepted_path).count() == 2
    bad = spark.read.parquet(res.rejected_path).first()["errors"][0]
    assert bad["reason"] == "fields" and "EXTRA" in bad["value"]


def test_types_are_inferred_from_clean_values(spark, tmp_path):
    land = _write(tmp_path / "in", "orders.csv", "k,qty,pct,d,note\n1,5,50%,2024-01-05,ab\n2,6,25%,2024-01-06,c\n")
    res = import_csv(spark, land, str(tmp_path / "out"), 1, sep=",")
    types = {r["current"]: r["sql_type"] for r in res.mapping.collect()}
    assert types["qty"] == "TINYINT UNSIGNED" and types["pct"].startswith("DECIMAL") and types["d"] == "DATE"
    rows = spark.read.parquet(res.accepted_path).orderBy("k").collect()
    assert [r["qty"] for r in rows] == [5, 6] and str(rows[0]["d"]) == "2024-01-05" and rows[1]["note"] == "c"
    assert "*" not in res.table_name and "__" not in res.table_name


def test_whole_numbers_stay_exact_and_overflow_is_a_reject(spark):
    big = [9007199254740993, -9223372036854775808, 9223372036854775807]
    df = spark.createDataFrame([(b, str(b)) for b in big] + [(1, "9223372036854775808"), (2, "99999999999999999999999")],
                               "n long, t string")
    out = check_types(df, {"n": "BIGINT", "t": "BIGINT"})
    got = sorted((r["n"], r["t"]) for r in out.accepted.collect())
    # the cleaning rule reads a leading minus as a sign
    assert got == sorted((b, b) for b in big)
    assert {e["reason"] for r in out.rejected.collect() for e in r["errors"]} == {"range"}
    assert out.rejected.count() == 2


def test_long_text_is_not_cut(spark):
    df = spark.createDataFrame([("x" * 70000, "y" * 70000)], "a string, b string")
    out = check_types(df, {"a": "MEDIUMTEXT", "b": "TEXT"})
    assert out.accepted.count() == 0
    assert [(e["column"], e["reason"]) for e in out.rejected.first()["errors"]] == [("b", "length")]
    assert check_types(df.select("a"), {"a": "MEDIUMTEXT"}).accepted.select(F.length("a")).first()[0] == 70000


@pytest.mark.parametrize("x", [12345678.9, 0.0001, 1e-5, 1e16, 123456789012.25, 5.0, -0.5, 2.5e-7, 1.5e300])
def test_numbers_print_like_python(spark, x):
    assert spark.range(1).select(python_float_text(F.lit(x))).first()[0] == str(x)


def test_long_quoted_field_does_not_recurse(spark):
    record = 'a,"' + "x" * 1_000_000 + '",b'
    df = spark.createDataFrame([(record,)], "r string")
    assert df.select(count_fields(F.col("r"), ",")).first()[0] == 3


def test_landing_routes_long_rows_and_repeats_nothing(spark, tmp_path):
    from sluice.streaming.landing import start_landing_import
    land = _write(tmp_path / "in", "a.csv", "id,qty\n1,5\n2,7,EXTRA\n3,900\n")
    args = (spark, land, ["id", "qty"], {"qty": "TINYINT UNSIGNED"}, str(tmp_path / "out"), str(tmp_path / "ck"))
    start_landing_import(*args).awaitTermination()
    start_landing_import(*args).awaitTermination()
    count = lambda n: spark.read.parquet(f"{tmp_path}/out/{n}").count()
    assert (count("accepted"), count("rejected"), count("long_rows")) == (1, 1, 1)


def test_landing_finds_columns_by_name(spark, tmp_path):
    from sluice.streaming.landing import start_landing_import
    land = _write(tmp_path / "in", "a.csv", "id,code\n1,x\n")
    _write(tmp_path / "in", "b.csv", 'code,id,more\n"y\nz",2,ignored\n')
    _write(tmp_path / "in", "c.csv", "id\n3\n")
    out = str(tmp_path / "out")
    start_landing_import(spark, land, ["id", "code"], {"id": "INT"}, out, str(tmp_path / "ck"), max_files_per_trigger=2).awaitTermination()
    got = spark.read.parquet(f"{out}/accepted").select("id", "code").collect()
    assert sorted((r["id"], r["code"]) for r in got) == [(1, "x"), (2, "y\nz"), (3, None)]


def test_logs_of_equal_name_in_two_folders(spark, tmp_path):
    from sluice.sources.logs import read_logs
    for d in ("a", "b"):
        _write(tmp_path, f"{d}/x.log", f"one {d}\ntwo {d}\n")
    logs = read_logs(spark, str(tmp_path))
    assert sorted((r["file_path"][-7:], r["line_no"]) for r in logs.lines.collect()) == [
        ("a/x.log", 1), ("a/x.log", 2), ("b/x.log", 1), ("b/x.log", 2)]


def test_fit_check_runs_each_rule_once(spark):
    df = spark.createDataFrame([("1", "2", "3", "4")], "a string, b string, c string, d string")
    out = check_types(df, {"a": "INT", "b": "DECIMAL(8,2)", "c": "VARCHAR(3)", "d": "DATE"})
    plan = out.accepted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") + plan.count("regexp_extract") < 40 * 4


def test_encoding_of_the_whole_file_decides(spark, tmp_path):
    from sluice.sources.encoding import encoding_census, read_csv_by_encoding
    files = {"late.csv": b"a,b\n" + b"1,x\n" * 20000 + "2,中文\n".encode("gb18030"), "bom.csv": "﻿a,b\n3,é\n".encode(),
             "none.csv": b"a,b\n4,\xff\xfe\n"}
    folder = tmp_path / "enc"
    folder.mkdir()
    for name, data in files.items():
        (folder / name).write_bytes(data)
    census = encoding_census(spark, str(folder), candidates=["utf-8", "gb18030"], errors="replace")
    got = {r["file_path"].rsplit("/", 1)[1]: (r["encoding"], r["decoded_ok"]) for r in census.collect()}
    assert got == {"late.csv": ("gb18030", True), "bom.csv": ("utf-8-sig", True), "none.csv": ("utf-8", False)}
    with pytest.raises(ValueError, match="1 files"):
        read_csv_by_encoding(spark, census, sep=",")
    rows = read_csv_by_encoding(spark, census, errors="ignore", sep=",")
    assert rows.where("b = '中文'").count() == 1 and rows.count() == 20003


def test_each_file_follows_its_own_header(spark, tmp_path):
    from sluice.sources.csv import read_csv_set
    land = _write(tmp_path / "in", "1.csv", "a,b\n1,2\n")
    _write(tmp_path / "in", "2.csv", "b;a;c\n20;10;30\n")
    r = read_csv_set(spark, land)
    assert r.names == ["a", "b", "c"]
    assert sorted(tuple(x) for x in r.rows.collect()) == [("1", "2", None), ("10", "20", "30")]
    res = import_csv(spark, land, str(tmp_path / "out"), 1)
    assert spark.read.parquet(res.accepted_path).count() == 2


def test_encodings_keep_own_headers_and_long_rows(spark, tmp_path):
    from sluice.sources.encoding import encoding_census, read_csv_set_by_encoding
    folder = tmp_path / "mixed"
    folder.mkdir()
    for name, text, enc in (("1.csv", "a,b\n1,é\n2,é,x\n", "utf-8"), ("2.csv", "b;a\né;3\n", "utf-8"),
                            ("3.csv", "a,b,c\n4,中文,5\n", "gb18030"), ("4.csv", "b,a\n中文,6\n中文,7,8\n", "gb18030")):
        (folder / name).write_bytes(text.encode(enc))
    r = read_csv_set_by_encoding(spark, encoding_census(spark, str(folder)))
    assert sorted((x.a, x.b, x.c) for x in r.rows.collect()) == [
        ("1", "é", None), ("3", "é", None), ("4", "中文", "5"), ("6", "中文", None)]
    assert sorted((x.record, x.n_fields) for x in r.rejects.collect()) == [("2,é,x", 3), ("中文,7,8", 3)]


def test_import_cleans_and_profiles_once(spark, tmp_path, monkeypatch):
    from sluice.operators import quality
    from sluice.plans import import_file
    calls, clean = [], quality.clean_columns
    for module in (quality, import_file):
        monkeypatch.setattr(module, "clean_columns", lambda *a, **k: (calls.append(1), clean(*a, **k))[1], raising=False)
    land = _write(tmp_path / "in", "a.csv", "k,qty,none,d\n1,5,,2024-01-05\n2,x,,2024-01-06\n3,7,,\n4,8,,2024-01-07,EXTRA\n")
    res = import_csv(spark, land, str(tmp_path / "out"), 1, overrides={"qty": "INT"}, enforce_gate=False, sep=",")
    assert len(calls) == 1
    assert res.mapping.inputFiles() and not any(f.endswith(".csv") for f in res.mapping.inputFiles())
    rows = spark.read.parquet(res.accepted_path).orderBy("k").collect()
    assert [(r["k"], r["qty"], str(r["d"])) for r in rows] == [(1, 5, "2024-01-05"), (3, 7, "None")]
    assert sorted(e["reason"] for r in spark.read.parquet(res.rejected_path).collect() for e in r["errors"]) == ["fields", "kind"]
