"""Segmented scans against plain windows, tails by seeking, counts measured by the landing write."""
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sluice.operators.runlog import progress_running, speed_moving_avg


def progress(spark, seed, n, keys=3):
    rng = np.random.default_rng(seed)
    seqs = {k: sorted(rng.choice(n * 5, n, replace=False).tolist()) for k in range(keys)}
    rows = [(f"l{k}", int(q), None if rng.random() < 0.05 else float(rng.integers(1, 900)) / 8, "x") for k in seqs for q in seqs[k]]
    return spark.createDataFrame(rows, "file_name string, seq long, speed double, note string").repartition(3)


def plain_avg(df):
    w = Window.partitionBy("file_name").orderBy("seq")
    s = F.col("speed")
    n = F.count(s).over(w.rowsBetween(-9, 0))
    recent, earlier = F.avg(s).over(w.rowsBetween(-2, 0)), F.avg(s).over(w.rowsBetween(-9, -3))
    return df.select("file_name", "seq", F.round(F.avg(s).over(w.rowsBetween(-9, 0)), 4), F.round(recent, 4),
                     F.round(F.when(n > 6, earlier).otherwise(recent), 4), (n > 6) & (recent < earlier * 0.85))


@pytest.mark.parametrize("stretch", [1, 7, 40, 100_000])
def test_moving_average_over_stretches(spark, stretch):
    df = progress(spark, 3, 120)
    got = speed_moving_avg(df, stretch=stretch).select("file_name", "seq", "avg_speed_10", "recent_avg", "earlier_avg", "slowdown")
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, plain_avg(df).collect()), key=key)


def test_one_log_of_a_million_lines(spark):
    df = spark.range(1_000_000).select(F.lit("a.log").alias("file_name"), F.col("id").alias("seq"),
                                       (F.pmod(F.xxhash64("id"), F.lit(800)) / 8).alias("speed"))
    got = speed_moving_avg(df, stretch=20_000).select("file_name", "seq", "avg_speed_10", "recent_avg", "earlier_avg", "slowdown")
    total = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64(*d.columns).cast("decimal(38,0)"))).first()
    assert total(got) == total(plain_avg(df).toDF(*got.columns))
    runs = df.select("file_name", "seq", F.lit(10).alias("rows"), (F.col("seq") % 11).alias("ok"), F.lit(0.25).alias("secs"), F.lit(10_000_000).alias("total"))
    last = progress_running(runs, "file_name", "seq", "rows", "ok", "secs", "total", stretch=30_000).orderBy(F.desc("seq")).first()
    assert (last["processed"], last["elapsed"], last["rows_per_sec"], last["eta_seconds"]) == (10_000_000, 250_000.0, 40.0, 0.0)
    assert last["inserted"] == sum(i % 11 for i in range(1_000_000))


@pytest.mark.parametrize("stretch", [3, 100_000])
def test_running_sums_over_stretches(spark, stretch):
    rows = [(f"r{k}", s, 10 + s % 7, 9, 0.5, 100000) for k in range(3) for s in range(0, 60, 1 + k)]
    df = spark.createDataFrame(rows, "run string, seq int, n long, ok long, secs double, total long")
    got = sorted((r["run"], r["seq"], r["processed"], r["inserted"], r["failed"], r["elapsed"]) for r in
                 progress_running(df, "run", "seq", "n", "ok", "secs", "total", stretch=stretch).collect())
    want = []
    for k in range(3):
        p = i = e = 0
        for r in (x for x in rows if x[0] == f"r{k}"):
            p, i, e = p + r[2], i + r[3], e + r[4]
            want.append((r[0], r[1], p, i, p - i, e))
    assert got == sorted(want)


@pytest.mark.parametrize("block", [3, 64, 1 << 16])
def test_tails_by_seeking(spark, tmp_path, block):
    from sluice.operators.runlog import log_results
    from sluice.sources.logs import read_log_tails, read_logs
    texts = {"empty": "", "one": "only", "few": "a\nb\n", "many": "".join(f"行 {i}\n" for i in range(300)), "open": "x\n" * 80 + "last",
             "crlf": "a\r\nb\r\n", "blank": "\n\n\n", "long": "y" * 5000 + "\nz\n"}
    for name, text in texts.items():
        (tmp_path / f"{name}.log").write_bytes(text.encode())
    logs = read_log_tails(spark, str(tmp_path), 50, block=block)
    got = {}
    for r in logs.lines.orderBy("line_no").collect():
        got.setdefault(r["file_name"][:-4], []).append(r["line"])
    for name, text in texts.items():
        lines = text.replace("\r\n", "\n").split("\n")
        want = (lines[:-1] if lines[-1] == "" else lines)[-50:]
        assert got.get(name, []) == want
    # Spark's listing leaves files without a byte out
    assert logs.files.count() == len(texts) - 1
    whole = read_logs(spark, str(tmp_path))
    status = lambda x: sorted((r["file_name"], r["status"]) for r in log_results(x.lines, x.files).collect())
    assert status(logs) == status(whole)


def test_import_measures_while_it_lands(spark, tmp_path):
    from sluice.operators import quality as QL
    from sluice.plans.import_file import import_csv
    (tmp_path / "in").mkdir()
    rows = "".join(f"{i},{'x' if i % 4 == 0 else i},{'longtext' if i % 10 == 0 else 'ab'}\n" for i in range(200))
    (tmp_path / "in" / "a.csv").write_text("k,qty,code\n" + rows + "1,2,3,EXTRA\n")
    res = import_csv(spark, str(tmp_path / "in"), str(tmp_path / "out"), 1, overrides={"qty": "INT", "code": "VARCHAR(3)"}, sep=",")
    landed = spark.read.parquet(str(tmp_path / "out" / "checked"))
    old, new = QL.import_report(landed, res.table_name).first(), res.report.first()
    assert all(old[c] == new[c] for c in old.asDict())
    assert new["rows_by_reason"] == {"kind": 50, "range": 0, "length": 20, "fields": 1} and new["average_speed"] > 0
    gate = QL.error_gate(landed).first()
    assert {k: gate[k] for k in ("n_rows", "n_rejected", "error_rate", "passed")} == QL.gate_of({"n_rows": 201, "n_rejected": gate["n_rejected"]})
    record = spark.read.parquet(res.runs_path).collect()
    assert len(record) == 1 and record[0]["total_rows"] == 201 and record[0]["column_types"]["qty"] == "INT"


@pytest.mark.parametrize("n,bad,passed", [(0, 0, True), (15, 10, True), (20, 11, False), (100, 50, True), (100, 51, False)])
def test_gate(n, bad, passed):
    from sluice.operators.quality import gate_of
    assert gate_of({"n_rows": n, "n_rejected": bad})["passed"] is passed
