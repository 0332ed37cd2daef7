import os

import pytest
from pyspark.sql import functions as F

from sluice.operators.chunks import chunk_manifest, with_ordinal
from sluice.session import local_path, scratch_path
from sluice.sinks.chunked import write_chunks

N = 7


@pytest.mark.parametrize("rows,chunks", [(0, 0), (1, 1), (N - 1, 1), (N, 1), (N + 1, 2), (3 * N, 3)])
def test_chunk_counts(spark, rows, chunks):
    df = spark.range(rows).select((F.col("id") * 3).alias("id"))
    o = with_ordinal(df, ["id"], partitions=4)
    got = {r.ordinal: r.id for r in o.collect()}
    assert got == {i + 1: 3 * i for i in range(rows)}
    m = chunk_manifest(o, N, "stem", "20240105").collect()
    assert len(m) == chunks
    sizes = sorted((r.chunk, r.n_rows) for r in m)
    assert all(n == N for _, n in sizes[:-1])
    assert sum(n for _, n in sizes) == rows
    if m:
        assert sorted(r.file_name for r in m)[0] == "stem_20240105_0001.csv"


def test_write_chunks_files(spark):
    out = scratch_path(spark, "t-chunks")
    df = spark.range(3 * N + 2).select(F.col("id").alias("k"), F.concat(F.lit("v,\""), F.col("id")).alias("v"))
    man = write_chunks(with_ordinal(df, ["k"], partitions=3), out, "data", "20240105", N).collect()
    names = sorted(r.file_name for r in man)
    assert names == [f"data_20240105_{i:04d}.csv" for i in range(1, 5)]
    files = sorted(f for f in os.listdir(local_path(out)) if not f.startswith("."))
    assert files == names
    with open(os.path.join(local_path(out), names[0]), "rb") as fh:
        raw = fh.read()
    assert raw.startswith(b"\xef\xbb\xbfk,v\n0,\"v,\"\"0\"\n")
    back = (spark.read.option("header", True).option("escape", '"').option("multiLine", True)
            .csv(f"{out}/*.csv").orderBy(F.col("k").cast("int")).collect())
    assert [r.v for r in back] == [f'v,"{i}' for i in range(3 * N + 2)]


def test_xlsx_chunks_roundtrip(spark):
    from sluice.sources.workbook import read_workbooks
    out = scratch_path(spark, "t-xlsx")
    df = spark.range(2 * N + 1).select(F.col("id").alias("k"), F.format_string("r%d", "id").alias("v"))
    write_chunks(with_ordinal(df, ["k"], partitions=2), out, "wb", "20240105", N, fmt="xlsx").collect()
    rows = read_workbooks(spark, out).table
    got = sorted((int(r.k), r.v) for r in rows.collect())
    assert got == [(i, f"r{i}") for i in range(2 * N + 1)]


def test_workbooks_follow_their_own_headers(spark):
    from sluice.sources.workbook import read_workbooks
    out = scratch_path(spark, "t-xlsx-heads")
    write = lambda rows, names, stem: write_chunks(
        with_ordinal(spark.createDataFrame(rows, names), [names.split(" ")[0]], partitions=1), out, stem, "20240105", N,
        fmt="xlsx").collect()
    write([("1", "2")], "a string, b string", "x1")
    write([("20", "10", "30")], "b string, a string, c string", "x2")
    import io
    import zipfile
    from pathlib import Path
    folder = Path(out.removeprefix("file:"))
    old = sorted(folder.glob("*.xlsx"))[0].read_bytes()
    blank = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(old)) as z, zipfile.ZipFile(blank, "w") as w:
        for n in z.namelist():
            empty = b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData/></worksheet>'
            w.writestr(n, empty if n.startswith("xl/worksheets/") else z.read(n))
    (folder / "x3.xlsx").write_bytes(blank.getvalue())
    r = read_workbooks(spark, out)
    assert r.header == ["a", "b", "c"]
    assert sorted(tuple(x) for x in r.table.collect()) == [("1", "2", None), ("10", "20", "30")]
    assert sorted((x.n_rows, x.status) for x in r.status.collect()) == [(0, "empty"), (1, "ok"), (1, "ok")]
