"""Committed chunk files: whole files, one manifest, one run record, whatever happens to attempts."""
import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from sluice.operators.chunks import with_ordinal
from sluice.sinks.chunked import prepare_output
from sluice.sinks.committed import run_records, save_chunks


def listing(folder):
    return sorted(f for f in os.listdir(folder) if not f.startswith("manifest-") and not f.endswith(".crc"))


@pytest.mark.parametrize("rows,chunks", [(0, 0), (1, 1), (7, 1), (8, 2), (23, 4)])
def test_files_manifest_and_record(spark, tmp_path, rows, chunks):
    out, runs = str(tmp_path / "out"), str(tmp_path / "runs")
    df = with_ordinal(spark.range(rows).select("id", F.concat(F.lit('a,"\n'), F.col("id")).alias("t")), ["id"])
    m = save_chunks(df, out, "data", "20240105", 7, runs=runs, source="here.csv").orderBy("chunk").collect()
    assert [(r["chunk"], r["n_rows"]) for r in m] == [(i + 1, min(7, rows - 7 * i)) for i in range(chunks)]
    assert listing(out) == [f"data_20240105_{i + 1:04d}.csv" for i in range(chunks)]
    assert all(os.path.getsize(f"{out}/{r['file_name']}") == r["n_bytes"] for r in m)
    if rows:
        raw = open(f"{out}/data_20240105_0001.csv", encoding="utf-8", newline="").read()
        assert raw.startswith('﻿id,t\n0,"a,""\n0"\n')
    record = run_records(spark, runs).collect()
    assert [(r["n_rows"], r["n_files"], r["columns"], r["source"]) for r in record] == [(rows, chunks, ["id", "t"], "here.csv")]


@pytest.mark.parametrize("chunk,parts", [(7, 3), (10, 4), (3, 2), (1000, 5), (25, 4)])
def test_only_split_chunks_are_shuffled(spark, tmp_path, chunk, parts):
    from sluice.sinks.committed import _split_chunks
    df = with_ordinal(spark.range(100).select((F.col("id") % 10).alias("k"), "id"), ["k"], partitions=parts)
    order = [r["id"] for r in df.orderBy("ordinal").collect()]
    split = {r["_chunk"] for r in _split_chunks(df, "ordinal", chunk).collect()}
    held = df.select(F.spark_partition_id().alias("p"), "ordinal").collect()
    where = {}
    for r in held:
        where.setdefault((r["ordinal"] - 1) // chunk + 1, set()).add(r["p"])
    assert split == {c for c, p in where.items() if len(p) > 1}
    out = str(tmp_path / "out")
    m = save_chunks(df, out, "data", "20240105", chunk, bom=False, in_place=True).orderBy("chunk").collect()
    got = [int(line.split(",")[1]) for r in m for line in open(f"{out}/{r['file_name']}").read().splitlines()[1:]]
    assert got == order and [r["n_rows"] for r in m] == [min(chunk, 100 - chunk * i) for i in range(-(-100 // chunk))]


def test_partitions_that_are_not_consecutive_are_shuffled(spark, tmp_path):
    out = str(tmp_path / "out")
    df = with_ordinal(spark.range(50).select("id"), ["id"]).repartition(3)
    m = save_chunks(df, out, "data", "20240105", 8, in_place=True).collect()
    assert sorted(r["n_rows"] for r in m) == [2, 8, 8, 8, 8, 8, 8]


def test_a_failing_job_leaves_nothing(spark, tmp_path):
    out, runs = str(tmp_path / "out"), str(tmp_path / "runs")
    bad = F.when(F.col("id") == 90, F.raise_error(F.lit("no"))).otherwise(F.lit("x"))
    df = spark.range(100).select("id", (F.col("id") + 1).alias("ordinal")).repartition(3).withColumn("v", bad.cast("string"))
    with pytest.raises(Exception):
        save_chunks(df, out, "data", "20240105", 10, runs=runs)
    assert not os.path.exists(out) or os.listdir(out) == []
    assert not os.path.exists(runs)


RUN = """
import sys
from sluice.session import build_session
from sluice.sinks.committed import run_records, save_chunks
from pyspark.sql import functions as F
out, = sys.argv[1:]
spark = build_session("local[3,4]", shuffle_partitions=3)
df = spark.range(100).select("id", (F.col("id") + 1).alias("ordinal"))
save_chunks(df, out, "data", "20240105", 10, runs=out + "-runs")
assert run_records(spark, out + "-runs").count() == 1
"""

#: loaded by every Python process of the run: the first attempt that writes dies after a few rows
DYING = """
import os
if "PYTHON_DIES_AT" in os.environ:
    from sluice.sinks.committed import ChunkWriter
    plain = ChunkWriter.write

    def write(self, batches):
        def some():
            for batch in batches:
                yield batch.slice(0, 5)
                try:
                    os.close(os.open(os.environ["PYTHON_DIES_AT"], os.O_CREAT | os.O_EXCL))
                except FileExistsError:
                    yield batch.slice(5)
                else:
                    os._exit(1)
        return plain(self, some())
    ChunkWriter.write = write
"""


def test_a_killed_attempt_leaves_whole_files_and_one_record(tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    (tmp_path / "sitecustomize.py").write_text(DYING)
    (tmp_path / "run.py").write_text(RUN)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "PYTHONPATH": f"{tmp_path}:{root}", "PYTHON_DIES_AT": mark}
    done = subprocess.run([sys.executable, str(tmp_path / "run.py"), out], env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    assert os.path.exists(mark)
    assert listing(out) == [f"data_20240105_{i:04d}.csv" for i in range(1, 11)]
    for i in range(1, 11):
        lines = open(f"{out}/data_20240105_{i:04d}.csv", encoding="utf-8-sig").read().split()
        assert lines == ["id"] + [str(k) for k in range(10 * i - 10, 10 * i)]
    manifest = [f for f in os.listdir(out) if f.startswith("manifest-") and f.endswith(".json")]
    assert len(manifest) == 1 and len(open(f"{out}/{manifest[0]}").readlines()) == 10
    assert sum(json.loads(x)["n_rows"] for x in open(f"{out}/{manifest[0]}")) == 100


def test_clearing_the_output_folder(spark, tmp_path):
    out = tmp_path / "out"
    out.mkdir()
    (out / "old.csv").write_text("x")
    prepare_output(spark, str(out))
    assert os.listdir(out) == ["old.csv"]
    assert prepare_output(spark, str(out), clear_old=True).startswith("file:") and os.listdir(out) == []
