"""Chunk files with a commit (K4-K6, K9): a Spark data source whose commit message is the manifest.

Tasks write whole chunks under names of their own in a folder of the run; nothing is visible under a chunk's
name until all tasks have ended well. Then the commit gives the files of the winning attempts their names, writes
the manifest, one run record, and clears the run's folder; files of attempts that were lost, doubled or killed go
with it. If the job fails, the abort clears the folder and nothing else has happened. A manifest is written last:
whoever finds it finds all its files.

Every chunk is in one partition and is written row by row as batches arrive. The commit gives names one file
after the other, as a Hadoop job commit does.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from sluice.operators.chunks import CHUNK_NAME_FORMAT, chunk_id
from sluice.session import qualified, staged
from sluice.sinks.chunked import BOM, _fs_for

FORMAT = "sluice_chunk_files"
MANIFEST = "run string, chunk int, file_name string, n_rows long, n_bytes long"
RUNS = "run string, source string, target string, n_rows long, n_files long, n_columns int, columns array<string>, recorded_at string"


@dataclass
class ChunkMessage(WriterCommitMessage):
    """What one task has written: chunk, temporary name, rows, bytes."""

    files: list[tuple[int, str, int, int]] = field(default_factory=list)


class ChunkFiles(DataSource):
    """Options: path, stem, day, run; header, bom, encoding; runs, source, target for the run record.
    The first column is the chunk number, the others are written as text."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> "ChunkWriter":
        return ChunkWriter(dict(self.options), [f.name for f in schema.fields[1:]])


class ChunkWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], columns: list[str]) -> None:
        self.options, self.columns = options, columns

    def _place(self):
        fs, root = _fs_for(self.options["path"])
        return fs, root, f"{root}/_temporary/{self.options['run']}"

    def _yes(self, option: str) -> bool:
        return self.options.get(option, "true").lower() == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> ChunkMessage:
        fs, _, temporary = self._place()
        fs.create_dir(temporary, recursive=True)
        mine, encoding = uuid.uuid4().hex, self.options.get("encoding", "utf-8")
        done, chunk, stream, size, rows = [], None, None, 0, 0

        def put(text: str) -> None:
            nonlocal size
            data = text.encode(encoding)
            stream.write(data)
            size += len(data)

        def close() -> None:
            if stream is not None:
                stream.close()
                done.append((chunk, f"{mine}-{chunk}", rows, size))

        try:
            for batch in iterator:
                frame = batch.to_pandas()
                for number, part in frame.groupby(frame.columns[0], sort=False):
                    if number != chunk:
                        close()
                        chunk, size, rows = int(number), 0, 0
                        stream = fs.open_output_stream(f"{temporary}/{mine}-{chunk}")
                        put((BOM if self._yes("bom") else "")
                            + (pd.DataFrame(columns=self.columns).to_csv(index=False) if self._yes("header") else ""))
                    put(part[self.columns].to_csv(index=False, header=False))
                    rows += len(part)
            close()
        except BaseException:
            if stream is not None:
                stream.close()
            raise
        return ChunkMessage(done)

    def commit(self, messages: list[ChunkMessage | None]) -> None:
        fs, root, temporary = self._place()
        o, lines = self.options, []
        for message in messages:
            for chunk, name, rows, size in message.files if message else ():
                final = CHUNK_NAME_FORMAT % (o["stem"], o["day"], chunk, o.get("ext", "csv"))
                fs.move(f"{temporary}/{name}", f"{root}/{final}")
                lines.append({"run": o["run"], "chunk": chunk, "file_name": final, "n_rows": rows, "n_bytes": size})
        lines.sort(key=lambda x: x["chunk"])
        self._clear(fs, root, temporary)
        if o.get("runs"):
            rfs, rroot = _fs_for(o["runs"])
            rfs.create_dir(rroot, recursive=True)
            record = {"run": o["run"], "source": o.get("source", ""), "target": o.get("target", o["path"]),
                      "n_rows": sum(x["n_rows"] for x in lines), "n_files": len(lines), "n_columns": len(self.columns),
                      "columns": self.columns, "recorded_at": time.strftime("%Y-%m-%d %H:%M:%S")}
            with rfs.open_output_stream(f"{rroot}/run_{o['run']}.json") as out:
                out.write((json.dumps(record, ensure_ascii=False) + "\n").encode())
        with fs.open_output_stream(f"{root}/{manifest_name(o['run'])}") as out:
            out.write("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in lines).encode())

    def abort(self, messages: list[ChunkMessage | None]) -> None:
        self._clear(*self._place())

    @staticmethod
    def _clear(fs, root: str, temporary: str) -> None:
        import pyarrow.fs as pafs
        if fs.get_file_info(temporary).type != pafs.FileType.NotFound:
            fs.delete_dir(temporary)
        parent = f"{root}/_temporary"
        if fs.get_file_info(parent).type == pafs.FileType.Directory and not fs.get_file_info(pafs.FileSelector(parent)):
            fs.delete_dir(parent)


def manifest_name(run: str) -> str:
    return f"manifest-{run}.json"


def save_chunks(df: DataFrame, out_dir: str, stem: str, day: str, chunk_rows: int, ordinal: str = "ordinal",
                bom: bool = True, header: bool = True, encoding: str = "utf-8", runs: str | None = None,
                source: str = "", target: str | None = None, partitions: int | None = None,
                in_place: bool = False) -> DataFrame:
    """K4/K5: ``df`` (with a 1-based ``ordinal``) as committed chunk files; the manifest ``(run, chunk, file_name,
    n_rows, n_bytes)``. With ``runs`` the commit adds one run record there (K9), see :func:`run_records`.

    ``in_place`` is for frames whose partitions hold consecutive ordinals and that are cheap to read again, as
    ``with_ordinal`` gives them: only rows of chunks that lie in two partitions are shuffled then."""
    spark = df.sparkSession
    spark.dataSource.register(ChunkFiles)
    out_dir = qualified(spark, out_dir)
    run = uuid.uuid4().hex[:12]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunk = chunk_id(F.col(ordinal), chunk_rows).alias("_chunk")
    text = [F.col(f"`{c}`").cast("string").alias(c) for c in df.columns if c != ordinal]
    # sorted with the ordinal, which is then dropped: a projection keeps the order
    rows = df.select(chunk, F.col(ordinal).alias("_ord"), *text)
    apart = lambda d: d.repartition(n, "_chunk").sortWithinPartitions("_chunk", "_ord")
    split = _split_chunks(df, ordinal, chunk_rows) if in_place else None
    if split is None:
        placed = apart(rows)
    else:
        marked = rows.join(F.broadcast(split), "_chunk", "left")
        placed = (marked.where("_split is null").drop("_split").sortWithinPartitions("_chunk", "_ord")
                  .unionByName(apart(marked.where("_split").drop("_split"))))
    placed = placed.drop("_ord")
    options = {"path": out_dir, "stem": stem, "day": day, "run": run, "bom": str(bom).lower(), "header": str(header).lower(),
               "encoding": encoding, "source": source, "target": target or out_dir}
    if runs:
        options["runs"] = qualified(spark, runs)
    placed.write.format(FORMAT).options(**options).mode("append").save()
    return spark.read.schema(MANIFEST).json(f"{out_dir}/{manifest_name(run)}")


def _split_chunks(df: DataFrame, ordinal: str, chunk_rows: int) -> DataFrame | None:
    """``_chunk, _split`` (true) of the chunks that lie in several partitions, at most two a partition; None if
    some partition's ordinals are not consecutive."""
    o = F.col(ordinal)
    parts = staged(df.groupBy(F.spark_partition_id().alias("part")).agg(F.min(o).alias("lo"), F.max(o).alias("hi"), F.count("*").alias("n")), "parts")
    if not parts.where("hi - lo + 1 <> n").isEmpty():
        return None
    last = parts.agg(F.max("hi")).first()[0]
    begins = parts.where((F.col("lo") - 1) % chunk_rows != 0).select(chunk_id(F.col("lo"), chunk_rows).alias("_chunk"))
    ends = parts.where((F.col("hi") % chunk_rows != 0) & (F.col("hi") != F.lit(last))).select(chunk_id(F.col("hi"), chunk_rows).alias("_chunk"))
    return begins.unionByName(ends).distinct().withColumn("_split", F.lit(True))


def run_records(spark, runs: str) -> DataFrame:
    """K9: the records of all committed runs."""
    return spark.read.schema(RUNS).json(f"{qualified(spark, runs)}/run_*.json")
