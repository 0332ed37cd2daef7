"""Token counts by separator scan over flat, unindexed token files.

A token file is a bare run of little-endian ids; a document ends with the end-of-document id.
Files are cut into blocks of whole ids that tasks read by range. One vectorised comparison finds
a block's separators; the block reports how many there are, where the first and last stand, and
the lengths of the documents that begin and end inside it. Boundaries are stitched by a prefix
scan over the blocks of a file (a few numbers each): the running count of separators numbers the
documents, and the last separator before a block gives the length of the document that reaches
into it.

Defined cases: an empty file has no documents; two separators in a row are a document of 0
tokens; ids after the last separator are a last document with ``ended`` false. A file whose size
is no multiple of the id width is refused. ``write_token_files`` turns null and empty texts into
documents of 0 tokens; repeated rows are separate documents. An empty table gives no rows; a text of any length is
counted whole, over as many blocks as it takes; only ``doc_id`` and ``text`` are read, whatever else there is.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm import words as W
from sluice.llm.base import stage
from sluice.session import scratch_path

#: bytes of a block
BLOCK = 4 << 20
END = 65535
TYPE = "<u2"


def _open(path: str):
    from pyarrow.fs import FileSystem
    return FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _write_batches(folder: str, end: int):
    """Word ids (hash modulo the separator) of each text, one flat file a task."""
    def run(batches):
        task = TaskContext.get()
        name = f"tokens-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        fs, at = _open(f"{folder}/{name}")
        fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
        number = 0
        with fs.open_output_stream(at) as out:
            for batch in batches:
                for c in W.chunks(batch.column("text")):
                    ids = (c.hashes % np.uint64(end)).astype(TYPE)
                    out.write(np.insert(ids, c.first[1:], end).tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n, pa.string()), pa.array(np.arange(number, number + n)), batch.column("doc_id")],
                    names=["file", "number", "doc_id"])
                number += n
    return run


def write_token_files(documents: DataFrame, folder: str, end: int = END) -> DataFrame:
    """Write ``documents`` as flat files of word ids; returns ``file, number, doc_id``. Names
    carry the task attempt, so a retried task cannot mix its file with another's: only files
    that the result names count."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return stage(documents.select("doc_id", "text").mapInArrow(
        _write_batches(folder, end), f"file string, number long, doc_id {kind}"), "manifest")


def token_blocks(spark: SparkSession, folder: str, block: int = BLOCK, width: int = 2) -> DataFrame:
    """``path, file, block, start, size`` for every block of the files in a folder."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)
             .select("path", "length").where("length > 0"))
    step = block // width * width
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.posexplode(
        F.sequence(F.lit(0), F.col("length") - 1, F.lit(step))).alias("block", "start")).select(
        "path", "file", "block", "start", F.least(F.lit(step), F.col("length") - F.col("start")).alias("size"))


def _scan_batches(end: int, kind: str):
    width = np.dtype(kind).itemsize

    def run(frames):
        for pdf in frames:
            rows = []
            for path, file, block, start, size in pdf[["path", "file", "block", "start", "size"]].itertuples(index=False):
                if size % width:
                    raise ValueError(f"{path}: not a whole number of ids")
                fs, at = _open(path)
                with fs.open_input_file(at) as f:
                    ids = np.frombuffer(f.read_at(int(size), int(start)), dtype=kind)
                base = int(start) // width
                stops = np.flatnonzero(ids == end) + base
                rows.append((file, block, base, len(ids), len(stops), int(stops[0]) if len(stops) else None,
                             int(stops[-1]) if len(stops) else None, (np.diff(stops) - 1).astype(np.int64).tolist()))
            yield pd.DataFrame(rows, columns=["file", "block", "base", "n", "stops", "first", "last", "inside"]).astype(
                {"first": "Int64", "last": "Int64"})
    return run


def count_tokens(blocks: DataFrame, end: int = END, kind: str = TYPE) -> DataFrame:
    """``file, number, n_tokens, ended`` for every document of the files."""
    parts = max(1, blocks.sparkSession.sparkContext.defaultParallelism)
    scans = stage(blocks.repartition(4 * parts, "file", "block").mapInPandas(
        _scan_batches(end, kind), "file string, block int, base long, n long, stops long, first long, last long, "
                                  "inside array<long>"), "scans")
    past = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # the scan carries a few numbers per block; document lengths stay where they are
    stitched = (scans.select("file", "block", "base", "n", "stops", "first", "last")
                .withColumn("number", F.coalesce(F.sum("stops").over(past), F.lit(0)))
                .withColumn("before", F.coalesce(F.max("last").over(past), F.lit(-1)))
                .withColumn("tail", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("block"))) == 1))
    across = stitched.where("stops > 0").select("file", "number", (F.col("first") - F.col("before") - 1).alias("n_tokens"),
                                                F.lit(True).alias("ended"))
    inside = (scans.where("stops > 1").select("file", "block", F.posexplode("inside").alias("at", "n_tokens"))
              .join(stitched.select("file", "block", "number"), ["file", "block"])
              .select("file", (F.col("number") + F.col("at") + 1).alias("number"), "n_tokens", F.lit(True).alias("ended")))
    stop = F.coalesce(F.col("last"), F.col("before"))
    rest = (stitched.where("tail").select("file", (F.col("number") + F.col("stops")).alias("number"),
                                          (F.col("base") + F.col("n") - stop - 1).alias("n_tokens"),
                                          F.lit(False).alias("ended")).where("n_tokens > 0"))
    return across.unionByName(inside).unionByName(rest)


def document_token_counts(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_tokens`` (words) of every row, through flat files in the shared scratch folder."""
    spark = documents.sparkSession
    folder = scratch_path(spark, "llm-tokens")
    manifest = write_token_files(documents, folder)
    if manifest.isEmpty():
        return manifest.select("doc_id", F.lit(0).cast("long").alias("n_tokens"))
    blocks = token_blocks(spark, folder, block).join(manifest.select("file").distinct(), "file", "left_semi")
    return count_tokens(blocks).join(manifest, ["file", "number"]).select("doc_id", "n_tokens")


def oracle() -> str:
    return r"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents"""
