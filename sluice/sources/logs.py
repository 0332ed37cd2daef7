"""Run-log scan (S17, S18): every ``*.log`` file as lines with file facts.

Returns ``files (file_name, file_path, size_bytes, mtime)`` and
``lines (file_name, file_path, line_no, line)``; a file is its path, since two folders may
hold the same name. Line numbers follow the file order: the
position is ``(split start, position in split)``, turned into a dense per-file number
only where an order is needed (tail, progress sequence).
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.session import qualified, staged


@dataclass
class Logs:
    files: DataFrame
    #: the lines of some paths, or of all files (None)
    read: Callable[[list[str] | None], DataFrame]

    @property
    def lines(self) -> DataFrame:
        return self.read(None)


# what Spark's file metadata escapes in a name, and what its paths take for a pattern
_ESCAPED = re.compile(r'[\x00-\x20\x7f"<>\\^`{|}%?#\[\]]')
_PATTERN = re.compile(r"([\\*?\[\]{}])")
_FOUND = "file_path string, file_name string, uri_name string, size_bytes long, mtime timestamp, folder boolean"


def _list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.fs as pafs
    from sluice.sinks.chunked import _fs_for
    schema = pa.schema([("file_path", pa.string()), ("file_name", pa.string()), ("uri_name", pa.string()), ("size_bytes", pa.int64()),
                        ("mtime", pa.timestamp("us", "UTC")), ("folder", pa.bool_())])
    for batch in batches:
        for uri in batch.column("uri").to_pylist():
            fs, local = _fs_for(uri)
            infos = [f for f in fs.get_file_info(pafs.FileSelector(local)) if not f.base_name.startswith(("_", "."))]
            found = [(f"{uri}/{f.base_name}", f.base_name, _ESCAPED.sub(lambda c: f"%{ord(c[0]):02X}", f.base_name), f.size, f.mtime, f.type == pafs.FileType.Directory) for f in infos]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*found), schema.types)], schema=schema)


def list_logs(spark: SparkSession, root: str, glob: str = "*.log", name: str = "file_name") -> DataFrame:
    """``file_name, file_path, size_bytes, mtime`` of the files under a folder that match ``glob`` (``*``, ``?``,
    ``[...]``), written: tasks list folders, level by level, so that neither the driver nor a later pass holds or
    lists the files. Empty files and names that begin with ``_`` or ``.`` are passed over, as Spark does; ``uri_name`` as ``name`` gives
    names as Spark's file metadata shows them."""
    folders = spark.range(0, 1, 1, 1).select(F.lit(qualified(spark, root).rstrip("/")).alias("uri"))
    levels = []
    while True:
        level = staged(folders.mapInArrow(_list_folders, _FOUND), "listing")
        levels.append(level.where(~F.col("folder")))
        below = level.where("folder").select(F.col("file_path").alias("uri"))
        n = below.count()
        if not n:
            break
        folders = below.repartition(min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found.where("size_bytes > 0").where(F.col("file_name").rlike(fnmatch.translate(glob).replace("\\Z", "\\z"))).select(
        F.col(name).alias("file_name"), "file_path", "size_bytes", F.col("mtime").cast("timestamp_ntz").alias("mtime"))


def read_logs(spark: SparkSession, root: str, glob: str = "*.log", encoding: str = "utf-8") -> Logs:
    files = list_logs(spark, root, glob, "uri_name")
    return Logs(files, lambda paths: _lines(spark, [_PATTERN.sub(r"\\\1", p) for p in paths] if paths else root, glob, encoding))


def _lines(spark: SparkSession, paths: str | list[str], glob: str, encoding: str) -> DataFrame:
    raw = (spark.read.option("encoding", encoding).option("pathGlobFilter", glob)
           .option("recursiveFileLookup", True).text(paths)
           .select(F.col("value").alias("line"),
                   F.col("_metadata.file_path").alias("file_path"),
                   F.col("_metadata.file_name").alias("file_name"),
                   F.col("_metadata.file_block_start").alias("_b"),
                   F.monotonically_increasing_id().alias("_pos")))
    # Dense 1-based line numbers without a per-file sort: rows per (file, split) give
    # split offsets (one row per split; the planner picks the join by its size); a line's number is its split offset + its position in the split.
    splits = (raw.groupBy("file_path", "_b")
              .agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_p0")))
    w = Window.partitionBy("file_path").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file_path", "_b", "_p0",
                           F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (raw.join(splits, ["file_path", "_b"])
            .select("file_name", "file_path", (F.col("_off") + F.col("_pos") - F.col("_p0") + 1)
                    .cast("bigint").alias("line_no"), "line"))


TAIL_BLOCK = 1 << 16


def _last_lines(fh, size: int, n: int, block: int) -> bytes:
    """The end of a file from before its ``n``-th last line on, read backwards in byte ranges."""
    parts, at, newlines = [], size, 0
    while at > 0 and newlines <= n:
        begin = max(0, at - block)
        fh.seek(begin)
        parts.append(fh.read(at - begin))
        newlines += parts[-1].count(b"\n")
        at = begin
    return b"".join(reversed(parts))


def _tail_batches(n: int, encoding: str, block: int):
    def run(frames):
        from sluice.sinks.chunked import _fs_for
        for pdf in frames:
            rows = []
            for path, name, size in zip(pdf["file_path"], pdf["file_name"], pdf["size_bytes"]):
                fs, local = _fs_for(path)
                with fs.open_input_file(local) as fh:
                    data = _last_lines(fh, size, n, block)
                lines = data.removesuffix(b"\n").split(b"\n")[-n:] if data else []
                rows += [(name, path, i - len(lines), line.removesuffix(b"\r").decode(encoding, "replace"))
                         for i, line in enumerate(lines)]
            yield pd.DataFrame(rows, columns=["file_name", "file_path", "line_no", "line"])
    return run


def read_log_tails(spark: SparkSession, root: str, n: int, glob: str = "*.log", encoding: str = "utf-8",
                   block: int = TAIL_BLOCK) -> Logs:
    """The last ``n`` lines of every log and nothing before them: files are listed without their content, and
    tasks seek back from each file's end in byte ranges until the lines are there. ``line_no`` counts from the
    end (-1 is the last line). The encoding must not hold the newline byte within a character."""
    files = list_logs(spark, root, glob)

    def tails(paths: list[str] | None) -> DataFrame:
        some = files if paths is None else files.where(F.col("file_path").isin(paths))
        dealt = some.select("file_path", "file_name", "size_bytes").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file_path")
        return dealt.mapInPandas(_tail_batches(n, encoding, block), "file_name string, file_path string, line_no long, line string")
    return Logs(files, tails)


def read_log_content(logs: Logs, file_name: str) -> DataFrame:
    """The lines, in order, of the log of that name (of each such log, where folders hold the same name); other
    logs are not opened."""
    paths = [r["file_path"] for r in logs.files.where(F.col("file_name") == file_name).select("file_path").collect()]
    if not paths:
        return logs.lines.where(F.col("file_name") == file_name).orderBy("line_no")
    return logs.read(paths).where(F.col("file_name") == file_name).orderBy("line_no")
