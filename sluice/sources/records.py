"""CSV records of big files in parallel, quoted newlines and any encoding included.

Spark's text source cuts files into byte ranges (blocks) and gives their lines as raw bytes, with the block
each line is in; a newline byte is never part of another character in the encodings accepted here, so lines
decode one by one, under a chosen error policy and without session settings. Whether a newline ends a
record depends on the quotes before it, back to the start of the file. So a first pass sums up every block
for both states it may start in (outside or inside quotes): the state it ends in and the records it ends.
A prefix scan over the blocks of a file (a table of one row a block) turns these into the true start states
and into record numbers in source order. A second pass cuts records; those that cross blocks are sent as
parts and put together, all others stay where they are: no key, no sort, no shuffle of the rows.

A field is quoted if it begins with the quote character; quotes elsewhere are text. Lines end with LF or
CR LF. Blank records are skipped. A quote that is never closed makes the rest of its file one record, as it
does for a sequential reader. Compressed files are one block each, as everywhere in Spark.
"""

from __future__ import annotations

import codecs
import csv as _csv
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.operators.columns import make_unique, normalize_names
from sluice.session import staged
from sluice.sources.csv import (DELIMITER_SAMPLE_LINES, HEADERLESS_PREFIX, PANDAS_NA_TOKENS, CsvRead,
                                delimiter_from_counts, DELIMITERS, na_to_null)

#: rows of a table of files or blocks up to which it is broadcast (about 100 MB); past it, a shuffle join
SMALL_ROWS = 1_000_000
POLICIES = ("strict", "replace", "ignore")


# ---- quotes ---------------------------------------------------------------------------

@dataclass(frozen=True)
class Dialect:
    """``escape`` equal to ``quote`` means that only doubled quotes stand for one."""

    sep: str = ","
    quote: str = '"'
    escape: str = "\\"

    def ends_inside(self, line: str, inside: bool) -> bool:
        """Whether a quoted field is open after ``line``, given whether one was before it."""
        fields, closing, rest = _patterns(self)
        at = 0
        if inside:
            m = closing.match(line)
            if m is None:
                return True
            m = rest.match(line, m.end())
            if m is None:
                return False
            at = m.end()
        at = fields.match(line, at).end()
        return line.startswith(self.quote, at) and closing.match(line, at + 1) is None

    def parse(self, record: str) -> list[str]:
        escape = None if self.escape == self.quote else self.escape
        one = lambda r: next(_csv.reader([r], delimiter=self.sep, quotechar=self.quote, escapechar=escape), [])
        try:
            return one(record)
        except _csv.Error:
            # a lone CR outside quotes is text here, which the parser refuses: another character stands in for it
            other = next(c for c in map(chr, range(0xE000, 0xF900)) if c not in record)
            return [f.replace(other, "\r") for f in one(record.replace("\r", other))]


@lru_cache(maxsize=64)
def _patterns(d: Dialect) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """Whole fields with their separators; the rest of a quoted field with its closing quote; what may
    follow that quote, up to the next separator."""
    q, s = re.escape(d.quote), re.escape(d.sep)
    if d.escape == d.quote:
        body, text = f"(?:[^{q}]|{q}{q})*+{q}", f"[^{s}]*+"
    else:
        e = re.escape(d.escape)
        body, text = f"(?:[^{q}{e}]|{e}.|{q}{q})*+{q}", f"(?:[^{s}{e}]|{e}.)*+{e}?"
    return (re.compile(f"(?:(?:{q}{body}{text}|(?!{q}){text}){s})*+", re.S), re.compile(body, re.S),
            re.compile(f"{text}{s}", re.S))


def states_after(lines: pa.Array, inside: bool, d: Dialect) -> np.ndarray:
    """Whether a quoted field is open after each line. Only lines with a quote are looked into."""
    quoted = np.flatnonzero(pc.match_substring(lines, d.quote).to_numpy(zero_copy_only=False))
    states, at = [inside], inside
    for line in lines.take(pa.array(quoted)).to_pylist():
        at = d.ends_inside(line, at)
        states.append(at)
    return np.repeat(np.array(states, dtype=bool), np.diff(np.concatenate([[0], quoted, [len(lines)]])))


# ---- lines ------------------------------------------------------------------------------

def check_encoding(name: str) -> str:
    """The canonical name of an encoding whose newline byte is in no other character."""
    known = codecs.lookup(name).name
    if "a\n".encode(known)[-2:] != b"a\n" or known.startswith(("iso2022", "hz", "utf-7")):
        raise ValueError(f"{name}: files of this encoding cannot be cut at newline bytes")
    return known


def decode_lines(raw: pa.Array, encoding: str, errors: str) -> pa.Array:
    """Lines of bytes as text. Each line starts afresh, since none is cut inside a character."""
    if encoding in ("utf-8", "utf-8-sig", "ascii"):
        try:
            return raw.cast(pa.large_string())
        except pa.ArrowInvalid:
            encoding = "utf-8"
    return pa.array([b.decode(encoding, errors) for b in raw.to_pylist()], pa.large_string())


def small(written: DataFrame) -> DataFrame:
    """A broadcast hint for a written table, once its rows are counted."""
    return F.broadcast(written) if written.count() <= SMALL_ROWS else written


def _in_order(lines: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``lines`` with the columns of a written ``table`` of files or blocks, still in source order: a broadcast
    join keeps it; past its bound rows are shuffled, a block's rows together, and sorted again."""
    if table.count() <= SMALL_ROWS:
        return lines.join(F.broadcast(table), keys, "left")
    return lines.join(table, keys, "left").sortWithinPartitions("file_path", "block", "nth")


def _one_form(path: str) -> Column:
    """``file:/x`` and ``file:///x`` name one file."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def source_lines(spark: SparkSession, paths: str | list[str], files: DataFrame | None = None,
                 encoding: str = "utf-8", sep: str = ",", with_size: bool = False) -> DataFrame:
    """``file_path, block, nth, line`` (bytes) ``, encoding, sep`` of all lines, in source order within each block.
    ``files(file_path, encoding, sep)``, if given (written), says how each file is read; a file it does
    not name is read as ``encoding`` and ``sep`` say. Spark drops a UTF-8 byte order mark: ``with_size`` adds
    ``size``, the file's, by which it can be told."""
    lines = (spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(paths)
             .select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("nth"), F.col("value").cast("binary").alias("line"),
                     *([F.col("_metadata.file_size").alias("size")] if with_size else [])))
    if files is None:
        return lines.withColumns({"encoding": F.lit(encoding), "sep": F.lit(sep)})
    named = files.select(_one_form("file_path").alias("file_path"), F.col("encoding").alias("_e"), F.col("sep").alias("_s"))
    found = _in_order(lines.withColumn("file_path", _one_form("file_path")), named, ["file_path"])
    return found.select("file_path", "block", "nth", "line", F.coalesce("_e", F.lit(encoding)).alias("encoding"),
                        F.coalesce("_s", F.lit(sep)).alias("sep"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Stretches of rows of one block."""
    path = batch.column("file_path").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    block = batch.column("block").to_numpy(zero_copy_only=False)
    if len(path):
        cut = np.flatnonzero((path[1:] != path[:-1]) | (block[1:] != block[:-1])) + 1
        yield from zip(np.concatenate([[0], cut]).tolist(), np.concatenate([cut, [len(path)]]).tolist())


def _text_of(batch: pa.RecordBatch, a: int, b: int, errors: str) -> tuple[pa.Array, str]:
    """The decoded lines of a stretch, and its separator."""
    encoding, path = batch.column("encoding")[a].as_py(), batch.column("file_path")[a].as_py()
    try:
        text = decode_lines(batch.column("line").slice(a, b - a), encoding, errors)
    except UnicodeDecodeError as e:
        raise ValueError(f"{path} is not {encoding}: {e.reason}") from e
    return text, batch.column("sep")[a].as_py()


_BLANK = r"^\s*$"


# ---- first pass: blocks -------------------------------------------------------------------

_SUMS = ("file_path string, block long, sep string, n_lines long, end_out boolean, end_in boolean, n_out long, n_in long, "
         "head string")


def _sum_up(quote: str, escape: str, errors: str):
    """One row a block: lines, and for both start states the state at its end and the records it ends.
    The first block of a file has its first record as well."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done = []
            for a, b in _runs(batch):
                key = batch.column("file_path")[a].as_py(), batch.column("block")[a].as_py()
                text, sep = _text_of(batch, a, b, errors)
                if now is None or (now["file_path"], now["block"]) != key:
                    if now:
                        done.append(now)
                    now = {"file_path": key[0], "block": key[1], "sep": sep, "n_lines": 0, "end_out": False, "end_in": True,
                           "n_out": 0, "n_in": 0, "head": None, "open": []}
                d = Dialect(sep, quote, escape)
                blank = pc.match_substring_regex(text, _BLANK).to_numpy(zero_copy_only=False)
                for end, n in (("end_out", "n_out"), ("end_in", "n_in")):
                    if end == "end_in" and now["end_in"] == was:
                        after, before = shared
                    else:
                        was = now[end]
                        after = states_after(text, was, d)
                        before = np.concatenate([[was], after[:-1]])
                        shared = after, before
                    now[n] += int((~after & ~(blank & ~before)).sum())
                    now[end] = bool(after[-1])
                    if end == "end_out" and key[1] == 0 and now["head"] is None:
                        _find_head(now, text, after, before, blank)
                now["n_lines"] += b - a
            if done:
                yield _sums(done)
        if now:
            yield _sums([now])
    return run


def _find_head(now: dict, text: pa.Array, after: np.ndarray, before: np.ndarray, blank: np.ndarray) -> None:
    """Add lines to the first record of a file until it ends."""
    begun = bool(now["open"])
    lines = np.flatnonzero(~(blank & ~before)) if not begun else np.arange(len(after))
    if not len(lines):
        return
    ends = np.flatnonzero(~after[lines[0]:])
    stop = lines[0] + ends[0] if len(ends) else len(after) - 1
    now["open"] += text.slice(lines[0], stop - lines[0] + 1).to_pylist()
    if len(ends):
        head = "\n".join(now["open"]).removeprefix("﻿")
        now["head"] = head[:-1] if head.endswith("\r") else head


def _sums(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{k: v for k, v in r.items() if k != "open"} for r in rows], schema=pa.schema([
        ("file_path", pa.string()), ("block", pa.int64()), ("sep", pa.string()), ("n_lines", pa.int64()), ("end_out", pa.bool_()),
        ("end_in", pa.bool_()), ("n_out", pa.int64()), ("n_in", pa.int64()), ("head", pa.string())]))


def blocks(lines: DataFrame, quote: str = '"', escape: str = "\\", errors: str = "strict") -> DataFrame:
    """``file_path, block, sep, n_lines, inside, n_records, base, crosses, head``, one row a block (written):
    whether it starts inside quotes, the records that start in it, how many start before it in its file,
    and whether a record crosses into or out of it."""
    if errors not in POLICIES:
        raise ValueError(f"errors must be one of {POLICIES}")
    sums = staged(lines.mapInArrow(_sum_up(quote, escape, errors), _SUMS), "blocks")
    w = Window.partitionBy("file_path").orderBy("block")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    # a block keeps the state, turns it round, or ends in the same state whatever it starts in; the state
    # before a block is that of the last block of the third kind, turned by those of the second since
    turns = (F.col("end_out") & ~F.col("end_in")).cast("int")
    fixed = F.col("end_out") == F.col("end_in")
    known = (sums.withColumn("turned", F.sum(turns).over(w))
             .withColumn("anchor", F.last(F.when(fixed, F.struct(F.col("end_out").cast("int").alias("state"), "turned")), True).over(before))
             .withColumn("so_far", F.coalesce(F.lag("turned").over(w), F.lit(0)))
             .withColumn("inside", (F.coalesce("anchor.state", F.lit(0)) + F.col("so_far") - F.coalesce("anchor.turned", F.lit(0))) % 2 == 1)
             .withColumn("leaves", F.when(F.col("inside"), F.col("end_in")).otherwise(F.col("end_out")))
             .withColumn("ended", F.when(F.col("inside"), F.col("n_in")).otherwise(F.col("n_out")))
             .withColumn("last", F.lead("block").over(w).isNull()))
    # records that start in a block: one ends that came in, one starts that leaves
    began = F.col("ended") - F.when(F.col("inside") & ~F.col("none_ends"), 1).otherwise(0) + F.when(F.col("leaves") & ~F.col("none_ends"), 1).otherwise(0)
    known = known.withColumn("none_ends", F.col("inside") & (F.col("ended") == 0)).withColumn("n_records", began)
    return staged(known.select(
        "file_path", "block", "sep", "n_lines", "inside", "n_records",
        F.coalesce(F.sum("n_records").over(before), F.lit(0)).alias("base"),
        (F.col("inside") | F.col("leaves")).alias("crosses"), "head"), "block-states")


def count_rows(spark: SparkSession, paths: str | list[str], files: DataFrame | None = None, encoding: str = "utf-8",
               sep: str = ",", escape: str = "\\", errors: str = "replace", header: bool = True) -> DataFrame:
    """``file_path, physical_rows, logical_rows`` of every file that has a line: lines and records,
    each less the header, not below 0. One pass, as many tasks as there are blocks."""
    found = blocks(source_lines(spark, paths, files, encoding, sep), escape=escape, errors=errors)
    less = 1 if header else 0
    return (found.groupBy("file_path").agg(F.sum("n_lines").alias("l"), F.sum("n_records").alias("r"))
            .select("file_path", F.greatest(F.col("l") - less, F.lit(0)).alias("physical_rows"),
                    F.greatest(F.col("r") - less, F.lit(0)).alias("logical_rows")))


# ---- second pass: records --------------------------------------------------------------------

_RECORDS = "file_path string, block long, sep string, record_no long, part int, record string"
_WHOLE, _HEAD, _TAIL, _MIDDLE = 0, 1, 2, 3


class _Cutter:
    """Cuts the lines of one block into records, over as many batches as it takes."""

    def __init__(self, path: str, block: int, sep: str, inside: bool, base: int, d: Dialect) -> None:
        self.key, self.inside, self.number, self.d = (path, block, sep), inside, base, d
        self.at_start, self.open = inside, []      # lines of a record that has not ended
        self.first = block == 0

    def feed(self, text: pa.Array) -> pa.RecordBatch:
        after = states_after(text, self.inside, self.d)
        before = np.concatenate([[self.inside], after[:-1]])
        self.inside = bool(after[-1])
        ends = np.flatnonzero(~after)
        if not len(ends):
            self.open += text.to_pylist()
            return self._batch(pa.array([], pa.large_string()), np.zeros(0, np.int64))
        starts = np.concatenate([[0], ends[:-1] + 1])
        records = text.take(pa.array(ends))
        many = starts < ends
        if self.open:
            many[0] = True
        if many.any():
            put = []
            for i in np.flatnonzero(many):
                lines = text.slice(starts[i], ends[i] - starts[i] + 1).to_pylist()
                put.append("\n".join(self.open + lines if i == 0 else lines))
            records = pc.replace_with_mask(records, pa.array(many), pa.array(put, pa.large_string()))
        part = np.zeros(len(records), dtype=np.int64)
        if self.at_start:
            part[0] = _HEAD
        self.at_start = False
        self.open = text.slice(ends[-1] + 1).to_pylist()
        # a blank line between records is none
        single = pc.match_substring_regex(records, _BLANK).to_numpy(zero_copy_only=False) & (part == _WHOLE) & ~before[starts]
        if single.any():
            records, part = records.filter(pa.array(~single)), part[~single]
        return self._batch(records, part)

    def _batch(self, records: pa.Array, part: np.ndarray) -> pa.RecordBatch:
        numbers = self.number + np.cumsum(part != _HEAD)
        self.number += int((part != _HEAD).sum())
        if self.first and len(records):
            head = records[0].as_py()
            if head.startswith("﻿"):
                records = pa.concat_arrays([pa.array([head[1:]], records.type), records.slice(1)])
            self.first = False
        if pc.any(pc.ends_with(records, "\r")).as_py():
            records = pc.replace_substring_regex(records, "\r\\z", "")
        return self._rows(records, part, numbers)

    def _rows(self, records: pa.Array, part: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
        n = len(part)
        path, block, sep = self.key
        return pa.RecordBatch.from_arrays(
            [pa.array([path] * n, pa.string()), pa.array(np.full(n, block)), pa.array([sep] * n, pa.string()),
             pa.array(numbers, pa.int64()), pa.array(part.astype(np.int32)), records.cast(pa.string())],
            names=["file_path", "block", "sep", "record_no", "part", "record"])

    def close(self) -> pa.RecordBatch:
        """What is left at the end of the block."""
        if not self.open:
            return self._batch(pa.array([], pa.large_string()), np.zeros(0, np.int64))
        kind = _MIDDLE if self.at_start else _TAIL
        return self._rows(pa.array(["\n".join(self.open)], pa.large_string()), np.array([kind]),
                          np.array([self.number + (kind == _TAIL)]))


def _cut(quote: str, escape: str, errors: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for a, b in _runs(batch):
                path, block = batch.column("file_path")[a].as_py(), batch.column("block")[a].as_py()
                text, sep = _text_of(batch, a, b, errors)
                if now is None or now.key[:2] != (path, block):
                    if now:
                        yield now.close()
                    now = _Cutter(path, block, sep, batch.column("inside")[a].as_py(), batch.column("base")[a].as_py(),
                                  Dialect(sep, quote, escape))
                yield now.feed(text)
        if now:
            yield now.close()
    return run


def records_of(stream, path: str, d: Dialect, encoding: str = "utf-8", errors: str = "strict", chunk: int = 1 << 20) -> Iterator[list[str]]:
    """The records of one open file, in order and by stretches of its lines, as :func:`records` cuts them."""
    cutter, left = _Cutter(path, 0, d.sep, False, 0, d), b""

    def text(lines: list[bytes]) -> pa.Array:
        try:
            return decode_lines(pa.array(lines, pa.large_binary()), encoding, errors)
        except UnicodeDecodeError as e:
            raise ValueError(f"{path} is not {encoding}: {e.reason}") from e
    while data := stream.read(chunk):
        *lines, left = (left + data).split(b"\n")
        if lines:
            yield cutter.feed(text(lines)).column("record").to_pylist()
    if left:
        yield cutter.feed(text([left])).column("record").to_pylist()
    yield cutter.close().column("record").to_pylist()


def records(lines: DataFrame, known: DataFrame, quote: str = '"', escape: str = "\\", errors: str = "strict") -> DataFrame:
    """``file_path, block, sep, record_no, record`` of all records; ``record_no`` counts from 1 in each file,
    in source order. ``known`` is what :func:`blocks` gave for the same lines."""
    keys = ["file_path", "block"]
    state = known.select(*keys, "inside", "base", "crosses")
    cut = lambda rows: rows.mapInArrow(_cut(quote, escape, errors), _RECORDS)
    shape = ["file_path", "block", "sep", "record_no", "record"]
    # the parts come from the few blocks that a record crosses; the others are not cut twice
    crossing = state.where("crosses")
    whole = cut(_in_order(lines, state, keys)).where(F.col("part") == _WHOLE).select(*shape)
    if crossing.isEmpty():
        return whole
    touched = _in_order(lines, crossing, keys).where(F.col("crosses"))
    parts = staged(cut(touched).where(F.col("part") != _WHOLE), "record-parts")
    order = F.struct("block", F.when(F.col("part") == _HEAD, 0).when(F.col("part") == _MIDDLE, 1).otherwise(2).alias("o"))
    w = Window.partitionBy("file_path").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = (parts.withColumn("order", order).withColumn("nth", F.count_if(F.col("part") == _TAIL).over(w))
              .groupBy("file_path", "sep", "nth").agg(
                  F.array_sort(F.collect_list(F.struct("order", "record", "record_no"))).alias("p"))
              .select("file_path", F.col("p")[0]["order"]["block"].alias("block"), "sep", F.col("p")[0]["record_no"].alias("record_no"),
                      F.regexp_replace(F.array_join(F.transform("p", lambda x: x["record"]), "\n"), "\r\\z", "").alias("record")))
    return whole.unionByName(joined.select(*shape))


def with_source_ordinal(found: DataFrame, known: DataFrame, skip: int = 1) -> DataFrame:
    """Records less the first ``skip`` of every file (its header), with ``ordinal`` from 1 over all
    files by path, in source order: offsets of files and blocks, no sort of the rows."""
    sizes = known.groupBy("file_path").agg(F.greatest(F.sum("n_records") - skip, F.lit(0)).alias("n"))
    # one row a file
    first = Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged(sizes.select("file_path", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("file_offset")), "file-offsets")
    return (found.where(F.col("record_no") > skip).join(small(offsets), "file_path")
            .withColumn("ordinal", F.col("file_offset") + F.col("record_no") - skip).drop("file_offset"))


# ---- CSV ------------------------------------------------------------------------------------------

def _parsed(seps: list[str], found: list[str], quote: str, escape: str) -> list[list[str]]:
    """The fields of each record. One parser takes them all; a record that it refuses or that runs into the next one
    gives it fewer rows than records, and each is then parsed alone."""
    if len(set(seps)) == 1:
        try:
            rows = list(_csv.reader(found, delimiter=seps[0], quotechar=quote, escapechar=None if escape == quote else escape))
        except _csv.Error:
            rows = []
        if len(rows) == len(found):
            return rows
    return [Dialect(s, quote, escape).parse(r) for s, r in zip(seps, found)]


def _fields(quote: str, escape: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _csv.field_size_limit(sys.maxsize)
        for batch in batches:
            seps = batch.column("sep").to_pylist()
            parsed = _parsed(seps, batch.column("record").to_pylist(), quote, escape)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parsed, pa.list_(pa.string()))],
                                             names=[*batch.schema.names, "fields"])
    return run


def read_records(spark: SparkSession, paths: str | list[str], sep: str | None = None, header: bool = True,
                 encoding: str | DataFrame = "utf-8", errors: str = "strict", quote: str = '"', escape: str = "\\",
                 na_tokens: list[str] | None = PANDAS_NA_TOKENS, with_source: bool = False) -> CsvRead:
    """A set of CSV files, each by its own header, delimiter and encoding, in one read.

    ``encoding`` is one name or a table ``(file_path, encoding)`` such as the census gives. Columns are united
    by normalised name, columns that a file lacks are null; short rows are padded with null and rows of more
    fields than their file's header go to the rejects. ``with_source`` adds ``file_path, record_no`` and
    ``ordinal`` (over all files by path, in source order). Only distinct headers reach the driver."""
    if isinstance(encoding, DataFrame):
        names = {r["encoding"] for r in encoding.select("encoding").distinct().collect()}
        canonical = F.create_map(*[F.lit(x) for n in sorted(names) for x in (n, check_encoding(n))]) if names else None
        files = encoding.select("file_path", (canonical[F.col("encoding")] if names else F.col("encoding")).alias("encoding"))
    else:
        files, encoding = None, check_encoding(encoding)
    if sep is None:
        files = _with_delimiters(spark, paths, files, encoding)
    elif files is not None:
        files = staged(files.withColumn("sep", F.lit(sep)), "files")
    lines = source_lines(spark, paths, files, encoding if isinstance(encoding, str) else "utf-8", sep or ",")
    known = blocks(lines, quote, escape, errors)
    found = records(lines, known, quote, escape, errors)

    if not known.groupBy("file_path").agg(F.sum("n_records").alias("n"), F.max("head").alias("head")).where("n > 0 and head is null").isEmpty():
        raise ValueError("a file's first record is not within its first block")
    # the distinct headers (without headers: widths), by the first file that has each
    heads = known.where(F.col("head").isNotNull()).select("file_path", "sep", F.col("head").alias("record"))
    heads = heads.mapInArrow(_fields(quote, escape), "file_path string, sep string, record string, fields array<string>")
    heads = staged(heads.select("file_path", (F.col("fields") if header else F.array(F.size("fields").cast("string"))).alias("title")), "heads")
    kinds = [r["title"] for r in heads.groupBy("title").agg(F.min("file_path").alias("first")).orderBy("first").collect()]
    titles = kinds if header else [[f"{HEADERLESS_PREFIX}{i + 1}" for i in range(int(k[0]))] for k in kinds]
    named = [make_unique(normalize_names(t)) for t in titles]
    columns = list(dict.fromkeys(n for ns in named for n in ns))
    original = dict(pair for ns, ts in reversed(list(zip(named, titles))) for pair in zip(ns, ts))

    rows = with_source_ordinal(found, known, 1 if header else 0)
    shape = rows.schema.simpleString()[len("struct<"):-1].replace(":", " ")
    rows = rows.mapInArrow(_fields(quote, escape), f"{shape}, fields array<string>")
    if len(kinds) > 1:
        number = F.array_position(F.array(*[F.array(*[F.lit(x) for x in k]) for k in kinds]), F.col("title")).cast("int") - 1
        rows = rows.join(small(staged(heads.select("file_path", number.alias("kind")), "file-kinds")), "file_path")
    else:
        rows = rows.withColumn("kind", F.lit(0))
    by_kind = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("kind") + 1)
    width = by_kind([len(t) for t in titles]) if kinds else F.lit(0)
    long_row = F.size("fields") > width

    def column(name: str):
        at = [ns.index(name) + 1 if name in ns else None for ns in named]
        place = F.lit(at[0]) if len(set(at)) == 1 else F.element_at(F.array(*[F.lit(a).cast("int") for a in at]), F.col("kind") + 1)
        value = F.try_element_at("fields", place)
        return (na_to_null(value, na_tokens) if na_tokens else value).alias(name)

    extra = ["file_path", "record_no", "ordinal"] if with_source else []
    good = rows.where(~long_row).select(*[column(c) for c in columns], *extra)
    rejects = rows.where(long_row).select("file_path", "record", F.size("fields").alias("n_fields"), F.slice("fields", 1, width).alias("fields"))
    return CsvRead(good, rejects, [original[c] for c in columns], columns)


def _with_delimiters(spark: SparkSession, paths, files: DataFrame | None, encoding) -> DataFrame:
    """``files`` with the delimiter that the first lines of each file show."""
    base = source_lines(spark, paths, None if files is None else staged(files.withColumn("sep", F.lit(",")), "files"),
                        encoding if isinstance(encoding, str) else "utf-8")
    first = base.where(F.col("block") == 0).mapInArrow(
        _first_lines(DELIMITER_SAMPLE_LINES), "file_path string, encoding string, first_lines array<string>")
    text = F.array_join(F.filter("first_lines", lambda x: F.trim(x) != ""), "")
    counts = [F.length(text) - F.length(F.replace(text, F.lit(d), F.lit(""))) for d in DELIMITERS]
    return staged(first.withColumn("sep", delimiter_from_counts(counts)).select("file_path", "encoding", "sep"), "files")


def _first_lines(n: int):
    """The first lines of each file's first block; later lines are passed over undecoded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, got = None, []

        def row():
            return pa.RecordBatch.from_pylist([{"file_path": now[0], "encoding": now[1], "first_lines": got}], schema=pa.schema(
                [("file_path", pa.string()), ("encoding", pa.string()), ("first_lines", pa.list_(pa.string()))]))
        for batch in batches:
            for a, b in _runs(batch):
                key = batch.column("file_path")[a].as_py(), batch.column("encoding")[a].as_py()
                if key != now:
                    if now:
                        yield row()
                    now, got = key, []
                if len(got) < n:
                    got += decode_lines(batch.column("line").slice(a, min(b - a, n - len(got))), key[1], "replace").to_pylist()
        if now:
            yield row()
    return run
