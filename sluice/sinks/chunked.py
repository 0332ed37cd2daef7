"""Chunked export (K4, K5, K6): one file per chunk of at most N rows, exact names
``<stem>_<yyyymmdd>_<%04d>.<ext>``, header in every file, optional UTF-8 BOM.

Rows are hash-partitioned by chunk id and sorted by ``(chunk, ordinal)`` inside each
partition; every task then streams its rows into its chunk files one Arrow batch at a
time (memory is one batch, not one chunk). A file is written under a task-attempt
temp name and renamed when complete, so a retried or speculative task never leaves a
half file. Files go through ``pyarrow.fs`` (local, HDFS, S3, GCS alike). The result is
the manifest ``(chunk, file_name, n_rows)`` as a DataFrame.
"""

from __future__ import annotations

import codecs
import io
import zipfile
from xml.sax.saxutils import escape as _xml_escape

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.chunks import CHUNK_NAME_FORMAT, chunk_id
from sluice.session import qualified

MANIFEST_SCHEMA = "chunk int, file_name string, n_rows long"
BOM = "﻿"


def _fs_for(uri: str):
    import pyarrow.fs as pafs
    if uri.startswith("file:"):
        uri = "file://" + "/" + uri[len("file:"):].lstrip("/")
    elif "://" not in uri:
        uri = "file://" + (uri if uri.startswith("/") else "/" + uri)
    return pafs.FileSystem.from_uri(uri)


def _xlsx_bytes(header: list[str], rows: list[list]) -> bytes:
    """A minimal one-sheet workbook (inline strings) with the stdlib only."""
    def letters(ci: int) -> str:
        s, n = "", ci + 1
        while n:
            n, r = divmod(n - 1, 26)
            s = chr(65 + r) + s
        return s

    opened = [f'<c r="{letters(ci)}' for ci in range(len(header))]
    gone = lambda v: v is None or (isinstance(v, float) and pd.isna(v))
    body = []
    for ri, row in enumerate([header, *rows], 1):
        start, end = f'{ri}" t="inlineStr"><is><t xml:space="preserve">', "</t></is></c>"
        cells = "".join([f"{at}{start}{_xml_escape(v if type(v) is str else str(v))}{end}" for at, v in zip(opened, row) if not gone(v)])
        body.append(f'<row r="{ri}">{cells}</row>')
    sheet = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
             '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
             f'<sheetData>{"".join(body)}</sheetData></worksheet>')
    parts = {
        "[Content_Types].xml": (
            '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
            '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
            '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            '<Default Extension="xml" ContentType="application/xml"/>'
            '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
            '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
            '</Types>'),
        "_rels/.rels": (
            '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/>'
            '</Relationships>'),
        "xl/workbook.xml": (
            '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
            '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
            'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
            '<sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>'),
        "xl/_rels/workbook.xml.rels": (
            '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/>'
            '</Relationships>'),
        "xl/worksheets/sheet1.xml": sheet,
    }
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return buf.getvalue()


def write_chunks(df: DataFrame, out_dir: str, stem: str, day: str, chunk_rows: int,
                 ordinal: str = "ordinal", fmt: str = "csv", bom: bool = True,
                 header: bool = True, partitions: int | None = None,
                 encoding: str = "utf-8") -> DataFrame:
    """K4 / K5: write ``df`` (with a 1-based ``ordinal``) as chunk files; returns the
    manifest. Values are written verbatim as text (D11: no per-chunk re-typing)."""
    spark = df.sparkSession
    data_cols = [c for c in df.columns if c != ordinal]
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    staged = (df.select(chunk_id(F.col(ordinal), chunk_rows).alias("_chunk"), F.col(ordinal).alias("_ord"),
                        *[F.col(f"`{c}`").cast("string").alias(c) for c in data_cols])
              .repartition(n_parts, "_chunk").sortWithinPartitions("_chunk", "_ord"))
    ext = fmt
    out_dir = qualified(spark, out_dir).rstrip("/")

    def writer(batches):
        from pyspark import TaskContext
        fs, root = _fs_for(out_dir)
        fs.create_dir(root, recursive=True)
        tc = TaskContext.get()
        tag = f"{tc.partitionId()}-{tc.attemptNumber()}" if tc else "0-0"
        state = {"chunk": None, "stream": None, "tmp": None, "n": 0, "rows": []}
        done = []

        def final_name(ch):
            return CHUNK_NAME_FORMAT % (stem, day, ch, ext)

        def close():
            ch = state["chunk"]
            if ch is None:
                return
            name = final_name(ch)
            tmp = f"{root}/.{name}.{tag}.tmp"
            if fmt == "xlsx":
                with fs.open_output_stream(tmp) as s:
                    s.write(_xlsx_bytes(data_cols, state["rows"]))
            else:
                state["stream"].close()
                tmp = state["tmp"]
            fs.move(tmp, f"{root}/{name}")
            done.append((int(ch), name, int(state["n"])))
            state.update(chunk=None, stream=None, tmp=None, n=0, rows=[])

        def open_chunk(ch):
            state.update(chunk=ch, n=0, rows=[])
            if fmt != "xlsx":
                tmp = f"{root}/.{final_name(ch)}.{tag}.tmp"
                s = fs.open_output_stream(tmp)
                if bom:
                    s.write(BOM.encode(encoding))
                if header:
                    s.write(pd.DataFrame(columns=data_cols).to_csv(index=False).encode(encoding))
                state.update(stream=s, tmp=tmp)

        for pdf in batches:
            if pdf.empty:
                continue
            for ch, part in pdf.groupby("_chunk", sort=False):
                if state["chunk"] != ch:
                    close()
                    open_chunk(ch)
                body = part[data_cols]
                if fmt == "xlsx":
                    state["rows"].extend(body.astype(object).where(body.notna(), None).values.tolist())
                else:
                    state["stream"].write(body.to_csv(index=False, header=False).encode(encoding))
                state["n"] += len(part)
        close()
        yield pd.DataFrame(done, columns=["chunk", "file_name", "n_rows"]).astype(
            {"chunk": "int32", "n_rows": "int64"})

    return staged.mapInPandas(writer, MANIFEST_SCHEMA)


def prepare_output(spark, out_dir: str, clear_old: bool = False) -> str:
    """K6: create the output folder; optionally remove the files already in it (an error if that fails)."""
    out_dir = qualified(spark, out_dir)
    fs, root = _fs_for(out_dir)
    if clear_old:
        fs.delete_dir_contents(root, missing_dir_ok=True)
    fs.create_dir(root, recursive=True)
    return out_dir


TEXT_MANIFEST_SCHEMA = "file_name string, n_lines long, n_bytes long"


def write_text_files(df: DataFrame, out_dir: str, file_col: str = "file_name",
                     order_col: str = "line_no", text_col: str = "line", encoding: str = "utf-8",
                     errors: str = "strict", bom: bool = False, newline: str = "\n",
                     partitions: int | None = None, folders: bool = False) -> DataFrame:
    """Lines ``(file, order, text)`` -> one text file per ``file`` value with that exact
    name (run logs K9, fixture files). Same streaming, temp-then-rename scheme as
    ``write_chunks``; returns ``(file_name, n_lines, n_bytes)``. ``folders`` gives each partition's files a folder of
    their own, so that no folder holds them all, and renames that folder instead of its files."""
    spark = df.sparkSession
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    staged = (df.select(F.col(file_col).alias("_f"), F.col(order_col).alias("_o"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
              .where(F.col("_f").isNotNull())
              .repartition(n_parts, "_f").sortWithinPartitions("_f", "_o").drop("_o"))
    out_dir = qualified(spark, out_dir).rstrip("/")

    def writer(batches):
        from pyspark import TaskContext
        tc = TaskContext.get()
        tag = f"{tc.partitionId()}-{tc.attemptNumber()}" if tc else "0-0"
        fs, root = _fs_for(out_dir)
        if folders and tc:
            root = f"{root}/{tc.partitionId():06d}"
        # where folders can be renamed, one rename a task shows all its files; else one a file
        whole = folders and tc is not None and fs.type_name in ("local", "hdfs")
        place = f"{root.rpartition('/')[0]}/.{tag}.tmp" if whole else root
        fs.create_dir(place, recursive=True)
        name, stream, lines, size = None, None, 0, 0
        done = []

        def temporary() -> str:
            return f"{place}/{name}" if whole else f"{place}/.{name}.{tag}.tmp"

        def put(data) -> None:
            nonlocal size
            stream.write(data)
            size += len(data)

        def close() -> None:
            if stream is None:
                return
            stream.close()
            if not whole:
                fs.move(temporary(), f"{root}/{name}")
            done.append((name, lines, size))

        for batch in batches:
            for new, n, data in _text_runs(batch, newline, encoding, errors):
                if new != name:
                    close()
                    name, lines, size = new, 0, 0
                    stream = fs.open_output_stream(temporary())
                    if bom:
                        put(BOM.encode(encoding))
                put(data)
                lines += n
        close()
        if whole:
            _show(fs, place, root)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(list(zip(*done)) or [(), (), ()], (pa.string(), pa.int64(), pa.int64()))],
                                         names=["file_name", "n_lines", "n_bytes"])

    return staged.mapInArrow(writer, TEXT_MANIFEST_SCHEMA)


def _text_runs(batch: pa.RecordBatch, newline: str, encoding: str, errors: str):
    """``(file, lines, bytes)`` of each stretch of one file's lines, cut from the joined lines of the batch."""
    files, text = batch.column("_f"), batch.column("_t").cast(pa.large_string())
    n = len(files)
    if not n:
        return
    joined = pc.binary_join_element_wise(text, pa.scalar(newline, pa.large_string()), pa.scalar("", pa.large_string()))
    offsets = np.frombuffer(joined.buffers()[1], dtype=np.int64)[joined.offset:joined.offset + n + 1]
    code = files.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    cut = (np.flatnonzero(code[1:] != code[:-1]) + 1).tolist()
    plain = codecs.lookup(encoding).name == "utf-8"
    for a, b in zip([0, *cut], [*cut, n]):
        lo, hi = int(offsets[a]), int(offsets[b])
        data = joined.buffers()[2].slice(lo, hi - lo) if hi > lo else b""
        yield files[a].as_py(), b - a, data if plain or hi == lo else data.to_pybytes().decode().encode(encoding, errors)


def _show(fs, written: str, final: str) -> None:
    """Give a written folder its name; if another attempt of the task was first, its folder stays."""
    import pyarrow.fs as pafs
    there = lambda: fs.get_file_info(final).type != pafs.FileType.NotFound
    if not there():
        try:
            fs.move(written, final)
            return
        except OSError:
            if not there():
                raise
    fs.delete_dir(written)
