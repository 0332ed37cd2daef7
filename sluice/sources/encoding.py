"""Encoding census (S7-S10): which text encoding each file decodes with.

The listing comes from ``binaryFile`` without its ``content`` column (Spark then does not read
the files); a Pandas UDF opens each path through ``pyarrow.fs`` and strict-decodes the whole file
in blocks with all candidates at once, in bounded memory. The first candidate that decodes
everything wins. The census says how a set of files is decoded (S9), under a decode policy (S10).
"""

from __future__ import annotations

import codecs
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Sample sizes of the importer and the splitter, candidate order.
IMPORTER_SAMPLE_BYTES = 50000
SPLITTER_SAMPLE_BYTES = 100000
BLOCK_BYTES = 1 << 20
DEFAULT_CANDIDATES = ["utf-8", "gb18030", "latin1"]
CENSUS_SCHEMA = "encoding string, decoded_ok boolean, has_bom boolean, has_cjk boolean"


def detect_blocks(blocks: Iterable[bytes], candidates: list[str],
                  errors: str = "strict") -> tuple[str, bool, bool, bool]:
    """First candidate that decodes every block; BOM -> utf-8-sig; plain ASCII -> utf-8.
    Returns ``(encoding, decoded_ok, has_bom, has_cjk)``."""
    live: dict[str, codecs.IncrementalDecoder] = {}
    cjk: dict[str, bool] = {}
    bom, first = False, True

    def feed(data: bytes, final: bool) -> None:
        for enc in list(live):
            try:
                text = live[enc].decode(data, final)
            except UnicodeDecodeError:
                del live[enc]
                continue
            cjk[enc] = cjk.get(enc, False) or any("一" <= ch <= "鿿" for ch in text)

    for data in blocks:
        if first:
            bom = data.startswith(codecs.BOM_UTF8)
            for enc in (["utf-8-sig"] if bom else []) + candidates:
                try:
                    live[enc] = codecs.getincrementaldecoder(enc)(errors="strict")
                except LookupError:
                    continue
            first = False
        feed(data, False)
    if first:
        return (candidates[0], True, False, False) if candidates else ("", False, False, False)
    feed(b"", True)
    if live:
        enc = next(iter(live))
        return enc, True, bom, cjk.get(enc, False)
    if errors in ("replace", "ignore") and candidates:
        return candidates[0], False, bom, False
    return "", False, bom, False


def detect_bytes(data: bytes, candidates: list[str], errors: str = "strict") -> tuple[str, bool, bool, bool]:
    """:func:`detect_blocks` of bytes at hand."""
    return detect_blocks([data] if data else [], candidates, errors)


def encoding_census(spark: SparkSession, path: str, glob: str = "*",
                    sample_bytes: int | None = None,
                    candidates: list[str] | None = None, errors: str = "strict") -> DataFrame:
    """``(file_path, size_bytes, encoding, decoded_ok, has_bom, has_cjk)`` per file.

    ``sample_bytes`` (:data:`IMPORTER_SAMPLE_BYTES`, :data:`SPLITTER_SAMPLE_BYTES`) limits the pass
    to each file's beginning, as the reference does; by default whole files decide. Files without a byte are not listed."""
    cands = list(dict.fromkeys(candidates or DEFAULT_CANDIDATES))   # U2: ordered distinct

    @F.pandas_udf(CENSUS_SCHEMA)
    def detect(paths: pd.Series) -> pd.DataFrame:
        from sluice.sinks.chunked import _fs_for
        out = []
        for p in paths:
            fs, local = _fs_for(p)
            with fs.open_input_stream(local) as fh:
                blocks = iter(lambda: fh.read(BLOCK_BYTES), b"") if sample_bytes is None else iter([fh.read(sample_bytes)])
                out.append(detect_blocks(blocks, cands, errors))
        return pd.DataFrame(out, columns=["encoding", "decoded_ok", "has_bom", "has_cjk"])

    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", True).load(path)
             .select(F.col("path").alias("file_path"), F.col("length").alias("size_bytes")))
    return files.withColumn("_e", detect(F.col("file_path"))).select("file_path", "size_bytes", "_e.*")


def read_csv_by_encoding(spark: SparkSession, census: DataFrame, errors: str = "strict",
                         **csv_options) -> DataFrame:
    """Accepted rows of :func:`read_csv_set_by_encoding`, which has the rejects too."""
    return read_csv_set_by_encoding(spark, census, errors, **csv_options).rows


def read_csv_set_by_encoding(spark: SparkSession, census: DataFrame, errors: str = "strict",
                             paths: str | list[str] | None = None, **csv_options):
    """The files of a census (:func:`encoding_census` or ``evidence.encoding_evidence``) in one read, each
    decoded as the census says and by its own header and delimiter; rows with too many fields are in ``rejects``.
    ``paths`` (a folder, say) names the files; without it their list is taken from the census.

    S10: files that no candidate decodes are never left out silently. ``strict`` raises;
    ``replace`` reads them with U+FFFD for bad bytes; ``ignore`` reads them without those."""
    from sluice.sources.records import read_records
    files = census.select("file_path", F.when(F.col("encoding") == "", None).otherwise(F.col("encoding")).alias("encoding"), "decoded_ok")
    if errors == "strict":
        bad = files.where(~F.col("decoded_ok")).agg(F.count("*").alias("n"), F.min("file_path").alias("path")).first()
        if bad["n"]:
            raise ValueError(f"{bad['n']} files decode with no candidate, {bad['path']} among them")
    if paths is None:
        paths = sorted(r["file_path"] for r in files.select("file_path").collect())
    named = files.select("file_path", F.coalesce("encoding", F.lit(DEFAULT_CANDIDATES[0])).alias("encoding"))
    r = read_records(spark, paths, encoding=named, errors=errors, with_source=True, **csv_options)
    r.rows = r.rows.drop("record_no", "ordinal")
    return r
