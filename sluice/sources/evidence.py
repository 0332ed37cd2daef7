"""Encodings of many files by evidence, with a confidence (S7, S8), and the orders in which encodings are tried.

Every block of every file is summed up where it is read: does it decode strictly, how many multi-byte UTF-8
characters has it, and how are its other high bytes (0x80 and up) arranged. Sums of blocks add up to those of a
file, so one big file is many tasks. Chinese text in the GB family holds high bytes in pairs whose first byte
mostly names a common character (rows 0xB0-0xD7) or a mark (0xA1-0xA9); in Latin-1 text high bytes mostly stand
alone next to letters and are accented small letters. Each pair and each lone byte shifts the log-odds of the two,
and the confidence is the odds' logistic. UTF-8 that decodes is hardly ever anything else.

GB2312 and GBK are reported as GB18030, which holds both, and ASCII as UTF-8. A guess below ``least`` gives way: to
GB18030 where the file decodes so and holds Chinese characters, else to UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.sources.encoding import DEFAULT_CANDIDATES
from sluice.session import staged
from sluice.sources.records import _runs, source_lines

# Below this confidence a guess is not followed; the orders in which encodings are tried,
# after the detected one (automatic, splitter) or the one the user chose.
LEAST_CONFIDENCE = 0.7
AUTOMATIC_ORDER = ["gb18030", "gbk", "utf-8", "utf-8-sig", "latin1"]
CHOSEN_ORDER = ["gb18030", "gbk", "utf-8", "latin1"]
SPLITTER_ORDER = ["utf-8", "gb18030", "utf-8-sig", "latin1"]

#: classes of high bytes: 0x80-0xA0, marks, unused rows, common characters, rare ones, 0xF8 and up
_CLASS = np.digitize(np.arange(256), [0xA1, 0xAA, 0xB0, 0xD8, 0xF8])
#: share of each class among first and second bytes of pairs in GB text, and among high bytes of Latin-1 text
_FIRST = np.array([1e-3, 0.15, 1e-3, 0.80, 0.05, 1e-4])
_SECOND = np.array([2e-2, 0.09, 0.06, 0.42, 0.33, 0.07])
_LATIN = np.array([1e-2, 0.03, 0.02, 0.10, 0.70, 0.14])
#: log-odds of a pair by its classes, and of a high byte without a partner (beside a letter, or not)
_PAIR = np.log(_FIRST)[:, None] + np.log(_SECOND)[None, :] - np.log(_LATIN)[:, None] - np.log(_LATIN)[None, :]
_LONE_BY_LETTER, _LONE = -3.0, -1.5
_CLASSES = len(_FIRST)

_SUMS = "file_path string, size long, n_bytes long, utf8 boolean, gb boolean, multi long, high long, cjk boolean, " \
        "lone_letter long, lone long, pairs array<long>"
_ARROW = pa.schema([("file_path", pa.string()), ("size", pa.int64()), ("n_bytes", pa.int64()), ("utf8", pa.bool_()), ("gb", pa.bool_()),
                    ("multi", pa.int64()), ("high", pa.int64()), ("cjk", pa.bool_()), ("lone_letter", pa.int64()), ("lone", pa.int64()),
                    ("pairs", pa.list_(pa.int64()))])


def candidate_order(detected: str | None = None, chosen: str | None = None, splitter: bool = False) -> list[str]:
    """The encodings to try, in order, each once."""
    tried = [chosen, *CHOSEN_ORDER] if chosen else [detected, *(SPLITTER_ORDER if splitter else AUTOMATIC_ORDER)]
    return list(dict.fromkeys(e for e in tried if e))


def evidence_of(data: bytes) -> dict:
    """What some whole lines of a file show."""
    b = np.frombuffer(data, np.uint8)
    out = {"n_bytes": len(b), "utf8": True, "gb": True, "multi": 0, "high": 0, "cjk": False, "lone_letter": 0, "lone": 0,
           "pairs": [0] * _CLASSES ** 2}
    high = b >= 0x80
    out["high"] = int(high.sum())
    if not out["high"]:
        return out
    try:
        text = data.decode("utf-8")
        out["multi"] = int((b >= 0xC2).sum())
        out["cjk"] = any("一" <= c <= "鿿" for c in text)
    except UnicodeDecodeError:
        out["utf8"] = False
    try:
        text = data.decode("gb18030")
        out["cjk"] |= any("一" <= c <= "鿿" for c in text)
    except UnicodeDecodeError:
        out["gb"] = False
    edge = np.diff(np.concatenate([[False], high, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    odd = (end - begin) % 2 == 1
    letter = np.concatenate([[False], ((b | 32) >= 97) & ((b | 32) <= 122) & ~high, [False]])
    by_letter = letter[begin] | letter[end + 1]
    out["lone_letter"], out["lone"] = int((odd & by_letter).sum()), int((odd & ~by_letter).sum())
    # the pairs of runs of even length
    where = np.flatnonzero(high)
    run = np.repeat(np.arange(len(begin)), end - begin)
    first = where[((where - begin[run]) % 2 == 0) & ~odd[run]]
    kind = _CLASS[b[first]] * _CLASSES + _CLASS[b[first + 1]]
    out["pairs"] = np.bincount(kind, minlength=_CLASSES ** 2).tolist()
    return out


def _sum_blocks(sample_bytes: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used = None, 0
        for batch in batches:
            rows = []
            for a, b in _runs(batch):
                key = batch.column("file_path")[a].as_py(), batch.column("block")[a].as_py()
                if key != now:
                    now, used = key, 0
                if sample_bytes is not None and (key[1] or used >= sample_bytes):
                    continue
                lines = batch.column("line").slice(a, b - a).to_pylist()
                if sample_bytes is not None:
                    begins = used + np.cumsum([0, *(len(x) + 1 for x in lines[:-1])])
                    lines = lines[:int((begins < sample_bytes).sum())]
                data = b"\n".join(lines) + b"\n"
                used += len(data)
                rows.append({"file_path": key[0], "size": batch.column("size")[a].as_py(), **evidence_of(data)})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
    return run


def encoding_evidence(spark: SparkSession, paths: str | list[str], sample_bytes: int | None = None,
                      least: float = LEAST_CONFIDENCE) -> DataFrame:
    """``file_path, encoding, confidence, decoded_ok, has_bom, has_cjk``, one row a file with a line (written).

    ``sample_bytes`` (``IMPORTER_SAMPLE_BYTES``, ``SPLITTER_SAMPLE_BYTES``) looks at the lines that begin
    within a file's first so many bytes; by default whole files count, and only then is a byte order mark seen."""
    sums = staged(source_lines(spark, paths, with_size=True).drop("nth").mapInArrow(_sum_blocks(sample_bytes), _SUMS), "evidence")
    if sample_bytes is not None:
        sums = sums.withColumn("size", F.col("n_bytes"))
    total = sums.groupBy("file_path").agg(
        # the lines with a newline each are the file, or one byte more than it, but for a mark of three bytes
        (F.max("size") - F.sum("n_bytes") >= 2).alias("has_bom"), F.bool_and("utf8").alias("utf8"), F.bool_and("gb").alias("gb"),
        F.bool_or("cjk").alias("has_cjk"), F.sum("multi").alias("multi"), F.sum("high").alias("high"),
        F.sum("lone_letter").alias("ll"), F.sum("lone").alias("lo"),
        *[F.sum(F.col("pairs")[i]).alias(f"p{i}") for i in range(_CLASSES ** 2)])
    odds = F.lit(_LONE_BY_LETTER) * F.col("ll") + F.lit(_LONE) * F.col("lo")
    for i in range(_CLASSES ** 2):
        odds = odds + F.lit(float(_PAIR[i // _CLASSES, i % _CLASSES])) * F.col(f"p{i}")
    known = total.withColumn("odds", odds)
    chinese = 1 / (1 + F.exp(-F.least(F.greatest(F.col("odds"), F.lit(-30.0)), F.lit(30.0))))
    chinese = F.when(F.col("gb"), chinese).otherwise(0.0)
    guess = (F.when(F.col("high") == 0, F.struct(F.lit("utf-8").alias("encoding"), F.lit(1.0).alias("confidence")))
             .when(F.col("utf8"), F.struct(F.when(F.col("has_bom"), F.lit("utf-8-sig")).otherwise(F.lit("utf-8")).alias("encoding"),
                                           (1 - 0.5 * F.pow(F.lit(0.5), F.col("multi").cast("double"))).alias("confidence")))
             .when(chinese >= 0.5, F.struct(F.lit("gb18030").alias("encoding"), chinese.alias("confidence")))
             .otherwise(F.struct(F.lit("latin1").alias("encoding"), (1 - chinese).alias("confidence"))))
    fallback = F.when(F.col("gb") & F.col("has_cjk"), F.lit("gb18030")).otherwise(F.lit(DEFAULT_CANDIDATES[0]))
    named = known.withColumn("guess", guess).withColumn(
        "encoding", F.when(F.col("guess.confidence") >= least, F.col("guess.encoding")).otherwise(fallback))
    ok = (F.when(F.col("encoding").startswith("utf-8"), F.col("utf8")).when(F.col("encoding") == "gb18030", F.col("gb")).otherwise(F.lit(True)))
    return staged(named.select("file_path", "encoding", F.round("guess.confidence", 6).alias("confidence"), ok.alias("decoded_ok"),
                                "has_bom", "has_cjk"), "encodings")
