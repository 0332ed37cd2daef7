"""A Bloom filter in segments, one a hash partition, built by Spark and read by tasks from the shared folder.

A 64-bit hash belongs to partition ``(hash >> 32) % parts``; its low 32 bits are its key there. All segments
together take ``FILTER_BYTES`` (or a byte each) at most: past that bound the filter lets more through, and
never loses a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.base import give_back
from sluice.session import scratch_path

FILTER_BYTES = 32 << 20
#: bits for each key, and the multipliers of its probes
FILTER_BITS = 10
_PROBES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
#: keys for which one more partition is dealt, where only keys are known
PART_KEYS = 1_000_000


def split(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Partitions and keys of 64-bit hashes."""
    return ((hashes >> np.uint64(32)) % np.uint64(parts)).astype(np.int64), hashes & np.uint64(0xFFFFFFFF)


def _places(keys: np.ndarray, bits) -> Iterator[np.ndarray]:
    """Where each probe of a key falls among ``bits`` bits (one number, or one a key)."""
    wide = keys.astype(np.uint64) + np.uint64(1)
    for p in _PROBES:
        yield (((wide * p) >> np.uint64(20)) % bits).astype(np.int64)


def segment(keys: np.ndarray, parts: int) -> bytes:
    """The filter of the keys of one of ``parts`` partitions."""
    limit = max(1, FILTER_BYTES // parts)
    bits = np.zeros(8 * max(1, min(limit, -(-len(keys) * FILTER_BITS // 8))), dtype=bool)
    for place in _places(keys, np.uint64(len(bits))):
        bits[place] = True
    return np.packbits(bits).tobytes()


class Filter:
    """All segments, read once a worker."""

    _kept: dict[str, "Filter"] = {}

    def __init__(self, table: pa.Table, parts: int) -> None:
        part = table.column("part").to_numpy()
        segments = pa.concat_arrays([c.cast(pa.large_binary()) for c in table.column("bits").chunks] or [pa.array([], pa.large_binary())])
        _, off, data = segments.buffers()
        offsets = np.frombuffer(off, np.int64)[segments.offset:segments.offset + len(part) + 1] if len(part) else np.zeros(1, np.int64)
        self.bits, self.begin, self.parts = np.zeros(parts, dtype=np.int64), np.zeros(parts, dtype=np.int64), parts
        self.bits[part], self.begin[part] = np.diff(offsets) * 8, offsets[:-1]
        self.data = np.frombuffer(data, np.uint8) if len(part) else np.zeros(1, np.uint8)

    @classmethod
    def at(cls, path: str, parts: int) -> "Filter":
        if path not in cls._kept:
            import pyarrow.parquet as pq
            from sluice.sinks.chunked import _fs_for
            fs, root = _fs_for(path)
            cls._kept.clear()
            cls._kept[path] = cls(pq.read_table(root, columns=["part", "bits"], filesystem=fs), parts)
        return cls._kept[path]

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        part, keys = split(hashes, self.parts)
        bits, begin = self.bits[part], self.begin[part]
        found = bits > 0
        for place in _places(keys, np.maximum(bits, 1).astype(np.uint64)):
            # np.packbits sets the highest bit of a byte first
            found &= (self.data[np.where(found, begin + (place >> 3), 0)] >> (7 - (place & 7)).astype(np.uint8)) & 1 > 0
        return found


def filter_of(hashes: DataFrame, name: str) -> tuple[str, int]:
    """Path and number of partitions of a filter of the distinct longs of a one-column table (written)."""
    parts = hashes.count() // PART_KEYS + 1
    column = hashes.columns[0]

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        _, keys = split(rows["h"].to_numpy().view(np.uint64), parts)
        bits = segment(keys, parts)
        give_back()
        return pd.DataFrame({"part": [key[0]], "bits": [bits]})

    path = scratch_path(hashes.sparkSession, f"llm-{name}")
    part = F.pmod(F.shiftrightunsigned(F.col(column), 32), F.lit(parts))
    (hashes.select(F.col(column).alias("h"), part.cast("long").alias("part")).groupBy("part")
     .applyInPandas(run, "part long, bits binary").write.parquet(path))
    return path, parts
