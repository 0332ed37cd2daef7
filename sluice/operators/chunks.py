"""Global row ordinal and chunk ids (W1), chunk counts (A12), the chunk manifest
and chunk file names (K8).

The ordinal is computed in two passes without a single-partition window:
1. range-partition and sort by the order key, then checkpoint to the shared folder
   (so both passes see the same partitions even after an executor is lost);
2. count rows per partition (a tiny table: one row per partition, so broadcasting it
   is bounded by the partition count, not the data), turn the counts into offsets,
   and add ``offset + position in partition``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.session import checkpoint_root

# Default rows per chunk file and the chunk file name layout.
DEFAULT_CHUNK_ROWS = 49998
CHUNK_NAME_FORMAT = "%s_%s_%04d.%s"      # stem, yyyymmdd, chunk number, extension

_POS_BITS = 33                            # monotonically_increasing_id: partition << 33 | pos


#: size of a range by the planner's estimate, and the most ranges that an estimate alone asks for
PARTITION_BYTES = 256 << 20
MOST_PARTITIONS = 400_000


def estimated_bytes(df: DataFrame) -> int:
    """The planner's estimate of a frame's size (of its files, for a plain scan)."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def with_ordinal(df: DataFrame, order_by: list[str | Column], name: str = "ordinal",
                 partitions: int | None = None) -> DataFrame:
    """Adds a 1-based global ``ordinal`` following ``order_by`` (ties keep the scan's order).

    ``partitions`` defaults to what the plan's size asks for at ``PARTITION_BYTES`` each, and to the shuffle
    partition setting at least; every partition is a contiguous key range. The place in the scan is the last
    key, so rows of one key are split as well.
    """
    spark = df.sparkSession
    checkpoint_root(spark)
    keys = [F.col(c) if isinstance(c, str) else c for c in order_by]
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                          min(MOST_PARTITIONS, -(-estimated_bytes(df) // PARTITION_BYTES)))
    ranged = (df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *keys, F.col("_tie"))
              .sortWithinPartitions(*keys, "_tie").drop("_tie")
              .withColumn("_mid", F.monotonically_increasing_id())
              .checkpoint(eager=True))
    part = F.shiftright(F.col("_mid"), _POS_BITS)
    pos = F.col("_mid") - F.shiftleft(part, _POS_BITS)
    counts = (ranged.select(part.alias("_part")).groupBy("_part")
              .agg(F.count(F.lit(1)).alias("_n")))
    # one row per partition: the offset window runs on a table of `n` rows
    offsets = counts.select(
        "_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    return (ranged.join(F.broadcast(offsets), part == F.col("_part"), "left")
            .withColumn(name, (F.coalesce(F.col("_off"), F.lit(0)) + pos + 1).cast("bigint"))
            .drop("_mid", "_part", "_off"))


def chunk_id(ordinal: Column, chunk_rows: int) -> Column:
    """1-based chunk number of a 1-based ordinal."""
    return (F.floor((ordinal - 1) / F.lit(chunk_rows)) + 1).cast("int")


def with_chunk(df: DataFrame, chunk_rows: int = DEFAULT_CHUNK_ROWS, ordinal: str = "ordinal",
               name: str = "chunk") -> DataFrame:
    return df.withColumn(name, chunk_id(F.col(ordinal), chunk_rows))


def chunk_count(rows: Column, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> Column:
    """ceil(rows / n), 0 for no rows."""
    return F.when(rows > 0, F.ceil(rows / F.lit(chunk_rows))).otherwise(F.lit(0)).cast("bigint")


def chunk_file_name(stem: Column, day: str, chunk: Column, ext: str = "csv") -> Column:
    """K8: ``<stem>_<yyyymmdd>_<%04d>.<ext>``; ``day`` is an argument (deterministic)."""
    return F.format_string(CHUNK_NAME_FORMAT, stem, F.lit(day), chunk, F.lit(ext))


def chunk_manifest(df: DataFrame, chunk_rows: int, stem: str, day: str, ext: str = "csv",
                   ordinal: str = "ordinal") -> DataFrame:
    """Per chunk ``(chunk, file_name, n_rows, first_ordinal, last_ordinal)``."""
    ch = chunk_id(F.col(ordinal), chunk_rows)
    return (df.groupBy(ch.alias("chunk"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                 F.min(ordinal).alias("first_ordinal"), F.max(ordinal).alias("last_ordinal"))
            .withColumn("file_name", chunk_file_name(F.lit(stem), day, F.col("chunk"), ext)))
