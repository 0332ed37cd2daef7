"""Helpers shared by the operators: staged tables, size-checked joins, components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.session import scratch_path

#: rows of a few long columns that may be broadcast (about 32 MB); beyond, a shuffle join runs
BROADCAST_ROWS = 1_000_000
#: rows of an Arrow batch that a Python worker takes at a time
SLICE = 1000

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, TypeError, AttributeError):  # not glibc
    _trim = None


def give_back() -> None:
    """Return the freed memory of this process to the system. Spark keeps idle workers, and glibc
    what numpy and Arrow freed in them: hundreds of MB beside a JVM that has no use for them."""
    if _trim:
        _trim(0)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, ``SLICE`` at a time; at their end freed memory goes back."""
    for batch in batches:
        for a in range(0, batch.num_rows, SLICE):
            yield batch.slice(a, SLICE)
    give_back()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: cuts the lineage, survives lost
    executors, and fixes row ids and other values that must not be computed twice."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint on a staged side, only after counting it; past ``rows`` the planner
    falls back to a sort-merge join (which AQE splits where a key is hot)."""
    return F.broadcast(small) if small.count() <= rows else small


def same(a, b, keys: list[str]):
    """Null-safe equality on the key columns of two frames."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def text_key(text="text") -> list:
    """Native 96-bit key of a text, to find its rows again in another scan: equal texts get
    equal keys whatever their ids, so repeated and null ids cannot mix rows up."""
    t = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(t).alias("tk1"), F.hash(t).alias("tk2")]


def has_repeats(rows: DataFrame) -> bool:
    """Whether some row of ``rows(doc_id, tk1, tk2)`` occurs twice, id and text alike."""
    return not rows.groupBy("doc_id", "tk1", "tk2").count().where("count > 1").isEmpty()


def one_row_each(docs: DataFrame, keys: DataFrame, repeats: bool, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Scan ``docs(doc_id, tk1, tk2, ...)`` again for the rows that ``keys(node, doc_id, tk1,
    tk2, ...)`` name, one row for each node."""
    small = sized(keys, rows).withColumnsRenamed({"doc_id": "_id", "tk1": "_k1", "tk2": "_k2"})
    found = docs.join(small, docs["doc_id"].eqNullSafe(F.col("_id")) & (F.col("tk1") == F.col("_k1"))
                      & (F.col("tk2") == F.col("_k2"))).drop("_id", "_k1", "_k2")
    return found.dropDuplicates(["node"]) if repeats else found


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, comp)`` for every node of ``edges(a, b)``; comp is the smallest node reachable.

    Alternates large-star and small-star steps (each a grouped minimum and a join, staged)
    until the edge set stops changing; only the edge count and checksum reach the driver.
    A hub's edges are pre-aggregated by the partial minimum, and AQE splits its join."""
    e = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
              .where("a <> b").distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a")
                 .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                           F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
                 .select("e.a", "e.b").where("a <> b").distinct())
        e = stage(small, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return (e.select(F.col("a").alias("node"), F.col("b").alias("comp"))
            .unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("comp"))).distinct())
