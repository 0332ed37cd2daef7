"""Table sinks: CREATE TABLE text (K1), target table name (K7), JDBC / table / Parquet
writes of accepted rows (K2), and append-only run records (K9).
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import humanize as H
from sluice.functions import sqltypes as st

# The reference's CREATE TABLE layout.
CREATE_PREFIX = "CREATE TABLE IF NOT EXISTS"
CREATE_SUFFIX = "CHARACTER SET utf8mb4 COLLATE utf8mb4_unicode_ci"


def create_table_sql(typed_profile: DataFrame, file_path: Column, epoch_seconds: int,
                     name_col: str = "column_name", ordinal_col: str = "ordinal") -> DataFrame:
    """K1 + K7: ``(table_name, ddl)`` — one row; columns in ordinal order.

    The column list is gathered with ``collect_list`` over the profile (one row per
    column: metadata, not data), sorted by ordinal inside the aggregate.
    """
    table = H.table_name_for(H.stem(file_path), epoch_seconds)
    defs = typed_profile.select(
        F.col(ordinal_col).alias("o"),
        F.concat(st.quote_identifier(F.col(name_col)), F.lit(" "), F.col("sql_type")).alias("d"))
    agg = defs.agg(F.array_sort(F.collect_list(F.struct("o", "d"))).alias("cols"))
    return agg.select(
        table.alias("table_name"),
        F.concat_ws(" ", F.lit(CREATE_PREFIX), st.quote_identifier(table), F.lit("("),
                    F.array_join(F.transform("cols", lambda x: x["d"]), ", "), F.lit(")"),
                    F.lit(CREATE_SUFFIX)).alias("ddl"))


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str],
               mapping: dict[str, str] | None = None, batch_size: int = 500,
               num_partitions: int | None = None, mode: str = "append") -> None:
    """K2: batched insert of validated rows through JDBC.

    Each task commits its own batches (N8), so call this only with rows that passed
    ``quality.check_types``. ``mapping`` (column -> SQL type) becomes
    ``createTableColumnTypes`` in Spark-parsable form (N7).
    """
    w = df.write.mode(mode).option("batchsize", batch_size)
    if num_partitions:
        w = w.option("numPartitions", num_partitions)
    if mapping:
        spark_types = ", ".join(f"`{c}` {st.spark_type_for(t).simpleString().upper()}"
                                for c, t in mapping.items() if c in df.columns)
        w = w.option("createTableColumnTypes", spark_types)
    w.jdbc(url, table, properties=properties)


def write_table(df: DataFrame, path_or_table: str, fmt: str = "parquet", mode: str = "append",
                as_table: bool = False) -> None:
    """K2 without a database: a Parquet folder or a catalog table."""
    w = df.write.mode(mode).format(fmt)
    if as_table:
        w.saveAsTable(path_or_table)
    else:
        w.save(path_or_table)


def run_record(spark, file_path: str, target: str, report: DataFrame, n_columns: int,
               types: dict[str, str], summary: str = "") -> DataFrame:
    """K9: one run record row (file, target, rows, columns, types, errors, summary)."""
    tmap = F.create_map(*[x for k, v in types.items() for x in (F.lit(k), F.lit(v))]) if types else \
        F.create_map().cast("map<string,string>")
    return report.select(
        F.lit(file_path).alias("file_path"), F.lit(target).alias("target"),
        F.col("total_rows"), F.col("rows_inserted"), F.col("error_rows"),
        F.lit(n_columns).alias("n_columns"), tmap.alias("column_types"),
        F.lit(summary).alias("summary"),
        F.lit(time.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz").alias("recorded_at"))


def append_run_record(record: DataFrame, runs_path: str) -> None:
    """K9: append to the shared ``runs`` table (Parquet)."""
    record.write.mode("append").parquet(runs_path)
