"""E1, the import path as one Spark plan:
scan -> names (P1/P2) -> clean, once, written -> profile and infer types -> user overrides (P6) -> fit check (Q1),
evaluated once, landed and counted by the landing write -> error gate (F6) -> write accepted + rejects ->
report (A10, A11) -> run record (K9).

Rows with too many fields join the rejects and the report. Only the profile rows (one per
column) and the measured counts reach the driver.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.operators import columns as C
from sluice.operators import profile as P
from sluice.operators import quality as QL
from sluice.session import staged
from sluice.sinks.tables import append_run_record, create_table_sql, run_record, write_table
from sluice.sources.csv import read_csv, read_csv_set


@dataclass
class ImportResult:
    table_name: str
    mapping: DataFrame
    ddl: str
    report: DataFrame
    accepted_path: str
    rejected_path: str
    runs_path: str


def _as_cleaned(df: DataFrame, flat: DataFrame, text: dict[str, str]) -> DataFrame:
    """Text columns as the type that cleaning gives every one of their values: whole numbers,
    numbers, date-times, or else text (D14: types are inferred from clean values). ``flat`` has the cleaned fields
    of ``df``, under the names that ``text`` gives its columns."""
    kinds = flat.agg(*[agg for c in text.values() for agg in (
        F.count_if(F.col(f"{c}__kind") == "num").alias(f"{c}n"),
        F.count_if((F.col(f"{c}__kind") == "num") & (F.col(f"{c}__num") != F.floor(f"{c}__num"))).alias(f"{c}f"),
        F.count_if(F.col(f"{c}__kind") == "ts").alias(f"{c}t"),
        F.count_if(F.col(f"{c}__kind") == "str").alias(f"{c}s"))]).first().asDict() if text else {}

    def typed(c: str):
        k = text.get(c)
        if k is None:
            return F.col(f"`{c}`")
        n, f, t, s = (kinds[k + x] or 0 for x in "nfts")
        if n and not t and not s:
            whole = F.coalesce(F.col(f"{k}__big"), F.col(f"{k}__num").try_cast("decimal(38,0)")).try_cast("long")
            return (F.col(f"{k}__num") if f else whole).alias(c)
        if t and not n and not s:
            return F.col(f"{k}__ts").alias(c)
        # mixed or plain text: kept as text, nulls by their tokens
        return F.when(F.col(f"{k}__kind") != "null", F.col(f"`{c}`")).alias(c)
    return flat.select(*[typed(c) for c in df.columns])


def import_csv(spark: SparkSession, path: str, out_dir: str, epoch_seconds: int,
               overrides: dict[str, str] | None = None, enforce_gate: bool = True,
               **csv_options) -> ImportResult:
    r = (read_csv_set if csv_options.get("header", True) else read_csv)(spark, path, **csv_options)
    # every value is parsed and cleaned once: empty columns, kinds, profile and fit check read what was written
    began = time.monotonic()
    flat, text = QL.clean_for_types(r.rows)
    flat = staged(flat, "cleaned")
    cleaning = time.monotonic() - began
    df = C.drop_null_columns(flat.select(*[F.col(f"`{c}`") for c in r.rows.columns]))
    text = {c: at for c, at in text.items() if c in df.columns}
    prof = P.infer_sql_types(P.profile(_as_cleaned(df, flat, text)))
    # a row per column, read twice
    mapping = staged(C.apply_overrides(C.column_mapping(r.header, r.names, prof), overrides or {}), "mapping")
    types = {row["current"]: row["sql_type"] for row in mapping.collect() if row["current"] in df.columns}
    # rows of too many fields are rejects as well: their record, under the first column
    long_error = F.array(F.struct(F.lit(df.columns[0]).alias("column"), F.lit("fields").alias("reason"),
                                  F.col("record").alias("value")))
    landed = f"{out_dir}/checked"
    checked = QL.check_types(df, types, cleaned=(flat, text)).checked
    empty = {f.name: F.lit(None).cast(f.dataType) for f in df.schema}
    longs = r.rejects.select(F.struct(*[v.alias(k) for k, v in empty.items()]).alias("_raw"),
                             F.lit(None).cast(checked.schema["_val"].dataType).alias("_val"),
                             long_error.alias("errors"), F.lit(0).alias("_part"))
    # counted while it is written: gate, report and run record read nothing again
    measured = Observation("import")
    began = time.monotonic()
    QL.observe_checked(checked.unionByName(longs), measured).write.mode("overwrite").parquet(landed)
    elapsed = cleaning + time.monotonic() - began
    done = QL.split_checked(spark.read.parquet(landed))
    gate = QL.gate_of(measured.get)
    if enforce_gate:
        QL.enforce_gate(gate)
    stem = r"[^/]*[*?\[{][^/]*$"  # a pattern names its folder
    named = re.sub(stem, "", path).rstrip("/").split("/")[-1]
    ddl_row = create_table_sql(mapping.withColumnRenamed("current", "column_name"),
                               F.lit(named), epoch_seconds).first()
    acc, rej = f"{out_dir}/accepted", f"{out_dir}/rejected"
    write_table(done.accepted, acc, mode="overwrite")
    write_table(done.rejected, rej, mode="overwrite")
    report = QL.report_of(spark, measured.get, ddl_row["table_name"], elapsed)
    runs = f"{out_dir}/runs"
    append_run_record(run_record(spark, path, ddl_row["table_name"], report, len(types), types,
                                 f"{gate['n_rejected']} of {gate['n_rows']} rows rejected"), runs)
    return ImportResult(ddl_row["table_name"], mapping, ddl_row["ddl"], report, acc, rej, runs)
