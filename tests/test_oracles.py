"""Every registered query against its DuckDB oracle on the smallest tables."""
import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from sluice.plans.inputs import TABLES

SF = "/root/testdata/sf0.001"
FAST = ["profile_nulls", "profile_strings", "numeric_share", "duplicate_names", "normalize_names",
        "clean_all", "clean_long_text", "human_size", "human_duration", "file_parts",
        "quarantine_accepted", "quarantine_rejected", "error_rate_gate", "row_ordinal", "chunk_manifest",
        "log_results", "speed_moving_avg", "progress_running", "csv_bad_lines", "infer_types",
        "split_csv_roundtrip", "csv_roundtrip"]


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if hasattr(v, "is_integer") and not isinstance(v, bool):
        v = float(v)
        return str(int(v)) if v == int(v) and abs(v) < 2 ** 53 else repr(round(v, 6))
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    try:
        import decimal
        if isinstance(v, decimal.Decimal):
            return _norm(float(v))
    except Exception:
        pass
    return str(v)


def _canon(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle_or_is_listed():
    q, o = E.queries(), E.oracle_sql()
    no_oracle = {n for n in set(q) - set(o) if n != "pipeline" and not n.startswith("op")}
    assert no_oracle <= {"unique_names", "encoding_census"}
    assert set(o) <= set(q)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    sp = E.queries()[name](spark, SF).toPandas()
    du = con.execute(E.oracle_sql()[name]).df()
    assert _canon(sp) == _canon(du)


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "sql_type" in df.columns
