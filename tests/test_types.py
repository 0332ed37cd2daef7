import datetime as dt

import pytest
from pyspark.sql import functions as F

from sluice.operators.profile import infer_sql_types, profile


def _type(spark, name, values, ddl):
    df = spark.createDataFrame([(v,) for v in values], f"`{name}` {ddl}")
    return infer_sql_types(profile(df)).first().sql_type


def test_all_null(spark):
    assert _type(spark, "x", [None, None], "string") == "VARCHAR(255)"


def test_id_name(spark):
    assert _type(spark, "user_id", ["a", "b"], "string") == "BIGINT"


@pytest.mark.parametrize("top,expected", [(255, "TINYINT UNSIGNED"), (256, "SMALLINT UNSIGNED"),
                                          (65536, "MEDIUMINT UNSIGNED"), (16777216, "INT UNSIGNED"),
                                          (4294967296, "BIGINT UNSIGNED")])
def test_unsigned_ladder(spark, top, expected):
    assert _type(spark, "n", [0, top], "bigint") == expected


@pytest.mark.parametrize("top,expected", [(127, "TINYINT"), (128, "SMALLINT"), (32768, "MEDIUMINT"),
                                          (8388608, "INT"), (2147483648, "BIGINT")])
def test_signed_ladder(spark, top, expected):
    assert _type(spark, "n", [-1, top], "bigint") == expected


def test_decimal(spark):
    assert _type(spark, "x", [5.0, 12.25], "double") == "DECIMAL(4,2)"
    assert _type(spark, "x", [-5.0], "double") == "DECIMAL(3,1)"
    assert _type(spark, "x", [0.5, float("inf")], "double") == "DOUBLE"


def test_decimal_digits_like_python(spark):
    vals = [12345678.9, 0.00012, 1.5e-05, 1e16, 123.456]
    got = _type(spark, "x", vals, "double")
    reprs = [str(v) for v in vals]
    i = max(len(s.split(".")[0]) if "." in s else len(s) for s in reprs)
    f = max(len(s.split(".")[-1]) if "." in s else 0 for s in reprs)
    p, s = min(i + f, 65), min(f, 30)
    assert got == f"DECIMAL({max(p, s + 1)},{s})"


def test_date_or_datetime(spark):
    assert _type(spark, "t", [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)], "timestamp_ntz") == "DATE"
    assert _type(spark, "t", [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2, 0, 0, 1)],
                 "timestamp_ntz") == "DATETIME"


def test_bool(spark):
    assert _type(spark, "b", [True, False], "boolean") == "TINYINT(1)"


@pytest.mark.parametrize("n,expected", [(10, "VARCHAR(15)"), (200, "VARCHAR(255)"), (300, "TEXT"),
                                        (70000, "MEDIUMTEXT")])
def test_text(spark, n, expected):
    assert _type(spark, "s", ["x" * n, "y"], "string") == expected


def test_longtext_from_profile_row(spark):
    from sluice.functions.sqltypes import text_type
    assert spark.range(1).select(text_type(F.lit(17000000))).first()[0] == "LONGTEXT"


def test_profile_nulls_and_lengths(spark):
    df = spark.createDataFrame([("ab", 1.5), (None, None), ("abcd", 2.0)], "s string, x double")
    p = {r.column_name: r for r in profile(df).collect()}
    assert p["s"].null_count == 1 and p["s"].null_pct == 33.33
    assert p["s"].max_len == 4 and p["s"].avg_len == 3.0
    assert p["x"].min_value == 1.5 and p["x"].max_value == 2.0 and p["x"].is_integral is False


def test_one_scan(spark):
    df = spark.range(100).select(F.col("id").alias("a"), F.col("id").cast("string").alias("b"))
    plan = profile(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range") == 1
