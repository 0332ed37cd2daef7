"""Column profiling (A1-A9, F2) in one pass, long form, plus type inference.

``profile(df)`` builds ONE ``agg`` with every statistic of every column (in slices of
``slice_size`` columns for very wide tables), so the table is scanned once; partial
aggregation runs map-side and only one small buffer per partition is merged. The
one-row result is turned to long form ``(column_name, ...)`` with ``inline`` — still
on executors, one row per column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import sqltypes as st

PROFILE_SCHEMA = T.StructType([
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("spark_type", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("n_rows", T.LongType()),
    T.StructField("null_count", T.LongType()),
    T.StructField("min_value", T.DoubleType()),
    T.StructField("max_value", T.DoubleType()),
    T.StructField("is_integral", T.BooleanType()),
    T.StructField("has_inf", T.BooleanType()),
    T.StructField("int_digits", T.IntegerType()),
    T.StructField("frac_digits", T.IntegerType()),
    T.StructField("max_len", T.LongType()),
    T.StructField("sum_len", T.LongType()),
    T.StructField("has_time", T.BooleanType()),
    T.StructField("has_backtick", T.BooleanType()),
    T.StructField("has_quotes", T.BooleanType()),
    T.StructField("has_backslash", T.BooleanType()),
    T.StructField("n_kinds", T.IntegerType()),
    T.StructField("n_integer", T.LongType()),
    T.StructField("n_float", T.LongType()),
    T.StructField("n_boolean", T.LongType()),
    T.StructField("n_datetime", T.LongType()),
    T.StructField("n_string", T.LongType()),
    T.StructField("min_whole", T.DecimalType(38, 0)),
    T.StructField("max_whole", T.DecimalType(38, 0)),
])
#: kinds of a cell's value; their counts in a column are its kind sketch
CELL_KINDS = ("integer", "float", "boolean", "datetime", "string")

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType)


def column_kind(dt: T.DataType) -> str:
    """The reference's dtype families."""
    if isinstance(dt, _INTEGRAL) or (isinstance(dt, T.DecimalType) and dt.scale == 0):
        return "integer"
    if isinstance(dt, _FRACTIONAL) or isinstance(dt, T.DecimalType):
        return "float"
    if isinstance(dt, T.StringType):
        return "string"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    return "other"


def _null(t: str) -> Column:
    return F.lit(None).cast(t)


def _stats_for(i: int, f: T.StructField, cells: bool = False) -> tuple[list[Column], dict[str, Column]]:
    """Aggregate expressions for one column and how to read them back."""
    c = F.col(f"`{f.name}`")
    kind = column_kind(f.dataType)
    p = f"c{i}_"
    aggs = [F.count(c).alias(p + "nn")]
    out: dict[str, Column] = {"null_count": F.col("n_rows_") - F.col(p + "nn")}
    if kind in ("integer", "float"):
        x = c.cast("double")
        finite = F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)
        aggs += [F.min(finite).alias(p + "min"), F.max(finite).alias(p + "max"),
                 F.bool_and(finite % 1 == 0).alias(p + "int")]
        out.update(min_value=F.col(p + "min"), max_value=F.col(p + "max"),
                   is_integral=F.col(p + "int"))
        if kind == "integer":
            # in the column's own type: a double would round beyond 2^53
            aggs += [F.min(c).alias(p + "lo"), F.max(c).alias(p + "hi")]
            out.update(min_whole=F.col(p + "lo"), max_whole=F.col(p + "hi"))
        if kind == "float":
            d = F.col(f"_digits_{i}")       # staged by profile() before the aggregate
            aggs += [F.bool_or(F.abs(x) == F.lit(float("inf"))).alias(p + "inf"),
                     F.max(d["int_digits"]).alias(p + "id"),
                     F.max(d["frac_digits"]).alias(p + "fd")]
            out.update(has_inf=F.coalesce(F.col(p + "inf"), F.lit(False)),
                       int_digits=F.col(p + "id"), frac_digits=F.col(p + "fd"))
    elif kind == "string":
        ln = F.length(c)
        aggs += [F.max(ln).alias(p + "ml"), F.sum(ln).alias(p + "sl"),
                 F.bool_or(c.contains("`")).alias(p + "bt"),
                 F.bool_or(c.contains("'") | c.contains('"')).alias(p + "q"),
                 F.bool_or(c.contains("\\")).alias(p + "bs")]
        out.update(max_len=F.col(p + "ml"), sum_len=F.col(p + "sl"),
                   has_backtick=F.col(p + "bt"), has_quotes=F.col(p + "q"),
                   has_backslash=F.col(p + "bs"))
        if cells:
            v = F.col(f"_kind_{i}")         # staged by profile() before the aggregate
            aggs += [F.count_if(v == k).alias(f"{p}k_{k}") for k in CELL_KINDS]
            n = {k: F.col(f"{p}k_{k}") for k in CELL_KINDS}
            many = sum(((n[k] > 0).cast("int") for k in CELL_KINDS[1:]), (n[CELL_KINDS[0]] > 0).cast("int"))
            out.update({f"n_{k}": n[k] for k in CELL_KINDS}, n_kinds=many,
                       kind=F.when((many > 1) & (n["string"] > 0), F.lit("mixed")).otherwise(F.lit("string")))
    elif kind == "datetime":
        if isinstance(f.dataType, T.DateType):
            aggs += [F.lit(False).alias(p + "ht")]
        else:
            aggs += [F.bool_or((F.hour(c) != 0) | (F.minute(c) != 0) | (F.second(c) != 0))
                     .alias(p + "ht")]
        out.update(has_time=F.col(p + "ht"))
    return aggs, out


def profile(df: DataFrame, columns: list[str] | None = None, slice_size: int = 200,
            derived: bool = True, cells: list[str] | None = None) -> DataFrame:
    """Long-form profile: one row per column (see ``PROFILE_SCHEMA`` plus derived columns).

    ``cells`` names text columns that hold values of any kind (cells of a sheet, fields of a file):
    their values are counted by kind in the same pass, counts that add up over partitions like every
    other statistic, and a column of several kinds with text among them is of kind ``mixed`` (T3).

    One scan per slice of ``slice_size`` columns (one slice for normal tables). With ``derived``
    false the derived columns are left to :func:`with_derived`, for a union of many profiles.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    # one null column a field, shared by all rows: the plan is built by few driver calls
    types = {sf.name: sf.dataType.simpleString() for sf in PROFILE_SCHEMA.fields}
    nulls = {name: _null(t).alias(name) for name, t in types.items()}
    parts = []
    for start in range(0, max(len(fields), 1), slice_size):
        sl = list(enumerate(fields))[start:start + slice_size]
        aggs = [F.count(F.lit(1)).alias("n_rows_")]
        rows = []
        for i, f in sl:
            a, out = _stats_for(i, f, f.name in (cells or ()))
            aggs += a
            vals = {
                "ordinal": F.lit(i + 1), "column_name": F.lit(f.name),
                "spark_type": F.lit(f.dataType.simpleString()),
                "kind": F.lit(column_kind(f.dataType)), "n_rows": F.col("n_rows_"),
                "n_kinds": F.lit(1),
            }
            vals.update(out)
            rows.append(F.struct(*[
                vals[sf.name].cast(types[sf.name]).alias(sf.name) if sf.name in vals else nulls[sf.name]
                for sf in PROFILE_SCHEMA.fields]))
        digits = {}
        for i, f in sl:
            if column_kind(f.dataType) == "float":
                x = F.col(f"`{f.name}`").cast("double")
                digits[f"_fin_{i}"] = F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)
        src = df
        kinds = {f"_kind_{i}": text_kind(F.col(f"`{f.name}`")) for i, f in sl
                 if f.name in (cells or ()) and column_kind(f.dataType) == "string"}
        if kinds:
            src = src.withColumns(kinds)
        if digits:
            src = src.select("*", *[v.alias(k) for k, v in digits.items()])
            src = st.with_float_repr_digits(src, {k.replace("_fin_", "_digits_"): k for k in digits})
        one = src.agg(*aggs)
        parts.append(one.select(F.inline(F.array(*rows))))
    long = reduce(DataFrame.unionByName, parts)
    return with_derived(long) if derived else long


def with_derived(p: DataFrame) -> DataFrame:
    """Percentages, averages and suggestions on the long-form profile (tiny)."""
    nn = F.col("n_rows") - F.col("null_count")
    return (p
            .withColumn("null_pct", F.coalesce(
                F.round(F.try_divide(F.col("null_count") * 100.0, F.col("n_rows")), 2), F.lit(0.0)))
            .withColumn("avg_len", F.round(F.try_divide(F.col("sum_len").cast("double"), nn), 1))
            .withColumn("suggested_type",
                        F.when(F.col("kind") == "integer",
                               st.profile_int_suggestion(F.col("min_value"), F.col("max_value")))
                        .when((F.col("kind") == "float") & F.col("is_integral"),
                              st.profile_int_suggestion(F.col("min_value"), F.col("max_value")))
                        .when((F.col("kind") == "string") & F.col("max_len").isNotNull(),
                              st.profile_text_suggestion(F.col("max_len")))))


def infer_sql_types(p: DataFrame) -> DataFrame:
    """T1-T10 on a profile: adds ``sql_type``. First hit wins, as in the reference."""
    k = F.col("kind")
    sql_type = (
        F.when(F.col("null_count") >= F.col("n_rows"), F.lit(st.DEFAULT_TYPE))           # T1
        .when(st.is_id_name(F.col("column_name")), F.lit(st.ID_TYPE))                    # T2
        .when((k == "mixed"), st.mixed_type(F.col("max_len")))                             # T3
        .when(k == "integer", st.int_ladder(F.col("min_whole"), F.col("max_whole")))      # T4
        .when((k == "float") & F.col("has_inf"), F.lit("DOUBLE"))                         # T6
        .when((k == "float") & F.col("int_digits").isNotNull(),
              st.decimal_type(F.col("int_digits"), F.col("frac_digits")))                 # T5
        .when(k == "float", F.lit("DOUBLE"))
        .when(k == "datetime", F.when(F.col("has_time"), F.lit("DATETIME"))
              .otherwise(F.lit("DATE")))                                                   # T7
        .when(k == "boolean", F.lit(st.BOOL_TYPE))                                         # T8
        .when(k == "string", st.text_type(F.col("max_len")))                               # T9
        .otherwise(F.lit(st.DEFAULT_TYPE)))                                                # T10
    return p.withColumn("sql_type", sql_type)


def shape(df: DataFrame) -> DataFrame:
    """A1: rows and columns."""
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns)).cast("bigint"))


def dtypes_frame(df: DataFrame) -> DataFrame:
    """A3: column dtype listing as a DataFrame (metadata only)."""
    spark = df.sparkSession
    rows = [(i + 1, f.name, f.dataType.simpleString(), column_kind(f.dataType))
            for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "ordinal int, column_name string, spark_type string, kind string")


def select_by_kind(df: DataFrame, kinds: tuple[str, ...] = ("integer", "float")) -> DataFrame:
    """Keep only the columns of the given kinds (numeric by default)."""
    return df.select(*[F.col(f"`{f.name}`") for f in df.schema.fields
                       if column_kind(f.dataType) in kinds])


def duplicate_names(names: DataFrame, group_cols: list[str], name_col: str = "name") -> DataFrame:
    """A2: duplicate column names (count > 1) per group (e.g. per file)."""
    return (names.groupBy(*group_cols, name_col)
            .agg(F.count(F.lit(1)).cast("bigint").alias("n"))
            .where(F.col("n") > 1))


# ---------------------------------------------------------------------------
# Text-value kinds (A4 / A5): classify each text value like pandas would read it.
# pandas' to_numeric accepts these shapes.
NUMERIC_TEXT_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
INF_NAN_TEXT = ["inf", "+inf", "-inf", "infinity", "+infinity", "-infinity", "nan"]
INT_TEXT_PATTERN = r"^\s*[+-]?[0-9]+\s*$"
BOOL_TEXT = ["true", "false"]
DATE_TEXT_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2})?)?$"
# ---------------------------------------------------------------------------


def text_kind(c: Column) -> Column:
    """A4 kind of one text value: integer / float / boolean / datetime / string (null: no kind)."""
    return (F.when(c.isNull(), F.lit(None).cast("string")).when(c.rlike(INT_TEXT_PATTERN), F.lit("integer"))
            .when(c.rlike(NUMERIC_TEXT_PATTERN) | F.lower(F.trim(c)).isin(INF_NAN_TEXT),
                  F.lit("float"))
            .when(F.lower(c).isin(BOOL_TEXT), F.lit("boolean"))
            .when(c.rlike(DATE_TEXT_PATTERN), F.lit("datetime"))
            .otherwise(F.lit("string")))


def kind_histogram(df: DataFrame, columns: list[str]) -> DataFrame:
    """A4: per text column and kind, the count and one (smallest) example.

    Unpivots to ``(column_name, value)`` and aggregates; the partial aggregate is
    map-side so each task ships one small row per (column, kind).
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value"))
        for c in columns])).alias("kv")).select("kv.*").where(F.col("value").isNotNull())
    return (long.groupBy("column_name", text_kind(F.col("value")).alias("kind"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n"), F.min("value").alias("example")))


def numeric_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """A5: share (%) of non-null text values that convert to a number, and whether
    every value is integral when all convert."""
    rows = []
    aggs = []
    for i, c in enumerate(columns):
        v = F.col(f"`{c}`").cast("string")
        is_num = v.rlike(NUMERIC_TEXT_PATTERN) | F.lower(F.trim(v)).isin(INF_NAN_TEXT)
        num = F.when(is_num, F.trim(v).try_cast("double"))
        aggs += [F.count(v).alias(f"n{i}"), F.count(num).alias(f"k{i}"),
                 F.bool_and(F.when(num.isNotNull(), num % 1 == 0)).alias(f"i{i}")]
        rows.append(F.struct(
            F.lit(c).alias("column_name"), F.col(f"n{i}").cast("bigint").alias("n_values"),
            F.col(f"k{i}").cast("bigint").alias("n_numeric"),
            F.coalesce(F.round(F.try_divide(F.col(f"k{i}") * 100.0, F.col(f"n{i}")), 2),
                       F.lit(0.0)).alias("numeric_pct"),
            F.when((F.col(f"k{i}") == F.col(f"n{i}")) & (F.col(f"n{i}") > 0),
                   F.when(F.col(f"i{i}"), F.lit("all integers")).otherwise(F.lit("all floats")))
            .alias("hint")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))
