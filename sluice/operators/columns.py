"""Column operators: name normalisation (P1, P2), dropping all-null columns (P3),
numeric coercion of text columns (P4), type overrides (P6), the column mapping (P7).

Names are metadata. For one table they are handled on the driver over ``df.columns``
(like Spark's own schema handling). For many files at once (a long DataFrame of
``(file, ordinal, name)``) the same rules run as DataFrame expressions.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.clean import unicode_strip
from sluice.operators.profile import NUMERIC_TEXT_PATTERN, INF_NAN_TEXT

# Prefix for names starting with a digit, name for empty names.
DIGIT_PREFIX = "col_"
EMPTY_NAME = "column"

_NON_WORD = re.compile(r"\W")          # not (alphanumeric or underscore), Unicode-aware


def clean_name(name) -> str:
    """P1 for one name, without the duplicate suffix."""
    s = _NON_WORD.sub("_", str(name).strip())
    if s[:1].isdigit():
        return DIGIT_PREFIX + s
    return s or EMPTY_NAME


def normalize_names(names: list) -> list[str]:
    """Clean every name; the k-th repeat (k >= 1) of a cleaned name gets ``_k``."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        c = clean_name(n)
        k = seen.get(c, -1) + 1
        seen[c] = k
        out.append(c if k == 0 else f"{c}_{k}")
    return out


def make_unique(names: list[str], case_insensitive: bool = True) -> list[str]:
    """A name already taken gets the first free ``_1``, ``_2``, ... suffix.

    Taken names are compared case-insensitively by default, as Spark's resolver and
    MySQL compare column names.
    """
    key = (lambda s: s.lower()) if case_insensitive else (lambda s: s)
    taken: set[str] = set()
    out = []
    for n in names:
        cand, k = n, 0
        while key(cand) in taken:
            k += 1
            cand = f"{n}_{k}"
        taken.add(key(cand))
        out.append(cand)
    return out


def normalize_columns(df: DataFrame) -> DataFrame:
    """P1 + P2 on one table's columns."""
    return df.toDF(*make_unique(normalize_names(df.columns)))


# ---- many-files form -------------------------------------------------------------

_SPARK_NON_WORD = r"[^\p{L}\p{N}_]"


def clean_name_col(name: Column) -> Column:
    """P1 (no suffix) as a Column expression."""
    s = F.regexp_replace(unicode_strip(name.cast("string")), _SPARK_NON_WORD, "_")
    return (F.when(s == "", F.lit(EMPTY_NAME))
            .when(s.rlike(r"^\p{Nd}"), F.concat(F.lit(DIGIT_PREFIX), s))
            .otherwise(s))


def normalize_names_df(names: DataFrame, group_cols: list[str], ordinal: str = "ordinal",
                       name: str = "name") -> DataFrame:
    """P1 over a long table of headers: adds ``clean`` and ``normalized``.

    The repeat number is a ``row_number`` over (group, clean name) — one small window
    per distinct name of one header, never the whole table.
    """
    w = Window.partitionBy(*group_cols, "clean").orderBy(ordinal)
    k = F.row_number().over(w) - 1
    return (names.withColumn("clean", clean_name_col(F.col(name)))
            .withColumn("normalized", F.when(k == 0, F.col("clean"))
                        .otherwise(F.concat_ws("_", F.col("clean"), k.cast("string"))))
            .drop("clean"))


#: what the free-suffix search appends; names that differ only in this tail can meet, others cannot
_SUFFIXES = r"(_[0-9]+)+$"


def unique_names_df(names: DataFrame, group_cols: list[str], ordinal: str = "ordinal",
                    name: str = "normalized", case_insensitive: bool = True) -> DataFrame:
    """P2 over a long table of headers: adds ``unique_name``.

    The search for a free suffix is a fold over names in order with the taken names as state. A name and its
    suffixed forms share what stands before their suffixes, so each header splits into families that never meet,
    and each family folds on its own: in native expressions, as many groups as there are distinct stems.
    """
    low = (lambda c: f"lower({c})") if case_insensitive else (lambda c: c)
    families = (names.withColumn("_stem", F.regexp_replace(F.expr(low(f"`{name}`")), _SUFFIXES, ""))
                .groupBy(*group_cols, "_stem").agg(F.array_sort(F.collect_list(F.struct(
                    F.col(ordinal).alias("o"), F.struct(*names.columns).alias("row"), F.col(name).alias("n")))).alias("_all")))
    first_free = (f"element_at(filter(sequence(1, size(acc.taken) + 1), "
                  f"k -> NOT array_contains(acc.taken, concat({low('x.n')}, '_', cast(k AS string)))), 1)")
    fold = f"""aggregate(_all, named_struct('taken', cast(array() AS array<string>), 'made', cast(array() AS array<string>)),
        (acc, x) -> transform(array(if(array_contains(acc.taken, {low('x.n')}), concat(x.n, '_', cast({first_free} AS string)), x.n)),
                              c -> named_struct('taken', array_append(acc.taken, {low('c')}), 'made', array_append(acc.made, c)))[0],
        acc -> acc.made)"""
    return (families.withColumn("_made", F.expr(fold)).select(F.explode(F.arrays_zip("_all", "_made")).alias("_z"))
            .select("_z._all.row.*", F.col("_z._made").alias("unique_name")))


# ---- table-level column operators ------------------------------------------------

def null_column_names(df: DataFrame) -> list[str]:
    """Names of the columns that hold no value (one aggregate pass)."""
    if not df.columns:
        return []
    row = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    return [c for i, c in enumerate(df.columns) if row[f"n{i}"] == 0]


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Drop the columns that are entirely null."""
    empty = set(null_column_names(df))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in empty])


def _numeric_text(v: Column) -> Column:
    t = F.trim(v)
    return F.when(v.rlike(NUMERIC_TEXT_PATTERN) | F.lower(t).isin(INF_NAN_TEXT), t.try_cast("double"))


def coerce_numeric(df: DataFrame, min_share: float = 1.0) -> DataFrame:
    """A text column whose non-null values parse as numbers (share >= ``min_share``)
    becomes numeric: BIGINT when every parsed value is integral, else DOUBLE.

    ``min_share=1.0`` is lossless; a tiny share (e.g. 1e-9) mimics "any value parses".
    Nulls do not spoil the integral test. One aggregate pass decides all columns.
    """
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text:
        return df
    aggs = []
    for i, c in enumerate(text):
        v = F.col(f"`{c}`")
        num = _numeric_text(v)
        aggs += [F.count(v).alias(f"n{i}"), F.count(num).alias(f"k{i}"),
                 F.bool_and(F.when(num.isNotNull(), (num % 1 == 0) & (F.abs(num) < 9.2e18)))
                 .alias(f"i{i}")]
    stats = df.agg(*aggs).first()
    decide = {}
    for i, c in enumerate(text):
        n, k, integral = stats[f"n{i}"], stats[f"k{i}"], stats[f"i{i}"]
        if n and k and k / n >= min_share:
            decide[c] = "bigint" if integral else "double"
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in decide:
            num = _numeric_text(c)
            if decide[f.name] == "bigint":
                val = F.coalesce(F.trim(c).try_cast("bigint"), num.try_cast("bigint"))
            else:
                val = num
            out.append(val.alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def apply_overrides(mapping: DataFrame, overrides: dict[str, str]) -> DataFrame:
    """User type overrides on a mapping ``(current, sql_type, ...)``."""
    if not overrides:
        return mapping.withColumn("overridden", F.lit(False))
    ov = F.create_map(*[x for k, v in overrides.items() for x in (F.lit(k), F.lit(v))])
    hit = ov[F.col("current")]
    return (mapping.withColumn("overridden", hit.isNotNull())
            .withColumn("sql_type", F.coalesce(hit, F.col("sql_type"))))


def column_mapping(original: list[str], current: list[str], typed_profile: DataFrame) -> DataFrame:
    """``(ordinal, original, current, sql_type, modified)``; ``original`` is the
    true header (D6), ``sql_type`` comes from the full-scan profile."""
    spark = typed_profile.sparkSession
    names = spark.createDataFrame(
        [(i + 1, str(o), c) for i, (o, c) in enumerate(zip(original, current))],
        "ordinal int, original string, current string")
    types = typed_profile.select(F.col("column_name").alias("current"), "sql_type")
    return (names.join(F.broadcast(types), "current", "left")   # one row per column: bounded
            .select("ordinal", "original", "current",
                    F.coalesce("sql_type", F.lit("VARCHAR(255)")).alias("sql_type"),
                    (F.col("original") != F.col("current")).alias("modified")))
