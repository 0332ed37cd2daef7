"""SQL type rules (T1-T10, A7, A8) as Column expressions over profile columns,
plus the SQL-type -> Spark storage-type map (N7) and identifier quoting (P5).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Integer ladders and text limits, as in the reference.
UNSIGNED_LADDER = [  # (max value inclusive, type) for min >= 0
    (255, "TINYINT UNSIGNED"),
    (65535, "SMALLINT UNSIGNED"),
    (16777215, "MEDIUMINT UNSIGNED"),
    (4294967295, "INT UNSIGNED"),
]
UNSIGNED_TOP = "BIGINT UNSIGNED"
SIGNED_LADDER = [  # (min, max, type) for min < 0
    (-128, 127, "TINYINT"),
    (-32768, 32767, "SMALLINT"),
    (-8388608, 8388607, "MEDIUMINT"),
    (-2147483648, 2147483647, "INT"),
]
SIGNED_TOP = "BIGINT"
# The profiling suggestion (A7) uses a shorter ladder without MEDIUMINT:
PROFILE_UNSIGNED_LADDER = [(255, "TINYINT UNSIGNED"), (65535, "SMALLINT UNSIGNED"),
                           (4294967295, "INT UNSIGNED")]
PROFILE_SIGNED_LADDER = [(-128, 127, "TINYINT"), (-32768, 32767, "SMALLINT"),
                         (-2147483648, 2147483647, "INT")]
VARCHAR_MAX = 255
TEXT_MAX = 65535
MEDIUMTEXT_MAX = 16777215
MIXED_VARCHAR_MAX = 65535
DECIMAL_MAX_PRECISION = 65
DECIMAL_MAX_SCALE = 30
INT_MAX_DIGITS = 10
DEFAULT_TYPE = "VARCHAR(255)"
ID_TYPE = "BIGINT"
BOOL_TYPE = "TINYINT(1)"
# ---------------------------------------------------------------------------


def int_ladder(mn: Column, mx: Column, unsigned=UNSIGNED_LADDER, signed=SIGNED_LADDER,
               unsigned_top=UNSIGNED_TOP, signed_top=SIGNED_TOP) -> Column:
    """Smallest integer type holding [mn, mx]."""
    u = None
    for hi, name in unsigned:
        u = (F.when(mx <= hi, F.lit(name)) if u is None else u.when(mx <= hi, F.lit(name)))
    u = u.otherwise(F.lit(unsigned_top))
    s = None
    for lo, hi, name in signed:
        cond = (mn >= lo) & (mx <= hi)
        s = F.when(cond, F.lit(name)) if s is None else s.when(cond, F.lit(name))
    s = s.otherwise(F.lit(signed_top))
    return F.when(mn >= 0, u).otherwise(s)


def profile_int_suggestion(mn: Column, mx: Column) -> Column:
    """A7's eight-rung suggestion (no MEDIUMINT)."""
    return int_ladder(mn, mx, PROFILE_UNSIGNED_LADDER, PROFILE_SIGNED_LADDER)


def _one_and_half(n: Column) -> Column:
    """int(1.5 * n) for a non-negative integer n, exact."""
    return F.floor((n.cast("bigint") * 3) / 2).cast("bigint")


def text_type(max_len: Column) -> Column:
    """Text type from the longest value (<= 0 counts as 255)."""
    m = F.when(max_len.isNull() | (max_len <= 0), F.lit(255)).otherwise(max_len)
    return (F.when(m <= VARCHAR_MAX,
                   F.format_string("VARCHAR(%d)", F.least(_one_and_half(m), F.lit(VARCHAR_MAX))))
            .when(m <= TEXT_MAX, F.lit("TEXT"))
            .when(m <= MEDIUMTEXT_MAX, F.lit("MEDIUMTEXT"))
            .otherwise(F.lit("LONGTEXT")))


def profile_text_suggestion(max_len: Column) -> Column:
    """A8's suggestion: VARCHAR(min(int(1.5 max), 255)) / TEXT / LONGTEXT."""
    return (F.when(max_len <= VARCHAR_MAX,
                   F.format_string("VARCHAR(%d)", F.least(_one_and_half(max_len), F.lit(VARCHAR_MAX))))
            .when(max_len <= TEXT_MAX, F.lit("TEXT"))
            .otherwise(F.lit("LONGTEXT")))


def mixed_type(max_len: Column) -> Column:
    """Mixed kinds including text -> VARCHAR(min(int(1.5 max), 65535))."""
    m = F.when(max_len.isNull() | (max_len <= 0), F.lit(255)).otherwise(max_len)
    return F.format_string("VARCHAR(%d)", F.least(_one_and_half(m), F.lit(MIXED_VARCHAR_MAX)))


def decimal_type(int_digits: Column, frac_digits: Column) -> Column:
    """T5: DECIMAL(p,s) from the widest integer part and fraction of ``str(x)``;
    no fraction anywhere -> INT (<= 10 digits) / BIGINT."""
    p0 = F.least(int_digits + frac_digits, F.lit(DECIMAL_MAX_PRECISION))
    s = F.least(frac_digits, F.lit(DECIMAL_MAX_SCALE))
    p1 = F.when(p0 <= 0, F.lit(1)).otherwise(p0)
    p = F.when(s >= p1, s + 1).otherwise(p1)
    return (F.when(frac_digits == 0,
                   F.when(int_digits <= INT_MAX_DIGITS, F.lit("INT")).otherwise(F.lit("BIGINT")))
            .otherwise(F.format_string("DECIMAL(%d,%d)", p, s)))


def with_float_repr_digits(df, cols: dict[str, str]):
    """Adds, for each ``out -> source`` pair, ``out`` = ``STRUCT<int_digits, frac_digits>``:
    the digits of Python's ``str(float)`` for a finite double, without Python; the minus
    sign counts as an integer digit.

    Java prints 1e-3 <= |x| < 1e7 plainly and the rest as ``d.dddEn``; Python prints
    1e-4 <= |x| < 1e16 plainly (always with a fraction, ``5.0``) and the rest as
    ``d.ddde+nn``. Both give the same shortest digit string: a plain text has its digits left
    and right of the point; only a text with an exponent is laid out anew the Python way.
    The text is staged as a flat column, so a number is printed once per row.
    """
    keep = [F.col(f"`{c}`") for c in df.columns]
    n = {out: f"__fd{i}" for i, out in enumerate(cols)}
    df1 = df.select(*keep, *[F.col(f"`{src}`").cast("string").alias(n[out]) for out, src in cols.items()])
    made = []
    for out in cols:
        js = F.col(n[out])
        point = F.instr(js, ".")
        neg = F.when(js.startswith("-"), F.lit(1)).otherwise(F.lit(0))
        mantissa = F.substring_index(js, "E", 1)
        e = F.substring_index(js, "E", -1).try_cast("int")
        nd = F.when(mantissa.endswith(".0"), F.lit(1)).otherwise(F.length(mantissa) - 1 - neg)
        exp_len = F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))) + 2
        plain = (e >= -4) & (e < 16)
        int_d = (F.when(plain & (e >= 0), e + 1).when(plain, F.lit(1))
                 .when(nd > 1, F.lit(1)).otherwise(1 + exp_len)) + neg
        frac_d = (F.when(plain & (e >= 0), F.greatest(nd - (e + 1), F.lit(1)))
                  .when(plain, (-e - 1) + nd).when(nd > 1, (nd - 1) + exp_len).otherwise(F.lit(0)))
        spread_out = F.struct(int_d.cast("int").alias("int_digits"), frac_d.cast("int").alias("frac_digits"))
        as_printed = F.struct((point - 1).cast("int").alias("int_digits"),
                              (F.length(js) - point).cast("int").alias("frac_digits"))
        made.append(F.when(js.isNotNull(), F.when(js.contains("E"), spread_out).otherwise(as_printed)).alias(out))
    return df1.select(*keep, *made)


def is_id_name(name: Column) -> Column:
    """``id`` or ends with ``_id``, any case."""
    n = F.lower(name)
    return (n == "id") | n.endswith("_id")


def quote_identifier(c: Column) -> Column:
    """P5: backtick -> space, wrapped in backticks; null -> NULL."""
    return F.coalesce(F.concat(F.lit("`"), F.regexp_replace(c, "`", " "), F.lit("`")), F.lit("NULL"))


def quote_identifier_py(name: str | None) -> str:
    return "NULL" if name is None else "`" + str(name).replace("`", " ") + "`"


_DEC = re.compile(r"^DECIMAL\((\d+),(\d+)\)$", re.I)
_VARCHAR = re.compile(r"^VARCHAR\((\d+)\)$", re.I)


def spark_type_for(sql_type: str) -> T.DataType:
    """Storage type in Spark for an emitted SQL type."""
    t = sql_type.strip().upper()
    table = {
        "TINYINT UNSIGNED": T.ShortType(), "SMALLINT UNSIGNED": T.IntegerType(),
        "MEDIUMINT UNSIGNED": T.IntegerType(), "INT UNSIGNED": T.LongType(),
        "BIGINT UNSIGNED": T.DecimalType(20, 0), "TINYINT": T.ByteType(),
        "SMALLINT": T.ShortType(), "MEDIUMINT": T.IntegerType(), "INT": T.IntegerType(),
        "INTEGER": T.IntegerType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(),
        "FLOAT": T.DoubleType(), "DATE": T.DateType(), "DATETIME": T.TimestampNTZType(),
        "TIMESTAMP": T.TimestampNTZType(), "TINYINT(1)": T.BooleanType(),
        "BOOLEAN": T.BooleanType(), "TEXT": T.StringType(), "MEDIUMTEXT": T.StringType(),
        "LONGTEXT": T.StringType(),
    }
    if t in table:
        return table[t]
    m = _DEC.match(t)
    if m:
        p, s = int(m.group(1)), int(m.group(2))
        return T.DecimalType(p, s) if p <= 38 else T.DoubleType()
    if _VARCHAR.match(t):
        return T.StringType()
    return T.StringType()


def type_bounds(sql_type: str) -> dict:
    """Value limits of a SQL type for the fit check (Q1)."""
    t = sql_type.strip().upper()
    for hi, name in UNSIGNED_LADDER:
        if t == name:
            return {"kind": "int", "min": 0, "max": hi}
    if t == UNSIGNED_TOP:
        return {"kind": "int", "min": 0, "max": 18446744073709551615}
    for lo, hi, name in SIGNED_LADDER:
        if t == name:
            return {"kind": "int", "min": lo, "max": hi}
    if t in ("BIGINT", "INTEGER"):
        return {"kind": "int", "min": -9223372036854775808, "max": 9223372036854775807}
    m = _DEC.match(t)
    if m:
        return {"kind": "decimal", "p": int(m.group(1)), "s": int(m.group(2))}
    m = _VARCHAR.match(t)
    if m:
        return {"kind": "text", "max_len": int(m.group(1))}
    if t == "TEXT":
        return {"kind": "text", "max_len": TEXT_MAX}
    if t == "MEDIUMTEXT":
        return {"kind": "text", "max_len": MEDIUMTEXT_MAX}
    if t == "LONGTEXT":
        return {"kind": "text", "max_len": None}
    if t in ("DATE", "DATETIME", "TIMESTAMP"):
        return {"kind": "time", "type": t}
    if t == "TINYINT(1)":
        return {"kind": "bool"}
    if t in ("DOUBLE", "FLOAT"):
        return {"kind": "double"}
    return {"kind": "text", "max_len": None}
