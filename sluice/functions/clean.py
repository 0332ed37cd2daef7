"""Value cleaning (C0-C9) as native Spark expressions: no Python in the plan.

``clean_text(col)`` turns one dirty text value into
``STRUCT<kind STRING, num DOUBLE, ts TIMESTAMP_NTZ, str STRING>`` where ``kind`` is
one of ``null``, ``num``, ``ts``, ``str``. Rules are tried in order, first hit wins:

1. strip Unicode whitespace; empty or a null token (any case) -> null
2. percent ``-?d+(.d+)? %`` -> number / 100
3. currency / embedded number (lazy prefix, optional minus, digits with commas) -> sign * number
4. Y-M-D, then D-M-Y, then M-D-Y (separators ``/ - .``), then ISO date-time
   (fraction and zone dropped, wall time kept); impossible dates fall through
5. plain number (only reachable with non-ASCII digits)
6. otherwise text, cut at 65,535 characters
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the reference's rules for identical results.
# Null tokens compared after strip, lower-cased: '', null, none, na, nan
NULL_TOKENS = ["null", "none", "na", "nan"]
# Patterns, in the reference's own order (Python syntax, \d and \s Unicode-aware):
PERCENT_PATTERN = r"^-?\s*\d+(\.\d+)?\s*%$"
CURRENCY_PATTERN = r"^[^\d]*?(-?)[\s]*([0-9,]+(\.\d+)?)[\s]*[^\d]*$"
YMD_PATTERN = r"^(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})$"
DMY_PATTERN = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})$"   # also tried as M-D-Y
ISO_PATTERN = r"^(\d{4})-(\d{2})-(\d{2})[T\s](\d{2}):(\d{2}):(\d{2})(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?$"
PLAIN_NUMBER_PATTERN = r"^-?\d+(\.\d+)?$"
MAX_TEXT_CHARS = 65535
# ---------------------------------------------------------------------------

# Java needs (?U) for Unicode \\d / \\s (Python's default). The date patterns run as they stand: without
# (?U) their digits are ASCII, and a date written with other digits cannot be parsed anyway.
_U = "(?U)"
_WS = r"[\s\x1c-\x1f]"  # Python's str.strip() also strips the four separator controls
_STRIP = _U + rf"^{_WS}+|{_WS}+$"
# differs from PERCENT_PATTERN in function: groups the number, and allows no space after '-',
# which float() rejects
_PERCENT_NUM = _U + r"^(-?\d+(?:\.\d+)?)\s*%$"
_CURRENCY = _U + CURRENCY_PATTERN
_PLAIN = _U + PLAIN_NUMBER_PATTERN
_DIGIT_SPAN = r"(?sU)\d(?:.*\d)?"
_NUMBER_SPAN = r"(?U)^[0-9][0-9,]*(?:\.\d+)?$"

FULLWIDTH_DIGITS = "０１２３４５６７８９"
ASCII_DIGITS = "0123456789"

CLEAN_TYPE = T.StructType([
    T.StructField("kind", T.StringType(), False),
    T.StructField("num", T.DoubleType(), True),
    T.StructField("ts", T.TimestampNTZType(), True),
    T.StructField("str", T.StringType(), True),
])


def unicode_strip(c: Column) -> Column:
    """Python ``str.strip()``: Spark's ``trim`` only removes U+0020."""
    return F.regexp_replace(c, _STRIP, "")


def _ascii_digits(c: Column) -> Column:
    return F.translate(c, FULLWIDTH_DIGITS, ASCII_DIGITS)


def _to_double(c: Column) -> Column:
    return _ascii_digits(c).try_cast("double")


def _ts(y: Column, m: Column, d: Column, hh=None, mi=None, ss=None) -> Column:
    z = F.lit(0)
    return F.try_make_timestamp_ntz(
        y.try_cast("int"), m.try_cast("int"), d.try_cast("int"),
        (hh if hh is not None else z).try_cast("int"),
        (mi if mi is not None else z).try_cast("int"),
        (ss if ss is not None else z).try_cast("decimal(16,6)"))


def _g(v: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(v, pattern, i)


def is_null_token(v: Column) -> Column:
    """After strip: '' or one of the null tokens, any case."""
    return v.isNull() | (v == "") | F.lower(v).isin(NULL_TOKENS)


def _pieces(v: Column) -> dict[str, Column]:
    """Every rule's candidate result for one stripped value (stage 2)."""
    pct = F.when(v.rlike(_PERCENT_NUM), _to_double(_g(v, _PERCENT_NUM, 1)) / F.lit(100.0))
    # The currency pattern's lazy prefix backtracks badly on long texts. Every digit of
    # a match lies inside its one number, so a match is only possible when the span
    # from the first to the last digit is such a number: test that in linear time and
    # run the full pattern (for its groups) only then. Texts without digits never
    # yield a number here (the number would be commas only).
    digit_span = F.regexp_extract(v, _DIGIT_SPAN, 0)
    cur_ok = (digit_span != "") & digit_span.rlike(_NUMBER_SPAN) & v.rlike(_CURRENCY)
    cur_text = F.regexp_replace(_g(v, _CURRENCY, 2), ",", "")
    cur_num = _to_double(cur_text)
    whole = _ascii_digits(cur_text)
    big = F.when(cur_ok & ~whole.contains("."), whole.try_cast("decimal(38,0)"))
    big = F.when(_g(v, _CURRENCY, 1) == "-", -big).otherwise(big)
    cur = F.when(cur_ok, F.when(_g(v, _CURRENCY, 1) == "-", -cur_num).otherwise(cur_num))
    ymd = F.when(v.rlike(YMD_PATTERN), _ts(_g(v, YMD_PATTERN, 1), _g(v, YMD_PATTERN, 2), _g(v, YMD_PATTERN, 3)))
    dmy_ok = v.rlike(DMY_PATTERN)
    dmy = F.when(dmy_ok, _ts(_g(v, DMY_PATTERN, 3), _g(v, DMY_PATTERN, 2), _g(v, DMY_PATTERN, 1)))
    mdy = F.when(dmy_ok, _ts(_g(v, DMY_PATTERN, 3), _g(v, DMY_PATTERN, 1), _g(v, DMY_PATTERN, 2)))
    iso_ok = v.rlike(ISO_PATTERN) & (_g(v, ISO_PATTERN, 6).try_cast("int") < 60)
    iso = F.when(iso_ok, _ts(_g(v, ISO_PATTERN, 1), _g(v, ISO_PATTERN, 2), _g(v, ISO_PATTERN, 3),
                             _g(v, ISO_PATTERN, 4), _g(v, ISO_PATTERN, 5), _g(v, ISO_PATTERN, 6)))
    return {"v": v, "is_null": is_null_token(v), "num": F.coalesce(pct, cur),
            "big": F.when(pct.isNull(), big),
            "ts": F.coalesce(ymd, dmy, mdy, iso), "plain": F.when(v.rlike(_PLAIN), _to_double(v))}


def _assemble_fields(p: dict[str, Column], cut: bool = True) -> dict[str, Column]:
    """Stage 3: first hit wins -> kind, num, ts, str, and big: the digits of a whole number,
    which a double may not hold. ``cut`` applies C8c (65,535 characters) to text."""
    kind = (F.when(p["is_null"], F.lit("null"))
            .when(p["num"].isNotNull(), F.lit("num"))
            .when(p["ts"].isNotNull(), F.lit("ts"))
            .when(p["plain"].isNotNull(), F.lit("num"))
            .otherwise(F.lit("str")))
    return {"kind": kind,
            "num": F.when(kind == "num", F.coalesce(p["num"], p["plain"])),
            "ts": F.when(kind == "ts", p["ts"]),
            "str": F.when(kind == "str", F.left(p["v"], F.lit(MAX_TEXT_CHARS)) if cut else p["v"]),
            "big": F.when(kind == "num", p["big"])}


def _assemble(p: dict[str, Column]) -> Column:
    f = _assemble_fields(p)
    return F.struct(*[f[k].alias(k) for k in ("kind", "num", "ts", "str")])


_PIECES = ["v", "is_null", "num", "ts", "plain", "big"]


def clean_columns(df: DataFrame, cols: dict[str, str], flat: bool = False, cut: bool = True) -> DataFrame:
    """C0 as a transform: for each ``out -> source`` text column adds ``out`` as
    ``STRUCT<kind, num, ts, str>`` (or, with ``flat=True``, the four columns
    ``out__kind``, ``out__num``, ``out__ts``, ``out__str``, ``out__big``).

    Staged projections of flat columns (strip; every rule's candidate; first hit) so
    each regex runs once per value and the generated code stays small. Catalyst does
    not merge them back because the intermediates are not cheap expressions; the
    struct is built last, from attributes, so consumers of single fields never
    re-inline the rules.
    """
    keep = [F.col(f"`{c}`") for c in df.columns]
    tmp = {out: f"__clean{i}_" for i, out in enumerate(cols)}
    s1 = df.select(*keep, *[unicode_strip(F.col(f"`{src}`")).alias(tmp[out] + "v")
                                    for out, src in cols.items()])
    s2 = s1.select(*keep, *[c.alias(tmp[out] + k) for out in cols
                            for k, c in _pieces(F.col(tmp[out] + "v")).items()])
    s3 = s2.select(*keep, *[c.alias(f"{out}__{k}") for out in cols
                            for k, c in _assemble_fields({k: F.col(tmp[out] + k) for k in _PIECES}, cut).items()])
    if flat:
        return s3
    return s3.select(*keep, *[F.struct(*[F.col(f"`{out}__{k}`").alias(k) for k in ("kind", "num", "ts", "str")])
                              .alias(out) for out in cols])


def clean_text(c: Column | str) -> Column:
    """C0 on one text value as a single Column expression (convenient for a few
    columns; for many columns use ``clean_columns``, which stages the work)."""
    raw = F.col(c) if isinstance(c, str) else c
    return _assemble(_pieces(unicode_strip(raw)))


def clean_number(c: Column | str) -> Column:
    """C1 on a numeric column: NaN and +-inf -> null, other values unchanged."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)


def python_float_text(x: Column) -> Column:
    """``str(float)`` of a finite double: plain digits from 1e-4 up to 1e16, else an exponent."""
    java = x.cast("string")
    size = F.abs(x)
    plain = F.regexp_replace(java.try_cast("decimal(38,18)").cast("string"), r"0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    mantissa = F.regexp_replace(F.substring_index(java, "E", 1), r"\.0$", "")
    exponent = F.substring_index(java, "E", -1).try_cast("int")
    sign = F.when(exponent < 0, "-").otherwise("+")
    scientific = F.concat(mantissa, F.lit("e"), sign, F.lpad(F.abs(exponent).cast("string"),
                                                             F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")))
    return (F.when((size < 1e16) & (x == F.floor(x)), F.format_string("%.1f", x))
            .when((size >= 1e-4) & (size < 1e16), F.when(java.contains("E"), plain).otherwise(java))
            .otherwise(scientific))
