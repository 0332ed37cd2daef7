"""Formatting helpers as native expressions: fixed-point text with Python's rounding,
human file sizes (C10), human durations (C11), path parts (C12)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit words of the reference's size and duration texts.
SIZE_UNITS = ("字节", "KB", "MB")          # bytes, KiB, MiB
DURATION_UNITS = ("秒", "分钟", "小时")      # seconds, minutes, hours


def py_fixed(x: Column, digits: int) -> Column:
    """Python ``f"{x:.{digits}f}"``: rounds the exact binary value (Java's ``%.1f``
    rounds the shortest decimal text half-up, which differs on e.g. 0.15)."""
    pattern = "0" if digits == 0 else "0." + "0" * digits
    return F.call_function("format_number", x.cast("double"), F.lit(pattern))


def human_size(n_bytes: Column, units: tuple[str, str, str] = SIZE_UNITS) -> Column:
    """``n <unit0>`` below 1 KiB, ``x.xx <unit1>`` below 1 MiB, else ``x.xx <unit2>``."""
    b = n_bytes.cast("bigint")
    return (F.when(b < 1024, F.concat(b.cast("string"), F.lit(" " + units[0])))
            .when(b < 1024 * 1024, F.concat(py_fixed(b / 1024.0, 2), F.lit(" " + units[1])))
            .otherwise(F.concat(py_fixed(b / (1024.0 * 1024.0), 2), F.lit(" " + units[2]))))


def human_duration(seconds: Column, units: tuple[str, str, str] = DURATION_UNITS,
                   digits: int = 1) -> Column:
    """C11: seconds below 60, minutes below 3600, else hours; one decimal."""
    s = seconds.cast("double")
    return (F.when(s < 60, F.concat(py_fixed(s, digits), F.lit(units[0])))
            .when(s < 3600, F.concat(py_fixed(s / 60.0, digits), F.lit(units[1])))
            .otherwise(F.concat(py_fixed(s / 3600.0, digits), F.lit(units[2]))))


def base_name(path: Column) -> Column:
    """Last path element (``/`` or ``\\`` separated)."""
    return F.substring_index(F.translate(path, "\\", "/"), "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot (``''`` when none), like ``splitext``."""
    return F.lower(F.regexp_extract(base_name(path), r"^\.*[^.].*(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    """Base name without the extension."""
    b = base_name(path)
    ext = F.regexp_extract(b, r"^\.*[^.].*(\.[^.]*)$", 1)
    return F.substring(b, F.lit(1), F.length(b) - F.length(ext))


def table_name_for(stem_col: Column, epoch_seconds: int) -> Column:
    """K7: non-alphanumeric characters -> ``_``, then ``_<epoch seconds>``."""
    return F.concat(F.regexp_replace(stem_col, r"[^\p{L}\p{N}]", "_"), F.lit(f"_{int(epoch_seconds)}"))
