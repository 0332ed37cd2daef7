"""DuckDB oracle SQL for the registered queries (tables pre-registered as views).

Independent re-statements of each operator's rules in plain SQL over the same
Parquet tables; derived inputs come from the same templates (``inputs``) rendered
for DuckDB. Column names equal those of the Spark queries.
"""

from __future__ import annotations

import pyarrow.parquet as pq

from sluice.plans import inputs as I
from sluice.plans.queries import CHUNK_ROWS, CLEAN_RULES, DAY, EPOCH, TYPED_TABLES

D = "duckdb"
SCHEMA_DIR = "/root/testdata/sf0.001"


def _cols(table: str) -> list[tuple[str, str]]:
    """(name, kind) of a table's columns, read from the Parquet schema."""
    sch = pq.read_schema(f"{SCHEMA_DIR}/{table}.parquet")
    out = []
    for f in sch:
        t = str(f.type)
        if t.startswith(("int", "uint")):
            k = "integer"
        elif t in ("double", "float"):
            k = "float"
        elif t.startswith("timestamp") or t.startswith("date"):
            k = "datetime"
        elif t in ("string", "large_string"):
            k = "string"
        elif t == "bool":
            k = "boolean"
        else:
            k = "other"
        out.append((f.name, k))
    return out


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---- type rules in SQL ------------------------------------------------------------------

def _int_ladder(mn: str, mx: str, short: bool = False) -> str:
    if short:
        u = (f"CASE WHEN {mx} <= 255 THEN 'TINYINT UNSIGNED' WHEN {mx} <= 65535 THEN 'SMALLINT UNSIGNED' "
             f"WHEN {mx} <= 4294967295 THEN 'INT UNSIGNED' ELSE 'BIGINT UNSIGNED' END")
        s = (f"CASE WHEN {mn} >= -128 AND {mx} <= 127 THEN 'TINYINT' WHEN {mn} >= -32768 AND {mx} <= 32767 "
             f"THEN 'SMALLINT' WHEN {mn} >= -2147483648 AND {mx} <= 2147483647 THEN 'INT' ELSE 'BIGINT' END")
    else:
        u = (f"CASE WHEN {mx} <= 255 THEN 'TINYINT UNSIGNED' WHEN {mx} <= 65535 THEN 'SMALLINT UNSIGNED' "
             f"WHEN {mx} <= 16777215 THEN 'MEDIUMINT UNSIGNED' WHEN {mx} <= 4294967295 THEN 'INT UNSIGNED' "
             f"ELSE 'BIGINT UNSIGNED' END")
        s = (f"CASE WHEN {mn} >= -128 AND {mx} <= 127 THEN 'TINYINT' WHEN {mn} >= -32768 AND {mx} <= 32767 "
             f"THEN 'SMALLINT' WHEN {mn} >= -8388608 AND {mx} <= 8388607 THEN 'MEDIUMINT' "
             f"WHEN {mn} >= -2147483648 AND {mx} <= 2147483647 THEN 'INT' ELSE 'BIGINT' END")
    return f"CASE WHEN {mn} >= 0 THEN {u} ELSE {s} END"


def _text_type(m: str) -> str:
    mm = f"(CASE WHEN {m} IS NULL OR {m} <= 0 THEN 255 ELSE {m} END)"
    return (f"CASE WHEN {mm} <= 255 THEN 'VARCHAR(' || CAST(least(({mm} * 3) // 2, 255) AS VARCHAR) || ')' "
            f"WHEN {mm} <= 65535 THEN 'TEXT' WHEN {mm} <= 16777215 THEN 'MEDIUMTEXT' ELSE 'LONGTEXT' END")


def _digits(c: str) -> tuple[str, str]:
    v = f"CAST(CASE WHEN isfinite({c}) THEN {c} END AS VARCHAR)"
    i = f"CASE WHEN contains({v}, '.') THEN length(split_part({v}, '.', 1)) ELSE length({v}) END"
    f = f"CASE WHEN contains({v}, '.') THEN length(split_part({v}, '.', 2)) ELSE 0 END"
    return i, f


def _decimal(i: str, f: str) -> str:
    p0 = f"least({i} + {f}, 65)"
    s = f"least({f}, 30)"
    p1 = f"(CASE WHEN {p0} <= 0 THEN 1 ELSE {p0} END)"
    p = f"(CASE WHEN {s} >= {p1} THEN {s} + 1 ELSE {p1} END)"
    return (f"CASE WHEN {f} = 0 THEN CASE WHEN {i} <= 10 THEN 'INT' ELSE 'BIGINT' END "
            f"ELSE printf('DECIMAL(%d,%d)', {p}, {s}) END")


def _type_row(table: str, src: str, ordinal: int, name: str, col: str, kind: str,
              extra: str = "") -> str:
    """One row: table_name, ordinal, column_name, sql_type (+ extra columns)."""
    nm = name.lower()
    is_id = "TRUE" if (nm == "id" or nm.endswith("_id")) else "FALSE"
    c = col
    if kind == "integer":
        body = _int_ladder(f"min({c})", f"max({c})")
    elif kind == "float":
        i, f = _digits(c)
        body = (f"CASE WHEN bool_or(isinf({c})) THEN 'DOUBLE' WHEN max({i}) IS NULL THEN 'DOUBLE' "
                f"ELSE {_decimal(f'max({i})', f'max({f})')} END")
    elif kind == "datetime":
        body = (f"CASE WHEN bool_or(hour({c}) <> 0 OR minute({c}) <> 0 OR second({c}) <> 0) "
                f"THEN 'DATETIME' ELSE 'DATE' END")
    elif kind == "string":
        body = _text_type(f"max(length({c}))")
    elif kind == "boolean":
        body = "'TINYINT(1)'"
    else:
        body = "'VARCHAR(255)'"
    sql_type = (f"CASE WHEN count({c}) = 0 THEN 'VARCHAR(255)' WHEN {is_id} THEN 'BIGINT' "
                f"ELSE {body} END")
    return (f"SELECT {_q(table)} AS table_name, {ordinal} AS ordinal, {_q(name)} AS column_name, "
            f"{sql_type} AS sql_type{extra} FROM {src}")


def infer_types_sql(tables=TYPED_TABLES) -> str:
    parts = []
    for t in tables:
        for i, (c, k) in enumerate(_cols(t)):
            parts.append(_type_row(t, t, i + 1, c, f'"{c}"', k))
    return _union(parts)


def int_ladder_sql() -> str:
    parts = []
    for t in TYPED_TABLES:
        for i, (c, k) in enumerate(_cols(t)):
            if k == "integer":
                parts.append(_type_row(t, t, i + 1, c, f'"{c}"', k,
                                       f', CAST(min("{c}") AS DOUBLE) AS min_value, CAST(max("{c}") AS DOUBLE) AS max_value'))
    return f"SELECT table_name, column_name, min_value, max_value, sql_type FROM ({_union(parts)})"


def decimal_type_sql() -> str:
    parts = []
    for t in TYPED_TABLES:
        for i, (c, k) in enumerate(_cols(t)):
            if k == "float":
                di, df = _digits(f'"{c}"')
                parts.append(_type_row(t, t, i + 1, c, f'"{c}"', k,
                                       f", CAST(max({di}) AS INTEGER) AS int_digits, CAST(max({df}) AS INTEGER) AS frac_digits"))
    return f"SELECT table_name, column_name, int_digits, frac_digits, sql_type FROM ({_union(parts)})"


def date_or_datetime_sql() -> str:
    parts = []
    for t in TYPED_TABLES:
        for i, (c, k) in enumerate(_cols(t)):
            if k == "datetime":
                parts.append(_type_row(t, t, i + 1, c, f'"{c}"', k,
                                       f', bool_or(hour("{c}") <> 0 OR minute("{c}") <> 0 OR second("{c}") <> 0) AS has_time'))
    return f"SELECT table_name, column_name, has_time, sql_type FROM ({_union(parts)})"


# ---- profiling --------------------------------------------------------------------------

def profile_nulls_sql() -> str:
    src = f"({I.events_with_nulls_sql(D)})"
    cols = ["event_id", "ts", "user_id", "event_type", "value", "props", "refund_note"]
    parts = [f"SELECT {_q(c)} AS column_name, CAST(count(*) AS BIGINT) AS n_rows, "
             f"CAST(count(*) - count({c}) AS BIGINT) AS null_count, "
             f"CAST(coalesce(round(100.0 * (count(*) - count({c})) / count(*), 2), 0.0) AS DOUBLE) AS null_pct, "
             f"count({c}) = 0 AS all_null FROM {src}" for c in cols]
    return _union(parts)


def profile_numeric_sql() -> str:
    parts = []
    for t in ["lineitem", "customer"]:
        for c, k in _cols(t):
            if k not in ("integer", "float"):
                continue
            fin = f'CASE WHEN isfinite("{c}") THEN CAST("{c}" AS DOUBLE) END' if k == "float" else f'CAST("{c}" AS DOUBLE)'
            integral = f"bool_and(({fin}) % 1 = 0)"
            parts.append(
                f"SELECT {_q(t)} AS table_name, {_q(c)} AS column_name, min({fin}) AS min_value, "
                f"max({fin}) AS max_value, {integral} AS is_integral, "
                f"CASE WHEN {integral} THEN {_int_ladder(f'min({fin})', f'max({fin})', short=True)} END AS suggested_type "
                f"FROM {t}")
    return _union(parts)


def _string_cols(t):
    return [c for c, k in _cols(t) if k == "string"]


def profile_strings_sql() -> str:
    parts = []
    for t in ["documents", "pages", "conversations", "orders"]:
        for c in _string_cols(t):
            m = f'max(length("{c}"))'
            parts.append(
                f"SELECT {_q(t)} AS table_name, {_q(c)} AS column_name, CAST({m} AS BIGINT) AS max_len, "
                f'round(avg(length("{c}")), 1) AS avg_len, '
                f"CASE WHEN {m} <= 255 THEN 'VARCHAR(' || CAST(least(({m} * 3) // 2, 255) AS VARCHAR) || ')' "
                f"WHEN {m} <= 65535 THEN 'TEXT' WHEN {m} IS NOT NULL THEN 'LONGTEXT' END AS suggested_type FROM {t}")
    return _union(parts)


def profile_special_chars_sql() -> str:
    parts = []
    for t in ["events", "documents", "pages", "conversations"]:
        for c in _string_cols(t):
            parts.append(
                f"SELECT {_q(t)} AS table_name, {_q(c)} AS column_name, "
                f"bool_or(contains(\"{c}\", '`')) AS has_backtick, "
                f"bool_or(contains(\"{c}\", '''') OR contains(\"{c}\", '\"')) AS has_quotes, "
                f"bool_or(contains(\"{c}\", '\\')) AS has_backslash FROM {t}")
    return _union(parts)


_TXT_COLS = ["user_id_txt", "value_txt", "props_txt", "mixed_txt", "mostly_num_txt"]
_NUM_RE = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_INF = "('inf','+inf','-inf','infinity','+infinity','-infinity','nan')"


def _text_kind(v: str) -> str:
    return (f"CASE WHEN regexp_matches({v}, '^\\s*[+-]?[0-9]+\\s*$') THEN 'integer' "
            f"WHEN regexp_matches({v}, '{_NUM_RE}') OR lower(trim({v})) IN {_INF} THEN 'float' "
            f"WHEN lower({v}) IN ('true','false') THEN 'boolean' "
            f"WHEN regexp_matches({v}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([ T][0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}(\\.[0-9]+)?)?)?$') THEN 'datetime' "
            f"ELSE 'string' END")


def profile_mixed_kinds_sql() -> str:
    src = f"({I.events_as_text_sql(D)})"
    long = _union([f"SELECT {_q(c)} AS column_name, {c} AS value FROM {src} WHERE {c} IS NOT NULL"
                   for c in _TXT_COLS])
    return (f"SELECT column_name, {_text_kind('value')} AS kind, CAST(count(*) AS BIGINT) AS n, "
            f"min(value) AS example FROM ({long}) GROUP BY 1, 2")


def type_edges_sql() -> str:
    src = f"({I.type_edges_sql(D)})"
    kinds = [("nothing", "float"), ("spiky", "float"), ("high", "boolean"), ("pair", "other"), ("day", "datetime"), ("moment", "datetime"),
             ("wide", "integer"), ("signed_no", "integer"), ("Session_ID", "string")]
    parts = []
    for i, (c, k) in enumerate(kinds):
        whole = [f"CAST({f}({c}) AS DECIMAL(38, 0))" if k == "integer" else "CAST(NULL AS DECIMAL(38, 0))" for f in ("min", "max")]
        source = f"(SELECT CAST(day AS TIMESTAMP) AS day FROM {src})" if c == "day" else src
        parts.append(_type_row("events", source, i + 1, c, c, k, f", {_q(k)} AS kind, count(*) - count({c}) AS null_count, "
                               f"{whole[0]} AS min_whole, {whole[1]} AS max_whole"))
    return f"SELECT ordinal, column_name, kind, null_count, min_whole, max_whole, sql_type FROM ({_union(parts)})"


def fit_typed_sql() -> str:
    return ("SELECT event_id, ts, user_id, CAST((abs(round(value, 2)) >= 100)::INT + (user_id NOT BETWEEN 0 AND 255)::INT AS INTEGER) "
            "AS n_errors FROM events")


def log_content_sql() -> str:
    return (f"SELECT file_name, CAST(line_no AS BIGINT) AS line_no, line FROM {_LOGS} WHERE file_name = (SELECT min(file_name) FROM {_LOGS})")


def mixed_types_sql() -> str:
    src = f"({I.mixed_cells_sql(D)})"
    parts = []
    for c in I.MIXED_CELLS:
        n = {k: f"count(*) FILTER (WHERE {c} IS NOT NULL AND {_text_kind(c)} = '{k}')"
             for k in ("integer", "float", "boolean", "datetime", "string")}
        parts.append(f"SELECT {_q(c)} AS column_name, " + ", ".join(f"{v} AS n_{k}" for k, v in n.items())
                     + f", count({c}) AS n_values, max(length({c})) AS max_len FROM {src}")
    kinds = " + ".join(f"(n_{k} > 0)::INT" for k in ("integer", "float", "boolean", "datetime", "string"))
    is_id = "column_name = 'id' OR right(column_name, 3) = '_id'"
    return f"""
SELECT column_name, CASE WHEN k > 1 AND n_string > 0 THEN 'mixed' ELSE 'string' END AS kind, k AS n_kinds,
  n_integer, n_float, n_boolean, n_datetime, n_string, CAST(max_len AS BIGINT) AS max_len,
  CASE WHEN n_values = 0 THEN 'VARCHAR(255)' WHEN {is_id} THEN 'BIGINT'
       WHEN k > 1 AND n_string > 0 THEN 'VARCHAR(' || CAST(least((max_len * 3) // 2, 65535) AS VARCHAR) || ')'
       ELSE {_text_type('max_len')} END AS sql_type
FROM (SELECT *, {kinds} AS k FROM ({_union(parts)}))"""


def numeric_share_sql() -> str:
    src = f"({I.events_as_text_sql(D)})"
    parts = []
    for c in _TXT_COLS:
        num = (f"CASE WHEN regexp_matches({c}, '{_NUM_RE}') OR lower(trim({c})) IN {_INF} "
               f"THEN TRY_CAST(trim({c}) AS DOUBLE) END")
        n, k = f"count({c})", f"count({num})"
        parts.append(
            f"SELECT {_q(c)} AS column_name, CAST({n} AS BIGINT) AS n_values, CAST({k} AS BIGINT) AS n_numeric, "
            f"CAST(coalesce(round({k} * 100.0 / nullif({n}, 0), 2), 0.0) AS DOUBLE) AS numeric_pct, "
            f"CASE WHEN {k} = {n} AND {n} > 0 THEN CASE WHEN bool_and(CASE WHEN ({num}) IS NOT NULL "
            f"THEN ({num}) % 1 = 0 END) THEN 'all integers' ELSE 'all floats' END END AS hint FROM {src}")
    return _union(parts)


def duplicate_names_sql() -> str:
    return (f"SELECT doc_id, name, CAST(count(*) AS BIGINT) AS n FROM ({I.doc_headers_sql(D)}) "
            f"GROUP BY 1, 2 HAVING count(*) > 1")


def table_shape_sql() -> str:
    return _union([f"SELECT {_q(t)} AS table_name, CAST(count(*) AS BIGINT) AS n_rows, "
                   f"CAST({len(_cols(t))} AS BIGINT) AS n_columns FROM {t}"
                   for t in ["lineitem", "orders", "events", "documents", "customer"]])


# ---- names ------------------------------------------------------------------------------

def _clean_name(v: str) -> str:
    s = f"regexp_replace(regexp_replace({v}, '^\\s+|\\s+$', '', 'g'), '[^\\pL\\pN_]', '_', 'g')"
    return (f"CASE WHEN {s} = '' THEN 'column' WHEN regexp_matches({s}, '^\\p{{Nd}}') THEN 'col_' || {s} "
            f"ELSE {s} END")


def normalize_names_sql() -> str:
    return (f"SELECT doc_id, ordinal, name, CASE WHEN k = 0 THEN clean ELSE clean || '_' || CAST(k AS VARCHAR) END "
            f"AS normalized FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, clean ORDER BY ordinal) - 1 AS k "
            f"FROM (SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, name, {_clean_name('name')} AS clean "
            f"FROM ({I.doc_headers_sql(D)})))")


def unique_names_sql() -> str:
    return f"""
WITH RECURSIVE h AS (SELECT doc_id, ordinal, normalized, regexp_replace(lower(normalized), '(_[0-9]+)+$', '') AS stem
                     FROM ({normalize_names_sql()})),
r AS (SELECT doc_id, 0 AS i, list(ordinal ORDER BY ordinal) AS os, list(normalized ORDER BY ordinal) AS ns,
             []::VARCHAR[] AS taken, []::VARCHAR[] AS made FROM h GROUP BY doc_id, stem
      UNION ALL
      SELECT doc_id, i + 1, os, ns, list_append(taken, lower(c)), list_append(made, c)
      FROM (SELECT *, CASE WHEN NOT list_contains(taken, lower(ns[i + 1])) THEN ns[i + 1] ELSE ns[i + 1] || '_' ||
                CAST(list_filter(range(1, len(taken) + 2), lambda k: NOT list_contains(taken, lower(ns[i + 1]) || '_' || k))[1] AS VARCHAR)
              END AS c FROM r WHERE i < len(ns)))
SELECT doc_id, unnest(os) AS ordinal, unnest(ns) AS normalized, unnest(made) AS unique_name FROM r WHERE i = len(ns)"""


# Expected P1/P2 names for the dirty orders header (worked out by hand from the rules).
_ORDERS_DIRTY = [(" Order ID ", "Order_ID", "o_orderkey"), ("customer-id", "customer_id", "o_custkey"),
                 ("status", "status", "o_orderstatus"), ("Total Price ($)", "Total_Price____", "o_totalprice"),
                 ("2024 date", "col_2024_date", "o_orderdate"), ("status", "status_1", "o_orderpriority")]


def column_mapping_sql() -> str:
    kinds = dict(_cols("orders"))
    parts = []
    for i, (orig, cur, src) in enumerate(_ORDERS_DIRTY):
        row = _type_row("orders", "orders", i + 1, cur, f'"{src}"', kinds[src])
        parts.append(f"SELECT ordinal, {_q(orig)} AS original, column_name AS current, sql_type, "
                     f"{'TRUE' if orig != cur else 'FALSE'} AS modified FROM ({row})")
    return _union(parts)


def create_table_ddl_sql() -> str:
    parts = []
    for t in ["orders", "lineitem", "customer", "part"]:
        rows = infer_types_sql([t])
        tn = f"{t}_{EPOCH}"
        parts.append(
            f"SELECT {_q(tn)} AS table_name, 'CREATE TABLE IF NOT EXISTS `{tn}` ( ' || "
            f"string_agg('`' || replace(column_name, '`', ' ') || '` ' || sql_type, ', ' ORDER BY ordinal) || "
            f"' ) CHARACTER SET utf8mb4 COLLATE utf8mb4_unicode_ci' AS ddl FROM ({rows})")
    return _union(parts)


def drop_null_columns_sql() -> str:
    return (f"SELECT event_id, ts, user_id, event_type, value, props FROM ({I.events_with_nulls_sql(D)})")


def coerce_numeric_sql() -> str:
    from sluice.plans.queries import _orders_text_sql
    return (f"SELECT TRY_CAST(okey AS BIGINT) AS okey, TRY_CAST(price AS DOUBLE) AS price, status, odate, cust "
            f"FROM ({_orders_text_sql(D)})")


# ---- cleaning -----------------------------------------------------------------------------

# DuckDB's RE2 reads the marked patterns as they stand (its \\d and \\s are ASCII)
# The cleaning rules' patterns, stated here on their own.
_CUR = r"^[^\d]*?(-?)[\s]*([0-9,]+(\.\d+)?)[\s]*[^\d]*$"
_YMD = r"^(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})$"
_DMY = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})$"
_ISO = r"^(\d{4})-(\d{2})-(\d{2})[T\s](\d{2}):(\d{2}):(\d{2})(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?$"
_PCT = r"^(-?\d+(?:\.\d+)?)\s*%$"


def _ts(y, m, d, hh="0", mi="0", ss="0") -> str:
    return (f"TRY_CAST(printf('%04d-%02d-%02d %02d:%02d:%02d', TRY_CAST({y} AS INTEGER), TRY_CAST({m} AS INTEGER), "
            f"TRY_CAST({d} AS INTEGER), TRY_CAST({hh} AS INTEGER), TRY_CAST({mi} AS INTEGER), "
            f"TRY_CAST({ss} AS INTEGER)) AS TIMESTAMP)")


def clean_cte(raw: str, prefix: str = "") -> str:
    """SELECT list producing kind, num, ts, str from ``raw`` (the C0 rules in SQL)."""
    v = f"regexp_replace({raw}, '^\\s+|\\s+$', '', 'g')"
    g = lambda p, i: f"regexp_extract({v}, '{p}', {i})"
    pct = f"CASE WHEN regexp_matches({v}, '{_PCT}') THEN TRY_CAST({g(_PCT, 1)} AS DOUBLE) / 100.0 END"
    cur = (f"CASE WHEN regexp_matches({v}, '{_CUR}') THEN (CASE WHEN {g(_CUR, 1)} = '-' THEN -1 ELSE 1 END) * "
           f"TRY_CAST(replace({g(_CUR, 2)}, ',', '') AS DOUBLE) END")
    ymd = f"CASE WHEN regexp_matches({v}, '{_YMD}') THEN {_ts(g(_YMD, 1), g(_YMD, 2), g(_YMD, 3))} END"
    dmy = f"CASE WHEN regexp_matches({v}, '{_DMY}') THEN {_ts(g(_DMY, 3), g(_DMY, 2), g(_DMY, 1))} END"
    mdy = f"CASE WHEN regexp_matches({v}, '{_DMY}') THEN {_ts(g(_DMY, 3), g(_DMY, 1), g(_DMY, 2))} END"
    iso = (f"CASE WHEN regexp_matches({v}, '{_ISO}') AND TRY_CAST({g(_ISO, 6)} AS INTEGER) < 60 THEN "
           f"{_ts(g(_ISO, 1), g(_ISO, 2), g(_ISO, 3), g(_ISO, 4), g(_ISO, 5), g(_ISO, 6))} END")
    plain = f"CASE WHEN regexp_matches({v}, '^-?[0-9]+(\\.[0-9]+)?$') THEN TRY_CAST({v} AS DOUBLE) END"
    is_null = f"({v} IS NULL OR {v} = '' OR lower({v}) IN ('null','none','na','nan'))"
    num = f"coalesce({pct}, {cur})"
    ts = f"coalesce({ymd}, {dmy}, {mdy}, {iso})"
    kind = (f"CASE WHEN {is_null} THEN 'null' WHEN ({num}) IS NOT NULL THEN 'num' WHEN ({ts}) IS NOT NULL "
            f"THEN 'ts' WHEN ({plain}) IS NOT NULL THEN 'num' ELSE 'str' END")
    return (f"{kind} AS {prefix}kind, CASE WHEN {is_null} THEN NULL ELSE coalesce({num}, CASE WHEN ({ts}) IS NULL "
            f"THEN {plain} END) END AS {prefix}num, "
            f"CASE WHEN {is_null} OR ({num}) IS NOT NULL THEN NULL ELSE {ts} END AS {prefix}ts, "
            f"CASE WHEN {is_null} OR ({num}) IS NOT NULL OR ({ts}) IS NOT NULL OR ({plain}) IS NOT NULL THEN NULL "
            f"ELSE left({v}, 65535) END AS {prefix}str")


def clean_all_sql(rule: str | None = None) -> str:
    """Every dirty value cleaned; with ``rule``, the rows of the whole table that it fired on."""
    every = f"SELECT id, raw, {clean_cte('raw')} FROM ({I.dirty_values_sql(D)})"
    return f"SELECT * FROM ({every}) WHERE {rule}" if rule else every


def clean_inf_sql() -> str:
    return ("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value / CAST(event_id % 4 AS DOUBLE) END "
            "AS value_clean FROM events")


def clean_long_text_sql() -> str:
    return (f"SELECT doc_id, CAST(length(t) AS INTEGER) AS raw_len, kind, CAST(length(str) AS INTEGER) AS clean_len "
            f"FROM (SELECT doc_id, t, {clean_cte('t')} FROM (SELECT doc_id, text || text || text AS t FROM documents))")


def human_size_sql() -> str:
    b = "size_bytes"
    txt = (f"CASE WHEN {b} < 1024 THEN CAST({b} AS VARCHAR) || ' 字节' "
           f"WHEN {b} < 1048576 THEN printf('%.2f', {b} / 1024.0) || ' KB' "
           f"ELSE printf('%.2f', {b} / 1048576.0) || ' MB' END")
    return (f"SELECT id, size_bytes, {txt} AS size_text FROM ("
            f"SELECT page_id AS id, CAST(strlen(html) AS BIGINT) AS size_bytes FROM pages "
            f"UNION ALL SELECT -doc_id - 1, CAST(n_chars * 37 AS BIGINT) FROM documents)")


def human_duration_sql() -> str:
    s = "seconds"
    txt = (f"CASE WHEN {s} < 60 THEN printf('%.1f', {s}) || '秒' WHEN {s} < 3600 THEN printf('%.1f', {s} / 60.0) || '分钟' "
           f"ELSE printf('%.1f', {s} / 3600.0) || '小时' END")
    return (f"SELECT user_id, seconds, {txt} AS duration_text FROM (SELECT user_id, "
            f"(epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds FROM events GROUP BY user_id)")


def file_parts_sql() -> str:
    path = "regexp_replace(url, '[?#].*$', '')"
    base = f"regexp_extract({path}, '([^/\\\\]*)$', 1)"
    ext = f"regexp_extract({base}, '^\\.*[^.].*(\\.[^.]*)$', 1)"
    stem = f"left({base}, length({base}) - length({ext}))"
    return (f"SELECT page_id, {base} AS base_name, {stem} AS stem, lower({ext}) AS extension, "
            f"regexp_replace({stem}, '[^\\pL\\pN]', '_', 'g') || '_{EPOCH}' AS table_name FROM pages")


# ---- quality --------------------------------------------------------------------------------

def _errors_sql() -> str:
    src = f"({I.dirty_orders_sql(D)})"
    text = ("CASE WHEN c_kind = 'str' THEN c_str WHEN c_kind = 'num' THEN CASE WHEN c_num = floor(c_num) "
            "THEN printf('%.1f', c_num) ELSE CAST(c_num AS VARCHAR) END "
            "WHEN c_kind = 'ts' THEN strftime(c_ts, '%Y-%m-%d %H:%M:%S') END")
    return f"""
WITH c AS (
  SELECT id, qty, code, price, odate, {clean_cte('qty', 'q_')}, {clean_cte('code', 'c_')},
    {clean_cte('price', 'p_')}, {clean_cte('odate', 'o_')}
  FROM {src})
SELECT *, {text} AS code_text,
  CASE WHEN q_kind = 'null' THEN NULL WHEN q_kind <> 'num' THEN 'kind'
       WHEN round(q_num, 0) < 0 OR round(q_num, 0) > 255 THEN 'range' END AS e_qty,
  CASE WHEN c_kind = 'null' THEN NULL WHEN length({text}) > 3 THEN 'length' END AS e_code,
  CASE WHEN p_kind = 'null' THEN NULL WHEN p_kind <> 'num' THEN 'kind'
       WHEN abs(round(p_num, 2)) >= 1000000.0 THEN 'range' END AS e_price,
  CASE WHEN o_kind = 'null' THEN NULL WHEN o_kind <> 'ts' THEN 'kind' END AS e_odate
FROM c"""


def quarantine_accepted_sql() -> str:
    return (f"SELECT id, CAST(round(q_num, 0) AS SMALLINT) AS qty, code_text AS code, "
            f"CAST(round(p_num, 2) AS DECIMAL(8,2)) AS price, CAST(o_ts AS DATE) AS odate "
            f"FROM ({_errors_sql()}) WHERE e_qty IS NULL AND e_code IS NULL AND e_price IS NULL AND e_odate IS NULL")


def quarantine_rejected_sql() -> str:
    src = f"({_errors_sql()})"
    return _union([
        f"SELECT id, 'qty' AS column, e_qty AS reason, qty AS value FROM {src} WHERE e_qty IS NOT NULL",
        f"SELECT id, 'code', e_code, code FROM {src} WHERE e_code IS NOT NULL",
        f"SELECT id, 'price', e_price, price FROM {src} WHERE e_price IS NOT NULL",
        f"SELECT id, 'odate', e_odate, odate FROM {src} WHERE e_odate IS NOT NULL"])


def reject_reasons_sql() -> str:
    return (f'SELECT "column", reason, CAST(count(*) AS BIGINT) AS n_rows FROM ({quarantine_rejected_sql()}) '
            f'GROUP BY 1, 2')


def _bad_count() -> str:
    return (f"SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE e_qty IS NOT NULL OR "
            f"e_code IS NOT NULL OR e_price IS NOT NULL OR e_odate IS NOT NULL) AS BIGINT) AS n_rejected "
            f"FROM ({_errors_sql()})")


def error_rate_gate_sql() -> str:
    return (f"SELECT n_rows, n_rejected, CAST(coalesce(round(n_rejected * 1.0 / nullif(n_rows, 0), 4), 0.0) AS DOUBLE) "
            f"AS error_rate, NOT (n_rejected > 10 AND n_rejected * 1.0 / n_rows > 0.5) AS passed FROM ({_bad_count()})")


def import_report_sql() -> str:
    return (f"SELECT 'orders_{EPOCH}' AS table_name, n_rows AS total_rows, n_rows - n_rejected AS rows_inserted, "
            f"n_rejected AS error_rows, CAST(coalesce(round((n_rows - n_rejected) * 100.0 / nullif(n_rows, 0), 2), 0.0) "
            f"AS DOUBLE) AS success_rate FROM ({_bad_count()})")


def type_override_sql() -> str:
    rows = infer_types_sql(["orders"])
    return (f"SELECT ordinal, column_name AS current, CASE column_name WHEN 'o_orderpriority' THEN 'VARCHAR(20)' "
            f"WHEN 'o_totalprice' THEN 'DOUBLE' ELSE sql_type END AS sql_type, "
            f"column_name IN ('o_orderpriority', 'o_totalprice') AS overridden FROM ({rows})")


# ---- ordinals and chunks -----------------------------------------------------------------------

def row_ordinal_sql() -> str:
    return (f"SELECT o_orderkey, o_custkey, ordinal, CAST((ordinal - 1) // {CHUNK_ROWS} + 1 AS INTEGER) AS chunk "
            f"FROM (SELECT o_orderkey, o_custkey, CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS ordinal "
            f"FROM orders)")


def chunk_manifest_sql() -> str:
    parts = []
    for t, key in [("orders", "o_orderkey"), ("events", "event_id")]:
        parts.append(
            f"SELECT chunk, CAST(count(*) AS BIGINT) AS n_rows, min(ordinal) AS first_ordinal, "
            f"max(ordinal) AS last_ordinal, printf('%s_%s_%04d.%s', '{t}', '{DAY}', chunk, 'csv') AS file_name, "
            f"'{t}' AS table_name FROM (SELECT CAST((ordinal - 1) // {CHUNK_ROWS} + 1 AS INTEGER) AS chunk, ordinal "
            f"FROM (SELECT CAST(row_number() OVER (ORDER BY {key}) AS BIGINT) AS ordinal FROM {t})) GROUP BY chunk")
    return _union(parts)


# ---- run logs -----------------------------------------------------------------------------------

_LOGS = f"({I.log_lines_sql(D)})"
_NAME_RE = r"^import_(.+)_(\d{8}_\d{6})\.log"
_DONE_RE = r"成功导入 (\d+)/(\d+) 行数据, 失败: (\d+), 用时: (.+), 平均速度"
_PROG_RE = (r"已导入 (\d+)/(\d+) 行 \(成功: (\d+), 失败: (\d+)\) \| "
            r"批次大小: (\d+) \| 速度: ([0-9.]+)行/秒")


def log_names_sql() -> str:
    return (f"SELECT file_name, CASE WHEN regexp_matches(file_name, '{_NAME_RE}') THEN "
            f"regexp_extract(file_name, '{_NAME_RE}', 1) ELSE replace(file_name, '.log', '') END AS table_name, "
            f"CASE WHEN regexp_matches(file_name, '{_NAME_RE}') THEN coalesce(try_strptime(regexp_extract(file_name, "
            f"'{_NAME_RE}', 2), '%Y%m%d_%H%M%S'), mtime) ELSE mtime END AS log_time "
            f"FROM (SELECT file_name, min(mtime) AS mtime FROM {_LOGS} GROUP BY file_name)")


def log_results_sql() -> str:
    cls = (f"CASE WHEN contains(line, '数据导入完成') THEN CASE WHEN regexp_matches(line, '{_DONE_RE}') THEN 1 END "
           f"WHEN contains(line, '错误率过高，中断导入操作') THEN 2 WHEN contains(line, '数据库操作出错') THEN 3 END")
    g = lambda i: f"regexp_extract(line, '{_DONE_RE}', {i})"
    return f"""
WITH t AS (SELECT file_name, line_no, line, row_number() OVER (PARTITION BY file_name ORDER BY line_no DESC) AS rn
           FROM {_LOGS}),
h AS (SELECT file_name, line_no, {cls} AS cls, TRY_CAST({g(1)} AS BIGINT) AS ins, TRY_CAST({g(2)} AS BIGINT) AS tot,
             TRY_CAST({g(3)} AS BIGINT) AS err, {g(4)} AS tt FROM t WHERE rn <= 50),
n AS (SELECT file_name, arg_max(struct_pack(cls := cls, ins := ins, tot := tot, err := err, tt := tt), line_no) AS r
      FROM h WHERE cls IS NOT NULL GROUP BY file_name),
k AS (SELECT DISTINCT file_name FROM {_LOGS})
SELECT k.file_name,
  coalesce(CASE r.cls WHEN 1 THEN '完成' WHEN 2 THEN '中断' WHEN 3 THEN '失败' END, '未知') AS status,
  CAST(CASE WHEN r.cls = 1 THEN r.tot ELSE 0 END AS BIGINT) AS total_rows,
  CAST(CASE WHEN r.cls = 1 THEN r.ins ELSE 0 END AS BIGINT) AS inserted_rows,
  CAST(CASE WHEN r.cls = 1 THEN r.err ELSE 0 END AS BIGINT) AS error_rows,
  CAST(CASE WHEN r.cls = 1 AND r.tot > 0 THEN round(r.ins * 100.0 / r.tot, 2) ELSE 0.0 END AS DOUBLE) AS success_rate,
  CASE WHEN r.cls = 1 THEN r.tt ELSE '未知' END AS time_taken
FROM k LEFT JOIN n ON k.file_name = n.file_name"""


def batch_throughput_sql() -> str:
    g = lambda i: f"regexp_extract(line, '{_PROG_RE}', {i})"
    return (f"SELECT file_name, line_no AS seq, TRY_CAST({g(1)} AS BIGINT) AS done_rows, TRY_CAST({g(2)} AS BIGINT) "
            f"AS total_rows, TRY_CAST({g(3)} AS BIGINT) AS ok_rows, TRY_CAST({g(4)} AS BIGINT) AS bad_rows, "
            f"TRY_CAST({g(5)} AS BIGINT) AS batch_size, TRY_CAST({g(6)} AS DOUBLE) AS speed FROM {_LOGS} "
            f"WHERE regexp_matches(line, '{_PROG_RE}')")


def speed_moving_avg_sql() -> str:
    w = "PARTITION BY file_name ORDER BY seq"
    return f"""
SELECT file_name, seq, speed, round(a10, 4) AS avg_speed_10, round(r3, 4) AS recent_avg,
  round(CASE WHEN n > 6 THEN e ELSE r3 END, 4) AS earlier_avg, (n > 6 AND r3 < e * 0.85) AS slowdown
FROM (SELECT file_name, seq, speed,
  avg(speed) OVER ({w} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS a10,
  avg(speed) OVER ({w} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS r3,
  avg(speed) OVER ({w} ROWS BETWEEN 9 PRECEDING AND 3 PRECEDING) AS e,
  count(speed) OVER ({w} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS n
  FROM ({batch_throughput_sql()}))"""


def progress_running_sql() -> str:
    w = "PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f"""
SELECT run_id, seq, CAST(p AS BIGINT) AS processed, CAST(i AS BIGINT) AS inserted, CAST(p - i AS BIGINT) AS failed,
  round(coalesce(i * 100.0 / nullif(p, 0), 0.0), 1) AS success_pct,
  round(coalesce(p / nullif(el, 0), 0.0), 1) AS rows_per_sec,
  round(coalesce((total_rows - p) / nullif(p / nullif(el, 0), 0), 0.0), 0) AS eta_seconds
FROM (SELECT run_id, seq, total_rows, sum(batch_rows) OVER ({w}) AS p, sum(ok_rows) OVER ({w}) AS i,
  sum(batch_seconds) OVER ({w}) AS el FROM ({I.batches_sql(D)}))"""


def oracles() -> dict[str, str]:
    out = {
        "profile_nulls": profile_nulls_sql(),
        "profile_numeric": profile_numeric_sql(),
        "profile_strings": profile_strings_sql(),
        "profile_special_chars": profile_special_chars_sql(),
        "profile_mixed_kinds": profile_mixed_kinds_sql(),
        "mixed_types": mixed_types_sql(),
        "type_edges": type_edges_sql(),
        "fit_typed": fit_typed_sql(),
        "log_content": log_content_sql(),
        "numeric_share": numeric_share_sql(),
        "duplicate_names": duplicate_names_sql(),
        "table_shape": table_shape_sql(),
        "infer_types": infer_types_sql(),
        "int_ladder": int_ladder_sql(),
        "decimal_type": decimal_type_sql(),
        "date_or_datetime": date_or_datetime_sql(),
        "column_mapping": column_mapping_sql(),
        "create_table_ddl": create_table_ddl_sql(),
        "normalize_names": normalize_names_sql(),
        "unique_names": unique_names_sql(),
        "drop_null_columns": drop_null_columns_sql(),
        "coerce_numeric": coerce_numeric_sql(),
        "clean_all": clean_all_sql(),
        "clean_percent": clean_all_sql(CLEAN_RULES["clean_percent"][0]),
        "clean_currency": clean_all_sql(CLEAN_RULES["clean_currency"][0]),
        "clean_dates": clean_all_sql(CLEAN_RULES["clean_dates"][0]),
        "clean_iso": clean_all_sql(CLEAN_RULES["clean_iso"][0]),
        "clean_null_tokens": clean_all_sql(CLEAN_RULES["clean_null_tokens"][0]),
        "clean_text_values": clean_all_sql(CLEAN_RULES["clean_text_values"][0]),
        "clean_inf": clean_inf_sql(),
        "clean_long_text": clean_long_text_sql(),
        "human_size": human_size_sql(),
        "human_duration": human_duration_sql(),
        "file_parts": file_parts_sql(),
        "quarantine_accepted": quarantine_accepted_sql(),
        "quarantine_rejected": quarantine_rejected_sql(),
        "reject_reasons": reject_reasons_sql(),
        "error_rate_gate": error_rate_gate_sql(),
        "import_report": import_report_sql(),
        "type_override": type_override_sql(),
        "row_ordinal": row_ordinal_sql(),
        "chunk_manifest": chunk_manifest_sql(),
        "log_names": log_names_sql(),
        "log_results": log_results_sql(),
        "batch_throughput": batch_throughput_sql(),
        "speed_moving_avg": speed_moving_avg_sql(),
        "progress_running": progress_running_sql(),
    }
    try:
        from sluice.plans import oracles_files
        out.update(oracles_files.oracles())
        out.update(oracles_files.more())
    except ImportError:
        pass
    return out
