"""Inputs derived from the given tables for the registered queries and the bench.

Each builder is one SQL text rendered for two dialects — Spark (run with
``spark.sql`` over views of the Parquet tables) and DuckDB (the oracle) — so both
engines start from exactly the same derived rows. Every builder reads whole tables:
the derived data grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def register_views(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    for t in names or TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- dialect helpers ----------------------------------------------------------------

def fix(expr: str, digits: int, dialect: str) -> str:
    """Python-style fixed-point text of a double."""
    if dialect == "spark":
        pat = "0" if digits == 0 else "0." + "0" * digits
        return f"format_number(CAST({expr} AS DOUBLE), '{pat}')"
    return f"printf('%.{digits}f', CAST({expr} AS DOUBLE))"


def dfmt(expr: str, fmt: str, dialect: str) -> str:
    """Date text; ``fmt`` in strftime form (%Y %m %d %H %M %S)."""
    if dialect == "spark":
        jf = (fmt.replace("%Y", "yyyy").replace("%m", "MM").replace("%d", "dd")
              .replace("%H", "HH").replace("%M", "mm").replace("%S", "ss"))
        jf = jf.replace("T", "'T'")
        return f'date_format({expr}, "{jf}")'
    return f"strftime({expr}, '{fmt}')"


def s(expr: str, dialect: str) -> str:
    """Cast to text."""
    return f"CAST({expr} AS {'STRING' if dialect == 'spark' else 'VARCHAR'})"


def repeat_nl(dialect: str) -> str:
    return "'\\n'" if dialect == "spark" else "chr(10)"


# ---- dirty values (C*, Q1) ---------------------------------------------------------

def dirty_values_sql(d: str) -> str:
    """One dirty text value per order, 16 shapes chosen by ``o_orderkey % 16``."""
    k, c = "o_orderkey", "o_custkey"
    y, m, dd = "year(o_orderdate)", "month(o_orderdate)", "day(o_orderdate)"
    return f"""
SELECT {k} AS id, CASE {k} % 16
  WHEN 0 THEN {s(f'{c} % 300', d)} || '%'
  WHEN 1 THEN '$' || {s(f'{c} % 7', d)} || ',' || lpad({s(f'{k} % 1000', d)}, 3, '0') || '.' || lpad({s(f'{c} % 100', d)}, 2, '0')
  WHEN 2 THEN '-$' || {s(f'{c} % 97', d)}
  WHEN 3 THEN '(' || {s(f'{c} % 500', d)} || ')'
  WHEN 4 THEN {s(y, d)} || '/' || {s(m, d)} || '/' || {s(dd, d)}
  WHEN 5 THEN {s(dd, d)} || '.' || {s(m, d)} || '.' || {s(y, d)}
  WHEN 6 THEN lpad({s(m, d)}, 2, '0') || '/' || lpad({s(dd, d)}, 2, '0') || '/' || {s(y, d)}
  WHEN 7 THEN {dfmt('o_orderdate', '%Y-%m-%dT%H:%M:%S', d)} || '.5+08:00'
  WHEN 8 THEN CASE {c} % 5 WHEN 0 THEN '' WHEN 1 THEN '   ' WHEN 2 THEN 'NULL' WHEN 3 THEN 'none' ELSE 'NaN' END
  WHEN 9 THEN o_orderpriority
  WHEN 10 THEN o_orderstatus || {s(f'{c} % 10', d)} || 'X'
  WHEN 11 THEN '2024-02-' || {s(f'28 + {c} % 4', d)}
  WHEN 12 THEN '1.2.' || {s(f'{c} % 9', d)}
  WHEN 13 THEN '  ' || {s(f'{c} % 400', d)} || '.5 %  '
  WHEN 14 THEN '+' || {s(f'{c} % 50', d)} || '%'
  ELSE '1e' || {s(f'{c} % 5', d)}
END AS raw
FROM orders"""


def dirty_orders_sql(d: str) -> str:
    """An order table as dirty text, for the fit-to-type check."""
    k = "o_orderkey"
    return f"""
SELECT {k} AS id,
  CASE WHEN {k} % 9 = 0 THEN '300' WHEN {k} % 9 = 1 THEN 'x' ELSE {s(f'o_custkey % 250', d)} END AS qty,
  CASE WHEN {k} % 7 = 0 THEN 'abcd' ELSE o_orderstatus END AS code,
  '$' || {s('CAST(o_totalprice AS DECIMAL(18,2))', d)} AS price,
  CASE WHEN {k} % 11 = 0 THEN 'soon' ELSE {s('year(o_orderdate)', d)} || '/' || {s('month(o_orderdate)', d)} || '/' || {s('day(o_orderdate)', d)} END AS odate
FROM orders"""


QUARANTINE_TARGETS = {"qty": "TINYINT UNSIGNED", "code": "VARCHAR(3)", "price": "DECIMAL(8,2)",
                      "odate": "DATE"}


def events_with_nulls_sql(d: str) -> str:
    """Events with nulls injected per column, plus one column that is always null."""
    k = "event_id"
    return f"""
SELECT {k} AS event_id,
  CASE WHEN {k} % 13 = 0 THEN NULL ELSE ts END AS ts,
  CASE WHEN {k} % 7 = 0 THEN NULL ELSE user_id END AS user_id,
  CASE WHEN {k} % 3 = 0 THEN NULL ELSE event_type END AS event_type,
  CASE WHEN {k} % 5 = 0 THEN NULL ELSE value END AS value,
  CASE WHEN {k} % 11 = 0 THEN NULL ELSE props END AS props,
  CAST(NULL AS {'STRING' if d == 'spark' else 'VARCHAR'}) AS refund_note
FROM events"""


def events_as_text_sql(d: str) -> str:
    """Events as text columns, one of them of mixed kinds."""
    k = "event_id"
    return f"""
SELECT {k} AS event_id, {s('user_id', d)} AS user_id_txt, {s('value', d)} AS value_txt,
  props AS props_txt,
  CASE {k} % 4 WHEN 0 THEN {s('user_id', d)} WHEN 1 THEN {s('value', d)}
       WHEN 2 THEN CASE WHEN value > 50 THEN 'true' ELSE 'false' END ELSE event_type END AS mixed_txt,
  CASE WHEN {k} % 10 = 0 THEN 'n/a' ELSE {s('user_id', d)} END AS mostly_num_txt
FROM events"""


def type_edges_sql(d: str) -> str:
    """Events with the columns that the last type rules are for: nothing, infinities, booleans, lists, dates."""
    k = "event_id"
    inf = "CAST('Infinity' AS DOUBLE)"
    return f"""
SELECT CAST(NULL AS DOUBLE) AS nothing, CASE WHEN {k} % 997 = 5 THEN {inf} WHEN {k} % 7 = 0 THEN NULL ELSE value END AS spiky,
  value > 50 AS high, {'array(value, value)' if d == 'spark' else '[value, value]'} AS pair,
  CASE WHEN {k} % 5 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS day, ts AS moment,
  CAST(user_id AS BIGINT) * 4611686018427 AS wide, {k} - 40000 AS signed_no, event_type AS Session_ID
FROM events"""


def mixed_cells_sql(d: str) -> str:
    """Documents and events as cells: columns of one kind, of several kinds with and without text among them,
    with nulls, and of texts far beyond 255 characters."""
    k = "doc_id"
    null = "CAST(NULL AS " + ("STRING" if d == "spark" else "VARCHAR") + ")"
    return f"""
SELECT {s(k, d)} AS whole_cell,
  CASE {k} % 2 WHEN 0 THEN {s('n_chars', d)} ELSE {s('n_chars', d)} || '.5' END AS number_cell,
  CASE {k} % 3 WHEN 0 THEN {s('n_chars', d)} WHEN 1 THEN text ELSE {null} END AS text_or_number_cell,
  CASE {k} % 5 WHEN 0 THEN {s('n_chars', d)} WHEN 1 THEN '2024-01-0' || {s(f'{k} % 9 + 1', d)} WHEN 2 THEN 'true'
       WHEN 3 THEN '1e' || {s(f'{k} % 7', d)} ELSE substr(lang, 1, 2) || {s(f'{k} % 100', d)} END AS any_cell,
  CASE WHEN {k} % 4 = 0 THEN '2024-02-0' || {s(f'{k} % 9 + 1', d)} ELSE {s('n_chars', d)} END AS date_or_number_cell,
  lang AS text_cell, {null} AS empty_cell,
  CASE WHEN {k} % 2 = 0 THEN 'x' ELSE {s('n_chars', d)} END AS row_id
FROM documents"""


MIXED_CELLS = ["whole_cell", "number_cell", "text_or_number_cell", "any_cell", "date_or_number_cell", "text_cell", "empty_cell", "row_id"]


def doc_headers_sql(d: str) -> str:
    """Every document's first line read as a header: ``(doc_id, ordinal, name)``."""
    if d == "spark":
        return r"""
SELECT doc_id, pos + 1 AS ordinal, name
FROM (SELECT doc_id, posexplode(split(split_part(text, '\n', 1), ' ')) AS (pos, name) FROM documents)"""
    return """
SELECT doc_id, ordinal, name FROM (
  SELECT doc_id, unnest(generate_series(1, len(arr))) AS ordinal, unnest(arr) AS name
  FROM (SELECT doc_id, string_split(split_part(text, chr(10), 1), ' ') AS arr FROM documents))"""


# ---- run logs (L*, W2, W3) -----------------------------------------------------------

def batches_sql(d: str) -> str:
    """One insert batch per order, one import run per customer (W3 input)."""
    return """
SELECT o_custkey AS run_id, o_orderkey AS batch_key,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq,
  20 + o_orderkey % 481 AS batch_rows,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 7 ELSE 0 END AS bad_rows,
  20 + o_orderkey % 481 - CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 7 ELSE 0 END AS ok_rows,
  (o_orderkey % 9000 + 100) / 10e0 AS speed,
  (20 + o_orderkey % 481) / ((o_orderkey % 9000 + 100) / 10e0) AS batch_seconds,
  sum(20 + o_orderkey % 481) OVER (PARTITION BY o_custkey) AS total_rows
FROM orders"""


ABORTED = "'2024-01-05 11:00:00,000 - ERROR - 错误率过高，中断导入操作'"
ENDED = "'2024-01-05 11:00:00,000 - INFO - 导入操作结束'"
FAILED = "'2024-01-05 11:00:00,000 - ERROR - 数据库操作出错: (2013, lost connection)'"


def log_lines_sql(d: str, once: bool = False) -> str:
    """Run-log lines ``(file_name, line_no, line)``: one log per customer.

    Line 1 starts the run, then one progress line per batch; the end depends on
    ``custkey % 4``: 0 done (for ``% 8 = 0`` after an abort line; for ``% 16 = 0``
    followed by 55 more lines so it falls out of the last 50), 1 abort, 2 database
    error, 3 nothing. Names follow ``import_<table>_<yyyymmdd_hhmmss>.log`` except
    for ``custkey % 10 = 9``. ``once`` (Spark) gives the same rows from one pass: a run's first batch also yields the
    lines of the run, so that no union reads the windows again and no join brings the runs' facts back.
    """
    start = f"'2024-01-05 10:00:00,000 - INFO - 开始导入文件: cust' || {s('run_id', d)} || '.csv'"
    cleaned = f"'2024-01-05 11:00:01,000 - INFO - 清理临时数据 ' || {s('i', d)}"
    nl_seq = ("sequence(1, 55)" if d == "spark" else "generate_series(1, 55)")
    explode = "explode" if d == "spark" else "unnest"
    prog = (f"'2024-01-05 10:00:00,000 - INFO - 已导入 ' || {s('done_rows', d)} || '/' || {s('total_rows', d)}"
            f" || ' 行 (成功: ' || {s('ok_cum', d)} || ', 失败: ' || {s('bad_cum', d)} || ') | 批次大小: '"
            f" || {s('batch_rows', d)} || ' | 速度: ' || {fix('speed', 1, d)} || '行/秒'")
    secs = "total_rows / 97e0"
    dur = (f"CASE WHEN {secs} < 60 THEN {fix(secs, 1, d)} || '秒' "
           f"WHEN {secs} < 3600 THEN {fix(secs + ' / 60e0', 1, d)} || '分钟' "
           f"ELSE {fix(secs + ' / 3600e0', 1, d)} || '小时' END")
    done = (f"'2024-01-05 11:00:00,000 - INFO - 数据导入完成: 成功导入 ' || {s('ok_total', d)} || '/' || "
            f"{s('total_rows', d)} || ' 行数据, 失败: ' || {s('bad_total', d)} || ', 用时: ' || {dur} || "
            f"', 平均速度: ' || {fix('ok_total / (' + secs + ')', 1, d)} || '行/秒'")
    name = (f"CASE WHEN run_id % 10 = 9 THEN 'run_cust' || {s('run_id', d)} || '.log' "
            f"ELSE 'import_cust' || {s('run_id', d)} || '_' || {dfmt('first_day', '%Y%m%d', d)} || '_' || "
            f"lpad({s('run_id % 24', d)}, 2, '0') || lpad({s('run_id % 60', d)}, 2, '0') || "
            f"lpad({s('(run_id * 7) % 60', d)}, 2, '0') || '.log' END")
    ctes = """
WITH b AS (
  SELECT o_custkey AS run_id, o_orderkey,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq,
    min(o_orderdate) OVER (PARTITION BY o_custkey) AS first_day,
    20 + o_orderkey % 481 AS batch_rows,
    CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 7 ELSE 0 END AS bad_rows,
    (o_orderkey % 9000 + 100) / 10e0 AS speed
  FROM orders),
c AS (
  SELECT run_id, seq, first_day, batch_rows, speed,
    sum(batch_rows) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS done_rows,
    sum(batch_rows - bad_rows) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ok_cum,
    sum(bad_rows) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bad_cum,
    sum(batch_rows) OVER (PARTITION BY run_id) AS total_rows,
    sum(batch_rows - bad_rows) OVER (PARTITION BY run_id) AS ok_total,
    sum(bad_rows) OVER (PARTITION BY run_id) AS bad_total,
    count(*) OVER (PARTITION BY run_id) AS n_batches
  FROM b),"""
    if once:
        of_run = [
            ("TRUE", "CAST(1 AS BIGINT)", start), ("run_id % 4 = 1 OR run_id % 8 = 0", "n_batches + 2", ABORTED),
            ("run_id % 4 = 0", "n_batches + 3", done), ("run_id % 4 = 0", "n_batches + 4", ENDED),
            ("run_id % 4 = 2", "n_batches + 3", FAILED)]
        row = lambda no, line: f"struct(CAST({no} AS BIGINT) AS line_no, {line} AS line)"
        lines = [f"CASE WHEN {when} THEN array({row(no, line)}) ELSE array() END" for when, no, line in of_run]
        lines.append(f"CASE WHEN run_id % 16 = 0 THEN transform({nl_seq}, i -> {row('n_batches + 4 + i', cleaned)}) ELSE array() END")
        return f"""{ctes[:-1]}
SELECT {name} AS file_name, entry.line_no AS line_no, entry.line AS line, CAST(first_day AS TIMESTAMP_NTZ) AS mtime
FROM c LATERAL VIEW explode(concat(array({row('seq + 1', prog)}),
  CASE WHEN seq = 1 THEN concat({', '.join(lines)}) ELSE array() END)) e AS entry
WHERE run_id IS NOT NULL"""
    return f"""{ctes}
runs AS (SELECT DISTINCT run_id, first_day, total_rows, ok_total, bad_total, n_batches FROM c),
lines AS (
  SELECT run_id, 1 AS line_no, {start} AS line FROM runs
  UNION ALL
  SELECT run_id, seq + 1, {prog} FROM c
  UNION ALL
  SELECT run_id, n_batches + 2, {ABORTED} FROM runs
   WHERE run_id % 4 = 1 OR run_id % 8 = 0
  UNION ALL
  SELECT run_id, n_batches + 3, {done} FROM runs WHERE run_id % 4 = 0
  UNION ALL
  SELECT run_id, n_batches + 4, {ENDED} FROM runs WHERE run_id % 4 = 0
  UNION ALL
  SELECT run_id, n_batches + 3, {FAILED} FROM runs
   WHERE run_id % 4 = 2
  UNION ALL
  SELECT run_id, n_batches + 4 + i, {cleaned}
  FROM (SELECT run_id, n_batches, {explode}({nl_seq}) AS i FROM runs WHERE run_id % 16 = 0) x
)
SELECT {name} AS file_name, CAST(line_no AS BIGINT) AS line_no, line,
  CAST(first_day AS TIMESTAMP{'_NTZ' if d == 'spark' else ''}) AS mtime
FROM lines JOIN runs USING (run_id)"""
