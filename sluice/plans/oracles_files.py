"""DuckDB oracles for the file-based queries: what the files must hold, computed from
the tables directly (DuckDB does not see the files Spark wrote)."""

from __future__ import annotations

from sluice.plans import inputs as I
from sluice.plans.oracles import D, _LOGS, log_results_sql
from sluice.plans.queries import CHUNK_ROWS, DAY, _bad_lines_sql, _na_sql

_ORD = (f"CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // {CHUNK_ROWS} + 1 AS INTEGER)")


def oracles() -> dict[str, str]:
    v = "VARCHAR"
    line = (f"concat_ws(',', CAST(o_orderkey AS {v}), CAST(o_custkey AS {v}), o_orderstatus, "
            f"CAST(o_totalprice AS {v}), CAST(o_orderdate AS {v}), o_orderpriority)")
    hdr = len("o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority\n") + 3
    size = "size_bytes"
    return {
        "split_csv_roundtrip": (
            f"SELECT printf('orders_{DAY}_%04d.csv', chunk) AS file_name, CAST(count(*) AS BIGINT) AS n_rows, "
            f"round(sum(o_totalprice), 2) AS total_price, min(o_orderkey) AS first_key "
            f"FROM (SELECT *, {_ORD} AS chunk FROM orders) GROUP BY chunk"),
        "csv_roundtrip": "SELECT conv_id, turn, role, text FROM conversations",
        "csv_row_count": (
            f"SELECT 'conversations_{DAY}_0001.csv' AS file_name, "
            f"CAST(count(*) + sum(length(text) - length(replace(text, chr(10), ''))) AS BIGINT) AS physical_rows, "
            f"CAST(count(*) AS BIGINT) AS logical_rows FROM conversations"),
        "headerless_csv": (
            f"SELECT CAST(c_custkey AS {v}) AS Column_1, c_name AS Column_2, CAST(c_nationkey AS {v}) AS Column_3, "
            f"CAST(c_acctbal AS {v}) AS Column_4, c_mktsegment AS Column_5 FROM customer"),
        "csv_infer": " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, CASE WHEN count({t}) = 0 THEN 'float64' "
            f"WHEN count(*) FILTER (WHERE regexp_matches({t}, '^\\s*[+-]?[0-9]+\\s*$')) = count({t}) THEN 'int64' "
            f"WHEN count(TRY_CAST({t} AS DOUBLE)) = count({t}) THEN 'float64' "
            f"WHEN count(*) FILTER (WHERE lower({t}) IN ('true', 'false')) = count({t}) THEN 'bool' ELSE 'object' END AS inferred_type FROM customer"
            for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment") for t in (f"CAST({c} AS VARCHAR)",)),
        "csv_bad_lines": (
            f"SELECT id, CASE id % 5 WHEN 0 THEN 'short' WHEN 1 THEN 'long' ELSE 'ok' END AS status, "
            f"CASE WHEN id % 5 <> 1 THEN CAST(o_orderkey AS {v}) END AS f1, "
            f"CASE WHEN id % 5 <> 1 THEN CAST(o_custkey AS {v}) END AS f2, "
            f"CASE WHEN id % 5 <> 1 THEN o_orderstatus END AS f3, "
            f"CASE WHEN id % 5 = 2 THEN o_orderpriority || ',x' WHEN id % 5 IN (3, 4) THEN o_orderpriority END AS f4, "
            f"CASE WHEN id % 5 IN (2, 4) THEN CAST(year(o_orderdate) AS {v}) END AS f5 "
            f"FROM ({_bad_lines_sql(D)}) JOIN orders ON id = o_orderkey"),
        "csv_na_tokens": (
            f"SELECT id, raw, CASE WHEN raw IN ('NA', 'N/A', '#N/A', 'null', '-nan') THEN NULL ELSE raw END AS value "
            f"FROM ({_na_sql(D)})"),
        "detect_delimiter": (
            "SELECT DISTINCT c_nationkey AS n_nationkey, CASE c_nationkey % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' "
            "WHEN 2 THEN chr(9) ELSE '|' END AS delimiter FROM customer"),
        "union_files": (
            f"SELECT CAST(c_custkey AS {v}) AS c_custkey, c_name, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') "
            f"THEN CAST(c_acctbal AS {v}) END AS c_acctbal, CASE WHEN c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING') "
            f"THEN c_mktsegment END AS c_mktsegment FROM customer"),
        "file_info": (
            f"SELECT file_name, 'CSV 文件' AS file_type, size_bytes, "
            f"CASE WHEN {size} < 1024 THEN CAST({size} AS VARCHAR) || ' 字节' WHEN {size} < 1048576 THEN "
            f"printf('%.2f', {size} / 1024.0) || ' KB' ELSE printf('%.2f', {size} / 1048576.0) || ' MB' END AS size_text, "
            f"rows, CAST(CASE WHEN rows > 0 THEN ceil(rows / 1000.0) ELSE 0 END AS BIGINT) AS chunks FROM ("
            f"SELECT printf('orders_{DAY}_%04d.csv', chunk) AS file_name, CAST({hdr} + sum(strlen({line}) + 1) AS BIGINT) "
            f"AS size_bytes, CAST(count(*) AS BIGINT) AS rows FROM (SELECT *, {_ORD} AS chunk FROM orders) GROUP BY chunk)"),
        "log_files": (
            f"SELECT r.file_name, CASE WHEN regexp_matches(r.file_name, '^import_(.+)_(\\d{{8}}_\\d{{6}})\\.log') THEN "
            f"regexp_extract(r.file_name, '^import_(.+)_(\\d{{8}}_\\d{{6}})\\.log', 1) ELSE replace(r.file_name, '.log', '') END "
            f"AS table_name, status, total_rows, inserted_rows, error_rows, success_rate, time_taken, "
            f"round(b / 1024.0, 2) AS size_kb FROM ({log_results_sql()}) r JOIN (SELECT file_name, "
            f"sum(strlen(line) + 1) AS b FROM {_LOGS} GROUP BY file_name) s ON r.file_name = s.file_name"),
    }


def more() -> dict[str, str]:
    from sluice.plans.oracles import quarantine_accepted_sql
    v = "VARCHAR"
    return {
        "workbook_scan": (
            f"SELECT CAST(o_orderkey AS {v}) AS o_orderkey, CAST(o_custkey AS {v}) AS o_custkey, o_orderstatus, "
            f"CAST(o_totalprice AS {v}) AS o_totalprice, CAST(o_orderdate AS {v}) AS o_orderdate, o_orderpriority "
            f"FROM orders"),
        "workbook_status": (
            f"SELECT printf('orders_{DAY}_%04d.xlsx', chunk) AS file_name, CAST(count(*) AS BIGINT) AS n_rows, "
            f"'ok' AS status FROM (SELECT {_ORD} AS chunk FROM orders) GROUP BY chunk"),
        "csv_by_encoding": (
            f"SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'long' ELSE 'ok' END AS status, "
            f"CASE WHEN doc_id % 10 <> 3 THEN coalesce(replace(source, ',', ' '), 'none') END AS source, "
            f"CASE WHEN doc_id % 10 <> 3 THEN CAST(n_chars AS {v}) || CASE doc_id % 3 WHEN 0 THEN ' 日é' "
            f"WHEN 1 THEN ' 中文' ELSE ' é' END END AS word FROM documents WHERE doc_id IS NOT NULL"),
        "workbook_states": " UNION ALL ".join(
            f"SELECT printf('{t}_{DAY}_%04d.xlsx', chunk) AS file_name, CAST({rows} AS BIGINT) AS n_rows, {state} AS status "
            f"FROM (SELECT CAST((row_number() OVER (ORDER BY {key}) - 1) // {CHUNK_ROWS} + 1 AS INTEGER) AS chunk FROM {t}) GROUP BY chunk"
            for t, key, rows, state in (("orders", "o_orderkey", "count(*)", "'ok'"), ("customer", "c_custkey", "count(*)", "'blank header'"),
                                        ("supplier", "s_suppkey", "0", "'empty'"))),
        "workbook_chunks": (
            f"SELECT chunk, printf('orders_{DAY}_%04d.csv', chunk) AS file_name, CAST(count(*) AS BIGINT) AS n_rows, "
            f"min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, CAST(2 AS BIGINT) AS first_record, "
            f"round(sum(o_totalprice), 2) AS total_price, (SELECT count(*) FROM orders) AS run_rows, "
            f"(SELECT CAST(ceil(count(*) / 1000.0) AS BIGINT) FROM orders) AS run_files FROM (SELECT *, "
            f"CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 + 1 AS INTEGER) AS chunk FROM orders) GROUP BY chunk"),
        "encoding_evidence": (
            "SELECT DISTINCT printf('docs_%s_%06d.txt', name, doc_id // 500) AS file_name, encoding, TRUE AS decoded_ok, "
            "name = 'bom' AS has_bom, TRUE AS sure FROM documents JOIN (VALUES (0, 'utf8', 'utf-8'), (1, 'bom', 'utf-8-sig'), "
            "(2, 'gb18030', 'gb18030'), (3, 'latin1', 'latin1')) k(i, name, encoding) ON i = doc_id % 4"),
        "source_order_chunks": (
            f"SELECT conv_id, turn, printf('conversations_{DAY}_%04d.csv', (ordinal - 1) // 300 + 1) AS file_name, "
            f"(ordinal - 1) % 300 + 1 AS record_no, ordinal, CAST((ordinal - 1) // 1000 + 1 AS INTEGER) AS chunk "
            f"FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id * 100000 + turn) AS ordinal FROM conversations)"),
        "streaming_import": quarantine_accepted_sql(),
        "import_pipeline": quarantine_accepted_sql(),
    }
