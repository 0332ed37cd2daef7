"""The registered queries: one per operator family of the inventory.

Each takes ``(spark, sf_dir)`` and returns a DataFrame over whole tables. Column
names equal those of the matching oracle in ``sluice.plans.oracles``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import humanize as H
from sluice.functions.clean import clean_columns
from sluice.operators import chunks as CH
from sluice.operators import columns as C
from sluice.operators import profile as P
from sluice.operators import quality as QL
from sluice.operators import runlog as L
from sluice.plans import inputs as I

REGISTRY: dict = {}

# Tables whose typed columns are profiled / typed by the inference queries.
TYPED_TABLES = ["lineitem", "orders", "events", "customer", "part", "supplier"]
CHUNK_ROWS = 4998
DAY = "20240105"
EPOCH = 1700000000


def register(fn):
    REGISTRY[fn.__name__] = fn
    return fn


def _sql(spark: SparkSession, sf_dir: str, builder, tables: list[str]) -> DataFrame:
    I.register_views(spark, sf_dir, tables)
    return spark.sql(builder("spark"))


def _union(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


# ---- step 1: profiling ----------------------------------------------------------------

@register
def profile_nulls(spark, sf_dir):
    """Null count and share per column of events with injected nulls."""
    df = _sql(spark, sf_dir, I.events_with_nulls_sql, ["events"])
    return P.profile(df).select("column_name", "n_rows", "null_count", "null_pct",
                                (F.col("null_count") == F.col("n_rows")).alias("all_null"))


@register
def profile_numeric(spark, sf_dir):
    """Min / max / integral / suggested integer type of numeric columns."""
    out = []
    for t in ["lineitem", "customer"]:
        p = P.profile(P.select_by_kind(I.load(spark, sf_dir, t)))
        out.append(p.select(F.lit(t).alias("table_name"), "column_name", "min_value", "max_value",
                            "is_integral", "suggested_type"))
    return _union(out)


@register
def profile_strings(spark, sf_dir):
    """Longest and mean length, suggested text type of string columns."""
    out = []
    for t in ["documents", "pages", "conversations", "orders"]:
        p = P.profile(P.select_by_kind(I.load(spark, sf_dir, t), ("string",)))
        out.append(p.select(F.lit(t).alias("table_name"), "column_name", "max_len", "avg_len",
                            "suggested_type"))
    return _union(out)


@register
def profile_special_chars(spark, sf_dir):
    """backtick / quote / backslash presence per text column (full scan)."""
    out = []
    for t in ["events", "documents", "pages", "conversations"]:
        p = P.profile(P.select_by_kind(I.load(spark, sf_dir, t), ("string",)))
        out.append(p.select(F.lit(t).alias("table_name"), "column_name", "has_backtick",
                            "has_quotes", "has_backslash"))
    return _union(out)


@register
def profile_mixed_kinds(spark, sf_dir):
    """A4: kinds of text values per column with counts and an example."""
    df = _sql(spark, sf_dir, I.events_as_text_sql, ["events"])
    return P.kind_histogram(df, ["user_id_txt", "value_txt", "props_txt", "mixed_txt", "mostly_num_txt"])


@register
def numeric_share(spark, sf_dir):
    """A5: share of number-convertible values per text column."""
    df = _sql(spark, sf_dir, I.events_as_text_sql, ["events"])
    return P.numeric_share(df, ["user_id_txt", "value_txt", "props_txt", "mixed_txt", "mostly_num_txt"])


@register
def duplicate_names(spark, sf_dir):
    """A2: repeated names within each document's header line."""
    h = _sql(spark, sf_dir, I.doc_headers_sql, ["documents"])
    return P.duplicate_names(h, ["doc_id"], "name")


@register
def table_shape(spark, sf_dir):
    """A1: rows and columns of every table."""
    return _union([P.shape(I.load(spark, sf_dir, t)).select(F.lit(t).alias("table_name"), "n_rows", "n_columns")
                   for t in ["lineitem", "orders", "events", "documents", "customer"]])


# ---- step 2: names and types ------------------------------------------------------------

def _typed_profile(spark, sf_dir, tables):
    # derived columns and types once over all tables' rows, not once a table
    raw = _union([P.profile(I.load(spark, sf_dir, t), derived=False).withColumn("table_name", F.lit(t))
                  for t in tables])
    return P.infer_sql_types(P.with_derived(raw))


@register
def infer_types(spark, sf_dir):
    """SQL type of every column of the typed tables (full scan)."""
    return _typed_profile(spark, sf_dir, TYPED_TABLES).select("table_name", "ordinal", "column_name",
                                                               "sql_type")


@register
def int_ladder(spark, sf_dir):
    """T4: integer columns, their range and type."""
    return (_typed_profile(spark, sf_dir, TYPED_TABLES).where(F.col("kind") == "integer")
            .select("table_name", "column_name", "min_value", "max_value", "sql_type"))


@register
def decimal_type(spark, sf_dir):
    """Float columns, digits of their values and the DECIMAL type."""
    return (_typed_profile(spark, sf_dir, TYPED_TABLES).where(F.col("kind") == "float")
            .select("table_name", "column_name", "int_digits", "frac_digits", "sql_type"))


@register
def date_or_datetime(spark, sf_dir):
    """Timestamp columns -> DATE when every value is at midnight, else DATETIME."""
    return (_typed_profile(spark, sf_dir, TYPED_TABLES).where(F.col("kind") == "datetime")
            .select("table_name", "column_name", "has_time", "sql_type"))


@register
def type_edges(spark, sf_dir):
    """Columns of nothing, with infinities, of booleans, lists, dates and wide numbers; kind and type."""
    df = _sql(spark, sf_dir, I.type_edges_sql, ["events"])
    typed = P.infer_sql_types(P.profile(df)).select("column_name", "null_count", "min_whole", "max_whole", "sql_type")
    return P.dtypes_frame(df).select("ordinal", "column_name", "kind").join(typed, "column_name")


@register
def fit_typed(spark, sf_dir):
    """Events of real types checked against target types: date-times and numbers pass unchanged, values
    that do not fit are rejects."""
    e = I.load(spark, sf_dir, "events").select("event_id", "ts", "value", "user_id")
    out = QL.check_types(e, {"ts": "DATETIME", "value": "DECIMAL(4,2)", "user_id": "TINYINT UNSIGNED"})
    accepted = out.accepted.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("user_id").cast("long").alias("user_id"),
                                   F.lit(0).alias("n_errors"))
    rejected = out.rejected.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("user_id").cast("long").alias("user_id"),
                                   F.size("errors").alias("n_errors"))
    return accepted.unionByName(rejected)


@register
def mixed_types(spark, sf_dir):
    """Columns of cells, how many values each kind has, and the type that mixed kinds get."""
    df = _sql(spark, sf_dir, I.mixed_cells_sql, ["documents"])
    p = P.infer_sql_types(P.profile(df, cells=I.MIXED_CELLS))
    return p.select("column_name", "kind", "n_kinds", "n_integer", "n_float", "n_boolean", "n_datetime", "n_string",
                    "max_len", "sql_type")


# Dirty headers given to the orders table (P1 input; the data stays the whole table).
ORDERS_DIRTY_HEADER = [" Order ID ", "customer-id", "status", "Total Price ($)", "2024 date", "status"]


def _orders_dirty(spark, sf_dir):
    o = I.load(spark, sf_dir, "orders")
    return o.toDF(*ORDERS_DIRTY_HEADER)


@register
def column_mapping(spark, sf_dir):
    """Original header, normalised name, inferred type, modified flag."""
    raw = _orders_dirty(spark, sf_dir)
    names = C.make_unique(C.normalize_names(raw.columns))
    df = raw.toDF(*names)
    prof = P.infer_sql_types(P.profile(df))
    return C.column_mapping(raw.columns, names, prof)


@register
def create_table_ddl(spark, sf_dir):
    """K1/K7/P5: CREATE TABLE text per table from the inferred mapping."""
    from sluice.sinks.tables import create_table_sql
    out = []
    for t in ["orders", "lineitem", "customer", "part"]:
        df = I.load(spark, sf_dir, t)
        prof = P.infer_sql_types(P.profile(df))
        out.append(create_table_sql(prof, F.lit(f"{t}.csv"), EPOCH))
    return _union(out)


@register
def normalize_names(spark, sf_dir):
    """P1 over every document's header line."""
    h = _sql(spark, sf_dir, I.doc_headers_sql, ["documents"])
    return C.normalize_names_df(h, ["doc_id"]).select("doc_id", "ordinal", "name", "normalized")


@register
def unique_names(spark, sf_dir):
    """P1 + P2 over every document's header line (free-suffix search per header)."""
    h = _sql(spark, sf_dir, I.doc_headers_sql, ["documents"])
    n = C.normalize_names_df(h, ["doc_id"]).select("doc_id", "ordinal", "normalized")
    return C.unique_names_df(n, ["doc_id"])


@register
def drop_null_columns(spark, sf_dir):
    """Events with injected nulls minus the all-null column."""
    return C.drop_null_columns(_sql(spark, sf_dir, I.events_with_nulls_sql, ["events"]))


def _orders_text_sql(d):
    return f"""
SELECT {I.s('o_orderkey', d)} AS okey, {I.s('o_totalprice', d)} AS price, o_orderstatus AS status,
  {I.s('o_orderdate', d)} AS odate,
  CASE WHEN o_orderkey % 10 = 0 THEN 'n/a' ELSE {I.s('o_custkey', d)} END AS cust
FROM orders"""


@register
def coerce_numeric(spark, sf_dir):
    """Text columns that are all numbers become BIGINT / DOUBLE."""
    return C.coerce_numeric(_sql(spark, sf_dir, _orders_text_sql, ["orders"]))


# ---- step 3: cleaning ---------------------------------------------------------------------

def _cleaned(spark, sf_dir):
    d = _sql(spark, sf_dir, I.dirty_values_sql, ["orders"])
    return clean_columns(d, {"c": "raw"}).select("id", "raw", "c.kind", "c.num", "c.ts", "c.str")


@register
def clean_all(spark, sf_dir):
    """The whole cleaning chain on every dirty value."""
    return _cleaned(spark, sf_dir)


def _clean_rule(name, rule, doc):
    def q(spark, sf_dir):
        # the partition id keeps the filter above the staged rules instead of inlining them
        return _cleaned(spark, sf_dir).withColumn("_part", F.spark_partition_id()).where(
            F.expr(rule) & (F.col("_part") >= 0)).drop("_part")
    q.__name__ = name
    q.__doc__ = doc
    return register(q)


# the whole table is cleaned; each query reports the values on which its rule fired
CLEAN_RULES = {
    "clean_percent": ("kind = 'num' AND raw LIKE '%#%%' ESCAPE '#'", "C4: percent values."),
    "clean_currency": ("kind = 'num' AND NOT raw LIKE '%#%%' ESCAPE '#'", "C5: currency and embedded numbers."),
    "clean_dates": ("kind = 'ts' AND raw NOT LIKE '%:%'", "C6/C7: Y-M-D, D-M-Y and M-D-Y dates."),
    "clean_iso": ("kind = 'ts' AND raw LIKE '%:%'", "C8: ISO date-times with fraction and zone."),
    "clean_null_tokens": ("kind = 'null'", "C3: blanks and null tokens."),
    "clean_text_values": ("kind = 'str'", "C8c: values that stay text, impossible dates included."),
}
for _name, (_rule, _doc) in CLEAN_RULES.items():
    _clean_rule(_name, _rule, _doc)


@register
def clean_inf(spark, sf_dir):
    """NaN / inf -> null on numeric columns (inf made from value / 0 shares)."""
    e = I.load(spark, sf_dir, "events")
    x = F.try_divide(F.col("value"), (F.col("event_id") % 4).cast("double"))
    y = F.when(F.col("event_id") % 4 == 0, F.lit(float("inf"))).otherwise(x)
    from sluice.functions.clean import clean_number
    return e.select("event_id", clean_number(y).alias("value_clean"))


@register
def clean_long_text(spark, sf_dir):
    """Texts cut at 65,535 characters (documents tripled to exceed it)."""
    d = I.load(spark, sf_dir, "documents")
    t = d.select("doc_id", F.concat("text", "text", "text").alias("t"))
    c = clean_columns(t, {"c": "t"})
    return c.select("doc_id", F.length("t").alias("raw_len"), F.col("c.kind").alias("kind"),
                    F.length("c.str").alias("clean_len"))


@register
def human_size(spark, sf_dir):
    """Human-readable sizes of pages and of documents x 37."""
    p = I.load(spark, sf_dir, "pages").select(F.col("page_id").alias("id"),
                                                F.octet_length("html").cast("bigint").alias("size_bytes"))
    d = I.load(spark, sf_dir, "documents").select((-F.col("doc_id") - 1).alias("id"),
                                                    (F.col("n_chars") * 37).cast("bigint").alias("size_bytes"))
    return p.unionByName(d).withColumn("size_text", H.human_size(F.col("size_bytes")))


@register
def human_duration(spark, sf_dir):
    """C11: span of every user's events as seconds / minutes / hours text."""
    e = I.load(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    g = e.groupBy("user_id").agg(((F.max(us) - F.min(us)) / 1e6).alias("seconds"))
    return g.withColumn("duration_text", H.human_duration(F.col("seconds")))


@register
def file_parts(spark, sf_dir):
    """Base name, stem, extension and table name of every page URL path."""
    p = I.load(spark, sf_dir, "pages")
    path = F.regexp_replace(F.col("url"), r"[?#].*$", "")
    return p.select("page_id", H.base_name(path).alias("base_name"), H.stem(path).alias("stem"),
                    H.extension(path).alias("extension"),
                    H.table_name_for(H.stem(path), EPOCH).alias("table_name"))


# ---- step 4: quality ----------------------------------------------------------------------

def _checked(spark, sf_dir):
    d = _sql(spark, sf_dir, I.dirty_orders_sql, ["orders"])
    return QL.check_types(d, I.QUARANTINE_TARGETS)


@register
def quarantine_accepted(spark, sf_dir):
    """Q1: rows that fit their target types, typed for the target."""
    return _checked(spark, sf_dir).accepted


@register
def quarantine_rejected(spark, sf_dir):
    """Rows that do not fit, one row per (row, column, reason)."""
    return QL.reject_reasons(_checked(spark, sf_dir).rejected, "id")


@register
def reject_reasons(spark, sf_dir):
    """reject counts per column and reason."""
    r = QL.reject_reasons(_checked(spark, sf_dir).rejected, "id")
    return r.groupBy("column", "reason").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))


@register
def error_rate_gate(spark, sf_dir):
    """error gate over the checked table."""
    return QL.error_gate(_checked(spark, sf_dir).checked)


@register
def import_report(spark, sf_dir):
    """Totals and success rate of an import."""
    return QL.import_report(_checked(spark, sf_dir).checked, f"orders_{EPOCH}")


@register
def type_override(spark, sf_dir):
    """Inferred types with user overrides applied."""
    o = I.load(spark, sf_dir, "orders")
    prof = P.infer_sql_types(P.profile(o))
    m = C.column_mapping(o.columns, o.columns, prof)
    return C.apply_overrides(m, {"o_orderpriority": "VARCHAR(20)", "o_totalprice": "DOUBLE"}).select(
        "ordinal", "current", "sql_type", "overridden")


# ---- step 5: ordinals and chunks ----------------------------------------------------------

@register
def row_ordinal(spark, sf_dir):
    """Global ordinal of orders by key and its chunk (N = 4,998)."""
    o = I.load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return CH.with_chunk(CH.with_ordinal(o, ["o_orderkey"]), CHUNK_ROWS)


@register
def chunk_manifest(spark, sf_dir):
    """Chunks of orders and events, names and row counts."""
    out = []
    for t, key in [("orders", "o_orderkey"), ("events", "event_id")]:
        df = CH.with_ordinal(I.load(spark, sf_dir, t).select(key), [key])
        out.append(CH.chunk_manifest(df, CHUNK_ROWS, t, DAY).withColumn("table_name", F.lit(t)))
    return _union(out)


# ---- step 7: run logs -------------------------------------------------------------------------

#: bytes of orders that the windows over one run's orders take at once, by the planner's estimate
RUN_BYTES = 4 << 20


def _by_run(spark, sf_dir):
    """The view ``orders``, dealt by customer into parts that grow in number with the table, not in size: the windows
    over a customer's orders keep these parts."""
    o = I.load(spark, sf_dir, "orders")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(CH.MOST_PARTITIONS, -(-CH.estimated_bytes(o) // RUN_BYTES)))
    o.repartition(parts, "o_custkey").createOrReplaceTempView("orders")


def _log_lines(spark, sf_dir):
    _by_run(spark, sf_dir)
    return spark.sql(I.log_lines_sql("spark", once=True))


@register
def log_names(spark, sf_dir):
    """L1: table name and time from every log file name (else stem + mtime)."""
    files = _log_lines(spark, sf_dir).groupBy("file_name").agg(F.min("mtime").alias("mtime"))
    return L.log_names(files)


@register
def log_results(spark, sf_dir):
    """L2: status and numbers from the last 50 lines of every log."""
    return L.log_results(_log_lines(spark, sf_dir).select("file_name", "line_no", "line"))


@register
def batch_throughput(spark, sf_dir):
    """L4: progress lines parsed into numbers."""
    return L.batch_throughput(_log_lines(spark, sf_dir))


@register
def speed_moving_avg(spark, sf_dir):
    """Moving speed averages and slow-down flags per log."""
    return L.speed_moving_avg(L.batch_throughput(_log_lines(spark, sf_dir))).select(
        "file_name", "seq", "speed", "avg_speed_10", "recent_avg", "earlier_avg", "slowdown")


@register
def progress_running(spark, sf_dir):
    """Running progress per import run."""
    b = _sql(spark, sf_dir, I.batches_sql, ["orders"])
    return L.progress_running(b, "run_id", "seq", "batch_rows", "ok_rows", "batch_seconds",
                              "total_rows").select(
        "run_id", "seq", "processed", "inserted", "failed", "success_pct", "rows_per_sec", "eta_seconds")


# ---- step 6: files (written from the tables into the shared scratch folder) -------------

def _scratch(spark, name):
    from sluice.session import scratch_path
    return scratch_path(spark, name)


def _run(df):
    """Run a writer for its files; its manifest stays where it is."""
    df.write.format("noop").mode("overwrite").save()


def _write_chunks(df, out, stem, chunk_rows, key, header=True, fmt="csv"):
    from sluice.sinks.chunked import write_chunks
    ordered = CH.with_ordinal(df, [key])
    return write_chunks(ordered, out, stem, DAY, chunk_rows, header=header, fmt=fmt)


@register
def split_csv_roundtrip(spark, sf_dir):
    """Orders cut into chunk files of 4,998 rows, read back per file."""
    from sluice.sources.csv import read_csv
    out = _scratch(spark, "split")
    o = I.load(spark, sf_dir, "orders")
    _run(_write_chunks(o, out, "orders", CHUNK_ROWS, "o_orderkey"))
    r = read_csv(spark, f"{out}/*.csv", sep=",", escape='"', with_file=True, keep_rejects=False)
    return (r.rows.groupBy(H.base_name(F.col("file_path")).alias("file_name"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                 F.round(F.sum(F.col("o_totalprice").cast("double")), 2).alias("total_price"),
                 F.min(F.col("o_orderkey").cast("bigint")).alias("first_key")))


@register
def csv_roundtrip(spark, sf_dir):
    """Conversations (quotes, commas, newlines in text) written and read back in blocks."""
    from sluice.sources.records import read_records
    out = _scratch(spark, "conv")
    c = I.load(spark, sf_dir, "conversations").withColumn("_k", F.col("conv_id") * 100000 + F.col("turn"))
    _run(_write_chunks(c.drop("_k").withColumn("_k", F.col("conv_id") * 100000 + F.col("turn")),
                  out, "conversations", 49998, "_k"))
    r = read_records(spark, out, sep=",", escape='"', na_tokens=None)
    return r.rows.select(F.col("conv_id").cast("bigint").alias("conv_id"),
                         F.col("turn").cast("bigint").alias("turn"), "role",
                         F.coalesce("text", F.lit("")).alias("text"))


@register
def csv_row_count(spark, sf_dir):
    """Physical lines minus header vs logical rows of a CSV with quoted newlines, counted by blocks."""
    from sluice.sources.records import count_rows
    out = _scratch(spark, "rows")
    c = I.load(spark, sf_dir, "conversations")
    _run(_write_chunks(c.withColumn("_k", F.col("conv_id") * 100000 + F.col("turn")).select(
        "conv_id", "turn", "role", "text", "_k"), out, "conversations", 10 ** 9, "_k"))
    return count_rows(spark, out, sep=",", escape='"').select(
        H.base_name(F.col("file_path")).alias("file_name"), "physical_rows", "logical_rows")


@register
def source_order_chunks(spark, sf_dir):
    """CSV files with quoted newlines read in source order and numbered over all files, cut into chunks
    of 1,000 rows; place and chunk of every row."""
    from sluice.sources.records import read_records
    out = _scratch(spark, "order")
    c = I.load(spark, sf_dir, "conversations")
    _run(_write_chunks(c.withColumn("_k", F.col("conv_id") * 100000 + F.col("turn")), out, "conversations", 300, "_k"))
    rows = read_records(spark, out, sep=",", escape='"', na_tokens=None, with_source=True).rows
    return rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                       H.base_name(F.col("file_path")).alias("file_name"), (F.col("record_no") - 1).alias("record_no"), "ordinal",
                       CH.chunk_id(F.col("ordinal"), 1000).alias("chunk"))


@register
def headerless_csv(spark, sf_dir):
    """A CSV without header read as Column_1..n."""
    from sluice.sources.csv import read_csv
    out = _scratch(spark, "nohdr")
    _run(_write_chunks(I.load(spark, sf_dir, "customer"), out, "customer", 49998, "c_custkey",
                  header=False))
    return read_csv(spark, f"{out}/*.csv", sep=",", header=False, escape='"', keep_rejects=False).rows


@register
def csv_infer(spark, sf_dir):
    """Physical type of every column of a CSV, one aggregate."""
    from sluice.sources.csv import infer_csv_types, read_csv
    out = _scratch(spark, "infer")
    _run(_write_chunks(I.load(spark, sf_dir, "customer"), out, "customer", 49998, "c_custkey"))
    return infer_csv_types(read_csv(spark, f"{out}/*.csv", sep=",", escape='"', keep_rejects=False).rows)


def _bad_lines_sql(d):
    k = "o_orderkey"
    s = lambda e: I.s(e, d)
    base = f"{s(k)} || ',' || {s('o_custkey')} || ',' || o_orderstatus"
    return f"""
SELECT {k} AS id, CASE {k} % 5
  WHEN 0 THEN {base}
  WHEN 1 THEN {base} || ',' || o_orderpriority || ',' || {s('year(o_orderdate)')} || ',extra'
  WHEN 2 THEN {base} || ',"' || o_orderpriority || ',x",' || {s('year(o_orderdate)')}
  WHEN 3 THEN {base} || ',' || o_orderpriority || ','
  ELSE {base} || ',' || o_orderpriority || ',' || {s('year(o_orderdate)')} END AS line
FROM orders"""


@register
def csv_bad_lines(spark, sf_dir):
    """Short rows padded, long rows flagged (from_csv over derived lines)."""
    from sluice.sources.csv import parse_lines
    lines = _sql(spark, sf_dir, _bad_lines_sql, ["orders"])
    return parse_lines(lines, "line", 5).drop("line")


def _na_sql(d):
    return """
SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'NA' WHEN 1 THEN 'N/A' WHEN 2 THEN '#N/A'
  WHEN 3 THEN 'null' WHEN 4 THEN '-nan' WHEN 5 THEN 'NA ' ELSE o_orderpriority END AS raw FROM orders"""


@register
def csv_na_tokens(spark, sf_dir):
    """S3: pandas NA tokens -> null (whole field only)."""
    from sluice.sources.csv import na_to_null
    d = _sql(spark, sf_dir, _na_sql, ["orders"])
    return d.select("id", "raw", na_to_null(F.col("raw")).alias("value"))


@register
def detect_delimiter(spark, sf_dir):
    """Delimiter of every file (customers of one nation per folder, one
    separator per nation)."""
    from sluice.sources.csv import DELIMITERS, detect_delimiters
    out = _scratch(spark, "delim")
    c = I.load(spark, sf_dir, "customer")
    sep = F.element_at(F.array(*[F.lit(x) for x in DELIMITERS]), (F.col("c_nationkey") % 4 + 1).cast("int"))
    line = F.concat_ws("\u0001", "c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    c.select(F.replace(line, F.lit("\u0001"), sep).alias("value"),
             F.col("c_nationkey").alias("nk")).write.partitionBy("nk").text(out)
    d = detect_delimiters(spark, out)
    return (d.withColumn("n_nationkey", F.regexp_extract("file_path", r"nk=([0-9]+)", 1).cast("int"))
            .groupBy("n_nationkey").agg(F.min("delimiter").alias("delimiter")))


@register
def union_files(spark, sf_dir):
    """Two CSV families with different columns unioned by name."""
    from sluice.sources.csv import read_csv, union_files as U
    c = I.load(spark, sf_dir, "customer")
    a_dir, b_dir = _scratch(spark, "ua"), _scratch(spark, "ub")
    grp = F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING")
    _run(_write_chunks(c.where(grp).select("c_custkey", "c_name", "c_acctbal"), a_dir, "a", 49998,
                  "c_custkey"))
    _run(_write_chunks(c.where(~grp).select("c_custkey", "c_name", "c_mktsegment"), b_dir, "b", 49998,
                  "c_custkey"))
    ra = read_csv(spark, f"{a_dir}/*.csv", sep=",", escape='"', keep_rejects=False).rows
    rb = read_csv(spark, f"{b_dir}/*.csv", sep=",", escape='"', keep_rejects=False).rows
    return U([ra, rb])


@register
def file_info(spark, sf_dir):
    """Type, size, rows and chunk count of every chunk file of orders."""
    from sluice.sources.csv import file_type_label, list_files, physical_line_counts
    out = _scratch(spark, "info")
    _run(_write_chunks(I.load(spark, sf_dir, "orders"), out, "orders", CHUNK_ROWS, "o_orderkey"))
    files = list_files(spark, out)
    rows = physical_line_counts(spark, f"{out}/*.csv")
    return (files.join(rows.drop("size_bytes"), files["path"] == rows["file_path"])
            .select("file_name", file_type_label(F.col("extension")).alias("file_type"),
                    F.col("size_bytes").cast("bigint").alias("size_bytes"),
                    H.human_size(F.col("size_bytes")).alias("size_text"),
                    F.col("physical_rows").alias("rows"),
                    CH.chunk_count(F.col("physical_rows"), 1000).alias("chunks")))


@register
def log_files(spark, sf_dir):
    """Run logs written as files and listed newest first, their last 50 lines read by seeking."""
    from sluice.sinks.chunked import write_text_files
    from sluice.sources.logs import read_log_tails
    out = _scratch(spark, "logs")
    _run(write_text_files(_log_lines(spark, sf_dir), out, folders=True))
    logs = read_log_tails(spark, out, L.TAIL_LINES)
    lst = L.log_list(logs.files, logs.lines)
    return lst.select("file_name", "table_name", "status", "total_rows", "inserted_rows", "error_rows",
                      "success_rate", "time_taken", "size_kb")


@register
def log_content(spark, sf_dir):
    """Run logs written as files; the lines of the first one by name, in order."""
    from sluice.sinks.chunked import write_text_files
    from sluice.sources.logs import read_log_content, read_logs
    out = _scratch(spark, "logtext")
    _run(write_text_files(_log_lines(spark, sf_dir), out, folders=True))
    logs = read_logs(spark, out)
    first = logs.files.agg(F.min("file_name")).first()[0]
    return read_log_content(logs, first).select("file_name", "line_no", "line")


# ---- step 9: workbooks, encodings, streaming ------------------------------------------------

@register
def workbook_scan(spark, sf_dir):
    """Orders cut into .xlsx chunk files, scanned back as a table."""
    from sluice.sources.workbook import read_workbooks
    out = _scratch(spark, "xlsx")
    o = I.load(spark, sf_dir, "orders")
    _run(_write_chunks(o, out, "orders", CHUNK_ROWS, "o_orderkey", fmt="xlsx"))
    return read_workbooks(spark, out).table


@register
def workbook_status(spark, sf_dir):
    """Rows and status of every workbook chunk of orders."""
    from sluice.sources.workbook import read_workbooks
    out = _scratch(spark, "xlsxs")
    _run(_write_chunks(I.load(spark, sf_dir, "orders"), out, "orders", CHUNK_ROWS, "o_orderkey", fmt="xlsx"))
    st = read_workbooks(spark, out).status
    return st.select(H.base_name(F.col("file_path")).alias("file_name"), "n_rows", "status")


@register
def workbook_states(spark, sf_dir):
    """Workbooks with rows (orders), with a blank header (customers under blank names) and with nothing below
    their header (suppliers whose values are all gone): rows and state of each."""
    from sluice.sources.workbook import read_workbooks
    out = _scratch(spark, "states")
    c, sup = I.load(spark, sf_dir, "customer"), I.load(spark, sf_dir, "supplier")
    gone = sup.select("s_suppkey", *[F.lit(None).cast("string").alias(n) for n in ("name", "phone")])
    _run(_write_chunks(I.load(spark, sf_dir, "orders"), f"{out}/a", "orders", CHUNK_ROWS, "o_orderkey", fmt="xlsx"))
    _run(_write_chunks(c.select(F.col("c_custkey").alias(" "), F.col("c_name").alias("  ")), f"{out}/b", "customer", CHUNK_ROWS, F.col("` `"), fmt="xlsx"))
    from sluice.sinks.chunked import write_chunks
    _run(write_chunks(CH.with_ordinal(gone, ["s_suppkey"]).drop("s_suppkey"), f"{out}/c", "supplier", DAY, CHUNK_ROWS, fmt="xlsx"))
    return read_workbooks(spark, out).status.select(H.base_name(F.col("file_path")).alias("file_name"), "n_rows", "status")


@register
def workbook_chunks(spark, sf_dir):
    """K5/K6/K9: workbooks of orders cut into committed CSV chunks of 1,000 rows in the order of their sheets; what
    each chunk file holds when it is read back, beside the manifest and the run's record."""
    from sluice.sinks.chunked import prepare_output
    from sluice.sinks.committed import run_records, save_chunks
    from sluice.sources.records import read_records
    from sluice.sources.workbook import read_workbooks
    books, out, runs = _scratch(spark, "books"), _scratch(spark, "bookchunks"), _scratch(spark, "bookruns")
    _run(_write_chunks(I.load(spark, sf_dir, "orders"), books, "orders", CHUNK_ROWS, "o_orderkey", fmt="xlsx"))
    rows = read_workbooks(spark, books, with_source=True).table.drop("file_path", "row_no")
    m = save_chunks(rows, prepare_output(spark, out, clear_old=True), "orders", DAY, 1000, runs=runs, source=books)
    back = read_records(spark, f"{out}/*.csv", sep=",", escape='"', with_source=True).rows
    held = back.groupBy(H.base_name(F.col("file_path")).alias("file_name")).agg(
        F.min(F.col("o_orderkey").cast("long")).alias("first_key"), F.max(F.col("o_orderkey").cast("long")).alias("last_key"),
        F.min("record_no").alias("first_record"), F.round(F.sum(F.col("o_totalprice").cast("double")), 2).alias("total_price"))
    run = run_records(spark, runs).select("run", F.col("n_rows").alias("run_rows"), F.col("n_files").alias("run_files"))
    return (m.join(held, "file_name").join(run, "run")
            .select("chunk", "file_name", "n_rows", "first_key", "last_key", "first_record", "total_price", "run_rows", "run_files"))


@register
def encoding_census(spark, sf_dir):
    """Documents written as text files in utf-8, utf-8 with BOM, gb18030 and
    latin-1 (a quarter of the documents each, 500 ids a file), then the encoding that every whole
    file decodes with."""
    from sluice.sinks.chunked import write_text_files
    from sluice.sources.encoding import encoding_census as census
    d = I.load(spark, sf_dir, "documents")
    base = _scratch(spark, "enc")
    for i, (enc, bom, errors) in enumerate([("utf-8", False, "strict"), ("utf-8", True, "strict"),
                                            ("gb18030", False, "strict"), ("latin-1", False, "replace")]):
        part = d.where(F.col("doc_id") % 4 == i).select(
            F.format_string("docs_%s_%06d.txt", F.lit(enc.replace("-", "")), F.expr("doc_id div 500"))
            .alias("file_name"), F.col("doc_id").alias("line_no"), F.col("text").alias("line"))
        _run(write_text_files(part, f"{base}/{i}", encoding=enc, bom=bom, errors=errors))
    c = census(spark, base, glob="*.txt")
    return c.select(H.base_name(F.col("file_path")).alias("file_name"), "encoding", "decoded_ok", "has_bom")


@register
def encoding_evidence(spark, sf_dir):
    """Documents as text files of four encodings, Chinese numerals in the gb18030 ones and accents in the
    Latin-1 ones; the encoding that the bytes of every file speak for, under the 0.7 rule."""
    from sluice.sinks.chunked import write_text_files
    from sluice.sources.evidence import LEAST_CONFIDENCE, encoding_evidence as evidence
    d = I.load(spark, sf_dir, "documents").where("doc_id is not null")
    base = _scratch(spark, "evidence")
    numerals = F.translate(F.col("n_chars").cast("string"), "0123456789", "零一二三四五六七八九")
    kinds = [("utf8", "utf-8", False, F.lit(" é日")), ("bom", "utf-8", True, F.lit(" é日")),
             ("gb18030", "gb18030", False, F.concat(F.lit(" 第"), numerals, F.lit("号"))), ("latin1", "latin-1", False, F.lit(" é là"))]
    for i, (name, enc, bom, mark) in enumerate(kinds):
        # French and Spanish texts in the Latin-1 files, all languages elsewhere; accents become '?' in gb18030 files
        body = F.regexp_replace(F.coalesce("text", F.lit("")), "[^\\x00-\\x7F]", "?") if name == "gb18030" else F.coalesce("text", F.lit(""))
        part = d.where(F.col("doc_id") % 4 == i).select(
            F.format_string("docs_%s_%06d.txt", F.lit(name), F.expr("doc_id div 500")).alias("file_name"),
            F.col("doc_id").alias("line_no"), F.concat(body, mark).alias("line"))
        _run(write_text_files(part, f"{base}/{i}", encoding=enc, bom=bom, errors="replace"))
    e = evidence(spark, base)
    return e.select(H.base_name(F.col("file_path")).alias("file_name"), "encoding", "decoded_ok", "has_bom",
                    (F.col("confidence") >= LEAST_CONFIDENCE).alias("sure"))


@register
def csv_by_encoding(spark, sf_dir):
    """Documents as CSV files in utf-8, gb18030 and latin-1, every other file with its columns in
    another order, each tenth row with a field too many; read back per encoding, long rows from the rejects."""
    from sluice.sinks.chunked import write_text_files
    from sluice.sources.encoding import read_csv_set_by_encoding
    from sluice.sources.evidence import encoding_evidence as evidence
    d = I.load(spark, sf_dir, "documents")
    base = _scratch(spark, "encset")
    turned = F.expr("doc_id div 5000 % 2 = 1")
    source = F.coalesce(F.replace("source", F.lit(","), F.lit(" ")), F.lit("none"))
    for i, (enc, mark) in enumerate([("utf-8", " 日é"), ("gb18030", " 中文"), ("latin-1", " é")]):
        word = F.concat(F.col("n_chars").cast("string"), F.lit(mark))
        part = d.where(F.col("doc_id") % 3 == i).select(
            F.format_string("docs_%06d.csv", F.expr("doc_id div 5000")).alias("file_name"), F.col("doc_id").alias("line_no"),
            turned.alias("turned"), F.concat_ws(
                ",", F.col("doc_id").cast("string"), F.when(turned, word).otherwise(source),
                F.when(turned, source).otherwise(word), F.when(F.col("doc_id") % 10 == 3, F.lit("extra"))).alias("line"))
        heads = part.select("file_name", "turned").distinct().select(
            "file_name", F.lit(-1).cast("long").alias("line_no"),
            F.when(F.col("turned"), F.lit("doc_id,word,source")).otherwise(F.lit("doc_id,source,word")).alias("line"))
        _run(write_text_files(part.drop("turned").unionByName(heads), f"{base}/{i}", encoding=enc))
    r = read_csv_set_by_encoding(spark, evidence(spark, base), paths=base)
    none = F.lit(None).cast("string")
    return r.rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit("ok").alias("status"), "source", "word").unionByName(
        r.rejects.select(F.col("fields")[0].cast("bigint").alias("doc_id"), F.lit("long").alias("status"),
                         none.alias("source"), none.alias("word")))


@register
def streaming_import(spark, sf_dir):
    """Structured Streaming: dirty order files landing in a folder are fit-checked per
    micro-batch; the accepted rows (same as quarantine_accepted)."""
    from sluice.streaming.landing import start_landing_import
    land, out, ck = _scratch(spark, "land"), _scratch(spark, "landout"), _scratch(spark, "landck")
    d = _sql(spark, sf_dir, I.dirty_orders_sql, ["orders"])
    _run(_write_chunks(d, land, "dirty_orders", CHUNK_ROWS, "id"))
    q = start_landing_import(spark, land, d.columns, I.QUARANTINE_TARGETS, out, ck,
                             max_files_per_trigger=2)
    q.awaitTermination()
    return spark.read.parquet(f"{out}/accepted").select(
        F.col("id").cast("bigint").alias("id"), "qty", "code", "price", "odate")


@register
def import_pipeline(spark, sf_dir):
    """Dirty orders as CSV files -> scan, names, profile, types (with overrides),
    fit check, gate, write; the accepted rows read back from the written table."""
    from sluice.plans.import_file import import_csv
    land, out = _scratch(spark, "imp"), _scratch(spark, "impout")
    d = _sql(spark, sf_dir, I.dirty_orders_sql, ["orders"])
    _run(_write_chunks(d, land, "dirty_orders", 49998, "id"))
    res = import_csv(spark, f"{land}/*.csv", out, EPOCH, overrides=dict(I.QUARANTINE_TARGETS),
                     enforce_gate=False, sep=",", escape='"')
    return spark.read.parquet(res.accepted_path)
