"""Run-log analytics (L1-L4, W2, W3, O1, O3) over log lines as rows.

A log is held as lines ``(file_name, line_no, line)`` plus file facts
``(file_name, size_bytes, mtime)`` — never as one string per file — so a huge log is
spread over tasks like any table. "The last 50 lines" is a per-file top-k
(``row_number() <= 50`` which Spark plans as a partial, map-side group limit).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.humanize import py_fixed
from sluice.operators.chunks import MOST_PARTITIONS, PARTITION_BYTES, estimated_bytes
from sluice.operators.quality import success_pct
from sluice.session import staged

# ---------------------------------------------------------------------------
# Log line texts and status words written/read by the reference.
LOG_NAME_PATTERN = r"^import_(.+)_(\d{8}_\d{6})\.log"
LOG_TIME_FORMAT = "yyyyMMdd_HHmmss"
DONE_MARKER = "数据导入完成"
DONE_PATTERN = r"成功导入 (\d+)/(\d+) 行数据, 失败: (\d+), 用时: (.+), 平均速度"
ABORT_MARKER = "错误率过高，中断导入操作"
DB_ERROR_MARKER = "数据库操作出错"
STATUS_DONE = "完成"
STATUS_ABORTED = "中断"
STATUS_FAILED = "失败"
STATUS_UNKNOWN = "未知"
PROGRESS_PATTERN = (r"已导入 (\d+)/(\d+) 行 \(成功: (\d+), 失败: (\d+)\) \| "
                    r"批次大小: (\d+) \| 速度: ([0-9.]+)行/秒")
PROGRESS_FORMAT = "已导入 %d/%d 行 (成功: %d, 失败: %d) | 批次大小: %d | 速度: %s行/秒"
DONE_FORMAT = "数据导入完成: 成功导入 %d/%d 行数据, 失败: %d, 用时: %s, 平均速度: %s行/秒"
TAIL_LINES = 50
#: the planner's sizes from here on say that it knows none
UNKNOWN_BYTES = 1 << 50
SPEED_WINDOW = 10
RECENT_WINDOW = 3
SLOWDOWN_RATIO = 0.85
SLOWDOWN_MIN_HISTORY = 6
# ---------------------------------------------------------------------------


def log_names(files: DataFrame) -> DataFrame:
    """L1: ``(file_name, table_name, log_time)`` from the name, else stem + mtime."""
    fn = F.col("file_name")
    ok = fn.rlike(LOG_NAME_PATTERN)
    parsed = F.try_to_timestamp(F.regexp_extract(fn, LOG_NAME_PATTERN, 2), F.lit(LOG_TIME_FORMAT))
    return files.select(
        "file_name", *(["file_path"] if "file_path" in files.columns else []),
        F.when(ok, F.regexp_extract(fn, LOG_NAME_PATTERN, 1))
        .otherwise(F.replace(fn, F.lit(".log"), F.lit(""))).alias("table_name"),
        F.when(ok, F.coalesce(F.to_timestamp_ntz(F.date_format(parsed, "yyyy-MM-dd HH:mm:ss")),
                              F.col("mtime")))
        .otherwise(F.col("mtime")).cast("timestamp_ntz").alias("log_time"))


def _file_key(lines: DataFrame) -> str:
    """Files are told apart by path where the scan gives it."""
    return "file_path" if "file_path" in lines.columns else "file_name"


def tail_lines(lines: DataFrame, n: int = TAIL_LINES) -> DataFrame:
    """O3: the last ``n`` lines of every file (per-file top-k, limit pushed map-side)."""
    w = Window.partitionBy(_file_key(lines)).orderBy(F.col("line_no").desc())
    return lines.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def log_results(lines: DataFrame, files: DataFrame | None = None, n: int = TAIL_LINES) -> DataFrame:
    """L2: newest matching line among the last ``n``: done line -> 完成 + numbers,
    abort line -> 中断, database error -> 失败, none -> 未知.

    A done marker whose numbers do not parse is skipped (the search goes on), as in
    the reference; an earlier abort line does not beat a later done line (D16).
    """
    line = F.col("line")
    done = line.contains(DONE_MARKER) & line.rlike(DONE_PATTERN)
    cls = (F.when(line.contains(DONE_MARKER), F.when(done, F.lit(1)))
           .when(line.contains(ABORT_MARKER), F.lit(2))
           .when(line.contains(DB_ERROR_MARKER), F.lit(3)))
    g = lambda i: F.regexp_extract(line, DONE_PATTERN, i)
    key = _file_key(lines)
    names = ["file_name"] if key == "file_name" else ["file_name", key]
    found = F.when(cls.isNotNull(), F.struct(cls.alias("_cls"), g(1).try_cast("bigint").alias("inserted_rows"), g(2).try_cast("bigint").alias("total_rows"),
                                             g(3).try_cast("bigint").alias("error_rows"), g(4).alias("time_taken")))
    # sorted without their text, by parts whose number follows the input: a task's share does not grow with it
    slim = lines.select(*names, "line_no", found.alias("_found"))
    size = estimated_bytes(slim)
    known = size if size < UNKNOWN_BYTES else 0
    parts = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTITIONS, -(-known // PARTITION_BYTES)))
    # every file with a line is in its tail, so the names come from it too; a line without a file has no result
    newest = (tail_lines(slim.repartition(parts, key), n).groupBy(*names)
              .agg(F.max_by("_found", F.when(F.col("_found").isNotNull(), F.col("line_no"))).alias("r"))
              .withColumn("r", F.when(F.col(key).isNotNull(), F.col("r"))))
    r = F.col("r")
    is_done = r["_cls"] == 1
    results = newest if files is None else files.select(*names).join(newest.select(key, "r"), key, "left")
    return (results.select(
        *names,
        F.coalesce(F.when(r["_cls"] == 1, F.lit(STATUS_DONE)).when(r["_cls"] == 2, F.lit(STATUS_ABORTED))
                   .when(r["_cls"] == 3, F.lit(STATUS_FAILED)), F.lit(STATUS_UNKNOWN)).alias("status"),
        F.when(is_done, r["total_rows"]).otherwise(F.lit(0)).cast("bigint").alias("total_rows"),
        F.when(is_done, r["inserted_rows"]).otherwise(F.lit(0)).cast("bigint").alias("inserted_rows"),
        F.when(is_done, r["error_rows"]).otherwise(F.lit(0)).cast("bigint").alias("error_rows"),
        F.when(is_done & (r["total_rows"] > 0), success_pct(r["inserted_rows"], r["total_rows"]))
        .otherwise(F.lit(0.0)).alias("success_rate"),
        F.when(is_done, r["time_taken"]).otherwise(F.lit(STATUS_UNKNOWN)).alias("time_taken")))


def log_list(files: DataFrame, lines: DataFrame) -> DataFrame:
    """L3 + O1: names, results, size in KB (2 dp), newest first."""
    res = log_results(lines, files)
    key = _file_key(lines)
    return (log_names(files).join(res.drop("file_name") if key != "file_name" else res, key)
            .join(files.select(key, "size_bytes", "mtime"), key)
            .withColumn("size_kb", F.round(F.col("size_bytes") / 1024.0, 2))
            .drop("size_bytes", "file_path")
            .orderBy(F.col("mtime").desc(), F.col("file_name")))


def batch_throughput(lines: DataFrame) -> DataFrame:
    """L4: progress lines -> ``(file_name, seq, done_rows, total_rows, ok_rows, bad_rows,
    batch_size, speed)``; ``seq`` is the line number."""
    line = F.col("line")
    g = lambda i: F.regexp_extract(line, PROGRESS_PATTERN, i)
    return (lines.where(line.rlike(PROGRESS_PATTERN))
            .select("file_name", F.col("line_no").alias("seq"),
                    g(1).try_cast("bigint").alias("done_rows"),
                    g(2).try_cast("bigint").alias("total_rows"),
                    g(3).try_cast("bigint").alias("ok_rows"),
                    g(4).try_cast("bigint").alias("bad_rows"),
                    g(5).try_cast("bigint").alias("batch_size"),
                    g(6).try_cast("double").alias("speed")))


#: stretch of sequence numbers that one task scans; what went before it comes to it as carried state
STRETCH = 100_000


def _stretched(rows: DataFrame, key: str, seq: str, stretch: int) -> DataFrame:
    """``rows`` with ``_at``, the stretch of its key's sequence that each is in (written: both passes read it)."""
    return staged(rows.withColumn("_at", F.floor(F.col(seq) / F.lit(stretch)).cast("long")), "stretches")


def speed_moving_avg(progress: DataFrame, key: str = "file_name", seq: str = "seq",
                     speed: str = "speed", stretch: int = STRETCH) -> DataFrame:
    """Mean of the last 10 speeds; mean of the last 3 vs the earlier ones in that
    window; ``slowdown`` when more than 6 are in the window and recent < 85 % of earlier.

    A log is cut into stretches that are scanned in parallel: each begins with the last nine rows before it,
    which the last nine stretches of its log together hold (a table of nine rows a stretch)."""
    cut = _stretched(progress, key, seq, stretch)
    carried_rows = SPEED_WINDOW - 1
    last = F.row_number().over(Window.partitionBy(key, "_at").orderBy(F.col(seq).desc()))
    ends = (cut.select(key, "_at", seq, speed).withColumn("_rn", last).where(F.col("_rn") <= carried_rows)
            .groupBy(key, "_at").agg(F.array_sort(F.collect_list(F.struct(seq, speed))).alias("_end")))
    before = Window.partitionBy(key).orderBy("_at").rowsBetween(-carried_rows, -1)
    carried = (ends.select(key, "_at", F.slice(F.concat(F.array_repeat(F.lit(None).cast(ends.schema["_end"].dataType.elementType), carried_rows),
                                                        F.flatten(F.collect_list("_end").over(before))), -carried_rows, carried_rows).alias("_c"))
               .select(key, "_at", F.explode(F.filter("_c", lambda x: x.isNotNull())).alias("_c"))
               .select(key, "_at", F.col("_c")[seq].alias(seq), F.col("_c")[speed].alias(speed), F.lit(True).alias("_carried")))
    w = Window.partitionBy(key, "_at").orderBy(seq)
    s = F.col(speed)
    last10 = w.rowsBetween(-(SPEED_WINDOW - 1), 0)
    recent = F.avg(s).over(w.rowsBetween(-(RECENT_WINDOW - 1), 0))
    earlier = F.avg(s).over(w.rowsBetween(-(SPEED_WINDOW - 1), -RECENT_WINDOW))
    n = F.count(s).over(last10)
    return (cut.withColumn("_carried", F.lit(False)).unionByName(carried, allowMissingColumns=True)
            .withColumn("avg_speed_10", F.round(F.avg(s).over(last10), 4))
            .withColumn("recent_avg", F.round(recent, 4))
            .withColumn("earlier_avg", F.round(F.when(n > SLOWDOWN_MIN_HISTORY, earlier)
                                               .otherwise(recent), 4))
            .withColumn("slowdown", (n > SLOWDOWN_MIN_HISTORY) & (recent < earlier * SLOWDOWN_RATIO))
            .where(~F.col("_carried")).drop("_carried", "_at"))


def progress_running(batches: DataFrame, key: str, seq: str, rows: str, ok: str,
                     seconds: str, total: str, stretch: int = STRETCH) -> DataFrame:
    """Running processed / inserted / failed rows, success %, rows per second and
    the ETA in seconds, from per-batch records.

    A run is cut into stretches that are scanned in parallel, each from the sums of those before it (a table
    of one row a stretch)."""
    cut = _stretched(batches, key, seq, stretch)
    sums = cut.groupBy(key, "_at").agg(F.sum(rows).alias("_r"), F.sum(ok).alias("_o"), F.sum(seconds).alias("_s"))
    before = Window.partitionBy(key).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(key, "_at", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("_r", "_o", "_s")])
    w = Window.partitionBy(key, "_at").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    processed = F.col("_r0") + F.sum(rows).over(w)
    inserted = F.col("_o0") + F.sum(ok).over(w)
    return (cut.join(offsets, [key, "_at"])
            .withColumn("processed", processed.cast("bigint"))
            .withColumn("inserted", inserted.cast("bigint"))
            .withColumn("_el", F.col("_s0") + F.sum(seconds).over(w))
            .withColumn("failed", (F.col("processed") - F.col("inserted")).cast("bigint"))
            .withColumn("success_pct", F.round(F.coalesce(
                F.try_divide(F.col("inserted") * 100.0, F.col("processed")), F.lit(0.0)), 1))
            .withColumn("elapsed", F.round("_el", 3))
            .withColumn("_v", F.try_divide(F.col("processed").cast("double"), F.col("_el")))
            .withColumn("rows_per_sec", F.round(F.coalesce("_v", F.lit(0.0)), 1))
            .withColumn("eta_seconds", F.round(F.coalesce(
                F.try_divide((F.col(total) - F.col("processed")).cast("double"), F.col("_v")), F.lit(0.0)), 0))
            .drop("_at", "_r0", "_o0", "_s0", "_el", "_v"))


def progress_line(done: Column, total: Column, ok: Column, bad: Column, batch: Column,
                  speed: Column) -> Column:
    """The reference's per-batch log line (for writing run logs, K9)."""
    return F.format_string(PROGRESS_FORMAT, done, total, ok, bad, batch, py_fixed(speed, 1))


def done_line(inserted: Column, total: Column, errors: Column, time_text: Column,
              speed: Column) -> Column:
    """The reference's summary log line (for writing run logs, K9)."""
    return F.format_string(DONE_FORMAT, inserted, total, errors, time_text, py_fixed(speed, 1))
