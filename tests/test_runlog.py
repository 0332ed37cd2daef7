import datetime as dt

from sluice.operators.runlog import (batch_throughput, log_names, log_results, speed_moving_avg)

DONE = "2024-01-05 - INFO - 数据导入完成: 成功导入 90/100 行数据, 失败: 10, 用时: 3.0秒, 平均速度: 30.0行/秒"
ABORT = "2024-01-05 - ERROR - 错误率过高，中断导入操作"
DBERR = "2024-01-05 - ERROR - 数据库操作出错: boom"
PROG = "已导入 {d}/100 行 (成功: {d}, 失败: 0) | 批次大小: 10 | 速度: {s}行/秒"

LOGS = {
    "import_t1_20240105_101112.log": ["start", DONE],
    "import_t2_20240105_101112.log": ["start", ABORT, DONE],
    "import_t3_20240105_101112.log": ["start", ABORT],
    "import_t4_20240105_101112.log": ["start", DBERR],
    "import_t5_20240105_101112.log": ["start", "x"],
    "import_t6_20240105_101112.log": ["start", DONE] + ["filler"] * 55,
    "other.log": ["start", DONE],
}


def _lines(spark):
    rows = [(f, i + 1, line) for f, lines in LOGS.items() for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "file_name string, line_no long, line string")


def test_results(spark):
    got = {r.file_name: r for r in log_results(_lines(spark)).collect()}
    assert got["import_t1_20240105_101112.log"].status == "完成"
    assert got["import_t1_20240105_101112.log"].success_rate == 90.0
    assert got["import_t1_20240105_101112.log"].time_taken == "3.0秒"
    assert got["import_t2_20240105_101112.log"].status == "完成"
    assert got["import_t3_20240105_101112.log"].status == "中断"
    assert got["import_t4_20240105_101112.log"].status == "失败"
    assert got["import_t5_20240105_101112.log"].status == "未知"
    assert got["import_t6_20240105_101112.log"].status == "未知"


def test_names(spark):
    mt = dt.datetime(2024, 2, 2, 3, 4, 5)
    files = spark.createDataFrame([(f, mt) for f in LOGS], "file_name string, mtime timestamp_ntz")
    got = {r.file_name: r for r in log_names(files).collect()}
    assert got["import_t1_20240105_101112.log"].table_name == "t1"
    assert got["import_t1_20240105_101112.log"].log_time == dt.datetime(2024, 1, 5, 10, 11, 12)
    assert got["other.log"].table_name == "other" and got["other.log"].log_time == mt


def test_throughput_and_slowdown(spark):
    speeds = [100.0] * 7 + [50.0] * 3
    rows = [("f", i + 1, PROG.format(d=10 * (i + 1), s=f"{s:.1f}")) for i, s in enumerate(speeds)]
    lines = spark.createDataFrame(rows, "file_name string, line_no long, line string")
    tp = batch_throughput(lines)
    assert tp.count() == 10
    w = {r.seq: r for r in speed_moving_avg(tp).collect()}
    assert w[10].slowdown is True and w[10].avg_speed_10 == 85.0
    assert w[9].slowdown is True
    assert w[6].slowdown is False
