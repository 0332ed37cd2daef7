"""Logs in many folders: listed by tasks, one opened for its content, tails as before."""


def _logs(tmp_path):
    for i in range(3):
        (tmp_path / "deep" / f"p{i}").mkdir(parents=True)
        (tmp_path / "deep" / f"p{i}" / f"import_t{i}_20240105_100000.log").write_text(f"a{i}\nb{i}\n")
    (tmp_path / "run x.log").write_text("z\n")
    (tmp_path / "empty.log").write_text("")
    (tmp_path / "other.txt").write_text("no")
    (tmp_path / ".hidden.log").write_text("no")
    (tmp_path / "_tmp").mkdir()
    (tmp_path / "_tmp" / "c.log").write_text("no")


def test_listing_and_content(spark, tmp_path):
    from sluice.sources.logs import read_log_content, read_log_tails, read_logs
    _logs(tmp_path)
    names = {f"import_t{i}_20240105_100000.log" for i in range(3)} | {"run x.log"}
    shown = {n.replace(" ", "%20") for n in names}
    logs = read_logs(spark, str(tmp_path))
    assert {r.file_name for r in logs.files.collect()} == shown == {r.file_name for r in logs.lines.collect()}
    tails = read_log_tails(spark, str(tmp_path), 1)
    assert {r.file_name for r in tails.files.collect()} == names
    for name in ("import_t1_20240105_100000.log", "run%20x.log"):
        got = read_log_content(logs, name)
        assert [(r.line_no, r.line) for r in got.collect()] == ([(1, "a1"), (2, "b1")] if "t1" in name else [(1, "z")])
        assert len(got.inputFiles()) == 1
    assert read_log_content(logs, "none.log").count() == 0


def test_text_files_in_folders(spark, tmp_path):
    from sluice.sinks.chunked import write_text_files
    rows = spark.createDataFrame([(f"f{i}.log", n, f"l{n}") for i in range(40) for n in range(2)], "file_name string, line_no long, line string")
    assert write_text_files(rows, str(tmp_path / "o"), partitions=4, folders=True).count() == 40
    found = list((tmp_path / "o").rglob("*.log"))
    assert len(found) == 40 and len({f.parent for f in found}) == 4 and all(f.read_text() == "l0\nl1\n" for f in found)


def test_text_files_are_shown_a_folder_at_once(spark, tmp_path):
    from sluice.sinks.chunked import _fs_for, _show, write_text_files
    rows = spark.createDataFrame([("é.log", 2, None), ("é.log", 1, "ä|b"), (None, 1, "x"), ("b.log", 1, "")],
                                 "file_name string, line_no long, line string")
    got = write_text_files(rows, str(tmp_path / "o"), partitions=1, folders=True, bom=True).collect()
    assert sorted(tuple(r) for r in got) == [("b.log", 1, 4), ("é.log", 2, 9)]
    assert {f.name: f.read_bytes() for f in (tmp_path / "o" / "000000").iterdir()} == {
        "b.log": b"\xef\xbb\xbf\n", "é.log": b"\xef\xbb\xbf\xc3\xa4|b\n\n"}
    assert [f.name for f in (tmp_path / "o").iterdir()] == ["000000"]
    # another attempt of a task comes too late
    (tmp_path / "o" / ".0-1.tmp").mkdir()
    (tmp_path / "o" / ".0-1.tmp" / "b.log").write_text("late")
    fs, root = _fs_for(str(tmp_path / "o"))
    _show(fs, f"{root}/.0-1.tmp", f"{root}/000000")
    assert [f.name for f in (tmp_path / "o").iterdir()] == ["000000"] and (tmp_path / "o" / "000000" / "b.log").read_bytes() == b"\xef\xbb\xbf\n"
    late = write_text_files(rows, str(tmp_path / "l"), encoding="gb18030", partitions=1).collect()
    assert sorted(tuple(r) for r in late) == [("b.log", 1, 1), ("é.log", 2, 2 + len("ä|b".encode("gb18030")))]
