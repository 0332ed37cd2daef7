"""Encodings by evidence: files of known encodings told apart, in blocks, under the 0.7 rule."""
import pytest
from pyspark.sql import functions as F

from sluice.sources.evidence import candidate_order, encoding_evidence, evidence_of

CHINESE = "数据导入工具的日志记录了每个文件的行数和错误。"
FRENCH = "Les élèves réussirent très vite à créer une œuvre éclatée, là où ça gênait déjà l'été."


def test_orders():
    assert candidate_order("utf-8") == ["utf-8", "gb18030", "gbk", "utf-8-sig", "latin1"]
    assert candidate_order(chosen="latin1") == ["latin1", "gb18030", "gbk", "utf-8"]
    assert candidate_order("gb18030", splitter=True) == ["gb18030", "utf-8", "utf-8-sig", "latin1"]
    assert candidate_order(splitter=True)[0] == "utf-8"


def test_files_are_told_apart(spark, tmp_path):
    files = {"ascii": b"plain text\n" * 50, "utf8": (FRENCH + CHINESE + "\n").encode(), "bom": b"\xef\xbb\xbf" + CHINESE.encode() + b"\n",
             "gbk": (CHINESE + "\n").encode("gbk") * 30, "gb_mixed": b"id,name\n" + b"".join(f"{i},{CHINESE[i % 20:i % 20 + 3]}\n".encode("gb18030") for i in range(400)),
             "latin": (FRENCH.replace("œ", "oe") + "\n").encode("latin-1") * 40, "one": "id\n1,é x\n".encode("latin-1"),
             "german": "Größe, Straße, über Öl und Ähre\n".encode("latin-1") * 20, "four": ("𠀀" + CHINESE).encode("gb18030") * 3}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    want = {"ascii": "utf-8", "utf8": "utf-8", "bom": "utf-8-sig", "gbk": "gb18030", "gb_mixed": "gb18030", "latin": "latin1",
            "one": "latin1", "german": "latin1", "four": "gb18030"}
    for size in (None, 64):
        if size:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            got = {r["file_path"].rsplit("/", 1)[1]: r for r in encoding_evidence(spark, str(tmp_path)).collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert {k: r["encoding"] for k, r in got.items()} == want
        assert all(r["decoded_ok"] and r["confidence"] >= 0.7 for r in got.values())
        assert got["bom"]["has_bom"] and got["gbk"]["has_cjk"] and not got["latin"]["has_bom"]


def test_low_confidence_gives_way(spark, tmp_path):
    """Two rare characters and a lone byte: no clear guess; the file decodes as GB and holds Chinese."""
    (tmp_path / "x").write_bytes(b"\xe9\xe8 ")
    sure = encoding_evidence(spark, str(tmp_path), least=0.0).first()
    unsure = encoding_evidence(spark, str(tmp_path), least=1.1).first()
    assert sure["encoding"] == "latin1" and unsure["encoding"] == "gb18030"


def test_sample_and_empty_folder(spark, tmp_path):
    (tmp_path / "late").write_bytes(b"ascii line\n" * 2000 + CHINESE.encode("gb18030"))
    assert encoding_evidence(spark, str(tmp_path), sample_bytes=1000).first()["encoding"] == "utf-8"
    assert encoding_evidence(spark, str(tmp_path)).first()["encoding"] == "gb18030"
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "none").write_bytes(b"")
    assert encoding_evidence(spark, str(tmp_path / "sub")).count() == 0


@pytest.mark.parametrize("data", [b"", b"abc", "é".encode("latin-1"), CHINESE.encode("gbk")])
def test_sums_count_each_high_byte_once(data):
    e = evidence_of(data)
    assert e["high"] == sum(b >= 0x80 for b in data)
    assert 2 * sum(e["pairs"]) + e["lone"] + e["lone_letter"] == e["high"]
