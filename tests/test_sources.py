import pytest
from pyspark.sql import functions as F

from loupe.sources import csv, tables


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.csv").write_bytes("名,值\n中文,1\n数据,2\n".encode("gbk"))
    (tmp_path / "b.csv").write_bytes("名,值\nplain,3\n数据,4\n".encode("utf-8-sig"))
    (tmp_path / "c.csv").write_bytes("name,值\n".encode("utf-8") + "x,5\n".encode())
    (tmp_path / "d.csv").write_bytes("name,city\n1,caf\xe9\n2,\xff\xe9\xa0\n".encode("latin1"))
    (tmp_path / "e.csv").write_bytes("名,值\n㐀𠀀,6\n".encode("gb18030"))
    return str(tmp_path)


def test_detect_encoding(spark, folder):
    found = {r.file.rsplit("/", 1)[1]: r.encoding for r in csv.detect_encoding(spark, folder).collect()}
    assert found == {"a.csv": "gbk", "b.csv": "utf-8", "c.csv": "utf-8", "d.csv": "latin1", "e.csv": "gb18030"}


def test_read_csv_joins_encodings_and_headers(spark, folder):
    df = csv.read_csv(spark, folder)
    assert set(df.columns) == {"名", "值", "name", "city"}
    assert dict(df.dtypes)["值"] == "int"
    got = {(r["名"], r["name"], r["值"], r["city"]) for r in df.collect()}
    assert ("中文", None, 1, None) in got and ("数据", None, 4, None) in got and ("㐀𠀀", None, 6, None) in got
    assert (None, "x", 5, None) in got
    assert (None, "1", None, "café") in got
    assert len(got) == 8


def test_written_copies_keep_the_original(spark, tmp_path):
    df = spark.range(5)
    path = tables.write_cleaned(df, str(tmp_path), "numbers", "csv")
    assert "/cleaned_numbers_" in path and spark.read.csv(path, header=True).count() == 5
    copy = tables.materialise(df, str(tmp_path / "copy"))
    assert copy.count() == 5
    with pytest.raises(Exception):
        tables.materialise(df, str(tmp_path / "copy"))


def test_size_needs_no_contents(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"0" * 3 * 1024 * 1024)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "y.bin").write_bytes(b"0" * 1024 * 1024)
    assert tuple(tables.size_mb(spark, str(tmp_path)).first()) == (2, 4.0)


def test_only_the_first_line_is_the_header(spark, tmp_path):
    (tmp_path / "g.csv").write_bytes("名,值\n中文,1\n名,值\n数据,2\n".encode("gbk"))
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "h.csv").write_bytes("name,n\nx,1\nname,n\ny,2\n".encode())
    gbk = csv.read_csv(spark, str(tmp_path / "g.csv"))
    assert [tuple(r) for r in gbk.collect()] == [("中文", "1"), ("名", "值"), ("数据", "2")]
    plain = csv.read_csv(spark, str(tmp_path / "u"))
    assert [tuple(r) for r in plain.collect()] == [("x", "1"), ("name", "n"), ("y", "2")]
