"""The text formats as data sources: splits, filters, columns, odd lines."""

import datetime
import decimal
import gzip

import pytest
from pyspark.sql import types as T
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, IsNull, LessThan

from millrace.sources import text_formats, text_source
from millrace.sources.text_source import TextReader

DDL = "a int, b string, c array<string>, m map<string,int>, s struct<x:bigint,y:array<int>>, d double, t date, n decimal(5,2), f boolean"


@pytest.fixture(scope="module")
def schema(spark):
    return T.StructType.fromDDL(DDL)


@pytest.fixture
def folder(tmp_path):
    lines = [f"{i}\x01n{i % 7}\x01x\x02y{i}\x01k\x03{i}\x01{i}\x021\x032\x01{i / 4}\x012024-01-{i % 28 + 1:02}\x01{i}.125\x01true" for i in range(600)]
    (tmp_path / "part-1").write_text("\n".join(lines[:300]) + "\n")
    (tmp_path / "part-2").write_text("\n".join(lines[300:]))  # no break at the end
    (tmp_path / "_SUCCESS").write_text("no data")
    (tmp_path / ".part.crc").write_text("no data")
    return tmp_path


def rows_of(reader):
    return [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]


@pytest.mark.parametrize("split", [1, 7, 64, 1000, 10**9])
def test_every_line_is_read_once(schema, folder, split):
    got = rows_of(TextReader(schema, {"path": str(folder), "split_bytes": str(split)}))
    assert sorted(r["a"] for r in got) == list(range(600))
    one = next(r for r in got if r["a"] == 417)
    assert one["c"] == ["x", "y417"] and one["m"] == [("k", 417)] and one["s"] == {"x": 417, "y": [1, 2]}
    assert one["d"] == 104.25 and one["t"] == datetime.date(2024, 1, 26) and one["f"] is True


def test_filters_are_applied_by_the_reader(schema, folder):
    reader = TextReader(schema, {"path": str(folder), "columns": "a,b"})
    pushed = [GreaterThan(("a",), 100), In(("b",), ("n1", "n2")), IsNotNull(("b",))]
    left = [IsNull(("c",)), EqualTo(("s", "x"), 1), GreaterThan(("d",), 1.0), LessThan(("n",), decimal.Decimal(1))]
    assert list(reader.pushFilters([*pushed, *left])) == left  # nested, not wanted or left to Spark
    got = rows_of(reader)
    assert {r["a"] for r in got} == {i for i in range(101, 600) if i % 7 in (1, 2)}
    assert all(r["c"] is None and r["d"] is None for r in got)  # columns that nobody asked for stay unparsed


def test_spark_hands_its_filters_over(spark, folder, capfd):
    t = text_source.create_text_table(spark, "text_rows", "a int, b string, c array<string>", str(folder), split_bytes="500")
    kept = t.where("a >= 590 AND b LIKE 'n%'")
    kept.explain()
    plan = capfd.readouterr().out
    assert "BatchScan" in plan and "Filter (" not in plan  # nothing is left for Spark to test
    assert sorted(r["a"] for r in kept.collect()) == list(range(590, 600))
    assert t.where("size(c) = 2 AND a < 3").count() == 3
    assert spark.sql("SELECT count(*) AS n FROM text_rows WHERE a IS NULL").first()["n"] == 0


def test_odd_lines(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"1\x01a\x01more\x01than\x01asked\n\n\\N\x01\\N\nnone\x01\xff\n99999999999\x01b\r\n-7\n 8 \x01c")
    t = text_source.create_text_table(spark, "odd_rows", "a int, b string", str(tmp_path / "x"))
    assert [tuple(r) for r in t.collect()] == [(1, "a"), (None, None), (None, None), (None, "�"), (None, "b"), (-7, None), (8, "c")]
    lines = spark.read.text(str(tmp_path / "x"))
    same = text_formats.parse_delimited(lines, "a int, b string")
    assert [r["a"] for r in same.collect()] == [r["a"] for r in t.collect()]


def test_empty_and_compressed(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert text_source.create_text_table(spark, "no_rows", "a int", str(tmp_path / "empty")).count() == 0
    with gzip.open(tmp_path / "z.gz", "wt") as f:
        f.write("".join(f"{i}|{i * i}\n" for i in range(5000)))
    t = text_source.create_text_table(spark, "squares", "a int, b bigint", str(tmp_path / "z.gz"), field="|", split_bytes="100")
    assert t.where("a >= 10").selectExpr("count(*)", "sum(b - a * a)").first()[:] == (4990, 0)


def test_regex_text(spark, tmp_path):
    (tmp_path / "log").write_text("GET /a 200\nPUT /b 404\nnothing\nGET /c' 500\n")
    t = text_source.create_text_table(spark, "log_lines", "verb string, path string, code string", str(tmp_path / "log"), "regex_text", pattern=r"(\w+) (/\S*) (\d+)")
    assert [tuple(r) for r in t.where("code > '300' AND verb = 'GET'").collect()] == [("GET", "/c'", "500")]
    assert t.where("verb IS NULL").count() == 1
    with pytest.raises(Exception, match="pattern"):
        text_source.create_text_table(spark, "bad_lines", "a string", str(tmp_path), "regex_text").collect()
    with pytest.raises(Exception, match="strings"):
        text_source.create_text_table(spark, "bad_lines", "a int", str(tmp_path), "regex_text", pattern="(.)").collect()
