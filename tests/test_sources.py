import pytest
from pyspark.sql import functions as F

from foliant.operators import models as Mo
from foliant.sources import tables as Tb
from foliant.streaming import replay as St


def test_read_manifest(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    p.write_text('{"image_id": "a", "answer": ["x", "y"], "answer_type": "span"}\n\n{"image_id": "b", "answer": "z"}\n')
    got = {r["image_id"]: r for r in Tb.read_manifest(spark, str(p)).collect()}
    assert got["a"]["answer"] == ["x", "y"] and got["a"]["answer_type"] == ["span"] and got["b"]["answer"] == ["z"]


def test_check_manifest(spark):
    ok = '{"image_id": "a", "dataset": "d", "split": "val", "image_path": "a.png"}'
    lines = spark.createDataFrame([(1, ok), (2, ""), (3, ok), (4, "{"), (5, '{"image_id": "b"}')], "line int, value string")
    files = spark.createDataFrame([("b.png",)], "path string")
    got = {(r["line"], r["error"]) for r in Tb.check_manifest(lines, files).collect()}
    assert (4, "unreadable") in got and (3, "repeated image_id") in got and (5, "missing split") in got and (1, "missing file") in got


def test_cache_and_sinks(spark, tmp_path):
    boxes = spark.createDataFrame([("a", "e", 0, [[1.9, 2.2]], None, 0.5)], "image_id string, engine string, box_id int, box array<array<double>>, text string, confidence double")
    Tb.cache_boxes(boxes, str(tmp_path / "c"))
    back = spark.read.parquet(str(tmp_path / "c"))
    assert back.first()["box"] == [[1, 2]] and back.first()["text"] == ""
    items = spark.createDataFrame([("a",), ("b",)], "image_id string")
    assert [r[0] for r in Tb.cache_misses(items, back, "e").collect()] == ["b"]
    Tb.write_rows(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "t"))
    with pytest.raises(Exception, match="exist"):
        Tb.write_rows(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "t"))
    Tb.write_rows(spark.createDataFrame([(2, 0.5)], "a int, c double"), str(tmp_path / "t"), "append")
    assert sorted(Tb.read_rows(spark, str(tmp_path / "t")).columns) == ["a", "b", "c"]


def test_boxes_survive_a_bad_image(spark):
    def make():
        def read(content):
            if not content:
                raise ValueError("empty")
            return [([[0, 0], [1, 0], [1, 1], [0, 1]], "t", 1.0)]

        return read

    Mo.register_engine("test", make)
    images = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b""))], "image_id string, content binary")
    got = {r["image_id"]: (r["text"], r["error"]) for r in Mo.read_boxes(images, "test").collect()}
    assert got == {"a": ("t", None), "b": (None, "ValueError: empty")}


def test_stream_resumes(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    row = lambda i: (i, None, i % 2, "click", float(i), "{}")
    spark.createDataFrame([row(i) for i in range(4)], St.EVENTS).write.parquet(src)
    for _ in range(2):
        St.run_resumable(St.event_stream(spark, src), lambda b: b.select("event_id"), "event_id", out, check)
    spark.createDataFrame([row(9)], St.EVENTS).write.mode("append").parquet(src)
    St.run_resumable(St.event_stream(spark, src), lambda b: b.select("event_id"), "event_id", out, check)
    assert sorted(r[0] for r in spark.read.parquet(out).select("event_id").collect()) == [0, 1, 2, 3, 9]


def test_pool_hash(spark):
    df = spark.createDataFrame([("q", [1])], "q string, p array<int>")
    assert len(df.select(Tb.pool_hash(F.col("q"), F.col("p"))).first()[0]) == 16
