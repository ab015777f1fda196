import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.sources import datasource as Ds


@pytest.fixture
def folder(spark, tmp_path):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("k"), F.concat(F.lit("t"), "id").alias("text"))
    df.repartition(6, "id").write.parquet(f"{tmp_path}/pages")
    return f"{tmp_path}/pages", {(r["id"], r["k"], r["text"]) for r in df.collect()}


def test_pages_are_partitions(spark, folder):
    path, rows = folder
    Ds.register_paged(spark, "folder_pages", Ds.FolderClient)
    df = spark.read.format("folder_pages").option("path", path).load()
    assert df.dtypes == [("id", "bigint"), ("k", "bigint"), ("text", "string")]
    assert df.rdd.getNumPartitions() == 6 and {tuple(r) for r in df.collect()} == rows
    two = spark.read.format("folder_pages").option("path", path).option("pagesPerPartition", 4).load()
    assert two.rdd.getNumPartitions() == 2 and two.count() == 1000


def test_filters_go_to_the_client(spark, folder, tmp_path):
    path, rows = folder
    seen = f"{tmp_path}/seen"
    os.makedirs(seen)

    class Spied(Ds.FolderClient):
        def page(self, number, filters):
            found = super().page(number, filters)
            with open(f"{seen}/{number}", "w") as f:
                f.write(f"{len(filters)} {found.num_rows}")
            return found

    Ds.register_paged(spark, "spied_pages", Spied)
    df = spark.read.format("spied_pages").option("path", path).option("filterable", "k").load()
    got = {tuple(r) for r in df.where("k = 3 and text <> 't3' and id < 500").collect()}
    assert got == {r for r in rows if r[1] == 3 and r[2] != "t3" and r[0] < 500}
    notes = [open(f"{seen}/{n}").read().split() for n in os.listdir(seen)]
    assert len(notes) == 6 and all(int(n) >= 1 for n, _ in notes) and sum(int(r) for _, r in notes) == sum(r[1] == 3 for r in rows)


def test_failing_pages_are_asked_again(spark, folder, tmp_path):
    path, rows = folder
    marks = f"{tmp_path}/marks"
    os.makedirs(marks)

    class Shaky(Ds.FolderClient):
        def page(self, number, filters):
            n = len([m for m in os.listdir(marks) if m.startswith(f"{number}-")])
            open(f"{marks}/{number}-{n}", "w").close()
            if n < 2:
                raise OSError("try again")
            return super().page(number, filters)

    Ds.register_paged(spark, "shaky_pages", Shaky)
    load = lambda tries: spark.read.format("shaky_pages").option("path", path).option("pause", 0.01).option("tries", tries).load()
    with pytest.raises(Exception, match="try again"):
        load(1).collect()
    for m in os.listdir(marks):
        os.remove(f"{marks}/{m}")
    assert {tuple(r) for r in load(3).collect()} == rows


def test_a_failed_write_leaves_nothing_and_a_rerun_adds_nothing(spark, tmp_path):
    path, flag = f"{tmp_path}/table", f"{tmp_path}/fail"
    open(flag, "w").close()

    def shaky(batches):
        for b in batches:
            if os.path.exists(flag) and b.num_rows and pa.compute.max(b.column(0)).as_py() == 99:
                raise RuntimeError("lost")
            yield b

    df = spark.range(100).repartition(4, "id").mapInArrow(shaky, "id long")
    with pytest.raises(Exception, match="lost"):
        Ds.write_run(df, path, "a")
    left = [os.path.join(d, n) for d, _, names in os.walk(path) for n in names]
    assert left == [] and Ds.read_runs(spark, path, "id long").count() == 0
    os.remove(flag)
    for _ in range(2):  # the second time adds nothing
        Ds.write_run(df, path, "a")
        assert sorted(r["id"] for r in Ds.read_runs(spark, path, "id long").collect()) == list(range(100))
    Ds.write_run(spark.range(5), path, "b")
    Ds.write_run(spark.range(0), path, "none")
    assert {r["run"]: r["count"] for r in Ds.read_runs(spark, path, "id long").groupBy("run").count().collect()} == {"a": 100, "b": 5}


def test_attempts_that_do_not_count_leave_nothing(spark, tmp_path):
    """A task's first attempt writes its file and fails afterwards; only the second attempt's file is committed."""
    sink = Ds._Sink(f"{tmp_path}/t", "r")
    files, staging, target, marker = sink._files()
    files.create_dir(staging, recursive=True)
    for name in ("part-00000-1.parquet", "part-00000-2.parquet"):
        pa.parquet.write_table(pa.table({"id": [1, 2, 3]}), f"{staging}/{name}")
    sink.commit([Ds._Written("part-00000-2.parquet", 3), None])
    assert os.listdir(target) == ["part-00000-2.parquet"] and not os.path.exists(staging) and os.path.exists(marker)
    assert Ds.read_runs(spark, f"{tmp_path}/t", "id long").count() == 3
