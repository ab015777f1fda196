"""Shared folder tables, distributed connected components and small helpers for the operators here."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the word definitions of the operators use it.
WS = r"\x20\x09-\x0D"
#: A table of at most this many bytes (its count times a row width is checked first) may be broadcast.
BROADCAST_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset and all runs on one machine."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="foliant-")
        sc.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


class Scratch:
    """Tables written to the shared folder: they cut lineage, survive lost executors and can be dropped early."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}

    def table(self, df: DataFrame, name: str = "table") -> DataFrame:
        path = shared_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def small_or_shuffled(side: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """side with a broadcast hint if its counted rows fit the limit, else without one (a shuffled join follows)."""
    return F.broadcast(side) if side.count() * row_bytes <= limit else side


def word_count(text: Column) -> Column:
    """Words, maximal runs without ASCII white space; null has none."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{WS}]++", "")
    return F.length(F.regexp_replace(body, f"[^{WS}]++[{WS}]*+", "x")).cast("long")


def numbered(n: int, width: int) -> int:
    """Blocks of about width rows that n rows need, one at least."""
    return max(1, -(-n // width))


def components(edges: DataFrame, scratch: Scratch, rounds: int = 80) -> DataFrame:
    """Connected components of edges (a, b): node, component (the smallest node that it reaches).

    Alternating large-star and small-star steps over tables in the shared folder: nothing of the graph
    reaches the driver but a row count and a hash sum per round, which tell when stars no longer change.
    Nodes without an edge are not returned. Rounds grow with the logarithm of the longest path.
    """
    kind = edges.schema["a"].dataType
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, seen = scratch.table(e, "edges"), None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.table(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        row = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        scratch.drop(e)
        e = new
        if seen == tuple(row):
            break
        seen = tuple(row)
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    roots = e.select(F.col("v").alias("u"), "v").distinct()
    out = e.unionByName(roots).select(F.col("u").cast(kind).alias("node"), F.col("v").cast(kind).alias("component"))
    return out
