"""Typed readers, validation, caches and sinks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

_TEXTS = Ty.ArrayType(Ty.StringType())
MANIFEST = Ty.StructType([Ty.StructField(n, _TEXTS if n in ("answer", "answer_type") else Ty.StringType()) for n in ("image_id", "dataset", "split", "image_path", "ocr_gt_text", "question", "answer", "answer_type", "metadata")])
#: Fields that every manifest row must have.
REQUIRED = ("image_id", "dataset", "split", "image_path")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder path under spark.checkpoint.dir; under a temporary one only where that is unset and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="foliant-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


class Stored:
    """Tables in work folders: they cut lineage, survive lost executors and can be dropped before the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = work_folder(self.spark, name)
        df.write.parquet(path)
        p, out = self._path(path), self.spark.read.schema(df.schema).parquet(path)
        p[0].deleteOnExit(p[1])
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, df: DataFrame) -> None:
        files, p = self._path(self.paths.pop(id(df))[1])
        files.delete(p, True)

    def _path(self, path: str) -> tuple:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own: a plan that repeats a long step for each of its readers outgrows the driver, whatever the
    rows are. Hinted, as its files are far smaller than its rows and Spark would broadcast them by the files' size."""
    return Stored(df.sparkSession).table(df, name).hint("merge")


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a fixed schema; a missing file has no rows."""
    return spark.read.schema(schema).option("header", True).csv(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def first_existing(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """Rows of the first of the paths that exists, with a fixed schema; none has no rows."""
    for p in paths:
        if path_exists(spark, p):
            return spark.read.schema(schema).parquet(p)
    return spark.createDataFrame([], schema)


def probed(c: Column, names: Sequence[str]) -> Column:
    """The first filled of several fields of a JSON text, as remote data sets name them differently; lists give their first item."""
    one = lambda n: F.coalesce(F.get_json_object(c, f"$.{n}[0]"), F.get_json_object(c, f"$.{n}"))
    return F.coalesce(*[F.nullif(one(n), F.lit("")) for n in names])


def answers_of(c: Column, depth: int = 3) -> Column:
    """Answers in a JSON text (a value, lists, texts that are lists themselves in JSON or with single quotes), flattened up to
    `depth` levels, blanks and repeats dropped, in first-seen order."""
    def opened(x: Column) -> Column:
        t = F.trim(x)
        listed = F.coalesce(F.from_json(t, "array<string>"), F.from_json(F.translate(t, "'", '"'), "array<string>"))
        return F.when(F.startswith(t, F.lit("[")) & F.endswith(t, F.lit("]")) & listed.isNotNull(), listed).otherwise(F.array(t))

    out = F.array(F.coalesce(c, F.lit("")))
    for _ in range(depth):
        out = F.flatten(F.transform(out, opened))
    plain = F.transform(out, lambda x: F.trim(F.regexp_replace(x, '^"|"$', "")))
    return F.array_distinct(F.filter(plain, lambda x: F.coalesce(x, F.lit("")) != ""))


def as_list(c: Column) -> Column:
    """A JSON text that holds a list or a single value as an array of strings."""
    return F.when(F.startswith(F.trim(c), F.lit("[")), F.from_json(c, "array<string>")).when(c.isNull(), F.lit(None).cast("array<string>")).otherwise(F.array(F.regexp_replace(c, '^"|"$', "")))


def read_manifest(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """JSON lines with the manifest's schema; scalar answers become one-element lists; blank lines are skipped."""
    loose = Ty.StructType([Ty.StructField(f.name, Ty.StringType()) for f in MANIFEST.fields])
    raw = spark.read.schema(loose).option("mode", mode).json(path)
    return raw.select(*[as_list(F.col(f.name)).alias(f.name) if isinstance(f.dataType, Ty.ArrayType) else F.col(f.name) for f in MANIFEST.fields])


def check_manifest(lines: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(line, image_id, error) of lines (line, value): unreadable JSON, missing fields, repeated ids, missing files.

    Blank lines are skipped but counted; nothing is raised. files (path) lists what exists; without it files are not checked.
    """
    some = lines.where(F.trim("value") != "").withColumn("j", F.try_parse_json("value"))
    bad = some.where(F.col("j").isNull()).select("line", F.lit(None).cast("string").alias("image_id"), F.lit("unreadable").alias("error"))
    rows = some.where(F.col("j").isNotNull()).select("line", F.try_variant_get("j", "$.image_id", "string").alias("image_id"), F.try_variant_get("j", "$.image_path", "string").alias("image_path"), *[F.try_variant_get("j", f"$.{k}", "string").isNull().alias(f"no_{k}") for k in REQUIRED])
    gone = rows.select("line", "image_id", F.explode(F.array_compact(F.array(*[F.when(F.col(f"no_{k}"), f"missing {k}") for k in REQUIRED]))).alias("error"))
    w = Window.partitionBy("image_id").orderBy("line")
    again = rows.where("image_id is not null").withColumn("_r", F.row_number().over(w)).where("_r > 1").select("line", "image_id", F.lit("repeated image_id").alias("error"))
    out = bad.unionByName(gone).unionByName(again)
    if files is not None:
        absent = rows.where("image_path is not null").join(files.select(F.col("path").alias("image_path")).distinct(), "image_path", "left_anti")
        out = out.unionByName(absent.select("line", "image_id", F.lit("missing file").alias("error")))
    return out


def join_annotations(imgs: DataFrame, anns: DataFrame) -> DataFrame:
    """(image_id, ocr_gt_text) of imgs (image_id, ids) and anns (id, text): texts joined by blanks in list order, none: empty."""
    x = imgs.select("image_id", F.posexplode_outer("ids").alias("pos", "id")).join(anns, "id", "left")
    g = x.groupBy("image_id").agg(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("pos", "text")))).alias("t"))
    return g.select("image_id", F.array_join(F.col("t.text"), " ").alias("ocr_gt_text"))


def audit(df: DataFrame, key: str, present: Column) -> DataFrame:
    """Rows, distinct keys, repeats and the share of missing files of a dataset; it passes at 1 % missing and no repeats."""
    n = F.count("*")
    x = df.agg(n.alias("total"), F.countDistinct(key).alias("distinct_ids"), (n - F.countDistinct(key)).alias("duplicates"), F.count_if(~present).alias("missing"))
    share = F.when(F.col("total") > 0, F.col("missing") / F.col("total")).otherwise(0.0)
    return x.withColumn("missing_rate", share).withColumn("passed", (share <= 0.01) & (F.col("duplicates") == 0))


def write_rows(df: DataFrame, path: str, mode: str = "errorifexists", fmt: str = "parquet") -> None:
    """Writes rows as a table; append widens an existing table's columns by name (the reader merges them)."""
    if fmt == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        df.write.mode(mode).option("header", True).format(fmt).save(path)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def cache_boxes(boxes: DataFrame, path: str) -> None:
    """The box cache: a table by engine, coordinates cut to whole pixels, confidence double, missing text empty."""
    cut = F.transform("box", lambda p: F.transform(p, lambda v: v.cast("int")))
    boxes.select("image_id", "engine", "box_id", cut.alias("box"), F.coalesce("text", F.lit("")).alias("text"), F.col("confidence").cast("double").alias("confidence")).write.mode("append").partitionBy("engine").parquet(path)


def cache_misses(items: DataFrame, cached: DataFrame, engine: str) -> DataFrame:
    return items.join(cached.where(F.col("engine") == engine).select("image_id").distinct(), "image_id", "left_anti")


def cache_texts(texts: DataFrame, path: str) -> None:
    """The cache of texts read from selected patches: (image_id, method, k) with an array of texts, by method."""
    texts.select("image_id", "method", F.col("k").cast("int").alias("k"), "texts").write.mode("append").partitionBy("method").parquet(path)


def cached_texts(items: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """items (image_id, method, k) with the texts that the cache holds, and the items that it lacks."""
    keys = ["image_id", "method", "k"]
    own = cached.select(*keys, "texts")
    return items.join(own, keys), items.join(own.select(*keys), keys, "left_anti")


def newest(spark: SparkSession, pattern: str, fmt: str = "parquet") -> DataFrame:
    """Rows of the newest file that matches (ties: the last by name)."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    row = files.orderBy(F.col("modificationTime").desc(), F.col("path").desc()).limit(1).collect()
    if not row:
        raise FileNotFoundError(pattern)
    return spark.read.format(fmt).load(row[0]["path"])


def partition_suffix(method: Column, k: Column) -> Column:
    """single for full-page readers, k0 for the overview, else k and the number."""
    return F.when(method.isin("original", "resize", "jpeg", "webp"), "single").when(method == "overview_only", "k0").otherwise(F.concat(F.lit("k"), k.cast("string")))


def pool_hash(question: Column, patches: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a pool's canonical JSON: the question's first 32 characters and the rectangles."""
    return F.substring(F.sha2(F.to_json(F.struct(patches.alias("patches"), F.substring(question, 1, 32).alias("question"))), 256), 1, 16)


def clean_id(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_")


def shortened(c: Column, width: int) -> Column:
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 1), F.lit("…"))).otherwise(c)
