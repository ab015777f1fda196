"""Views over the driver's tables that stand in for pages, boxes, questions, readers and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Page size of the stand-in pages.
PAGE_W, PAGE_H = 1000, 1300
#: Line items whose pages share a partition: a page becomes dozens of patches, so pages are dealt by number, not by their few bytes.
LINES = 100_000
#: Questions of a task that computes much of each.
QUESTIONS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str) -> int:
    """Partitions over which pages are dealt: one per LINES line items, as many as there are cores at least."""
    return max(table(spark, sf_dir, "lineitem").count() // LINES + 1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """df dealt by its number of rows: Spark joins small partitions by their bytes, which say little of rows that cost much."""
    return df.repartition(max(df.count() // QUESTIONS + 1, df.sparkSession.sparkContext.defaultParallelism))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR boxes: a line item is a box on its order's page, its part's name the text; dealt by page as page_ids() are, so that
    a task's windows do not grow with the table."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("text"))
    line = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).repartition(dealt(spark, sf_dir), "l_orderkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return line.select(
        F.col("l_orderkey").alias("image_id"),
        (F.row_number().over(order) - 1).cast("long").alias("box_id"),
        (F.col("l_partkey") * 37 % 900).alias("x0"),
        (F.col("l_suppkey") * 53 % 1200).alias("y0"),
        (40 + 4 * F.col("l_quantity")).cast("long").alias("w"),
        (12 + 4 * F.col("l_linenumber")).cast("long").alias("h"),
        F.round(1 - F.col("l_discount"), 4).alias("confidence"),
        "text",
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, question, page, gold1, gold2, resize, bm25, learned): user turns, the reply as page, three readers."""
    c = table(spark, sf_dir, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("page"))
    ws = F.filter(F.split(F.regexp_replace("page", r"\s+", " "), " "), lambda t: t != "")
    some = lambda start, n: F.array_join(F.slice("ws", start, n), " ")
    q = u.join(a.hint("merge"), ["conv_id", "turn"]).withColumn("ws", ws)  # texts that repeat are far larger than their files
    return q.select(
        "conv_id", "turn", "question", "page", some(1, 8).alias("gold1"), some(1, 5).alias("gold2"),
        F.when(F.col("conv_id") % 3 == 0, F.concat(some(1, 5), F.lit(" extra"))).otherwise(some(1, 5)).alias("resize"),
        F.when(F.col("conv_id") % 7 == 0, "").otherwise(some(1, 8)).alias("bm25"),
        F.when(F.col("conv_id") % 2 == 0, some(1, 3)).when(F.col("conv_id") % 5 == 0, "unknown 42").otherwise(some(2, 5)).alias("learned"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """questions() in long form: a row per reader, pos its place in the tie order."""
    routes = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(r).alias("route"), F.col(r).alias("pred")) for i, r in enumerate(("resize", "bm25", "learned"))]))
    return questions(spark, sf_dir).withColumn("r", routes).select("conv_id", "turn", "question", "page", "gold1", "gold2", "r.*")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric rows: (method, image_id, row_no, value, budget)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("method"), F.col("user_id").alias("image_id"), F.col("event_id").alias("row_no"), "value", F.get_json_object("props", "$.k").cast("long").alias("budget"))


def page_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, hashed into partitions whose number follows the table, so that what is made of a page stays dealt over tasks."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"))
    return line.repartition(dealt(spark, sf_dir), "image_id").distinct()


def box_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question per page: the page's order priority and a part name chosen by its key."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), "o_orderpriority", (F.col("o_orderkey") % 64 + 1).alias("pk"))
    p = table(spark, sf_dir, "part").where("p_partkey <= 64").select(F.col("p_partkey").alias("pk"), "p_name")
    return o.join(F.broadcast(p), "pk").select("image_id", F.concat(F.lit("What is the total of the "), F.col("p_name"), F.lit(" in "), F.col("o_orderpriority"), F.lit("?")).alias("question"))
