"""Evaluations from end to end as functions over tables, and runs of named steps."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import joins as J
from .operators import metrics as M


def ocr_evaluation(predictions: DataFrame, allowed: Sequence[tuple[str, str]], done: DataFrame | None = None) -> DataFrame:
    """A row per sample, method and budget of predictions (id, method, prediction, truth): text scores, or not_applicable.

    allowed lists the pairs of method and budget that make sense, the others are marked and not scored. done (id, method) are rows
    of an earlier run, which are skipped. Budgets are a literal list, so their product with the samples has a fixed factor.
    """
    x = predictions if done is None else predictions.join(done.select("id", "method").distinct(), ["id", "method"], "left_anti")
    p, t = T.tokens(F.col("prediction")), F.col("truth")
    x = x.withColumn("_s", F.struct(
        T.cer(F.col("prediction"), t).alias("cer"), T.wer(F.col("prediction"), t).alias("wer"), T.word_recall(F.col("prediction"), t).alias("word_recall"), T.word_precision(F.col("prediction"), t).alias("word_precision"),
        F.size(p).cast("long").alias("predicted_token_count"), T.duplicate_ratio(p).alias("duplicate_token_ratio"), (F.trim("prediction") != "").alias("ocr_nonempty"),
    ))
    x = x.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in sorted({b for _, b in allowed})])))
    known = F.concat_ws("|", "method", "budget").isin(*["|".join(a) for a in allowed])
    scores = ["cer", "wer", "word_recall", "word_precision", "predicted_token_count", "duplicate_token_ratio", "ocr_nonempty"]
    x = x.select("id", "method", "budget", (~known).alias("not_applicable"), *[F.when(known, F.col(f"_s.{c}")).alias(c) for c in scores])
    return x.withColumn("word_f1", T.f1(F.col("word_precision"), F.col("word_recall")))


def answer_evaluation(answers: DataFrame) -> DataFrame:
    """answers (method, answers, raw or prediction) with the parsed prediction, exact match and ANLS; a missing one scores 0."""
    x = answers if "prediction" in answers.columns else answers.withColumn("prediction", T.parse_answer(F.col("raw")))
    x = x.withColumn("prediction", F.coalesce("prediction", F.lit("")))
    return x.withColumn("exact_match", T.exact_match(F.col("prediction"), F.col("answers"))).withColumn("anls", T.anls(F.col("prediction"), F.col("answers")))


def coverage_evaluation(labels: DataFrame, scores: dict[str, Column], by: list[str], position: str, ks: Sequence[int]) -> DataFrame:
    """A row per method (a score over labels with strict and soft): share of questions whose first k hold evidence, by tier, the mean
    rank of the first evidence where there is any, and the mean reciprocal rank."""
    x = labels.withColumn("_m", F.explode(F.array(*[F.struct(F.lit(n).alias("method"), c.alias("own")) for n, c in scores.items()]))).select(*by, position, "strict", "soft", "_m.*")
    r = M.ranked(x, ["method", *by], "own", position)
    any_ = F.col("strict") | F.col("soft")
    hit = lambda c, k: F.bool_or(c & (F.col("rank") <= k)).cast("int").cast("double")
    q = r.groupBy("method", *by).agg(*[hit(c, k).alias(f"{n}{k}") for k in ks for n, c in (("strict", F.col("strict")), ("any", any_))], F.min(F.when(any_, F.col("rank"))).cast("double").alias("first"))
    return q.groupBy("method").agg(F.count("*").alias("n"), *[F.avg(f"{n}{k}").alias(f"coverage_at_{k}_{n}") for k in ks for n in ("strict", "any")], F.round(F.avg("first"), 6).alias("mean_first_rank"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def bootstrap_report(rows: DataFrame, comparisons: Sequence[tuple[str, str]], key: str, value: str, at_least: float | None = None) -> DataFrame:
    """(comparison, mean, n, low, high, significant) of paired differences of methods: significant if the lower end is above 0, or
    reaches at_least where that is given."""
    out = None
    for a, b in comparisons:
        one = J.paired(rows.where(F.col("method") == a), rows.where(F.col("method") == b), [key], value).select(F.lit(f"{a}_vs_{b}").alias("comparison"), key, "diff")
        out = one if out is None else out.unionByName(one)
    x = M.bootstrap(out, ["comparison"], "diff", key)
    return x.withColumn("significant", F.col("low") > 0 if at_least is None else F.col("low") >= at_least)


def run_steps(spark: SparkSession, steps: Sequence[tuple[str, Callable[[SparkSession], object]]], tries: int = 1, pause: float = 0.0) -> DataFrame:
    """(place, step, status, error, result) of steps run in order, each up to `tries` times with a pause in seconds that doubles; after
    one that fails none is run. A step that returns a whole number has it as result."""
    rows, failed = [], False
    for i, (name, step) in enumerate(steps, 1):
        status, error, result = ("not run", None, None) if failed else ("failed", None, None)
        for k in range(0 if failed else tries):
            try:
                found = step(spark)
                status, error, result = "done", None, found if isinstance(found, int) and not isinstance(found, bool) else None
                break
            except Exception as e:  # the report tells it
                error = f"{type(e).__name__}: {str(e)[:200]}"
                if k < tries - 1:
                    time.sleep(pause * 2**k)
        failed = failed or status == "failed"
        rows.append((i, name, status, error, result))
    return spark.createDataFrame(rows, "place int, step string, status string, error string, result long")


def main(args: Sequence[str]) -> int:
    """python -m foliant.pipelines FOLDER QUERY...: runs queries of the catalogue over a folder of tables as steps."""
    from .plans import catalogue

    spark = SparkSession.builder.getOrCreate()
    folder, names = args[0], args[1:] or sorted(catalogue.QUERIES)
    report = run_steps(spark, [(n, lambda s, n=n: catalogue.QUERIES[n](s, folder).write.format("noop").mode("overwrite").save()) for n in names])
    report.show(len(names), truncate=False)
    return int(report.where("status <> 'done'").limit(1).count())


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
