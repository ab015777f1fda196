"""What is shuffled, by the plan."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliant.llm import mixing, simhash


def shuffles_of_text(df):
    """Exchanges that carry the column text."""
    run, found = df._jdf.queryExecution(), []

    def walk(p):
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(p.initialPlan())
        if kind == "ShuffleExchangeExec":
            found.append("text#" in p.output().toString())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(run.executedPlan())
    return sum(found)


def docs(spark, n=200):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.sha2(F.col("id").cast("string"), 256)).alias("text"), F.lit("en").alias("lang"), (F.col("id") % 3).cast("string").alias("source"), F.lit(9).alias("n_chars"))


def test_texts_are_not_shuffled_to_be_mixed(spark):
    assert shuffles_of_text(mixing.apply_mix(mixing.mix_sources(mixing.documents_to_mix(docs(spark))))) == 0


def test_texts_are_shuffled_once_for_near_copies(spark):
    """Few or many, so that what a small table takes tells what a large one does."""
    assert shuffles_of_text(simhash.keep_one(docs(spark))) == 1


@pytest.mark.parametrize("sizes", [[5] * 7, [0, 0, 5, 5, 5, 1], [0, 0]])
def test_equal_rows_at_the_cut(spark, sizes):
    """Rows that tie in key and size share what is left at the cut, and add up to the budget."""
    rows = [("a", n, 77) for n in sizes] + [("b", 3, i) for i in range(40)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "source string, size long, key long"), weights=(1, 3)).collect()
    assert Counter((r["source"], r["size"]) for r in out) == Counter((s, n) for s, n, _ in rows)
    for s in "ab":
        own = [r for r in out if r["source"] == s]
        assert sum(r["taken"] for r in own) == int(own[0]["target"] + 0.5)
        assert sum(0 < r["taken"] % r["size"] for r in own if r["size"]) <= 1
