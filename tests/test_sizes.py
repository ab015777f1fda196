"""What a plan gathers or leaves to one task, seen on small tables with limits as small."""

import pytest

from foliant.plans import catalogue
from foliant.sources import views as V


def broadcast_rows(df):
    """Rows of the broadcasts that ran."""
    run = df._jdf.queryExecution()
    run.toRdd().count()
    found = []

    def walk(p):
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(p.plan())
        if kind == "BroadcastExchangeExec":
            found.append(p.metrics().apply("numOutputRows").value())
        children = p.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(run.executedPlan())
    return found


@pytest.mark.parametrize("name", ["q32_weak_labels", "q19_patch_text", "q192_patch_features"])
def test_patches_are_not_broadcast(spark, sf_dir, name):
    """35,000 patches, which Spark takes for the few bytes of their pages."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200k")
    try:
        assert max(broadcast_rows(catalogue.QUERIES[name](spark, sf_dir)), default=0) < 10_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pages_are_dealt_by_number(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(V, "LINES", 1000)
    per = V.page_ids(spark, sf_dir).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(per) == 7 and max(per) < 2 * sum(per) / len(per)


@pytest.mark.parametrize("name", ["q51b_rule_table", "q26_mmr", "q25_nms", "q16_grid_patches"])
def test_arrays_are_computed_once(spark, sf_dir, name):
    """No filter or join tests the size of an array that its explode computes again."""
    plan, found = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan(), []

    def walk(p):
        if p.getClass().getSimpleName() in ("Filter", "Join"):
            found.append(p.simpleString(10_000))
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(plan)
    assert not any("lambda" in x for x in found)


def joins(df):
    """Joins of the optimized plan."""
    walk = lambda p: (p.getClass().getSimpleName() == "Join") + sum(walk(p.children().apply(i)) for i in range(p.children().size()))
    return walk(df._jdf.queryExecution().optimizedPlan())


def lambdas(plan):
    """Bodies of the lambda functions in a plan's text."""
    at = plan.find("lambdafunction(")
    while at >= 0:
        depth, i = 1, at + len("lambdafunction(")
        while depth and i < len(plan):
            depth += {"(": 1, ")": -1}.get(plan[i], 0)
            i += 1
        yield plan[at:i]
        at = plan.find("lambdafunction(", at + 1)


@pytest.mark.parametrize("text", ["token_overlap", "bm25_degenerate", "substring_overlap"])
def test_texts_are_normalised_once(spark, text):
    """What a lambda names from outside is computed anew for each word, so no pattern runs inside one."""
    from pyspark.sql import functions as F

    from foliant.functions import text as T

    df = spark.createDataFrame([("What is the total?", "a total of 3")], "q string, t string")
    plan = df.select(getattr(T, text)(F.col("q"), F.col("t")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert not [b for b in lambdas(plan) if "regexp_replace" in b]


def test_pairs_are_computed_once(spark, sf_dir):
    """The best pair is no condition as well, and its candidates are not ordered inside a lambda."""
    plan = catalogue.QUERIES["q26c_best_pair"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array(") + plan.count("array_sort(") <= 2


def test_suppression_ends_with_the_last_pick(spark):
    """Those behind the first k are not compared: a rectangle whose size is no number would fail there under ANSI rules."""
    from pyspark.sql import functions as F

    from foliant.operators import selection as Sel

    rows = [(1, i, 100 * i, 0, 50, 50, 1.0 - i / 10) for i in range(3)] + [(1, 3, 2**62, 0, 2**62, 2**62, 0.0)]
    df = spark.createDataFrame(rows, "image_id long, idx long, x long, y long, w long, h long, score double")
    kept = Sel.candidates(df, ["image_id"]).select(F.transform(Sel.suppress(F.col("c"), 0.5, 2), lambda x: x["idx"])).first()[0]
    assert kept == [0, 1]


def test_boxes_are_dealt_by_number(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(V, "LINES", 1000)
    assert V.boxes(spark, sf_dir).rdd.getNumPartitions() == 7


def test_scores_need_no_join_of_all_patches(spark, sf_dir):
    """Boxes with parts and boxes with cells are joined, patches with sums are not."""
    from foliant.plans.spatial_queries import scored

    assert joins(scored(spark, sf_dir)) == 2


def test_patches_meet_boxes_once(spark, sf_dir):
    """Neighbours and boxes meet the patches in one join, and come back in one; apart they made two joins more."""
    assert joins(catalogue.QUERIES["q22_graph_features"](spark, sf_dir)) <= 28


@pytest.mark.parametrize("name", ["q184_table_pair_selector", "q120_packed_results", "q161_selector_registry", "q181_node_evidence", "q186_entity_row_selector", "q185_entity_evidence"])
def test_plans_stay_small(spark, sf_dir, monkeypatch, name):
    """A step that several others read stands in one plan only: the driver holds every node of a plan, whatever the rows are."""
    from foliant.sources.tables import Stored

    plans, table = [], Stored.table
    leaves = lambda p: sum(leaves(p.children().apply(i)) for i in range(p.children().size())) or 1
    monkeypatch.setattr(Stored, "table", lambda self, df, name: plans.append(df) or table(self, df, name))
    plans.append(catalogue.QUERIES[name](spark, sf_dir))
    assert max(leaves(df._jdf.queryExecution().optimizedPlan()) for df in plans) <= 24
