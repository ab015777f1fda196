"""Steps that shuffled rows per draw or per patch: what they give, by brute force, and that they no longer make such rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import metrics as M
from foliant.operators import scores as Sc
from foliant.operators import spatial as Sp
from foliant.plans import catalogue


def exchanges(df):
    """Texts of the plan's exchanges."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return [x.strip() for x in plan.split("\n") if "Exchange " in x]


def test_bootstrap_makes_no_row_per_draw(spark):
    """Draws are looked up where they are made; groups of different sizes, a null value and a null group."""
    rows = [("a", i, i / 7) for i in range(23)] + [("b", i, -i / 3 if i else None) for i in range(5)] + [(None, 1, 2.0)]
    df = spark.createDataFrame(rows, "rule string, id long, v double")
    out = M.bootstrap(df, ["rule"], "v", "id", boots=20)
    assert "Generate explode(sequence(0, 19" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["rule"]: r for r in out.collect()}
    assert set(got) == {"a", "b"}  # the group's ends are joined by its name
    for rule in got:
        v, means = [x for r, _, x in rows if r == rule], []
        for b in range(20):
            drawn = [v[int(hashlib.md5(f"42:{rule}:{b}:{j}".encode()).hexdigest()[:8], 16) % len(v)] for j in range(len(v))]
            means.append(np.mean([x for x in drawn if x is not None]))
        assert [got[rule][c] for c in ("low", "high")] == pytest.approx(list(np.quantile(means, [0.025, 0.975])))
        assert got[rule]["n"] == len(v) and got[rule]["mean"] == pytest.approx(np.mean([x for x in v if x is not None]))


def test_grid_pool_equals_brute_force(spark):
    """Boxes at the edges of rectangles, without size, without a text or a confidence, and a page without boxes."""
    rng = np.random.default_rng(3)
    rects = [(0, 0, 40, 30), (20, 10, 40, 30), (60, 0, 10, 90)]
    rows = [(int(p), i, int(rng.integers(0, 70)), int(rng.integers(0, 60)), int(rng.integers(0, 30)), int(rng.integers(0, 20)), None if i % 5 == 4 else i / 10, [" a ", "b", "", None, "c d"][i % 5]) for p in range(4) for i in range(6 * p)]
    boxes = spark.createDataFrame(rows, "image_id long, box_id long, x0 long, y0 long, w long, h long, confidence double, text string").repartition(3)
    pages = spark.createDataFrame([(p,) for p in range(4)], "image_id long")
    got = {(r["image_id"], r["idx"]): r for r in Sp.rows_of(Sp.grid_pool(pages, boxes, rects, "confidence", "text"), "total").collect()}
    assert len(got) == 12
    for p in range(4):
        own = [r for r in rows if r[0] == p]
        for i, (x, y, w, h) in enumerate(rects):
            cut = lambda a, n, b, m: max(0, min(a + n, b + m) - max(a, b))
            held = [(r, cut(x, w, r[2], r[4]) * cut(y, h, r[3], r[5])) for r in own]
            held = [(r, a) for r, a in held if a > 0]
            known, texts = [r[6] for r, _ in held if r[6] is not None], [r[7].strip() for r, _ in held if r[7] and r[7].strip()]
            g = got[p, i]
            assert (g["x"], g["y"], g["w"], g["h"], g["area"], g["n"], g["text"]) == (x, y, w, h, sum(a for _, a in held), len(held), " ".join(texts))
            assert g["total"] == (sum(r[4] * r[5] for r in own) if own else None) and g["confidence"] == (pytest.approx(np.mean(known)) if known else None)


@pytest.mark.parametrize("name", ["q19_patch_text", "q20_patch_coverage_conf", "q26_mmr", "q30_two_stage", "q81_patch_types", "q97_anchor_pair", "q139_safe_expand", "q159_label_boost", "q161_selector_registry", "q32_weak_labels", "q22_graph_features"])
def test_patches_are_not_shuffled(spark, sf_dir, name):
    """No exchange or sort for a join above what makes a row per patch: a patch stays where its page is."""
    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan()

    def shuffled(p, above):
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return shuffled(p.executedPlan(), above)
        exchange = kind == "ShuffleExchangeExec" and "idx#" in p.outputPartitioning().toString()
        children = [p.children().apply(i) for i in range(p.children().size())]
        return exchange or any(shuffled(c, above) for c in children)

    assert not shuffled(plan, False)


def test_selectors_in_one_pass_pick_what_each_picks(spark):
    rng = np.random.default_rng(5)
    rows = [(p, i, float(rng.integers(0, 3)), None if i == 2 else float(rng.integers(0, 9))) for p in range(5) for i in range(1 + 4 * p)]
    df = spark.createDataFrame(rows, "image_id long, idx long, text_confidence double, bm25 double")
    methods = ["ocr_confidence_topk", "bm25_only", "uniform", "multiscale_uniform"]
    for k in (1, 2, 3):
        got = {tuple(r) for r in Sc.select_each(df, methods, ["image_id"], k).collect()}
        assert got == {(m, r["image_id"], r["idx"]) for m in methods for r in Sc.select_named(df, m, ["image_id"], k).collect()}
    with pytest.raises(ValueError):
        Sc.select_each(df, ["evidence"], ["image_id"], 2)


@pytest.mark.parametrize("name", ["q181_node_evidence", "q182_node_pair_selector", "q184_table_pair_selector", "q185_entity_evidence", "q186_entity_row_selector", "q192_patch_features"])
def test_evidence_shuffles_no_patches(spark, sf_dir, name):
    """Pairs, nodes and rows meet the patches within their rows; neither what is stored nor the query deals a patch anew."""
    from foliant.sources.tables import Stored

    plans, table = [], Stored.table
    with pytest.MonkeyPatch.context() as m:
        m.setattr(Stored, "table", lambda self, df, name: plans.append(df) or table(self, df, name))
        plans.append(catalogue.QUERIES[name](spark, sf_dir))
    spark.conf.set("spark.sql.shuffle.partitions", "50")  # more than pages are dealt over
    try:
        assert not any("idx#" in x for df in plans for x in exchanges(df))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_dense_and_sparse_pages_have_the_same_edges(spark, monkeypatch):
    """Pages up to DENSE boxes meet page by page, denser ones cell by cell."""
    rng = np.random.default_rng(6)
    rows = [(p, i, int(rng.integers(0, 900)), int(rng.integers(0, 600)), int(rng.integers(1, 400)), 20, 0.5, "t") for p in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "image_id long, box_id long, x0 long, y0 long, w long, h long, confidence double, text string")
    found = []
    for dense in (0, 40):
        monkeypatch.setattr(Sp, "DENSE", dense)
        found.append(sorted(map(tuple, Sp.layout_edges(df).collect())))
    assert found[0] == found[1] and len(found[0]) > 50
