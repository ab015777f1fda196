import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import models as Mo
from foliant.operators import selectors as Se

LONG = "q long, route string, x1 double, x2 double, anls double, em double, fold string, prediction string"


def long_rows(seed=2, n=40):
    rng = np.random.default_rng(seed)
    out = []
    for q in range(n):
        for r in ("a", "b", "c"):
            x1, x2 = float(rng.normal()), float(rng.integers(0, 4))
            y = float(np.clip(0.5 + 0.3 * x1 - 0.1 * x2 + rng.normal() / 5, 0, 1))
            out.append((q, r, x1, x2, y, float(y > 0.6), "f", "p"))
    return out


def fold(q, folds=3):
    return int(hashlib.md5(str(q).encode()).hexdigest()[:8], 16) % folds


def ridge(x, y, alpha=1.0):
    m, my = x.mean(0), y.mean()
    w = np.linalg.solve((x - m).T @ (x - m) + alpha * np.eye(x.shape[1]), (x - m).T @ (y - my))
    return w, my - w @ m


def test_fold_models_and_ablations(spark):
    rows = long_rows()
    df = spark.createDataFrame(rows, LONG).repartition(4)
    x, y, k = np.array([r[2:4] for r in rows]), np.array([r[4] for r in rows]), np.array([fold(r[0]) for r in rows])
    models = Se.fold_models(df.withColumn("_fold", Se.fold_of(["q"], 3)), ["x1", "x2"], ["anls"], "_fold", 3, 1.0, {"full": [], "less": ["x1"]})
    for f in range(3):
        w, b = ridge(x[k != f], y[k != f])
        assert models.weights[0, f, 0] == pytest.approx(w) and models.intercepts[0, f, 0] == pytest.approx(b)
        w, b = ridge(x[k != f][:, 1:], y[k != f])
        assert models.weights[1, f, 0] == pytest.approx([0, *w]) and models.intercepts[1, f, 0] == pytest.approx(b)
    own = {(r["q"]): (r["route"], r["predicted"]) for r in Se.ablated_selections(df, ["q"], ["x1", "x2"], {"g": ["x1"]}, "anls", ["a", "b", "c"]).where("rule = 'full'").collect()}
    old = {(r["q"]): (r["route"], r["predicted"]) for r in Mo.select_out_of_fold(df, ["q"], ["x1", "x2"], "anls", ["a", "b", "c"]).collect()}
    assert {q: r for q, (r, _) in own.items()} == {q: r for q, (r, _) in old.items()} and all(own[q][1] == pytest.approx(old[q][1]) for q in own)


def test_evaluation_takes_further_models(spark):
    df = spark.createDataFrame(long_rows(), LONG)
    base = df.where("route = 'a'").select(F.lit("resize").alias("rule"), "q", "route", "anls", "em")
    bases = base.unionByName(base.withColumn("rule", F.lit("shortest_nonempty")))
    best = df.select("q", "route", F.col("anls").alias("predicted"))
    got = {r["rule"]: r for r in Se.evaluate_selectors(df, bases, ["q"], ["x1", "x2"], {"one": ["x1"], "two": ["x2"]}, ["a", "b", "c"], models={"oracle": best}).collect()}
    assert set(got) == {"resize", "shortest_nonempty", "full", "without_one", "without_two", "oracle"}
    assert got["oracle"]["recovered"] == pytest.approx(1) and got["full"]["anls"] > got["without_one"]["anls"] and got["full"]["hurt"] >= 1 and not got["full"]["p16"]
    assert got["resize"]["route_counts"] == "a=40"


def ndcg(rows, k=2):
    total = []
    for _, g in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        g = list(g)
        best = sum(v / math.log2(i + 2) for i, v in enumerate(sorted((r[2] for r in g), reverse=True)[:k]))
        own = sum(r[2] / math.log2(i + 2) for i, r in enumerate(sorted(g, key=lambda r: -r[1])[:k]))
        total.append(own / best if best else 1.0)
    return sum(total) / len(total)


def test_boosted_ranker_orders_at_least_as_well_as_ridge(spark):
    rng, rows = np.random.default_rng(7), []
    for q in range(60):
        for r in "abcdef":
            x1, x2 = float(rng.normal()), float(rng.normal())
            rows.append((q, r, x1, x2, float(np.clip(1 - abs(x1) + 0.1 * x2, 0, 1)), 0.0, "", ""))  # best in the middle: no line fits that
    df = spark.createDataFrame(rows, LONG)
    label = {(r[0], r[1]): r[4] for r in rows}
    scored = lambda out: ndcg([(r["q"], r["predicted"], label[r["q"], r["route"]]) for r in out.collect()])
    ranked = Se.boosted_scores(df, ["q"], ["x1", "x2"], "anls", 3, ranked=True, trees=10, rate=0.3, leaves=8, least_rows=5)
    x = df.withColumn("_f", Se.fold_of(["q"], 3))
    line = Se.fold_models(x, ["x1", "x2"], ["anls"], "_f", 3).predict(x, "_p", F.col("_f")).select("q", "route", F.col("_p")[0].alias("predicted"))
    assert scored(ranked) > scored(line) and scored(ranked) > 0.9
    squares = Se.boosted_scores(df, ["q"], ["x1", "x2"], "anls", 3, trees=10, rate=0.3, leaves=8, least_rows=5)
    assert scored(squares) > scored(line)


def test_best_route_equals_newton(spark):
    rows = long_rows()
    got = {(r["q"], r["route"]): r["predicted"] for r in Se.best_route_scores(spark.createDataFrame(rows, LONG), ["q"], ["x1", "x2"], "anls", 3).collect()}
    top = {q: max(r[4] for r in rows if r[0] == q) for q in range(40)}
    for f in range(3):
        own = [r for r in rows if fold(r[0]) != f]
        x, y = np.array([r[2:4] for r in own]), np.array([float(r[4] >= top[r[0]] - 1e-9) for r in own])
        m, s = x.mean(0), x.std(0, ddof=1)
        z, w = np.column_stack([np.ones(len(x)), (x - m) / s]), np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-z @ w))
            w = w - np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag([0, 1, 1]), z.T @ (p - y) + np.array([0, 1, 1]) * w)
        for r in rows:
            if fold(r[0]) == f:
                assert got[r[0], r[1]] == pytest.approx(1 / (1 + math.exp(-(w[0] + ((np.array(r[2:4]) - m) / s) @ w[1:]))), abs=1e-5)


def test_route_before_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(q, float(rng.normal()), *(float(v) for v in rng.uniform(0, 1, 3)), "x") for q in range(60)]
    rows = [(q, x, a, float(np.clip(a + x / 3, 0, 1)), c, g) for q, x, a, _, c, g in rows] + [(99, None, 0.1, 0.2, 0.3, "x")]
    out, tuned = Se.route_before(spark.createDataFrame(rows, "q long, x double, a_r double, a_s double, a_t double, gain string").repartition(3), ["q"], ["x"], ["r", "s", "t"])
    got = {r["q"]: (r["route"], r["gain"]) for r in out.collect()}
    rows = rows[:-1]
    x, y, k = np.array([[r[1]] for r in rows]), np.array([r[2:5] for r in rows]), np.array([fold(r[0]) for r in rows])
    assert len(got) == 60
    for f in range(3):
        p = np.column_stack([x @ w + b for w, b in (ridge(x[k != f], y[k != f, j]) for j in range(3))])
        gain, alt = p.max(1) - p[:, 0], p.argmax(1)
        means = [np.where(gain[k != f] > m, y[k != f, alt[k != f]], y[k != f, 0]).mean() for m in Se.MARGINS]
        assert tuned[f] == Se.MARGINS[int(np.argmax(np.round(means, 9)))]
        for i in np.flatnonzero(k == f):
            assert got[i][0] == "rst"[alt[i] if gain[i] > tuned[f] else 0] and got[i][1] == pytest.approx(gain[i])


def test_sweep_equals_brute_force(spark):
    rng, configs = np.random.default_rng(9), [[1.0, 0.0], [0.5, 0.5], [0.0, 1.0], [0.0, 0.0]]
    rows = [(None if q == 3 else q, i, None if i == 4 else float(rng.integers(0, 5)), float(rng.normal()), None if i == 2 else bool(rng.random() < 0.2), bool(rng.random() < 0.4)) for q in range(25) for i in range(int(rng.integers(1, 40)))]
    df = spark.createDataFrame(rows, "q long, i long, a double, b double, s boolean, n boolean").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = Se.weight_sweep(df, "q", "i", ["a", "b"], configs, "s", "n").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for c, (a, b) in enumerate(configs):
        hits = [0, 0]
        for q in {r[0] for r in rows}:
            top = sorted((r for r in rows if r[0] == q), key=lambda r: (-round(a * (r[2] or 0) + b * r[3], 12), r[1]))[:2]
            hits[0] += any(r[4] for r in top)
            hits[1] += any(r[5] for r in top)
        want.append((hits[0] / 25, hits[1] / 25, c))
    order = sorted(want, key=lambda w: (-w[0], -w[1], w[2]))
    assert [(r["strict_rate"], r["any_rate"], r["config"]) for r in sorted(got, key=lambda r: r["place"])] == [pytest.approx(o) for o in order] and {r["n"] for r in got} == {25}
    assert Se.weight_sweep(df.limit(0), "q", "i", ["a", "b"], configs, "s", "n").count() in (0, 4)
