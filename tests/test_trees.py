import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import trees as Tr

COLS = "id long, q long, a double, b double, c double, y double, fold int, prediction string"


def rows(seed=3, n=240):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        a, b, c = float(rng.integers(0, 30)), float(rng.normal()), float(rng.integers(0, 3))
        y = float(np.clip(round(a / 8 + b + rng.normal() / 3), 0, 4))
        out.append((i, i // 8, None if i % 41 == 0 else a, float("nan") if i % 37 == 0 else b, c, y, (i // 8) % 3, "x"))
    return [*out, (n, n // 8, 1.0, 1.0, 1.0, None, 0, "x"), out[5]]


def gradients(objective, s, y, q):
    if objective == "squares":
        return s - y, np.ones(len(s))
    g, h = np.zeros(len(s)), np.zeros(len(s))
    for k in set(q.tolist()):
        own = np.flatnonzero(q == k)
        place = {i: r for r, i in enumerate(sorted(own, key=lambda i: (-s[i], np.flatnonzero(own == i)[0])))}
        best = sum(v / math.log2(r + 2) for r, v in enumerate(sorted(y[own], reverse=True)))
        for i in own:
            for j in own:
                if y[i] > y[j]:
                    d = (y[i] - y[j]) * abs(1 / math.log2(place[i] + 2) - 1 / math.log2(place[j] + 2)) / best
                    p = 1 / (1 + math.exp(s[i] - s[j]))
                    g[i] -= p * d
                    g[j] += p * d
                    h[i] += p * (1 - p) * d
                    h[j] += p * (1 - p) * d
    return g, h


def grow(x, g, h, seen, features, leaves, least):
    """Best leaf first, every threshold tried on the values themselves."""
    step = lambda v: np.rint(v * Tr.STEP)
    g, h = step(g) / Tr.STEP, step(h) / Tr.STEP

    def split(at):
        own, best = at & seen, (0.0, None, None)
        whole = g[own].sum() ** 2 / h[own].sum() if h[own].sum() > 0 else 0.0
        for f in features:
            for v in np.unique(x[:, f])[:-1]:
                lo = own & (x[:, f] <= v)
                hi = own & ~lo
                if min(lo.sum(), hi.sum()) >= least and min(h[lo].sum(), h[hi].sum()) >= 1e-3:
                    gain = g[lo].sum() ** 2 / h[lo].sum() + g[hi].sum() ** 2 / h[hi].sum() - whole
                    if gain > best[0] + 1e-12:
                        best = (gain, f, v)
        return best

    parts = [np.ones(len(x), bool)]
    found = [split(parts[0])]
    while len(parts) < leaves and max(f[0] for f in found) > 0:
        k = max(range(len(parts)), key=lambda k: found[k][0])
        _, f, v = found.pop(k)
        at = parts.pop(k)
        for p in (at & (x[:, f] <= v), at & ~(x[:, f] <= v)):
            parts.append(p)
            found.append(split(p))
    out = np.zeros(len(x))
    for p in parts:
        out[p] = -g[p & seen].sum() / h[p & seen].sum() if h[p & seen].sum() > 0 else 0.0
    return out


@pytest.mark.parametrize("objective", ["squares", "ranks"])
def test_trees_equal_brute_force(spark, monkeypatch, objective):
    monkeypatch.setattr(Tr, "CHUNK", 50)
    data = rows()
    df = spark.createDataFrame(data, COLS).repartition(5)
    options = {"objective": objective, "trees": 4, "leaves": 6, "rate": 0.3, "least_rows": 5, "feature_share": 0.67, "row_share": 0.8, "fold": "fold", "folds": 3, "group": ["q"] if objective == "ranks" else None}
    forests, out = Tr.boost(df, ["id"], ["a", "b", "c"], "y", **options)
    got = {}
    for r in out.collect():
        got.setdefault(r["id"], []).append(r["prediction"])
    assert sorted(got) == list(range(240)) and len(got[5]) == 2
    rid = {r["id"]: r["rid"] for r in df.select("id", F.xxhash64("id").alias("rid")).collect()}
    own = sorted((r for r in data if r[5] is not None), key=lambda r: rid[r[0]])
    x = np.array([[-np.inf if v is None or v != v else v for v in r[2:5]] for r in own])
    y, q, fold, ids = np.array([r[5] for r in own]), np.array([r[1] for r in own]), np.array([r[6] for r in own]), np.array([rid[r[0]] for r in own])
    import random

    for k in range(3):
        train = fold != k
        s = np.full(len(own), y[train].mean() if objective == "squares" else 0.0)
        for t in range(4):
            features = sorted(random.Random(f"42:{t}:{k}").sample(range(3), 2))
            g, h = gradients(objective, s, y, q)
            s = s + 0.3 * grow(x, g, h, train & Tr.in_bag(ids, 42, t, 0.8), features, 6, 5)
        for i in np.flatnonzero(fold == k):
            assert got[own[i][0]][0] == pytest.approx(s[i], abs=1e-6)
    again = {(r["id"], r["prediction"]) for r in Tr.boost(df.repartition(2), ["id"], ["a", "b", "c"], "y", **options)[1].collect()}
    assert again == {(i, p) for i, ps in got.items() for p in ps}
    scored = {r["id"]: r for r in forests[0].transform(df, "score").collect()}
    assert all(scored[r[0]]["score"] == pytest.approx(got[r[0]][0], abs=1e-9) and scored[r[0]]["prediction"] == "x" for r in data if r[6] == 0 and r[5] is not None)


def test_bins_of_many_values():
    x = np.random.default_rng(1).normal(size=(5000, 2))
    x[:7, 1] = np.nan
    edges = Tr.bin_edges(x, 16)
    b = Tr.binned(x, edges)
    assert [len(e) for e in edges] == [15, 15] and b.max() == 16 and (b[:7, 1] == 0).all() and min(np.bincount(b[:, 0])[1:]) > 250
    assert ((x[:, [0]] <= edges[0][None, :]).argmax(1) == np.where(b[:, 0] < 16, b[:, 0] - 1, 0)).all()


def test_odd_tables(spark):
    forests, out = Tr.boost(spark.createDataFrame([], COLS), ["id"], ["a", "b"], "y", trees=2)
    assert out.count() == 0 and forests[0].trees == [] and forests[0].transform(spark.createDataFrame(rows(), COLS)).where("prediction <> 0").count() == 0
    same = spark.createDataFrame([(i, 0, 1.0, 1.0, 1.0, 2.0, 0, "") for i in range(30)], COLS)
    forests, out = Tr.boost(same, ["id"], ["a", "b"], "y", trees=2, objective="ranks", group=["q"])
    assert {r["prediction"] for r in out.collect()} == {0.0}
