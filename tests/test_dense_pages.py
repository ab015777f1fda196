import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import spatial as Sp

BOX = "image_id long, box_id long, x0 long, y0 long, w long, h long, confidence double, text string"


def boxes(n, width, height, seed=4):
    rng = np.random.default_rng(seed)
    return [(1, i, int(rng.integers(0, width)), int(rng.integers(0, height)), int(rng.integers(1, 300)), int(rng.integers(1, 40)), 0.5, f"t{i % 7}") for i in range(n)]


def test_one_huge_page_is_split(spark):
    """20,000 boxes of one page: joins spread over cells, and what they find is what every pair of rows gives."""
    rows = boxes(20_000, 40_000, 60_000)
    df = spark.createDataFrame(rows, BOX)
    got = {(r["a"], r["b"], r["rel"]) for r in Sp.layout_edges(df).collect()}
    x0, y0, w, h = (np.array([r[k] for r in rows], float) for k in (2, 3, 4, 5))
    cx, cy, want = x0 + w / 2, y0 + h / 2, set()
    order = np.argsort(cy)
    for at, i in enumerate(order):  # neighbours by height only: no relation spans 80 pixels or more
        near = order[at + 1 : at + 1 + np.searchsorted(cy[order[at + 1 :]], cy[i] + 80)]
        for j in near:
            a, b = (i, j) if i < j else (j, i)
            dx, dy, r, d = abs(cx[a] - cx[b]), abs(cy[a] - cy[b]), cx[b] - cx[a], cy[b] - cy[a]
            for rel, ok in (("same_row", dy < 15 and dx < max(w[a], 50)), ("same_column", dx < 15 and dy < 40), ("nearby_right", 0 < r < 200 and dy < 20), ("nearby_below", 0 < d < 80 and dx < 40)):
                if ok:
                    want.add((int(a), int(b), rel))
    assert got == want and len(want) > 500
    patches = spark.createDataFrame([(1, i, int(200 * i), int(300 * i), 1500, 1700) for i in range(150)], "image_id long, idx long, x long, y long, w long, h long")
    found = {(r["idx"], r["box_id"]): r["area"] for r in Sp.overlaps(patches, df).collect()}
    brute = {}
    for i in range(150):
        ow = np.minimum(200 * i + 1500, x0 + w) - np.maximum(200 * i, x0)
        oh = np.minimum(300 * i + 1700, y0 + h) - np.maximum(300 * i, y0)
        for j in np.flatnonzero((ow > 0) & (oh > 0)):
            brute[i, int(j)] = int(ow[j] * oh[j])
    assert found == brute and len(brute) > 1000
    cells = Sp._at(df, F.col("x0"), F.col("y0")).groupBy("image_id", "_i", "_j").count().agg(F.max("count")).first()[0]
    assert cells < 20_000 / 100


@pytest.mark.parametrize("step,parity", [(None, True), (8, False), (8, True), (64, False)])
def test_coverage_equals_a_raster(spark, step, parity):
    rng = np.random.default_rng(8)
    rows = [(p, int(rng.integers(-20, 190)), int(rng.integers(0, 130)), int(rng.integers(0, 90)), int(rng.integers(1, 70))) for p in range(6) for _ in range(p * 4)]
    rows = [(p, x // 8 * 8 if i % 2 else x, y // 8 * 8 if i % 2 else y, w, h) for i, (p, x, y, w, h) in enumerate(rows)]
    patches = spark.createDataFrame(rows + rows[:3], "image_id long, x long, y long, w long, h long")
    got = {r["image_id"]: r["area_coverage"] for r in Sp.pool_stats(patches, spark.createDataFrame([], BOX), 200, 140, step, parity).collect()}
    unit = step or 1
    for p in range(1, 6):
        page = np.zeros((140, 200), bool)
        for q, x, y, w, h in rows:
            if q == p and (not (parity and step) or (x % unit == 0 and y % unit == 0)):
                page[y : y + h, max(0, x) : max(0, x + w)] = True
        assert got[p] == pytest.approx(page[::unit, ::unit].mean())
