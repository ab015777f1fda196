"""Steps whose cost per row was too high at size: what they compute, by brute force, and for how few rows they compute it."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions import fuzzy as Z
from foliant.operators import spatial as Sp
from foliant.operators import trees as Tr

BOX = "image_id long, box_id long, x0 long, y0 long, w long, h long, confidence double, text string"


def own_pool(boxes, asked, width, height, threshold):
    def square(b):
        x, y = (min(max(0, round(v - 128)), side - 1) for v, side in ((b[2] + b[4] / 2, width), (b[3] + b[5] / 2, height)))
        return x, y, max(1, min(256, width - x)), max(1, min(256, height - y))

    bands = {}
    for b in boxes:
        bands.setdefault(int((b[3] + b[5] / 2) // 1) // 20, []).append(b)
    every = Sp._page_rectangles(width, height) + [square(b) for b in boxes] + [square(b) for b in boxes if set(b[7].split()) & asked]
    for _, own in sorted(bands.items()):
        if len(own) >= 3:
            x, y = max(0, min(b[2] for b in own) - 8), max(0, min(b[3] for b in own) - 8)
            w, h = max(64, max(b[2] + b[4] for b in own) - min(b[2] for b in own) + 16), max(32, min(256, max(b[3] + b[5] for b in own) - min(b[3] for b in own) + 16))
            x, y = min(x, width - 1), min(y, height - 1)
            every.append((x, y, max(1, min(w, width - x)), max(1, min(h, height - y))))
    kept = []
    for r in every:
        if all(Sp._iou(k, r) < threshold for k in kept):
            kept.append(r)
    return kept


@pytest.mark.parametrize("threshold", [0.3, 0.55, 0.8])
def test_candidate_pool_equals_brute_force(spark, threshold):
    rng = random.Random(5)
    rows = [(p, i, rng.randrange(0, 700), rng.choice([40, 42, 44, rng.randrange(0, 900)]), rng.randrange(20, 240), rng.randrange(10, 40), 0.9, rng.choice(["red metal", "blue", "brown paper"])) for p in range(12) for i in range(p)]
    boxes = spark.createDataFrame(rows, BOX).repartition(3)
    questions = spark.createDataFrame([(p, "What is the total of the red paper?") for p in range(0, 12, 2)], "image_id long, question string")
    pool = Sp.candidate_pool(boxes, questions, 700, 900, threshold)
    got = {}
    for r in pool.collect():
        got.setdefault(r["image_id"], {})[r["idx"]] = (r["x"], r["y"], r["w"], r["h"])
    assert set(got) == set(range(1, 12))
    for p, own in got.items():
        assert [own[i] for i in range(len(own))] == own_pool([r for r in rows if r[0] == p], {"red", "paper", "total"}, 700, 900, threshold)


def test_candidate_pool_asks_free_squares_only(spark):
    """Questions meet the squares that the page's own rectangles leave free, not every box."""
    boxes = spark.createDataFrame([(1, 0, 10, 10, 30, 12, 0.9, "red")], BOX)
    pool = Sp.candidate_pool(boxes, spark.createDataFrame([(1, "red?")], "image_id long, question string"), 1000, 1300)
    plan = pool._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and plan.index("question#") < plan.index("ArrowEvalPython")
    assert pool.where(F.col("idx") >= 46).count() == 0


def test_late_interaction_of_repeated_keys_and_long_texts(spark, monkeypatch):
    """Blocks of tokens give what all pairs give; rows that share a key count together; nothing to compare counts 0."""
    monkeypatch.setattr(Z, "ASKED", 3)
    monkeypatch.setattr(Z, "BLOCK", 5)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(2, 8)))
    rows = [(i // 2, " ".join(word() for _ in range(rng.randrange(1, 9))), " ".join(word() for _ in range(rng.randrange(1, 30)))) for i in range(40)]
    rows += [(90, "", "abc"), (91, "abc abc", None), (92, None, None), (93, "abc " + "a" * 300, "abcd " + "ab" * 150), (94, "abc", "")]

    def similar(a, b):
        if a == b or a in b or b in a:
            return 1.0 if a == b else 0.85
        x, y = ({s[i : i + 3] for i in range(max(1, len(s) - 2))} for s in (a, b))
        return max(len(x & y) / len(x | y), 0.75 * difflib.SequenceMatcher(None, a, b).ratio())

    want = {}
    for n, q, t in rows:
        ts = (t or "").split()
        want.setdefault(n, []).extend(max((similar(a, b) for b in ts), default=0.0) for a in (q or "").split())
    got = {r["n"]: r["late"] for r in Z.late_interaction(spark.createDataFrame(rows, "n int, q string, t string"), ["n"], "q", "t").collect()}
    assert got == {n: pytest.approx(sum(v) / len(v) if v else 0.0) for n, v in want.items()}


def test_late_interaction_makes_no_row_per_pair(spark):
    """Tokens meet within their row: no row per pair of tokens, no join on tokens."""
    df = spark.createDataFrame([(1, "red metal", "read metals")], "n int, q string, t string")
    plan = Z.late_interaction(df, ["n"], "q", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_ranked_groups_share_chunks(spark, monkeypatch):
    """Small groups are gathered into few chunks; gradients of many groups at once are those of each alone."""
    starts, rng = np.array([0, 3, 4, 9, 12, 17]), np.random.default_rng(4)
    score, label = np.round(rng.normal(size=20), 1), rng.integers(0, 4, 20).astype(float)
    label[:3] = 0.0
    ends = [*starts[1:], 20]
    alone = [Tr.lambdas(score[a:b], label[a:b], np.array([0])) for a, b in zip(starts, ends, strict=True)]
    for pairs in (1, 1 << 20):
        monkeypatch.setattr(Tr, "PAIRS", pairs)
        for got, want in zip(Tr.lambdas(score, label, starts), zip(*alone, strict=True), strict=True):
            assert got.tolist() == pytest.approx(np.concatenate(want).tolist())
    sizes, table = {}, Tr.Stored.table

    def noted(self, df, name):
        out = table(self, df, name)
        sizes.setdefault(name, out.count())
        return out

    monkeypatch.setattr(Tr.Stored, "table", noted)
    df = spark.createDataFrame([(i, i // 3, float(i % 7), float(i % 3)) for i in range(300)], "id long, q long, a double, y double")
    forests, out = Tr.boost(df, ["id"], ["a"], "y", objective="ranks", group=["q"], trees=1, leaves=2, least_rows=1)
    assert out.count() == 300 and sizes["chunks"] == sizes["state"] == 1
