import difflib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions import fuzzy as Z
from foliant.functions import geometry as G
from foliant.functions import pixels as P
from foliant.functions import text as T
from foliant.operators import metrics as M
from foliant.operators import scores as Sc


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_ocr_metrics(spark):
    rows = [("hello world", "hello world"), ("hello", "hello world"), ("", ""), ("x", ""), ("hello foo bar", "hello world"), (None, None)]
    p, g = F.col("p"), F.col("g")
    assert one(spark, rows, "p string, g string", T.cer(p, g)) == [0.0, pytest.approx(6 / 11), 0.0, 1.0, pytest.approx(edits("hello foo bar", "hello world") / 11), 0.0]
    assert one(spark, rows, "p string, g string", T.wer(p, g)) == [0.0, 0.5, 0.0, 1.0, 1.0, 0.0]
    assert one(spark, rows, "p string, g string", T.word_recall(p, g)) == [1.0, 0.5, 1.0, 0.0, 0.5, 1.0]
    assert one(spark, rows, "p string, g string", T.word_precision(p, g)) == [1.0, 1.0, 1.0, 0.0, pytest.approx(1 / 3), 1.0]


def test_anls_and_match(spark):
    rows = [("helo", ["hello"]), ("March 12 2024", ["12 March 2024"]), ("", [""]), ("x", []), ("x", None), (None, ["a"])]
    got = one(spark, rows, "p string, g array<string>", T.anls(F.col("p"), F.col("g")))
    assert got[0] == pytest.approx(0.8) and got[2:] == [1.0, 0.0, 0.0, 0.0]
    assert one(spark, rows, "p string, g array<string>", T.exact_match(F.col("p"), F.col("g"))) == [0.0, 0.0, 1.0, 0.0, 0.0, 0.0]
    assert one(spark, [("a .",)], "p string", T.normalize_answer(F.col("p"))) == ["a "]


def test_parse_answer(spark):
    rows = [('user: q\nassistant\nAnswer: "Paris."\nbecause',), ("The answer is: 42.",), ("",), (None,), ("Final answer: 3,5!!",)]
    assert one(spark, rows, "p string", T.parse_answer(F.col("p"))) == ["Paris", "42", "", "", "3,5"]  # quotes go before final punctuation


def test_merge_and_duplicates(spark):
    rows = [(["hello world", "world foo"],), (["", "  ", "bar"],)]
    assert one(spark, rows, "p array<string>", T.merge_tokens(F.col("p"))) == ["hello world foo", "bar"]
    assert one(spark, [("a a b",), ("",)], "p string", T.duplicate_ratio(T.tokens(F.col("p")))) == [pytest.approx(1 / 3), 0.0]


def test_types(spark):
    rows = [("How many pages?", "12"), ("What is the total amount?", "x"), ("Who signed?", "John Smith"), (None, None)]
    assert one(spark, rows, "q string, p string", T.question_type(F.col("q"))) == ["count", "count", "person", "phrase"]
    assert one(spark, rows, "q string, p string", T.prediction_type(F.col("p"))) == ["numeric", "phrase", "person", "empty"]


def test_matcher_ratio(spark):
    rows = [("the quick fox", "the quack fox"), ("", "a"), ("abc", "abc")]
    got = one(spark, rows, "a string, b string", Z.matcher_ratio(F.col("a"), F.col("b")))
    assert got == [pytest.approx(difflib.SequenceMatcher(None, *rows[0]).ratio()), 0.0, 1.0]


def test_geometry(spark):
    df = spark.createDataFrame([(10, 10, 30, 30), (-5, 90, 500, 50)], "x int, y int, w int, h int")
    r = G.rect(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    assert [tuple(x[0]) for x in df.select(G.clamp(r, 100, 100)).collect()] == [(10, 10, 30, 30), (0, 90, 100, 10)]
    a = G.rect(F.lit(0), F.lit(0), F.lit(10), F.lit(10))
    assert df.select(G.iou(a, G.rect(F.lit(5), F.lit(0), F.lit(10), F.lit(10)))).first()[0] == pytest.approx(1 / 3)
    poly = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((0, 0), (4, 0), (4, 2), (0, 2))])
    assert tuple(df.select(G.polygon_center(poly)).first()[0]) == (2.0, 1.0)
    assert tuple(df.select(G.polygon_hull(poly)).first()[0]) == (0, 0, 4, 2)


def test_budgets(spark):
    rows = [(1000.0, 1000.0), (1100.0, 1000.0), (80.0, 100.0), (40.0, 100.0), (0.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, t double")
    assert [r[0] for r in df.select(M.pixel_budget(F.col("a"), F.col("t"))).collect()] == [True, False, False, False, True]
    assert [tuple(r[0]) for r in df.select(M.byte_budget(F.col("a"), F.col("t"))).collect()][2:4] == [(True, 0.8, False), (True, 0.4, True)]


def test_guards():
    with pytest.raises(ValueError):
        Sc.guard_features(["bm25", "label_positive"])
    with pytest.raises(ValueError):
        Sc.guard_answers("bm25", ["x"])
    Sc.guard_answers("oracle_topk", ["x"])


def test_pixels():
    flat = np.full((20, 30), 255, np.uint8)
    assert P.edge_density(flat) == 0 and P.entropy(flat) == 0
    page = flat.copy()
    page[8:12, 10:20] = 0
    assert P.margin_box(page) == (2, 0, 26, 20)
    assert P.margin_box(flat) == (0, 0, 30, 20)
    at = P.carve(page, page < 128, share=0.8)
    assert at.shape == (20, 24) and all(set(range(10, 20)) <= set(row) for row in at[8:12])
    assert P.largest_quality(lambda q: q * 10, 500) == (50, True) and P.largest_quality(lambda q: 1000, 500) == (5, False)
    assert len(P.kept_lines(np.full((40, 10), 255), np.zeros((40, 10), bool), 0)) == 10


def test_bootstrap_exact(spark):
    v = [0.1, 0.4, -0.2, 0.3]
    rng = np.random.default_rng(42)
    means = [rng.choice(np.array(v), size=4, replace=True).mean() for _ in range(1000)]
    df = spark.createDataFrame([("m", i, x) for i, x in enumerate(v)], "method string, k int, d double")
    r = M.bootstrap_exact(df, ["method"], "d", "k").first()
    assert (r["low"], r["high"]) == (pytest.approx(np.percentile(means, 2.5)), pytest.approx(np.percentile(means, 97.5)))
