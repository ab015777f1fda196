"""Expected rows written by hand from the surveyed rules, not from the checking SQL."""

import difflib

import pytest
from pyspark.sql import functions as F

from foliant.functions import fuzzy as Z
from foliant.functions import text as T
from foliant.operators import evidence as Ev
from foliant.operators import gates as Gt
from foliant.operators import labels as L
from foliant.operators import scores as Sc
from foliant.operators import selection as Sel
from foliant.operators import spatial as Sp
from foliant.sources import config as C
from foliant.sources import tables as Tb


def test_question_buckets(spark):
    want = {
        "When was it signed": "date", "total time": "date", "What is the $ figure": "amount/currency", "how many pages": "number", "Who wrote it": "person/name", "Which bank is it": "organization",
        "which school": "organization", "what institution issued this": "organization", "the zip of the sender": "address/location", "which avenue": "address/location", "where is it": "address/location",
        "the invoice": "id/code", "tracking reference": "id/code", "which serial": "id/code", "what is the no": "phrase/other", "which institute": "phrase/other", "": "phrase/other", None: "phrase/other",
    }
    got = {r[0]: r[1] for r in spark.createDataFrame([(q,) for q in want], "q string").select("q", L.question_bucket(F.col("q"))).collect()}
    assert got == want


CASES = [  # (predictions of resize, bm25, learned), ANLS, exact match, grounded, chosen, shortest, golds -> labels
    (("x", "y", "z"), (0, 0, 0), (0, 0, 0), (True, True, True), "resize", "resize", ["abc"], ["F1"]),
    (("abc", "y", "z"), (1, 0, 0), (1, 0, 0), (False, True, True), "resize", "resize", ["abc"], ["F2"]),
    (("x", "abc", "z"), (0, 1, 0), (0, 1, 0), (True, True, True), "resize", "resize", ["abc"], ["F3"]),
    (("abc", "ABC d", "z"), (1, 1, 0), (1, 1, 0), (True, True, True), "resize", "resize", ["abc"], ["F4"]),
    (("abcde", "y", "z"), (0.95, 0, 0), (0, 0, 0), (True, True, True), "resize", "resize", ["abc"], ["F5"]),
    (("abcde", "y", "z"), (0.6, 0, 0), (0, 0, 0), (False, True, True), "resize", "resize", ["abc", "abcdef"], ["F6", "F8"]),
    (("ab", "y", "z"), (0.6, 0, 0), (0, 0, 0), (True, True, True), "resize", "resize", ["abc"], ["F7"]),
    (("abcd", "y", "z"), (0.3, 0, 0), (0, 0, 0), (True, True, True), "resize", "resize", ["abc", "ab"], ["F8"]),
    (("abcd", "abc", "z"), (0.3, 1, 0), (0, 1, 0), (True, True, True), "bm25", "bm25", ["abc"], ["S3", "S1"]),
    (("abc", "y", "z"), (1, 0, 0), (1, 0, 0), (True, True, True), "resize", "learned", ["abc"], ["S4", "S6"]),
    (("ab", "abc", "z"), (0.3, 1, 0), (0, 1, 0), (False, True, True), "bm25", "bm25", ["abc"], ["S3", "S2"]),
    (("abc", "abc", "abc"), (1, 1, 1), (1, 1, 1), (True, True, True), "resize", "resize", ["abc"], ["S6"]),
    (("abcd", "y", "z"), (0.3, 0, 0), (0, 0, 0), (True, True, True), "resize", "resize", ["abc"], ["F8"]),
]


def test_taxonomy(spark):
    names = ("resize", "bm25", "learned")
    schema = "n int, p array<string>, a array<double>, e array<double>, g array<boolean>, chosen string, shortest string, golds array<string>"
    df = spark.createDataFrame([(i, list(p), [float(x) for x in a], [float(x) for x in e], list(g), c, s, gold) for i, (p, a, e, g, c, s, gold, _) in enumerate(CASES)], schema)
    readers = {n: (F.col("p")[i], F.col("a")[i], F.col("e")[i], F.col("g")[i]) for i, n in enumerate(names)}
    got = {r["n"]: r["t"][:2] for r in df.select("n", L.taxonomy(readers, F.col("chosen"), F.col("shortest"), F.col("golds")).alias("t")).collect()}
    assert got == {i: case[-1] for i, case in enumerate(CASES)}


@pytest.mark.parametrize("name", ["answer", "gt_answer", "answers", "strict_positive", "any_positive", "label_positive", "label_confidence", "label_exact_patch_ocr", "label_fullpage_box_overlap", "label_soft_token_overlap", "label_fuzzy_match"])
def test_leaks_raise(name):
    with pytest.raises(ValueError, match=name):
        Sc.guard_features(["bm25", name])


def test_no_leaks_and_answers():
    assert Sc.guard_features(["bm25", "exact_match"]) == ["bm25", "exact_match"]
    with pytest.raises(ValueError):
        Sc.guard_answers("bm25_only", ["x"])
    Sc.guard_answers("oracle", ["x"])
    Sc.guard_answers("bm25_only", ["x"], evaluating=True)


def test_statuses(spark):
    rows = [(a, b) for a in (True, False) for b in (True, False)]
    got = spark.createDataFrame(rows, "r boolean, s boolean").select("r", "s", Gt.scale_status(F.col("r"), F.col("s")).alias("p17"), Gt.transfer_status(F.col("r"), F.col("s")).alias("p18")).collect()
    assert {(r["r"], r["s"]): (r["p17"], r["p18"]) for r in got} == {(True, True): ("PASS", "FULL TRANSFER"), (True, False): ("PARTIAL", "PARTIAL TRANSFER"), (False, True): ("PARTIAL", "FAIL"), (False, False): ("FAIL", "FAIL")}
    one = lambda *v: spark.createDataFrame([tuple(None if x is None else float(x) for x in v)], ", ".join(f"c{i} double" for i in range(len(v))))
    c = [F.col(f"c{i}") for i in range(5)]
    k = lambda a, b: one(a, b).select(Gt.headline_k(c[0], c[1])).first()[0]
    assert [k(0.15, 0.0), k(0.1, 0.3), k(0.1, 0.2), k(None, None)] == [2, 4, None, None]
    g5 = lambda *v: one(*v).select(Gt.transfer_gate(*c[:4])).first()[0]
    assert [g5(50, 0.05, 0.04, 0.03), g5(50, 0.03, 0.0, 0.0), g5(49, 0.05, 0.04, 0.03), g5(80, 0.02, 0.0, 0.0)] == ["strong", "min", None, None]
    learned = lambda *v, at_4=False: one(*v).select(Gt.learned_gate(*c[:4], F.lit(True), F.lit(at_4))).first()[0]
    assert [learned(0.5, 0.5, 0.4, 0.5), learned(0.4, 0.5, 0.4, 0.5), learned(0.5, 0.4, 0.4, 0.5), learned(0.1, 0.1, 0.4, 0.5, at_4=True)] == [True, False, False, True]
    assert [one(v).select(Gt.drop_status(c[0])).first()[0] for v in (0.015, 0.02, 0.04)] == ["PASS", "PARTIAL", "FAIL"]
    assert [one(v).select(Gt.near_target(c[0], 0.5, 0.02)).first()[0] for v in (0.51, 0.6, None)] == [True, False, True]


def test_heuristic_and_ablation_gates(spark):
    cover = spark.createDataFrame([("qe", 0.5, 0.6), ("base", 0.5, 0.6), ("a", 0.4, 0.5), ("b", 0.1, 0.2)], "method string, strict double, any double")
    low = lambda s, a: spark.createDataFrame([("strict", 0.0, s), ("any", 0.1, a)], "tier string, mean double, low double")
    gate = lambda others, ends: tuple(Gt.heuristic_gate(cover, "qe", "base", others, ends).first())
    assert gate(["a", "b"], low(-0.02, 0.0)) == (True, True, True, True)
    assert gate(["a", "base"], low(0.0, 0.0)) == (True, False, True, False)
    assert gate(["a"], low(-0.03, 0.0)) == (True, True, False, False)
    assert gate(["a"], low(0.0, 0.0).limit(0)) == (True, True, False, False)
    rows = spark.createDataFrame([("full", 0.8), ("x", 0.7), ("y", 0.7), ("z", 0.75), ("w", 0.8)], "drop_group string, anls double")
    assert tuple(Gt.ablation_gate(rows, "full").first()) == (0, 3, True)
    assert tuple(Gt.ablation_gate(rows.union(spark.createDataFrame([("v", 0.9)], rows.schema)), "full").first()) == (1, 3, False)


def boxes(spark, rows):
    return spark.createDataFrame([("p", i, x0, y0, x1 - x0, y1 - y0, conf, t) for i, (t, x0, y0, x1, y1, conf) in enumerate(rows)], "image_id string, box_id long, x0 long, y0 long, w long, h long, confidence double, text string")


def asked(spark, q):
    return spark.createDataFrame([("p", q)], "image_id string, question string")


def test_form_pairs(spark):
    b = boxes(spark, [("Name:", 10, 10, 60, 30, 0.9), ("John Smith", 70, 10, 160, 30, 0.9), ("Date 2024-01-15", 10, 50, 120, 70, 0.9)])
    got = Ev.node_pairs(b, asked(spark, "What is the name?")).collect()
    assert any({r["label"], r["value"]} == {0, 1} and r["rel"] in ("same_row", "nearby_right") for r in got)
    assert len({frozenset((r["label"], r["value"])) for r in got}) == len(got)


def test_table_rows_and_selectors(spark):
    b = boxes(spark, [("Name", 10, 10, 60, 30, 0.9), ("Alice", 100, 10, 160, 30, 0.9), ("Age", 10, 60, 60, 80, 0.9), ("42", 100, 60, 160, 80, 0.9)])
    q = asked(spark, "What is the age of Alice?")
    assert Sp.row_clusters(b).count() == 2
    kinds = [r["kind"] for r in Ev.text_rows(b, q).collect()]
    assert len(kinds) == 2 and any(k in ("table_like_row", "question_row") for k in kinds)
    pairs = {(r["label"], r["value"]): r["rel"] for r in Ev.table_pairs(b, q).collect()}
    assert pairs[(2, 3)] == "nearby_right" and pairs[(1, 3)] == "below_label"
    pool = spark.createDataFrame([("p", i, x, y, 90, 40, qa) for i, (x, y, qa) in enumerate([(0, 0, 0.3), (90, 0, 0.2), (0, 50, 0.1), (90, 50, 0.0), (200, 200, 0.0)])], "image_id string, idx long, x long, y long, w long, h long, qa double")
    node = Ev.node_evidence(pool, b, q)
    assert [r["idx"] for r in Ev.select_node_pairs(node, 3).orderBy("slot").collect()][0] == 0
    assert {r["idx"]: r["evidence"] > 0 for r in node.collect()}[3]
    table = Ev.select_table_pairs(Ev.table_evidence(pool, b, q), Ev.table_pairs(b, q)).first()
    assert table["first"] == 0 and table["second"] in (1, 2, 3)
    parsed = q.withColumn("entity", F.array(F.lit("alice"))).withColumn("field", F.array(F.lit("age")))
    entity = {r["idx"]: (r["entity"], r["able"]) for r in Ev.entity_evidence(pool, b, parsed).collect()}
    assert entity[4][1] is False and entity[1][0] > entity[3][0]
    assert Ev.select_entity_rows(Ev.entity_evidence(pool, b, parsed)).count() == 1


def test_late_score(spark):
    pairs = [("What is the total amount of brown metal?", "total metl brwn 12"), ("Where?", "x"), ("total", ""), ("held options", "S. H. Khan held")]

    def by_hand(q, t):
        qs, ts = spark.createDataFrame([(q, t)], "q string, t string").select(T.content_tokens(F.col("q")), T.tokens(F.col("t"))).first()

        def sim(a, b):
            if a == b:
                return 1.0
            if a in b or b in a:
                return 0.85
            x, y = ({s[i : i + 3] for i in range(max(1, len(s) - 2))} for s in (a, b))
            return max(len(x & y) / len(x | y), 0.75 * difflib.SequenceMatcher(None, a, b).ratio())

        return sum(max(sim(a, b) for b in ts) for a in qs) / len(qs) if qs and ts else 0.0

    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "n int, q string, t string")
    want = [by_hand(*p) for p in pairs]
    assert [r[0] for r in df.orderBy("n").select(Z.late_score(F.col("q"), F.col("t"))).collect()] == pytest.approx(want)
    joined = {r["n"]: r["late"] for r in Z.late_interaction(df, ["n"], "q", "t").collect()}
    assert [joined[i] for i in range(len(pairs))] == pytest.approx(want)


def test_every_selector(spark):
    rows = [("p", i, 40 * (i % 5), 40 * (i // 5), 60, 60) for i in range(15)]
    df = spark.createDataFrame(rows, "image_id string, idx long, x long, y long, w long, h long")
    for i, c in enumerate(sorted({c for _, c, _ in Sc.SELECTORS.values() if c} | {"q_score", "proxy", "answer_type", "bm25"})):
        df = df.withColumn(c, ((F.col("idx") * (3 + i) + i) % 13) / 13.0)
    df = df.withColumn("label_positive", F.col("idx") % 2 == 0)
    boxes = spark.createDataFrame([("p", i, 30 * i, 20 * (i % 3), 25, 12, 0.9, t) for i, t in enumerate(("Total:", "42 USD", "Date:", "2020", "name"))], "image_id string, box_id long, x0 long, y0 long, w long, h long, confidence double, text string")
    questions = spark.createDataFrame([("p", "What is the total amount?")], "image_id string, question string")
    for name in Sc.SELECTORS:
        got = [r["idx"] for r in Sc.select_named(df, name, ["image_id"], 2, boxes=boxes, questions=questions).collect()]
        assert len(got) == len(set(got)) == 2, name
    with pytest.raises(ValueError):
        Sc.select_named(df, "none", ["image_id"], 2)


def test_edge_strip_falls_back(spark):
    df = spark.createDataFrame([("a", 0, 0, 90), ("a", 1, 50, 3), ("a", 2, 50, 50), ("b", 0, 9, 9), ("b", 1, 3, 9), ("b", 2, 9, 9), ("b", 3, 9, 9)], "g string, idx int, x int, y int")
    got = sorted((r["g"], r["idx"]) for r in Sel.edge_strip(df, ["g"], "idx", 2).collect())
    assert got == [("a", 0), ("a", 1), ("b", 0), ("b", 2)]


def test_images_and_config(spark, tmp_path):
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "a.pgm").write_bytes(b"P5\n3 2\n255\n" + bytes(range(6)))
    (tmp_path / "i" / "b.ppm").write_bytes(b"P6 1 2 255\n" + bytes([32, 10, 9, 13, 0, 255]))
    (tmp_path / "i" / "c.txt").write_bytes(b"no image")
    got = {r["path"][-5:]: (r["w"], r["h"], r["area"], bytes(r["content"])) for r in C.read_images(spark, str(tmp_path / "i")).collect()}
    assert [v[:3] for _, v in sorted(got.items())] == [(3, 2, 6), (1, 2, 2), (None, None, None)]
    assert C.decode_image(got["a.pgm"][3]).tolist() == [[0, 1, 2], [3, 4, 5]] and C.decode_image(got["b.ppm"][3]).tolist() == [[[32, 10, 9]], [[13, 0, 255]]]
    with pytest.raises(ValueError):
        C.decode_image(b"no image")
    (tmp_path / "c.json").write_text('{"a": {"b": 1}}')
    (tmp_path / "e.json").write_text("")
    assert C.load_config("c.json", str(tmp_path)) == {"a": {"b": 1}} and C.load_config(str(tmp_path / "e.json")) == {}
    paths = C.Paths(str(tmp_path))
    assert paths.data("x").endswith("data/x")
    (tmp_path / "Data").mkdir()
    (tmp_path / "Data" / "x").write_text("")
    assert paths.data("x").endswith("Data/x") and (tmp_path / "outputs").exists() is False
    assert paths.outputs("m", "t.csv").endswith("t.csv") and (tmp_path / "outputs" / "m").is_dir() and not (tmp_path / "outputs" / "m" / "t.csv").exists()


def test_answer_lists(spark):
    cases = {'["a", "b", "a"]': ["a", "b"], "[\"['0.28']\"]": ["0.28"], "plain": ["plain"], '[["x"], " "]': ["x"], "": [], None: [], "[broken": ["[broken"]}
    got = {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in cases], "c string").select("c", Tb.answers_of(F.col("c"))).collect()}
    assert got == cases


def test_parsed_questions(spark):
    cases = {
        "What are the options held by S. H. Khan?": (["khan"], ["options", "held"], "number"),
        'What is the "brown metal" price for Acme Corp in 2021?': (["brown", "metal", "acme", "corp", "2021"], ["price"], "currency"),
        "Which patient John Smith met": (["john", "smith", "met"], ["patient"], "number"),
        "When was 12.5 paid to Mary": (["12.5", "mary"], ["paid"], "date"),
        "": ([], [], "number"),
        None: ([], [], "number"),
    }
    got = {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in cases], "q string").select("q", Z.parsed_question(F.col("q")).alias("p")).collect()}
    for q, (entity, field, hint) in cases.items():
        assert set(entity) <= set(got[q]["entity"]) and set(field) <= set(got[q]["field"]) and got[q]["hint"] == hint, (q, got[q])
        assert len(set(got[q]["entity"])) == len(got[q]["entity"]) and not set(got[q]["entity"]) & set(got[q]["field"])


def test_fuzzy_grounding(spark):
    cases = [("brown metal", "a brwn metal box", True), ("brown metal", "x brown metal y", True), ("brown metal", "blue wood", False), ("", "x", False), ("x", "", False), (" ".join("abcdefghijkl"), " ".join("abcdefghijkm"), False), ("a b c d", "a b", False)]
    df = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(cases)], "n int, p string, t string")
    got = [r[0] for r in df.orderBy("n").select(Z.fuzzy_grounded(F.col("p"), F.col("t"))).collect()]

    def by_hand(p, t):
        if not p or not t:
            return False
        if p in t:
            return True
        w, n = t.split()[:400], len(p.split())
        return n <= 10 and any(difflib.SequenceMatcher(None, p, " ".join(w[i : i + n])).ratio() >= 0.82 for i in range(max(1, len(w) - n + 1)))

    assert got == [by_hand(p, t) for p, t, _ in cases] and got[:5] == [x for _, _, x in cases][:5]


def test_steps(spark):
    from foliant import pipelines as Pl

    calls = []

    def shaky(s):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("again")

    got = [tuple(r) for r in Pl.run_steps(spark, [("a", shaky)], tries=3).collect()]
    assert got == [(1, "a", "done", None, None)] and len(calls) == 3
    assert [r["result"] for r in Pl.run_steps(spark, [("n", lambda s: s.range(5).count()), ("b", lambda s: True)]).collect()] == [5, None]
    got = [(r["step"], r["status"], r["error"]) for r in Pl.run_steps(spark, [("a", lambda s: 1 / 0), ("b", lambda s: None)]).collect()]
    assert got == [("a", "failed", "ZeroDivisionError: division by zero"), ("b", "not run", None)]


def test_ridge(spark):
    import numpy as np

    from foliant.operators import models as Mo

    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 3)) * [1, 5, 0.2] + [0, 100, 3]
    y = x @ [0.5, -2.0, 7.0] + 3 + rng.standard_normal(60)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)] + [(None, 1.0, 1.0, 1.0)], "a double, b double, c double, y double").repartition(3)
    m = Mo.fit_values(df, ["a", "b", "c"], "y", 2.0)
    c = x - x.mean(0)
    want = np.linalg.solve(c.T @ c + 2 * np.eye(3), c.T @ (y - y.mean()))
    assert m.weights == pytest.approx(want.tolist()) and m.intercept == pytest.approx(y.mean() - want @ x.mean(0))
    assert Mo.fit_values(df.limit(0), ["a"], "y").intercept == 0


def test_page_compression():
    import numpy as np

    from foliant.functions import pixels as Px

    page = np.full((60, 80), 255, np.uint8)
    page[20:30, 10:40] = 0
    assert Px.compressed(page, "margin", pad=2).shape == (14, 34)
    assert Px.compressed(page, "resize", area=0.25, pad=2).shape == (7, 17)
    wide = np.full((60, 80), 255, np.uint8)
    wide[[2, 57]] = 0
    thin = Px.compressed(wide, "whitespace", pad=0)
    assert thin.shape[0] < 56 and thin.shape[1] == 80 and (thin[[0, -1]] == 0).all()
    carved = Px.compressed(page, "carve", protected=page == 0, pad=6)
    assert carved.shape[0] == 22 and carved.shape[1] < 42 and (carved == 0).sum() == 300
    with pytest.raises(ValueError):
        Px.compressed(page, "zip")
    assert Px.shrunk(np.arange(16).reshape(4, 4), 0.25).tolist() == [[0, 2], [8, 10]]


def test_connectors_and_modes(spark):
    with pytest.raises(ValueError, match="no connector"):
        C.connect(spark, "elsewhere")
    df = spark.createDataFrame([("a", 0, 0, 0, 10, 10, 0.1, 0.2)], "image_id string, idx long, x long, y long, w long, h long, patch_score double, q_score double")
    pages = spark.createDataFrame([("a", 1000, 500)], "image_id string, w int, h int")
    with pytest.raises(ValueError, match="needs a question"):
        Sel.overview_and_patches(df, pages, "question_aware", 1, has_question=False)
    got = Sel.overview_and_patches(df, pages, "question_aware", 1).first()
    assert (got["n_patches"], got["overview_w"], got["overview_h"], got["patch_pixels"]) == (1, 316, 158, 100)
    chart = C.line_chart(spark.createDataFrame([("s", 0, 1.0), ("s", 1, 3.0), ("t", 0, 2.0)], "m string, x int, y double"), "m", "x", "y", 100, 50)
    assert {r["m"]: r["points"] for r in chart.collect()} == {"s": "0.0,50.0 100.0,0.0", "t": "0.0,25.0"}
    assert C.svg(chart, "m", 100, 50).count("<polyline") == 2
