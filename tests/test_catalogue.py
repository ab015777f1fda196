import difflib
import hashlib
import re

import numpy as np
import pytest

from foliant.functions import fuzzy as Z
from foliant.functions import text as T
from foliant.plans import catalogue, metric_queries
from foliant.sources import views as V

from .oracle import assert_same

CHECKED = sorted(set(catalogue.QUERIES) & set(catalogue.ORACLES))


@pytest.mark.parametrize("name", CHECKED)
def test_equals_sql(spark, sf_dir, name):
    assert_same(catalogue.QUERIES[name](spark, sf_dir), catalogue.ORACLES[name], sf_dir)


def run(spark, sf_dir, name):
    return catalogue.QUERIES[name](spark, sf_dir).collect()


#: Queries without SQL that other files test: boosted trees and selectors against brute force, the registry name by name.
ELSEWHERE = {"q209_boosted_ranker", "q210_boosted_regression", "q211_best_route_probability", "q216_all_selectors"}


def test_queries_without_sql_are_tested():
    here = {"q41_bootstrap_numpy", "q68_late_interaction", "q69_fuzzy_ratio", "q70_entity_tokens", "q72_lr_ranker", "q99_candidate_pool", "q193_fuzzy_grounding", "q194_parsed_questions"}
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == here | ELSEWHERE


def test_exact_bootstrap(spark, sf_dir):
    rows = {}
    for r in sorted(metric_queries.last_runs(spark, sf_dir).collect(), key=lambda r: r["image_id"]):
        rows.setdefault(r["method"], {})[r["image_id"]] = r["value"]
    got = {r["method"]: r for r in run(spark, sf_dir, "q41_bootstrap_numpy")}
    assert set(got) == set(rows) - {"view"}
    for m, r in got.items():
        v = np.array([x - rows["view"][i] for i, x in rows[m].items() if i in rows["view"]])
        rng = np.random.default_rng(42)
        means = [rng.choice(v, size=len(v), replace=True).mean() for _ in range(1000)]
        assert (r["mean"], r["low"], r["high"], r["n"]) == pytest.approx((v.mean(), *np.percentile(means, [2.5, 97.5]), len(v)))


def words(text):
    return re.sub(r"\s+", " ", re.sub(r"[!-/:-@\[-`{-~]", "", (text or "").lower())).strip().split()


def similar(a, b):
    if a == b:
        return 1.0
    if a in b or b in a:
        return 0.85
    x, y = ({s[i : i + 3] for i in range(max(1, len(s) - 2))} for s in (a, b))
    return max(len(x & y) / len(x | y), 0.75 * difflib.SequenceMatcher(None, a, b).ratio())


def test_late_interaction(spark, sf_dir):
    q = {(r["conv_id"], r["turn"]): r for r in V.questions(spark, sf_dir).collect()}
    for r in run(spark, sf_dir, "q68_late_interaction"):
        own = q[r["conv_id"], r["turn"]]
        ask, page = [w for w in words(own["question"]) if len(w) > 1 and w not in T.STOP_WORDS], set(words(own["page"]))
        want = sum(max(similar(a, b) for b in page) for a in ask) / len(ask) if ask and page else 0.0
        assert r["late"] == pytest.approx(want, abs=1e-9)


def test_ratios_and_grounding(spark, sf_dir):
    p = {(r["conv_id"], r["turn"], r["route"]): r for r in V.predictions(spark, sf_dir).collect()}
    collapse = lambda t: re.sub(r"\s+", " ", (t or "").lower()).strip()
    answer = lambda t: re.sub(r"\s+", " ", re.sub(r"[!-/:-@\[-`{-~]", "", re.sub(r"^\s+|\s+$", "", (t or "").lower())))
    for r in run(spark, sf_dir, "q69_fuzzy_ratio"):
        own = p[r["conv_id"], r["turn"], r["route"]]
        a, b = collapse(own["pred"]), collapse(own["gold1"])
        assert r["ratio"] == pytest.approx(difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0, abs=1e-9)
    for r in run(spark, sf_dir, "q193_fuzzy_grounding"):
        own = p[r["conv_id"], r["turn"], r["route"]]
        a, b = answer(own["pred"]), answer(own["page"])
        w, n = b.split(), len(a.split())
        near = bool(a and b) and (a in b or (0 < n <= 10 and any(difflib.SequenceMatcher(None, a, " ".join(w[i : i + n])).ratio() >= 0.82 for i in range(max(1, len(w) - n + 1)))))
        assert r["fuzzy"] == near


def test_entities(spark, sf_dir):
    texts = {(r["conv_id"], r["turn"]): r["text"] or "" for r in V.table(spark, sf_dir, "conversations").collect()}
    for r in run(spark, sf_dir, "q70_entity_tokens"):
        t = texts[r["conv_id"], r["turn"]]
        found = [*re.findall(r"\b((?:[A-Z]\.\s*)+[A-Z][a-z]+)", t, re.A), *re.findall(r"[\"']([^\"']{2,})[\"']", t), *re.findall(r"(?<=\s)([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)", t, re.A), *re.findall(r"\b(\d+(?:\.\d+)?)\b", t, re.A)]
        want = list(dict.fromkeys(w for f in found for w in words(f) if len(w) > 1 and w not in T.STOP_WORDS))
        if t.isascii():
            assert r["entities"].split() == want
    for r in run(spark, sf_dir, "q194_parsed_questions"):
        entity, field = (x.split("|") if x else [] for x in (r["entity"], r["field"]))
        assert len(set(entity)) == len(entity) and not set(entity) & set(field) and r["hint"] in ("date", "currency", "name", "percent", "number")
        assert set(w for w in words(texts[r["conv_id"], r["turn"]]) if len(w) > 1 and w not in T.STOP_WORDS) - set(Z.NO_ENTITY) <= set(entity) | set(field) | set(Z.QUESTION_ONLY)


def test_ranker_scores(spark, sf_dir):
    got = run(spark, sf_dir, "q72_lr_ranker")
    labels = {r["doc_id"]: r["quality"] for r in V.table(spark, sf_dir, "labels").collect()}
    assert {r["doc_id"] for r in got} == set(labels) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["fold"] == int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:8], 16) % 3 for r in got)


def test_candidate_pools(spark, sf_dir):
    pools = {}
    for r in run(spark, sf_dir, "q99_candidate_pool"):
        pools.setdefault(r["image_id"], []).append(r)
    for pool in list(pools.values())[:60]:
        pool.sort(key=lambda r: r["idx"])
        assert [r["idx"] for r in pool] == list(range(len(pool)))
        for i, a in enumerate(pool):
            assert a["x"] >= 0 and a["y"] >= 0 and a["x"] + a["w"] <= V.PAGE_W and a["y"] + a["h"] <= V.PAGE_H
            for b in pool[:i]:
                inter = max(0, min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"])) * max(0, min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"]))
                assert inter / (a["w"] * a["h"] + b["w"] * b["h"] - inter) < 0.3


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
