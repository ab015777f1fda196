"""Choosing one reader's answer per question, as expressions over an array of candidates.

A candidate is a struct (pos, route, pred): pos is the reader's place in the tie order. norm is added by prepared().
Every choice is made inside a row, so a table of questions is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

ROUTES = ("resize", "bm25", "learned")


def prepared(page: Column | None = None, **routes: Column) -> Column:
    """Array of candidates in tie order; grounded tells whether the answer stands in the page's text."""
    items = []
    for i, (name, pred) in enumerate(routes.items()):
        norm = T.normalize_answer(pred)
        here = F.lit(False) if page is None else (T.normalize_match(pred) != "") & F.contains(T.normalize_match(page), T.normalize_match(pred))
        items.append(F.struct(F.lit(i).alias("pos"), F.lit(name).alias("route"), F.coalesce(pred, F.lit("")).alias("pred"), norm.alias("norm"), F.length(norm).alias("len"), here.alias("grounded"), T.prediction_type(pred).alias("ptype")))
    return F.array(*items)


def nonempty(c: Column) -> Column:
    return F.filter(c, lambda x: x["norm"] != "")


def _first(c: Column, *by) -> Column:
    """Route of the candidate that comes first by the given keys; null for none."""
    keyed = F.transform(c, lambda x: F.struct(*[k(x).alias(f"k{i}") for i, k in enumerate(by)], x["route"].alias("route")))
    return F.try_element_at(F.array_sort(keyed), F.lit(1))["route"]


def shortest(c: Column, default: str = "resize") -> Column:
    return F.coalesce(_first(nonempty(c), lambda x: x["len"], lambda x: x["pos"]), F.lit(default))


def longest(c: Column, default: str = "resize") -> Column:
    return F.coalesce(_first(nonempty(c), lambda x: -x["len"], lambda x: (x["route"] != default).cast("int"), lambda x: x["pos"]), F.lit(default))


def _count_same(c: Column, x: Column) -> Column:
    return F.size(F.filter(c, lambda y: y["norm"] == x["norm"]))


def majority(c: Column, default: str = "resize") -> Column:
    """The most common answer, of equals the one met first; among its readers the default one, else the first."""
    own = nonempty(c)
    counted = F.transform(own, lambda x: F.struct((-_count_same(own, x)).alias("n"), F.array_min(F.transform(F.filter(own, lambda y: y["norm"] == x["norm"]), lambda y: y["pos"])).alias("first"), (x["route"] != default).cast("int").alias("other"), x["pos"].alias("pos"), x["route"].alias("route")))
    return F.coalesce(F.try_element_at(F.array_sort(counted), F.lit(1))["route"], F.lit(default))


def distinct_answers(c: Column) -> Column:
    return F.size(F.array_distinct(F.transform(nonempty(c), lambda x: x["norm"])))


def on_disagreement(c: Column, prefer: str, default: str = "resize") -> Column:
    """Majority where readers agree; else the preferred reader if it answered, else the default."""
    answered = F.exists(nonempty(c), lambda x: x["route"] == prefer) if prefer != default else F.lit(True)
    return F.when(distinct_answers(c) <= 1, majority(c, default)).when(answered, prefer).otherwise(default)


def consensus_first(c: Column, default: str = "resize") -> Column:
    """The answer that two or more readers gave; else the shortest."""
    own = nonempty(c)
    most = F.coalesce(F.array_max(F.transform(own, lambda x: _count_same(own, x))), F.lit(0))
    return F.when(most >= 2, majority(c, default)).otherwise(shortest(c, default))


def digit_overlap(c: Column, question: Column, default: str = "resize") -> Column:
    """Most of the question's digits (each place counts), or most digits if it has none; ties to the default, then the first."""
    q = T.digits(question)
    places = F.filter(F.split(q, ""), lambda d: d != "")

    def score(x: Column) -> Column:
        own = T.digits(x["norm"])
        return F.when(q == "", F.length(own)).otherwise(F.size(F.filter(places, lambda d: F.contains(own, d))))

    return F.coalesce(_first(nonempty(c), lambda x: -score(x), lambda x: (x["route"] != default).cast("int"), lambda x: x["pos"]), F.lit(default))


def typed_shortest(c: Column, question: Column, default: str = "resize") -> Column:
    """The shortest answer whose type fits the question's; else the shortest."""
    fits = F.filter(nonempty(c), lambda x: T.type_match(T.question_type(question), x["ptype"]) > 0.5)
    return F.coalesce(_first(fits, lambda x: x["len"], lambda x: x["pos"]), shortest(c, default))


def grounded_shortest(c: Column, question: Column | None = None, default: str = "resize", use_ocr: bool = True, use_type: bool = False, use_length: bool = True, use_consensus: bool = False) -> Column:
    """The production rule: the shortest answer that stands in the page, ties in reader order; none: the shortest; none: default."""
    if not use_ocr:
        return typed_shortest(c, question, default) if use_type else shortest(c, default)
    own = F.filter(nonempty(c), lambda x: x["grounded"])
    keys = [lambda x: x["len"], lambda x: x["pos"]] if use_length else [lambda x: x["pos"]]
    pick = _first(own, *keys)
    if use_type and question is not None:
        pick = F.coalesce(_first(F.filter(own, lambda x: T.type_match(T.question_type(question), x["ptype"]) > 0.5), *keys), pick)
    if use_consensus:
        most = F.coalesce(F.array_max(F.transform(own, lambda x: _count_same(own, x))), F.lit(0))
        counted = F.transform(own, lambda x: F.struct((-_count_same(own, x)).alias("n"), F.array_min(F.transform(F.filter(own, lambda y: y["norm"] == x["norm"]), lambda y: y["pos"])).alias("first"), x["pos"].alias("pos"), x["route"].alias("route")))
        pick = F.when(most >= 2, F.try_element_at(F.array_sort(counted), F.lit(1))["route"]).otherwise(pick)
    return F.coalesce(pick, shortest(c, default))


def random_route(key: Column, routes: tuple[str, ...] = ROUTES, seed: int = 0) -> Column:
    """A reader drawn by an MD5 of the key, the same in every engine."""
    n = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("long")
    return F.element_at(F.array(*[F.lit(r) for r in routes]), (n % len(routes) + 1).cast("int"))


def rules(c: Column, question: Column, key: Column) -> dict[str, Column]:
    """All rules by name."""
    return {
        "resize": F.lit("resize"),
        "bm25": F.when(F.exists(nonempty(c), lambda x: x["route"] == "bm25"), "bm25").otherwise("resize"),
        "majority_vote": majority(c),
        "resize_on_disagree": on_disagreement(c, "resize"),
        "bm25_on_disagree": on_disagreement(c, "bm25"),
        "learned_on_disagree": on_disagreement(c, "learned"),
        "shortest_nonempty": shortest(c),
        "longest_nonempty": longest(c),
        "max_digit_overlap": digit_overlap(c, question),
        "consensus_first": consensus_first(c),
        "answer_type_shortest": typed_shortest(c, question),
        "grounded_shortest": grounded_shortest(c),
        "grounded_typed": grounded_shortest(c, question, use_type=True),
        "grounded_first": grounded_shortest(c, use_length=False),
        "grounded_consensus": grounded_shortest(c, use_consensus=True),
        "uniform_random": random_route(key),
    }


def swapped(questions: DataFrame, reader: str, other: str) -> DataFrame:
    """questions with one reader's answers replaced by another's; true_<reader> keeps its own for comparisons."""
    return questions.withColumn(f"true_{reader}", F.col(reader)).withColumn(reader, F.col(other))


#: Words of a sentence, and a lead-in, in a prediction.
SENTENCE, LEAD = r"(?i)\b(the|is|are|was|were|of|to|and|for|in|on|at)\b", r"(?i)^\s*(the\s+)?answer\s+is\b"
PERSON = r"(?i:\b(mr|mrs|ms|dr|prof)\.?\b)|[A-Z][a-z]+\s+[A-Z][a-z]+"


def output_features(c: Column, x: Column, question: Column, full: Column, patch: Column) -> dict[str, Column]:
    """Features of one reader's output x among the candidates c of its question: text, types, agreement, lengths, OCR presence.

    Nothing here looks at the gold answer. Ties for the shortest go to the default reader, ties for the longest to another.
    """
    one = lambda test: F.coalesce(test, F.lit(False)).cast("double")
    p, n = F.coalesce(x["pred"], F.lit("")), x["norm"]
    toks = F.filter(F.split(n, " "), lambda w: w != "")
    date, percent = F.rlike(p, F.lit(T.ascii_words(T.PREDICTION_DATE))), F.rlike(p, F.lit(T.ascii_words(T.PREDICTION_PERCENT)))
    out = {f"route_{r}": one(x["route"] == r) for r in ROUTES}
    out |= {
        "len_chars": F.length(p).cast("double"), "len_tokens": F.size(toks).cast("double"), "is_empty": one(F.size(toks) == 0), "is_single_token": one(F.size(toks) == 1),
        "digit_frac": F.length(F.regexp_replace(p, r"\P{Nd}", "")) / F.greatest(F.lit(1), F.length(p)),
        "is_numeric": one((F.size(toks) > 0) & ~F.rlike(n, F.lit(r"\p{L}")) & F.rlike(p, F.lit(r"\d")) & ~date & ~F.contains(p, F.lit("%"))),
        "is_date_like": one(date), "is_amount_like": one(F.rlike(p, F.lit(T.ascii_words(T.PREDICTION_AMOUNT)))), "is_percent_like": one(percent), "is_person_like": one(F.rlike(p, F.lit(T.ascii_words(PERSON)))),
        "contains_sentence_words": one(F.rlike(p, F.lit(SENTENCE)) & (F.size(toks) >= 4)), "starts_with_answer_is": one(F.rlike(p, F.lit(T.ascii_words(LEAD)))),
    }
    ptype, qtype = T.prediction_type(p), T.question_type(question)
    out |= {f"pred_type_{k}": one(ptype == k) for k in ("empty", "numeric", "percent", "amount", "date", "person", "phrase")}
    out |= {f"qtype_{k}": one(qtype == k) for k in ("count", "percent", "date", "person", "location", "value", "phrase")}
    out["answer_type_match"] = T.type_match(qtype, ptype)
    own = nonempty(c)
    same = lambda y: F.size(F.filter(own, lambda z: z["norm"] == y["norm"]))
    most = F.coalesce(F.array_max(F.transform(own, same)), F.lit(0))
    leader = F.try_element_at(F.array_sort(F.transform(own, lambda y: F.struct((-same(y)).alias("n"), y["pos"].alias("pos"), y["norm"].alias("norm")))), F.lit(1))["norm"]
    others = F.filter(own, lambda y: y["route"] != x["route"])
    sims = F.transform(others, lambda y: T.similarity(n, y["norm"]))
    some = (n != "") & (F.size(others) > 0)
    ends = lambda sign: F.try_element_at(F.array_sort(F.transform(own, lambda y: F.struct((sign * F.length(y["norm"])).alias("n"), F.when(y["route"] == ROUTES[0], 0 if sign > 0 else 1).otherwise(1 if sign > 0 else 0).alias("d"), y["pos"].alias("pos"), y["route"].alias("route")))), F.lit(1))["route"]
    out |= {
        "agreement_size": most.cast("double"), "n_same_normalized": F.when(n != "", same(x)).otherwise(0).cast("double"), "in_majority": one((n != "") & (n == leader) & (most >= 2)),
        "agree_count": F.when(n != "", F.size(F.filter(others, lambda y: y["norm"] == n))).otherwise(0).cast("double"),
        "edit_sim_mean": F.when(some, F.aggregate(sims, F.lit(0.0), lambda s, v: s + v) / F.size(sims)).otherwise(0.0), "edit_sim_max": F.when(some, F.array_max(sims)).otherwise(0.0),
        "is_substring_of_other": one(some & F.exists(others, lambda y: (y["norm"] != n) & F.contains(y["norm"], n))), "other_is_substring": one(some & F.exists(others, lambda y: (y["norm"] != n) & F.contains(n, y["norm"]))),
        "is_shortest_nonempty": one(x["route"] == ends(1)), "is_longest_nonempty": one(x["route"] == ends(-1)),
    }
    whole, part = T.normalize_answer(full), T.normalize_answer(patch)
    return out | {"pred_in_full_ocr": one((n != "") & F.contains(whole, n)), "pred_in_patch_ocr": one((n != "") & F.contains(part, n)), "ocr_full_chars": F.length(whole).cast("double"), "ocr_patch_chars": F.length(part).cast("double")}


def router_features(c: Column, question: Column) -> dict[str, Column]:
    """Features of a question before a reader is chosen: each reader's lengths and emptiness, agreement, the question's type."""
    own = nonempty(c)
    out = {}
    for i, r in enumerate(ROUTES):
        n = c[i]["norm"]
        out |= {f"{r}_len_chars": F.length(F.coalesce(c[i]["pred"], F.lit(""))).cast("double"), f"{r}_len_tokens": F.size(F.filter(F.split(n, " "), lambda w: w != "")).cast("double"), f"{r}_is_empty": (n == "").cast("double")}
    kinds = F.size(F.array_distinct(F.transform(own, lambda y: y["norm"])))
    out |= {"n_distinct": kinds.cast("double"), "n_nonempty": F.size(own).cast("double"), "all_agree": ((kinds == 1) & (F.size(own) == len(ROUTES))).cast("double")}
    qtype = T.question_type(question)
    return out | {f"qtype_{k}": (qtype == k).cast("double") for k in ("count", "percent", "date", "person", "location", "value", "phrase")}
