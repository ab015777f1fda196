"""Queries of boosted and logistic selectors, of the whole selector evaluation, of routing before reading, and of weight sweeps."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import routing as R
from ..operators import selectors as Se
from ..sources import views as V
from . import sqltext as S
from .gate_queries import _ends
from .metric_queries import _PL, patch_labels
from .registry import query
from .routing_queries import _WIDE, LONG, RULES_SQL, evaluated, wide_scores, with_candidates

KEYS, FOLDS = ["conv_id", "turn"], 3
#: Features that the trees of the registered queries see.
TREE_FEATURES = ["len_chars", "len_tokens", "digit_frac", "is_numeric", "is_date_like", "answer_type_match", "agreement_size", "n_same_normalized", "edit_sim_mean", "edit_sim_max", "is_substring_of_other", "is_shortest_nonempty", "is_longest_nonempty", "pred_in_full_ocr", "pred_in_patch_ocr"]
TREES = {"trees": 12, "leaves": 15, "rate": 0.2, "least_rows": 10}


def route_table(spark, d):
    """A row per question and reader: features of its output, anls and em."""
    q = with_candidates(spark, d, V.spread).select(*KEYS, "question", "page", "gold1", "gold2", "c", F.explode_outer("c").alias("x"))
    f = R.output_features(F.col("c"), F.col("x"), F.col("question"), F.col("page"), F.col("gold2"))
    g = F.array("gold1", "gold2")
    return q.select(*KEYS, F.col("x.route").alias("route"), T.anls(F.col("x.pred"), g).alias("anls"), T.exact_match(F.col("x.pred"), g).alias("em"), *[c.cast("double").alias(n) for n, c in f.items() if n in TREE_FEATURES])


def _rounded(scores):
    return scores.select(*KEYS, "route", F.round("predicted", 6).alias("predicted"))


@query("q209_boosted_ranker")
def boosted_ranker(spark, d):
    return _rounded(Se.boosted_scores(route_table(spark, d), KEYS, TREE_FEATURES, "anls", FOLDS, ranked=True, **TREES))


@query("q210_boosted_regression")
def boosted_regression(spark, d):
    return _rounded(Se.boosted_scores(route_table(spark, d), KEYS, TREE_FEATURES, "anls", FOLDS, **TREES))


@query("q211_best_route_probability")
def best_route_probability(spark, d):
    return _rounded(Se.best_route_scores(route_table(spark, d), KEYS, TREE_FEATURES[:6], "anls", FOLDS))


_FOLD = "cast(concat('0x', substr(md5(concat(conv_id, ':', turn)), 1, 8)) as bigint) % 3"
_VARIANTS = """m as (select k, avg(x1) as m1, avg(x2) as m2, avg(y) as my from f group by 1),
s as (select f.k, any_value(m1) as m1, any_value(m2) as m2, any_value(my) as my, sum((x1 - m1) * (x1 - m1)) + 1 as a11, sum((x2 - m2) * (x2 - m2)) + 1 as a22, sum((x1 - m1) * (x2 - m2)) as a12, sum((x1 - m1) * (y - my)) as b1, sum((x2 - m2) * (y - my)) as b2 from f join m using (k) group by 1),
w as (select k, m1, m2, my, 'full' as rule, (a22 * b1 - a12 * b2) / (a11 * a22 - a12 * a12) as w1, (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) as w2 from s
  union all select k, m1, m2, my, 'without_length', 0, b2 / a22 from s union all select k, m1, m2, my, 'without_agreement', b1 / a11, 0 from s)"""
BASES = ("resize", "shortest_nonempty", "majority_vote")


@query("q212_selector_evaluation", f"""
with {RULES_SQL}, tz as (select conv_id, turn, concat(conv_id, ':', turn) as id, pos, route, len::double as x1, same::double as x2, anls as y, anls, em, {_FOLD} as fold from (select * exclude (same), case when norm = '' then 0 else same end as same from x)),
f as (select r.k, tz.* from tz, range(3) r(k) where tz.fold <> r.k), {_VARIANTS},
pz as (select tz.*, w.rule, my + w1 * (x1 - m1) + w2 * (x2 - m2) as predicted from tz join w on w.k = tz.fold), gz as (select *, max(predicted) over (partition by rule, id) as top from pz),
e as (select rule, id, arg_min(route, pos) as route, arg_min(anls, pos) as anls, arg_min(em, pos) as em from gz where predicted >= top - 1e-9 group by 1, 2
  union all select p.rule, concat(p.conv_id, ':', p.turn), p.route, x.anls, x.em from picks p join x on x.conv_id = p.conv_id and x.turn = p.turn and x.route = p.route where p.rule in {BASES}),
{_ends('resize', 'r')}, {_ends('shortest_nonempty', 's')},
g as (select rule, count(*) as n, avg(anls) as anls, avg(em) as em from e group by 1),
c as (select rule, string_agg(concat(route, '=', n), ',' order by concat(route, '=', n)) as route_counts from (select rule, route, count(*) as n from e group by 1, 2) group by 1),
o as (select avg(best) as oracle from (select id, max(y) as best from tz group by 1)), b as (select max(m) as single from (select route, avg(y) as m from tz group by 1)),
h as (select count(*) filter (where v.anls > u.anls + 1e-6) as helped, count(*) filter (where v.anls < u.anls - 1e-6) as hurt from g v, g u where u.rule = 'full' and v.rule like 'without%')
select g.rule, n, round(anls, 6) as anls, round(em, 6) as em, route_counts, round(r.delta, 6) as delta_resize, round(r.low, 6) as low_resize, round(s.delta, 6) as delta_shortest, round(s.low, 6) as low_shortest, s.delta > 0 as p14, r.low > 0 and s.low > 0 as p15,
  helped, hurt, helped = 0 and hurt >= 3 as p16, round((anls - single) / greatest(oracle - single, 1e-9), 6) as recovered from g join c using (rule) join j_r r using (rule) join j_s s using (rule), o, b, h""")
def selector_evaluation(spark, d):
    q = with_candidates(spark, d).select(*KEYS, "gold1", "gold2", "c", F.explode("c").alias("x"))
    g, same = F.array("gold1", "gold2"), F.size(F.filter("c", lambda y: (y["norm"] != "") & (y["norm"] == F.col("x.norm"))))
    long = q.select(*KEYS, "x.route", F.col("x.len").cast("double").alias("len"), same.cast("double").alias("same"), T.anls(F.col("x.pred"), g).alias("anls"), T.exact_match(F.col("x.pred"), g).alias("em"))
    out = Se.evaluate_selectors(long, evaluated(spark, d, BASES), KEYS, ["len", "same"], {"length": ["len"], "agreement": ["same"]}, list(R.ROUTES), FOLDS)
    r6 = [F.round(c, 6).alias(c) for c in ("anls", "em", "delta_resize", "low_resize", "delta_shortest", "low_shortest", "recovered")]
    return out.select("rule", "n", "route_counts", *r6, "p14", "p15", "helped", "hurt", "p16")


_PRE_MODELS = _VARIANTS.replace("w as (select k, m1", "wz as (select k, m1")
_PRE = f"""{_WIDE}, u as (select w.*, length(q.question)::double as x1, len(string_split(q.question, ' '))::double as x2, {_FOLD.replace('conv_id', 'w.conv_id').replace('turn', 'w.turn')} as fold from w join (select conv_id, turn, any_value(question) as question from preds group by 1, 2) q using (conv_id, turn)),
l as (select r.j, r.j as route_no, u.*, case r.j when 0 then a0 when 1 then a1 else a2 end as y from u, range(3) r(j)),
f as (select r.k * 3 + l.j as k, x1, x2, y from l, range(3) r(k) where l.fold <> r.k), {_PRE_MODELS},
p as (select u.*, r.k, {', '.join(f"max(case when wz.k % 3 = {j} then my + w1 * (x1 - m1) + w2 * (x2 - m2) end) as p{j}" for j in range(3))} from u, range(3) r(k), wz where wz.rule = 'full' and wz.k // 3 = r.k group by all),
z as (select *, greatest(p0, p1, p2) - p0 as gain, case when p0 >= p1 and p0 >= p2 then 0 when p1 >= p2 then 1 else 2 end as alt from p),
y as (select *, case alt when 0 then a0 when 1 then a1 else a2 end - a0 as lead from z),
tz as (select y.k, m.v as margin, sum(case when gain > m.v then lead else 0 end) as s from y, (select unnest({list(Se.MARGINS)})::double as v) m where y.fold <> y.k group by 1, 2),
best as (select tz.k, min(margin) as margin from tz join (select k, max(s) as s from tz group by 1) b on b.k = tz.k and tz.s >= b.s - 1e-9 group by 1),
routed as (select y.*, best.margin, case when gain > best.margin then alt else 0 end as pick from y join best using (k) where fold = k)"""


def routed_before(spark, d):
    q = V.questions(spark, d).select(*KEYS, F.length("question").cast("double").alias("x1"), F.size(F.split("question", " ")).cast("double").alias("x2"))
    return Se.route_before(wide_scores(spark, d).join(q, KEYS), KEYS, ["x1", "x2"], list(R.ROUTES), folds=FOLDS)


@query("q213_pre_router", f"with {_PRE} select conv_id, turn, case pick when 0 then 'resize' when 1 then 'bm25' else 'learned' end as route, round(gain, 6) as gain from routed")
def pre_router(spark, d):
    return routed_before(spark, d)[0].select(*KEYS, "route", F.round("gain", 6).alias("gain"))


@query("q214_pre_router_report", f"""
with {_PRE}, mz as (select avg(a0) as m0, avg(a1) as m1, avg(a2) as m2 from routed), bz as (select case when m0 >= m1 and m0 >= m2 then 0 when m1 >= m2 then 1 else 2 end as base from mz),
v as (select case pick when 0 then a0 when 1 then a1 else a2 end as got, greatest(a0, a1, a2) as best, case base when 0 then a0 when 1 then a1 else a2 end as own, base from routed, bz)
select count(*) as n, case max(base) when 0 then 'resize' when 1 then 'bm25' else 'learned' end as best_single, round(avg(got), 6) as routed, round(avg(own), 6) as base, round(avg(best), 6) as oracle, round((avg(got) - avg(own)) / greatest(avg(best) - avg(own), 1e-9), 6) as recovered,
  round(avg((got >= best - 1e-9)::int), 6) as optimal_rate, count(*) filter (where got - own > 1e-9) as wins, count(*) filter (where abs(got - own) <= 1e-9) as ties, count(*) filter (where got - own < -1e-9) as losses from v""")
def pre_router_report(spark, d):
    out = Se.router_report(routed_before(spark, d)[0], list(R.ROUTES))
    r6 = [F.round(c, 6).alias(c) for c in ("routed", "base", "oracle", "recovered", "optimal_rate")]
    return out.select("n", "best_single", *r6, "wins", "ties", "losses")


#: Weights of the sweep: of the score, of the place in the table and of the length; the rest goes to the first.
GRID = [(a, b, c) for a, b, c in itertools.product((0.4, 0.5, 0.6, 0.7), (0.1, 0.15, 0.2, 0.25), (0.05, 0.1, 0.15))]


@query("q215_weight_sweep", f"""
with {_PL}, c as (select row_number() over () - 1 as config, w.* from (values {', '.join(f"({a}::double, {b}::double, {c}::double)" for a, b, c in GRID)}) w(a, b, c)),
s as (select config, question_id, pl.doc_id, strict, soft, round(a * (score / 97.0::double) + b * ((pl.doc_id % 10) / 10.0::double) + c * ((d.n_chars % 13) / 13.0::double), 12) as s from pl join documents d using (doc_id), c),
r as (select *, row_number() over (partition by config, question_id order by s desc, doc_id) as rank from s), q as (select config, question_id, coalesce(bool_or(strict and rank <= 2), false)::int as st, coalesce(bool_or((strict or soft) and rank <= 2), false)::int as an from r group by 1, 2)
select config::integer as config, avg(st) as strict_rate, avg(an) as any_rate, count(*) as n, row_number() over (order by avg(st) desc, avg(an) desc, config) as place from q group by config""")
def weight_sweep(spark, d):
    x = patch_labels(spark, d).join(V.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    x = x.select("question_id", "doc_id", "strict", (F.col("strict") | F.col("soft")).alias("any"), (F.col("score") / 97).alias("x1"), (F.col("doc_id") % 10 / 10).alias("x2"), (F.col("n_chars") % 13 / 13).alias("x3"))
    return Se.weight_sweep(x, "question_id", "doc_id", ["x1", "x2", "x3"], [list(w) for w in GRID], "strict", "any")
