"""Queries of answer selection: rules, their evaluation, features, ablations, margins and taxonomy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import routing as R
from ..sources import views as V
from . import sqltext as S
from .registry import query
from .text_queries import PTYPE, _QTYPE

_N = lambda r: S.answer(r)
#: Long form with everything that the rules look at.
LONG = f"""{S.PREDS},
t as (select *, {S.answer('pred')} as norm, {PTYPE} as ptype, {S.match('pred')} <> '' and contains({S.match('page')}, {S.match('pred')}) as grounded, lower(coalesce(question, '')) as lq from preds),
x as (select *, length(norm) as len, {_QTYPE} as qtype, greatest({S.anls('pred', 'gold1')}, {S.anls('pred', 'gold2')}) as anls,
  case when norm in ({S.answer('gold1')}, {S.answer('gold2')}) then 1.0 else 0.0 end::double as em,
  count(*) filter (where norm <> '') over (partition by conv_id, turn, norm) as same, min(pos) over (partition by conv_id, turn, norm) as first from t)"""
_PICK = "select conv_id, turn, coalesce(arg_min(route, {key}) filter (where {cond}), 'resize') as route from x group by 1, 2"


def pick(cond: str, key: str) -> str:
    return f"select conv_id, turn, arg_min(route, {key}) filter (where {cond}) as route from x group by conv_id, turn"


SHORT, MAJOR = "len * 10 + pos", "(10 - same) * 1000 + first * 10 + case when route = 'resize' then 0 else 1 + pos end"
RULES_SQL = f"""{LONG},
k as (select distinct conv_id, turn, question from x),
d as (select conv_id, turn, count(distinct norm) filter (where norm <> '') as n, max(same) filter (where norm <> '') as most, bool_or(route = 'bm25' and norm <> '') as b, bool_or(route = 'learned' and norm <> '') as l from x group by 1, 2),
p1 as ({pick("norm <> ''", SHORT)}), p2 as ({pick("norm <> ''", "-len * 10 + case when route = 'resize' then 0 else 1 + pos end")}), p3 as ({pick("norm <> ''", MAJOR)}),
p4 as ({pick("norm <> '' and grounded", SHORT)}), p5 as ({pick("norm <> '' and list_contains(fits, ptype)", SHORT)} ),
p6 as ({pick("norm <> '' and grounded", "pos")}),
all_ as (select k.conv_id, k.turn, d.n, d.most, d.b, d.l, coalesce(p1.route, 'resize') as short, coalesce(p2.route, 'resize') as long, coalesce(p3.route, 'resize') as major, p4.route as grounded, p5.route as typed, p6.route as gfirst
  from k join d using (conv_id, turn) join p1 using (conv_id, turn) join p2 using (conv_id, turn) join p3 using (conv_id, turn) join p4 using (conv_id, turn) join p5 using (conv_id, turn) join p6 using (conv_id, turn)),
picks as (
  select conv_id, turn, 'resize' as rule, 'resize' as route from all_ union all select conv_id, turn, 'bm25', case when b then 'bm25' else 'resize' end from all_
  union all select conv_id, turn, 'majority_vote', major from all_ union all select conv_id, turn, 'resize_on_disagree', case when n <= 1 then major else 'resize' end from all_
  union all select conv_id, turn, 'bm25_on_disagree', case when n <= 1 then major when b then 'bm25' else 'resize' end from all_
  union all select conv_id, turn, 'learned_on_disagree', case when n <= 1 then major when l then 'learned' else 'resize' end from all_
  union all select conv_id, turn, 'shortest_nonempty', short from all_ union all select conv_id, turn, 'longest_nonempty', long from all_
  union all select conv_id, turn, 'consensus_first', case when most >= 2 then major else short end from all_
  union all select conv_id, turn, 'answer_type_shortest', coalesce(typed, short) from all_
  union all select conv_id, turn, 'grounded_shortest', coalesce(grounded, short) from all_ union all select conv_id, turn, 'grounded_first', coalesce(gfirst, short) from all_)"""
_FITS = "case " + " ".join(f"when qtype = '{q}' then [{', '.join(repr(v) for v in fits)}]" for q, fits in T.TYPE_MATCHES.items()) + " end"
RULES_SQL = RULES_SQL.replace("list_contains(fits, ptype)", f"list_contains({_FITS}, ptype)")
NAMES = ("resize", "bm25", "majority_vote", "resize_on_disagree", "bm25_on_disagree", "learned_on_disagree", "shortest_nonempty", "longest_nonempty", "consensus_first", "answer_type_shortest", "grounded_shortest", "grounded_first")


def with_candidates(spark, d, dealt=lambda q: q):
    q = dealt(V.questions(spark, d))
    return q.withColumn("c", R.prepared(F.col("page"), **{r: F.col(r) for r in R.ROUTES}))


def evaluated(spark, d, names=NAMES):
    """A row per question and rule: (conv_id, turn, rule, route, anls, em).

    The outer explode keeps Spark from testing the array's size, with all rules written out, as a condition of the join below."""
    q = with_candidates(spark, d)
    rules = R.rules(F.col("c"), F.col("question"), F.concat_ws(":", "conv_id", "turn"))
    q = q.withColumn("p", F.array(*[F.struct(F.lit(n).alias("rule"), rules[n].alias("route")) for n in names]))
    golds = F.array("gold1", "gold2")
    scores = F.map_from_arrays(F.array(*[F.lit(r) for r in R.ROUTES]), F.array(*[F.struct(T.anls(F.col(r), golds).alias("anls"), T.exact_match(F.col(r), golds).alias("em")) for r in R.ROUTES]))
    q = q.withColumn("s", scores).select("conv_id", "turn", "s", F.explode_outer("p").alias("p"))
    return q.select("conv_id", "turn", "p.rule", "p.route", F.col("s")[F.col("p.route")]["anls"].alias("anls"), F.col("s")[F.col("p.route")]["em"].alias("em"))


@query("q01_grounded_shortest", f"""
with {RULES_SQL}
select p.route, count(*) as n, round(avg(x.anls), 6) as mean_anls, round(avg(x.em), 6) as mean_em from picks p join x on x.conv_id = p.conv_id and x.turn = p.turn and x.route = p.route where p.rule = 'grounded_shortest' group by 1""")
def grounded_shortest(spark, d):
    return evaluated(spark, d, ("grounded_shortest",)).groupBy("route").agg(F.count("*").alias("n"), F.round(F.avg("anls"), 6).alias("mean_anls"), F.round(F.avg("em"), 6).alias("mean_em"))


def _picks(name: str):
    def run(spark, d):
        return evaluated(spark, d, (name,)).select("conv_id", "turn", "route")

    return run


for _q, _n in (("q51_majority", "majority_vote"), ("q52_consensus", "consensus_first"), ("q53_longest", "longest_nonempty"), ("q53b_shortest", "shortest_nonempty"), ("q52b_learned_on_disagree", "learned_on_disagree"), ("q52c_typed_shortest", "answer_type_shortest")):
    query(_q, f"with {RULES_SQL} select conv_id, turn, route from picks where rule = '{_n}'")(_picks(_n))


@query("q54_digits", rf"""
with {LONG}, z as (select *, regexp_replace(question, '\D+', '', 'g') as qd, regexp_replace(norm, '\D+', '', 'g') as pd from x),
s as (select *, case when qd = '' then length(pd) else len(list_filter(string_split(qd, ''), lambda c: c <> '' and contains(pd, c))) end as score from z)
select conv_id, turn, coalesce(arg_min(route, -score * 10 + case when route = 'resize' then 0 else 1 + pos end) filter (where norm <> ''), 'resize') as route from s group by 1, 2""")
def digits(spark, d):
    q = with_candidates(spark, d)
    return q.select("conv_id", "turn", R.digit_overlap(F.col("c"), F.col("question")).alias("route"))


@query("q51b_rule_table", f"""
with {RULES_SQL}, e as (select p.*, x.anls, x.em from picks p join x on x.conv_id = p.conv_id and x.turn = p.turn and x.route = p.route)
select rule, round(avg(anls), 6) as mean_anls, round(avg(em), 6) as mean_em, count(*) filter (where route = 'resize') as n_resize, count(*) filter (where route = 'bm25') as n_bm25, count(*) filter (where route = 'learned') as n_ler from e group by 1""")
def rule_table(spark, d):
    return evaluated(spark, d).groupBy("rule").agg(F.round(F.avg("anls"), 6).alias("mean_anls"), F.round(F.avg("em"), 6).alias("mean_em"), *[F.count_if(F.col("route") == r).alias(a) for r, a in (("resize", "n_resize"), ("bm25", "n_bm25"), ("learned", "n_ler"))])


def wide_scores(spark, d):
    q = V.questions(spark, d)
    g = F.array("gold1", "gold2")
    return q.select("conv_id", "turn", *[T.anls(F.col(r), g).alias(f"a_{r}") for r in R.ROUTES], *[T.exact_match(F.col(r), g).alias(f"e_{r}") for r in R.ROUTES])


_WIDE = f"""{LONG}, w as (select conv_id, turn, max(anls) filter (where pos = 0) as a0, max(anls) filter (where pos = 1) as a1, max(anls) filter (where pos = 2) as a2, max(em) filter (where pos = 0) as e0, max(em) filter (where pos = 1) as e1, max(em) filter (where pos = 2) as e2 from x group by 1, 2)"""


@query("q55_oracle_best", f"""
with {_WIDE} select count(*) as n, round(avg(greatest(a0, a1, a2)), 6) as oracle_anls, round(avg(case when a0 >= a1 and a0 >= a2 then e0 when a1 >= a2 then e1 else e2 end), 6) as oracle_em,
  round(avg(greatest(a0, a1, a2)) - avg(a0), 6) as headroom from w""")
def oracle_best(spark, d):
    a, e = F.array(*[f"a_{r}" for r in R.ROUTES]), F.array(*[f"e_{r}" for r in R.ROUTES])
    w = wide_scores(spark, d).select(F.array_max(a).alias("best"), F.element_at(e, F.array_position(a, F.array_max(a)).cast("int")).alias("em"), "a_resize")
    return w.agg(F.count("*").alias("n"), F.round(F.avg("best"), 6).alias("oracle_anls"), F.round(F.avg("em"), 6).alias("oracle_em"), F.round(F.avg("best") - F.avg("a_resize"), 6).alias("headroom"))


def _sim(a: str, b: str) -> str:
    return f"case when {a} = '' and {b} = '' then 1.0 when {a} = '' or {b} = '' then 0.0 else 1.0 - {S.edits(a, b)}::double / greatest(length({a}), length({b})) end"


@query("q56_route_features", rf"""
with {LONG}, p as (select a.conv_id, a.turn, a.route, count(*) filter (where a.norm <> '' and a.norm = b.norm) as agree_count, avg({_sim('a.norm', 'b.norm')}) as edit_sim_mean, max({_sim('a.norm', 'b.norm')}) as edit_sim_max,
  bool_or(a.norm <> '' and b.norm <> '' and a.norm <> b.norm and contains(b.norm, a.norm)) as is_substring_of_other from x a join x b on a.conv_id = b.conv_id and a.turn = b.turn and a.route <> b.route group by 1, 2, 3)
select x.conv_id, x.turn, x.route, cast(length(pred) as bigint) as len_chars, cast(len(list_filter(string_split(norm, ' '), lambda w: w <> '')) as bigint) as len_tokens, norm = '' as is_empty,
  length(regexp_replace(pred, '[^0-9]', '', 'g'))::double / greatest(length(pred), 1) as digit_frac, ptype, qtype, list_contains({_FITS}, ptype) as type_match, grounded,
  p.agree_count, round(p.edit_sim_mean, 9) as edit_sim_mean, p.edit_sim_max, p.is_substring_of_other from x join p on p.conv_id = x.conv_id and p.turn = x.turn and p.route = x.route""")
def route_features(spark, d):
    q = with_candidates(spark, d).withColumn("qtype", T.question_type(F.col("question")))
    x = q.select("conv_id", "turn", "qtype", "c", F.explode("c").alias("x"))
    n = F.col("x.norm")
    others = F.filter("c", lambda y: y["route"] != F.col("x.route"))
    sims = F.transform(others, lambda y: T.similarity(n, y["norm"]))
    words = F.filter(F.split(n, " "), lambda w: w != "")
    return x.select(
        "conv_id", "turn", F.col("x.route").alias("route"), F.length("x.pred").cast("long").alias("len_chars"), F.size(words).cast("long").alias("len_tokens"), (n == "").alias("is_empty"),
        (F.length(F.regexp_replace("x.pred", "[^0-9]", "")) / F.greatest(F.length("x.pred"), F.lit(1))).alias("digit_frac"), F.col("x.ptype").alias("ptype"), "qtype",
        (T.type_match(F.col("qtype"), F.col("x.ptype")) > 0.5).alias("type_match"), F.col("x.grounded").alias("grounded"),
        F.size(F.filter(others, lambda y: (n != "") & (y["norm"] == n))).cast("long").alias("agree_count"),
        F.round(F.aggregate(sims, F.lit(0.0), lambda s, v: s + v) / F.size(sims), 9).alias("edit_sim_mean"), F.array_max(sims).alias("edit_sim_max"),
        F.exists(others, lambda y: (n != "") & (y["norm"] != "") & (y["norm"] != n) & F.contains(y["norm"], n)).alias("is_substring_of_other"),
    )


@query("q57_long_unpivot", f"with {LONG} select conv_id, turn, route, pred, grounded, anls, em from x")
def long_unpivot(spark, d):
    g = F.array("gold1", "gold2")
    x = with_candidates(spark, d).select("conv_id", "turn", "gold1", "gold2", F.explode("c").alias("x"))
    return x.select("conv_id", "turn", "x.route", "x.pred", "x.grounded", T.anls(F.col("x.pred"), g).alias("anls"), T.exact_match(F.col("x.pred"), g).alias("em"))


@query("q58_ablation_grid", f"""
with {LONG}, g as (select conv_id, turn, coalesce(arg_min(route, {SHORT}) filter (where norm <> '' and grounded), arg_min(route, {SHORT}) filter (where norm <> ''), 'resize') as whole,
  coalesce(arg_min(route, pos) filter (where norm <> '' and grounded), arg_min(route, {SHORT}) filter (where norm <> ''), 'resize') as no_length, coalesce(arg_min(route, {SHORT}) filter (where norm <> ''), 'resize') as no_page,
  coalesce(arg_min(route, {SHORT}) filter (where norm <> '' and grounded and route <> 'bm25'), arg_min(route, {SHORT}) filter (where norm <> '' and route <> 'bm25'), 'resize') as no_bm25 from x group by 1, 2),
l as (select conv_id, turn, unnest(['full', 'no_length', 'no_page', 'no_bm25']) as variant, unnest([whole, no_length, no_page, no_bm25]) as route from g)
select variant, round(avg(anls), 6) as mean_anls, round(avg(em), 6) as mean_em from l join x using (conv_id, turn, route) group by 1""")
def ablation_grid(spark, d):
    q = with_candidates(spark, d)
    c, less = F.col("c"), F.filter("c", lambda x: x["route"] != "bm25")
    picks = {"full": R.grounded_shortest(c), "no_length": R.grounded_shortest(c, use_length=False), "no_page": R.grounded_shortest(c, use_ocr=False), "no_bm25": R.grounded_shortest(less)}
    g = F.array("gold1", "gold2")
    x = q.withColumn("v", F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), p.alias("route")) for k, p in picks.items()])))
    pred = F.filter("c", lambda y: y["route"] == F.col("v.route"))[0]["pred"]
    x = x.select("v.variant", T.anls(pred, g).alias("anls"), T.exact_match(pred, g).alias("em"))
    return x.groupBy("variant").agg(F.round(F.avg("anls"), 6).alias("mean_anls"), F.round(F.avg("em"), 6).alias("mean_em"))


_MARGIN = f"""{_WIDE}, m as (select *, greatest(a0, a1 * 0.9, a2 * 0.95) as top from w), r as (select *, case when top - a0 <= 0.05 then 0 when a1 * 0.9 >= a2 * 0.95 then 1 else 2 end as pick from m)"""


@query("q59_margin_route", f"with {_MARGIN} select conv_id, turn, case pick when 0 then 'resize' when 1 then 'bm25' else 'learned' end as route from r")
def margin_route(spark, d):
    return margins(spark, d).select("conv_id", "turn", "route")


def margins(spark, d, margin: float = 0.05):
    """The best predicted reader unless its gain over the default is at most the margin; predictions stand in for a model's."""
    w = wide_scores(spark, d)
    b, l = F.col("a_bm25") * 0.9, F.col("a_learned") * 0.95  # noqa: E741
    top = F.greatest("a_resize", b, l)
    route = F.when(top - F.col("a_resize") <= margin, "resize").when(b >= l, "bm25").otherwise("learned")
    return w.withColumn("route", route)


@query("q60_scorecard", f"""
with {_MARGIN}, s as (select *, case pick when 0 then a0 when 1 then a1 else a2 end as got, greatest(a0, a1, a2) as best from r)
select round(avg(got), 6) as routed, round(avg(a0), 6) as base, round(avg((got >= best - 1e-9)::int), 6) as optimal_rate, count(*) filter (where got > a0 + 1e-9) as wins, count(*) filter (where abs(got - a0) <= 1e-9) as ties, count(*) filter (where got < a0 - 1e-9) as losses,
  round(case when avg(best) - avg(a0) > 1e-9 then (avg(got) - avg(a0)) / (avg(best) - avg(a0)) else 0 end, 6) as recovered from s""")
def scorecard(spark, d):
    x = margins(spark, d)
    got = F.when(F.col("route") == "resize", F.col("a_resize")).when(F.col("route") == "bm25", F.col("a_bm25")).otherwise(F.col("a_learned"))
    x = x.select(got.alias("got"), "a_resize", F.greatest("a_resize", "a_bm25", "a_learned").alias("best"))
    g, a = F.col("got"), F.col("a_resize")
    room = F.avg("best") - F.avg("a_resize")
    return x.agg(
        F.round(F.avg("got"), 6).alias("routed"), F.round(F.avg("a_resize"), 6).alias("base"), F.round(F.avg((g >= F.col("best") - 1e-9).cast("int")), 6).alias("optimal_rate"),
        F.count_if(g > a + 1e-9).alias("wins"), F.count_if(F.abs(g - a) <= 1e-9).alias("ties"), F.count_if(g < a - 1e-9).alias("losses"),
        F.round(F.when(room > 1e-9, (F.avg("got") - F.avg("a_resize")) / room).otherwise(0.0), 6).alias("recovered"),
    )


@query("q62_taxonomy", f"""
with {RULES_SQL}, e as (select p.conv_id, p.turn, max(p.route) filter (where p.rule = 'grounded_shortest') as r, max(p.route) filter (where p.rule = 'shortest_nonempty') as s from picks p group by 1, 2),
v as (select e.*, max(x.anls) filter (where x.route = e.r) as ra, max(x.em) filter (where x.route = e.r) as re, bool_or(x.grounded) filter (where x.route = e.r) as g, max(x.anls) filter (where x.route = e.s) as sa,
  max({S.match('pred')}) filter (where x.route = e.r) as rp, max({S.match('pred')}) filter (where pos = 0) as p0, max(anls) filter (where pos = 0) as a0, max(anls) filter (where pos = 1) as a1, max(anls) filter (where pos = 2) as a2,
  max(em) filter (where pos = 0) as e0, bool_or(grounded) filter (where pos = 0) as g0, count(*) filter (where anls >= 0.999) as right, count(distinct {S.match('pred')}) filter (where anls >= 0.999) as ways,
  any_value(list_distinct(list_filter(list_transform([gold1, gold2], lambda t: {S.match('t')}), lambda t: t <> ''))) as golds from e join x using (conv_id, turn) group by all),
f as (select *, list_filter([case when a0 <= 1e-9 and a1 <= 1e-9 and a2 <= 1e-9 and ra <= 1e-9 then 'F1' end, case when ra >= 0.999 and not g then 'F2' end, case when ra <= 1e-9 and g and s = r and greatest(a0, a1, a2) >= 0.999 then 'F3' end,
  case when "right" >= 2 and ways >= 2 then 'F4' end, case when ra >= 0.9 and re <= 1e-9 and g then 'F5' end, case when ra >= 0.5 and ra < 0.999 and not g then 'F6' end,
  case when ra >= 0.2 and ra < 0.9 and g and len(list_filter(golds, lambda t: length(t) > length(rp))) > 0 then 'F7' end, case when len(golds) > 1 and ra < 0.999 then 'F8' end], lambda l: l is not null) as fl,
  list_filter([case when ra >= 0.999 and r in ('bm25', 'learned') and a0 < 0.999 then 'S3' end, case when ra >= 0.999 and r = 'resize' and s <> 'resize' and least(a1, a2) < 0.999 then 'S4' end, case when ra >= 0.999 and a0 < 0.999 and not g0 then 'S2' end,
  case when ra >= 0.999 and a0 < 0.999 and length(rp) < length(p0) then 'S1' end, case when ra >= 0.999 and a0 >= 0.9 and e0 <= 1e-9 and re >= 0.999 then 'S5' end, case when ra >= 0.999 and r <> s and sa < 0.999 then 'S6' end], lambda l: l is not null) as sl from v)
select conv_id, turn, case when len(fl) > 0 then fl[1] when len(sl) > 0 then sl[1] when ra >= 0.999 then 'S6' else 'F8' end as primary_label, case when len(fl) > 0 then fl[2] else sl[2] end as secondary_label from f""")
def taxonomy(spark, d):
    q = with_candidates(spark, d)
    g = F.array("gold1", "gold2")
    for r in R.ROUTES:
        q = q.withColumn(f"a_{r}", T.anls(F.col(r), g)).withColumn(f"e_{r}", T.exact_match(F.col(r), g))
    q = q.withColumn("r", R.grounded_shortest(F.col("c"))).withColumn("s", R.shortest(F.col("c")))
    grounded = lambda route: F.filter("c", lambda x: x["route"] == route)[0]["grounded"]
    q = q.select("conv_id", "turn", L.taxonomy({x: (F.col(x), F.col(f"a_{x}"), F.col(f"e_{x}"), grounded(F.lit(x))) for x in R.ROUTES}, F.col("r"), F.col("s"), g).alias("t"))
    return q.select("conv_id", "turn", F.col("t")[0].alias("primary_label"), F.get("t", F.lit(1)).alias("secondary_label"))


@query("q56b_cost_table", f"""
with {S.RUNS}, m as (select method, median(value) as seconds from runs group by 1)
select method as reader, round(seconds, 6) as seconds, 1 as calls from m union all select 'three_calls', round(sum(seconds), 6), 3 from m where method in ('click', 'view', 'error')""")
def cost_table(spark, d):
    m = V.runs(spark, d).groupBy("method").agg(F.median("value").alias("seconds"))
    one = m.select(F.col("method").alias("reader"), F.round("seconds", 6).alias("seconds"), F.lit(1).alias("calls"))
    three = m.where("method in ('click', 'view', 'error')").agg(F.round(F.sum("seconds"), 6).alias("seconds")).select(F.lit("three_calls").alias("reader"), "seconds", F.lit(3).alias("calls"))
    return one.unionByName(three)
