"""Queries of gates, packed results, reader swaps, label density, coordinate joins, gap reports and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions import text as T
from ..operators import gates as Gt
from ..operators import joins as J
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import routing as R
from ..operators import scores as Sc
from ..operators import selection as Sel
from ..sources import views as V
from . import sqltext as S
from .metric_queries import _PL, patch_labels
from .registry import query
from .routing_queries import RULES_SQL, evaluated
from .source_queries import _FEATS
from .spatial_queries import _IOU, _SCORED, patches, scored_pools

_BOOT = "cast(concat('0x', substr(md5(concat('42:', rule, ':', b, ':', pos)), 1, 8)) as bigint)"


def _ends(base: str, name: str) -> str:
    return f"""d_{name} as (select e.rule, e.id, e.anls - b.anls as diff from e join e b on b.id = e.id and b.rule = '{base}'),
p_{name} as (select rule, diff, row_number() over (partition by rule order by id) - 1 as pos, count(*) over (partition by rule) as n from d_{name}),
w_{name} as (select rule, b, {_BOOT} % n as pos from p_{name}, range(200) t(b)),
m_{name} as (select w.rule, b, avg(diff) as m from w_{name} w join p_{name} p on p.rule = w.rule and p.pos = w.pos group by 1, 2),
i_{name} as (select rule, quantile_cont(m, 0.025) as low, quantile_cont(m, 0.975) as high from m_{name} group by 1),
j_{name} as (select i_{name}.*, delta from i_{name} join (select rule, avg(diff) as delta from d_{name} group by 1) using (rule))"""


PACKED = ("resize", "shortest_nonempty", "grounded_shortest", "majority_vote", "answer_type_shortest")
_PACK = f"""e as (select p.rule, p.conv_id * 1000 + p.turn as id, p.route, x.anls, x.em from picks p join x on x.conv_id = p.conv_id and x.turn = p.turn and x.route = p.route where p.rule in {PACKED}),
{_ends('resize', 'r')}, {_ends('shortest_nonempty', 's')},
g as (select rule, count(*) as n, avg(anls) as anls, avg(em) as em, string_agg(distinct route, ',' order by route) as routes from e group by 1),
kz as (select g.*, r.delta as dr, r.low as lr, r.high as hr, s.delta as ds, s.low as ls, s.high as hs from g join j_r r using (rule) join j_s s using (rule))"""


def packed(spark, d):
    e = evaluated(spark, d, PACKED).withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return Gt.pack(e, "id")


@query("q120_packed_results", f"""
with {RULES_SQL}, {_PACK}
select rule, n, round(anls, 6) as anls, round(em, 6) as em, routes, round(dr, 6) as delta_resize, round(lr, 6) as low_resize, round(hr, 6) as high_resize, round(ds, 6) as delta_shortest, round(ls, 6) as low_shortest, round(hs, 6) as high_shortest,
  case when rule = 'grounded_shortest' then 'production' else 'comparator' end as role, anls >= 0.805 as target_anls_met, em >= 0.705 as target_em_met from kz""")
def packed_results(spark, d):
    r6 = [F.round(c, 6).alias(c) for c in ("anls", "em", "delta_resize", "low_resize", "high_resize", "delta_shortest", "low_shortest", "high_shortest")]
    return packed(spark, d).select("rule", "n", "routes", *r6, "role", "target_anls_met", "target_em_met")


@query("q121_selector_gates", f"""
with {RULES_SQL}, {_PACK}
select rule, ds > 0 as p14, lr > 0 and ls > 0 as p15, case when dr > 0 and lr > 0 and ds > 0 and ls > 0 then 'PASS' when (dr > 0 and lr > 0) or (ds > 0 and ls > 0) then 'PARTIAL' else 'FAIL' end as p17,
  case when dr > 0 and lr > 0 and ds > 0 and ls > 0 then 'FULL TRANSFER' when dr > 0 and lr > 0 then 'PARTIAL TRANSFER' else 'FAIL' end as p18 from kz""")
def selector_gates(spark, d):
    return packed(spark, d).select("rule", "p14", "p15", "p17", "p18")


_SWAPPED = RULES_SQL.replace("'resize' as route, resize as pred", "'resize' as route, learned as pred")


@query("q122_reader_swap", f"""
with {_SWAPPED}, tz as (select conv_id, turn, greatest({S.anls('resize', 'gold1')}, {S.anls('resize', 'gold2')}) as base from qa),
e as (select p.rule, x.anls, tz.base from picks p join x on x.conv_id = p.conv_id and x.turn = p.turn and x.route = p.route join tz on tz.conv_id = p.conv_id and tz.turn = p.turn where p.rule in ('grounded_shortest', 'majority_vote'))
select rule, count(*) as n, round(avg(anls), 6) as swapped, round(avg(base), 6) as base, round(avg(anls - base), 6) as delta, count(*) filter (where anls > base + 1e-9) as wins, count(*) filter (where anls < base - 1e-9) as losses from e group by 1""")
def reader_swap(spark, d):
    """One reader's answers replaced by another's, the rules run again, compared with the replaced reader's true answers."""
    q = R.swapped(V.questions(spark, d), "resize", "learned")
    c = R.prepared(F.col("page"), **{r: F.col(r) for r in R.ROUTES})
    g = F.array("gold1", "gold2")
    q = q.withColumn("c", c)
    rules = R.rules(F.col("c"), F.col("question"), F.concat_ws(":", "conv_id", "turn"))
    q = q.select("true_resize", *[T.anls(F.col(r), g).alias(f"a_{r}") for r in R.ROUTES], T.anls(F.col("true_resize"), g).alias("base"), F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), rules[n].alias("route")) for n in ("grounded_shortest", "majority_vote")])).alias("p"))
    got = F.when(F.col("p.route") == "resize", F.col("a_resize")).when(F.col("p.route") == "bm25", F.col("a_bm25")).otherwise(F.col("a_learned"))
    q = q.select("p.rule", got.alias("got"), "base")
    delta = F.col("got") - F.col("base")
    return q.groupBy("rule").agg(F.count("*").alias("n"), F.round(F.avg("got"), 6).alias("swapped"), F.round(F.avg("base"), 6).alias("base"), F.round(F.avg(delta), 6).alias("delta"), F.count_if(delta > 1e-9).alias("wins"), F.count_if(delta < -1e-9).alias("losses"))


@query("q123_label_density", f"""
with {_PL} select question_id, count(*) as num_candidates, count(*) filter (where strict or soft) as num_positive_any, count(*) filter (where strict) as num_positive_strict, count(*) filter (where soft and not strict) as num_positive_soft_only,
  count(*) filter (where strict or soft)::double / greatest(1, count(*)) as positive_fraction_any, count(*) filter (where strict)::double / greatest(1, count(*)) as positive_fraction_strict from pl group by 1""")
def label_density(spark, d):
    return Gt.label_density(patch_labels(spark, d), ["question_id"])


@query("q124_coordinate_join", f"""
with {S.PATCHES}, c as (select *, case when idx % 3 = 0 then null else (idx * 7 % 11)::double end as s, case when idx % 4 = 0 then null else (idx * 5 % 13)::double end as a from patches)
select image_id, idx, s is not null as has_strict, a is not null as has_any, case when s is null and a is null then null else round(0.6::double * coalesce(s, 0) + 0.4::double * coalesce(a, 0), 9) end as combined,
  row_number() over (partition by image_id order by case when s is null and a is null then '-infinity'::double else 0.6::double * coalesce(s, 0) + 0.4::double * coalesce(a, 0) end desc, idx) as place from c""")
def coordinate_join(spark, d):
    from pyspark.sql import Window

    p = patches(spark, d)
    keys = ["image_id", "x", "y", "w", "h"]
    strict = p.where("idx % 3 <> 0").select(*keys, (F.col("idx") * 7 % 11).cast("double").alias("score"))
    any_ = p.where("idx % 4 <> 0").select(*keys, (F.col("idx") * 5 % 13).cast("double").alias("score"))
    x = Gt.coordinate_scores(p, strict, any_, ["image_id"])
    there = lambda c: F.col(c) > float("-inf")
    place = F.row_number().over(Window.partitionBy("image_id").orderBy(F.col("combined").desc(), "idx")).cast("long")
    return x.select("image_id", "idx", there("strict").alias("has_strict"), there("any").alias("has_any"), F.when(there("combined"), F.round("combined", 9)).alias("combined"), place.alias("place"))


_FLAGS = f"""{_PL}, r as (select *, row_number() over (partition by question_id order by strict::int + soft::int desc, doc_id) as rank from pl),
f as (select question_id, bool_or(score > 90) as fullpage_answer, bool_or(strict or soft) as evidence, bool_or(strict) as exact, bool_or(strict and score > 50) as box_overlap, bool_or(soft) as soft_token, bool_or(soft and score < 30) as fuzzy,
  bool_or((strict or soft) and rank <= 2) as oracle_evidence, bool_or(strict and score > 80 and rank <= 2) as oracle_exact from r group by 1)"""
FLAGS = ["fullpage_answer", "evidence", "exact", "box_overlap", "soft_token", "fuzzy", "oracle_evidence", "oracle_exact"]
BUCKETS = {"fullpage_yes_evidence_no": ("fullpage_answer", "evidence"), "fullpage_yes_box_overlap_no": ("fullpage_answer", "box_overlap"), "box_overlap_yes_exact_no": ("box_overlap", "exact"), "evidence_yes_exact_no": ("evidence", "exact"), "fullpage_yes_oracle_exact_no": ("fullpage_answer", "oracle_exact")}


@query("q217_seam_gate", f"""
with {RULES_SQL}, {_PACK}
select rule, n, round(dr, 6) as delta_resize, round(ds, 6) as delta_original, case when dr > 0 and lr > 0 and ds > 0 and ls > 0 then 'PASS' when dr > 0 and lr > 0 then 'PARTIAL' else 'FAIL' end as status from kz""")
def seam_gate(spark, d):
    """Every rule as if it read compressed pages, against resizing and against the shortest rule as the original selector."""
    wins = {b: (F.col(f"delta_{b}") > 0) & (F.col(f"low_{b}") > 0) for b in ("resize", "shortest")}
    return packed(spark, d).select("rule", "n", F.round("delta_resize", 6).alias("delta_resize"), F.round("delta_shortest", 6).alias("delta_original"), Gt.seam_status(wins["resize"], wins["shortest"]).alias("status"))


@query("q125_gap_report", f"""
with {_FLAGS}, t as (select count(*) as n, {', '.join(f"count(*) filter (where {c}) as {c}" for c in FLAGS)}, {', '.join(f"count(*) filter (where {a} and not {b}) as b_{k}" for k, (a, b) in BUCKETS.items())} from f),
l as ({' union all '.join([f"select '{c}' as metric, {c} as hits, n from t" for c in FLAGS] + [f"select 'bucket_{k}', b_{k}, n from t" for k in BUCKETS] + ["select 'gap', fullpage_answer - oracle_exact, n from t"])})
select metric, hits::double / n as rate, hits, n from l""")
def gap_report(spark, d):
    x = patch_labels(spark, d).withColumn("rel", F.col("strict").cast("int") + F.col("soft").cast("int"))
    r = M.ranked(x, ["question_id"], "rel", "doc_id")
    s, o, any_, top = F.col("strict"), F.col("soft"), F.col("strict") | F.col("soft"), F.col("rank") <= 2
    tests = [F.col("score") > 90, any_, s, s & (F.col("score") > 50), o, o & (F.col("score") < 30), any_ & top, s & (F.col("score") > 80) & top]
    f = r.groupBy("question_id").agg(*[F.bool_or(t).alias(c) for c, t in zip(FLAGS, tests, strict=True)])
    return Gt.gap_report(f, FLAGS, ("fullpage_answer", "oracle_exact"), BUCKETS)


@query("q126_oracle_gate", f"""
with {_PL}, r as (select *, row_number() over (partition by question_id order by strict::int + soft::int desc, doc_id) as rank from pl),
q as (select question_id, bool_or((strict or soft) and rank <= 2)::int as e2, bool_or((strict or soft) and rank <= 4)::int as e4, count(*) as n from r group by 1)
select avg(e2) as oracle_at_2, avg(e4) as oracle_at_4, case when avg(e2) >= 0.15 then 2 when avg(e4) >= 0.3 then 4 end as headline_k, avg(n) between 10 and 100000 and avg(e2) >= 0.1 and avg(e4) >= 0.1 and avg(e2) >= 0 and avg(e4) >= 0.5 as pool_passed,
  abs(avg(e2) - 0.9) <= 0.2 as baseline_passed from q""")
def oracle_gate(spark, d):
    x = patch_labels(spark, d).withColumn("rel", F.col("strict").cast("int") + F.col("soft").cast("int"))
    r = M.ranked(x, ["question_id"], "rel", "doc_id")
    hit = lambda k: F.bool_or((F.col("rel") > 0) & (F.col("rank") <= k)).cast("int")
    q = r.groupBy("question_id").agg(hit(2).alias("e2"), hit(4).alias("e4"), F.count("*").alias("n"))
    a, b, n = F.avg("e2"), F.avg("e4"), F.avg("n")
    limits = {"candidates_min": 10, "candidates_max": 100000, "area_min": 0.1, "centre_min": 0.1, "small_min": 0.0, "edge_min": 0.5}
    return q.agg(a.alias("oracle_at_2"), b.alias("oracle_at_4"), Gt.headline_k(a, b).alias("headline_k"), Gt.candidates_gate(n, a, b, a, b, limits).alias("pool_passed"), Gt.near_target(a, 0.9, 0.2).alias("baseline_passed"))


_COVER = f"""{_PL}, s as (select question_id, doc_id, strict, soft, m.method, case m.method when 'qe' then score + 50 * strict::int when 'base' then score + 20 * strict::int when 'first' then -doc_id else -score end as own from pl, (values ('qe'), ('base'), ('first'), ('worst')) m(method)),
r as (select *, row_number() over (partition by method, question_id order by own desc, doc_id) as rank from s),
q as (select method, question_id, bool_or(strict and rank <= 2)::int::double as st, bool_or((strict or soft) and rank <= 2)::int::double as an from r group by 1, 2),
c as (select method, avg(st) as strict, avg(an) as "any" from q group by 1)"""


def _coverage(spark, d):
    x = patch_labels(spark, d)
    own = {"qe": F.col("score") + 50 * F.col("strict").cast("int"), "base": F.col("score") + 20 * F.col("strict").cast("int"), "first": -F.col("doc_id"), "worst": -F.col("score")}
    x = x.withColumn("m", F.explode(F.array(*[F.struct(F.lit(k).alias("method"), v.cast("double").alias("own")) for k, v in own.items()]))).select("question_id", "doc_id", "strict", "soft", "m.*")
    r = M.ranked(x, ["method", "question_id"], "own", "doc_id")
    top = F.col("rank") <= 2
    return r.groupBy("method", "question_id").agg(F.bool_or(F.col("strict") & top).cast("int").cast("double").alias("st"), F.bool_or((F.col("strict") | F.col("soft")) & top).cast("int").cast("double").alias("an"))


@query("q127_heuristic_gate", f"""
with {_COVER}, x as (select 'strict' as rule, a.question_id as id, a.st - b.st as diff from q a join q b on a.question_id = b.question_id and b.method = 'base' where a.method = 'qe' union all select 'any', a.question_id, a.an - b.an from q a join q b on a.question_id = b.question_id and b.method = 'base' where a.method = 'qe'),
p as (select rule, diff, row_number() over (partition by rule order by id) - 1 as pos, count(*) over (partition by rule) as n from x), w as (select rule, b, {_BOOT} % n as pos from p, range(200) t(b)),
m as (select w.rule, b, avg(diff) as m from w join p on p.rule = w.rule and p.pos = w.pos group by 1, 2), i as (select rule, quantile_cont(m, 0.025) as low from m group by 1),
g as (select count(*) = 2 and bool_and(e.mean >= 0 and i.low >= -0.02) as ok from i join (select rule, avg(diff) as mean from x group by 1) e using (rule)),
o as (select max(strict) filter (where method = 'qe') as s, max("any") filter (where method = 'qe') as a, max(strict) filter (where method = 'base') as bs, max("any") filter (where method = 'base') as ba, max(strict) filter (where method in ('first', 'worst')) as os, max("any") filter (where method in ('first', 'worst')) as oa from c)
select s >= bs and a >= ba as beats_base, s > os and a > oa as beats_others, ok as intervals_ok, s >= bs and a >= ba and s > os and a > oa and ok as passed from o, g""")
def heuristic_gate(spark, d):
    q = _coverage(spark, d)
    cover = q.groupBy("method").agg(F.avg("st").alias("strict"), F.avg("an").alias("any"))
    both = q.where("method = 'qe'").alias("a").join(q.where("method = 'base'").alias("b"), "question_id")
    diff = lambda c, name: both.select(F.lit(name).alias("tier"), "question_id", (F.col(f"a.{c}") - F.col(f"b.{c}")).alias("diff"))
    low = M.bootstrap(diff("st", "strict").unionByName(diff("an", "any")), ["tier"], "diff", "question_id")
    return Gt.heuristic_gate(cover, "qe", "base", ["first", "worst"], low)


@query("q128_learned_transfer_gates", f"""
with {_COVER}, {S.RUNS}, {"last_ as (select * from (select *, row_number() over (partition by method, image_id order by row_no desc) as r from runs) where r = 1)"},
o as (select max(strict) filter (where method = 'qe') as s, max("any") filter (where method = 'qe') as a, max(strict) filter (where method = 'base') as bs, max("any") filter (where method = 'base') as ba from c),
t as (select count(*) as n, avg(x.value - y.value) as da, avg((x.budget > 50)::int - (y.budget > 50)::int) as de, avg(x.value - z.value) as db from last_ x join last_ y using (image_id) join last_ z using (image_id) where x.method = 'purchase' and y.method = 'view' and z.method = 'click')
select (s > bs and a >= ba and s - bs >= 0 and a - ba >= 0) as learned_passed, n, case when n >= 50 and da >= 0.03 and de >= 0 and db >= 0 then case when da >= 0.04 and db >= 0.02 and de >= 0.03 then 'strong' else 'min' end end as transfer,
  case when da <= 0.015 then 'PASS' when da <= 0.03 then 'PARTIAL' else 'FAIL' end as drop_status from o, t""")
def learned_transfer_gates(spark, d):
    from .metric_queries import last_runs

    cover = _coverage(spark, d).groupBy("method").agg(F.avg("st").alias("strict"), F.avg("an").alias("any"))
    pick = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    o = cover.agg(*[pick(m, c).alias(f"{m}_{c}") for m in ("qe", "base") for c in ("strict", "any")])
    means = (F.col("qe_strict") >= F.col("base_strict")) & (F.col("qe_any") >= F.col("base_any"))
    o = o.select(Gt.learned_gate(F.col("qe_strict"), F.col("qe_any"), F.col("base_strict"), F.col("base_any"), means, F.lit(False)).alias("learned_passed"))
    r = last_runs(spark, d)
    one = lambda m, k: r.where(F.col("method") == m).select("image_id", F.col("value").alias(f"v{k}"), (F.col("budget") > 50).cast("int").alias(f"e{k}"))
    t = one("purchase", 0).join(one("view", 1), "image_id").join(one("click", 2), "image_id")
    t = t.agg(F.count("*").alias("n"), F.avg(F.col("v0") - F.col("v1")).alias("da"), F.avg(F.col("e0") - F.col("e1")).alias("de"), F.avg(F.col("v0") - F.col("v2")).alias("db"))
    t = t.select("n", Gt.transfer_gate(F.col("n"), F.col("da"), F.col("de"), F.col("db")).alias("transfer"), Gt.drop_status(F.col("da")).alias("drop_status"))
    return o.join(F.broadcast(t))  # a row each


@query("q129_ablation_gate", f"""
with {_PL}, s as (select question_id, doc_id, strict, m.g, case m.g when 'none' then score + 40 * strict::int when 'text' then score when 'layout' then doc_id % 97 when 'type' then -score else score + 39 * strict::int end as own from pl, (values ('none'), ('text'), ('layout'), ('type'), ('prior')) m(g)),
r as (select *, row_number() over (partition by g, question_id order by own desc, doc_id) as rank from s), q as (select g, question_id, bool_or(strict and rank <= 2)::int as hit from r group by 1, 2), a as (select g, avg(hit) as anls from q group by 1), f as (select max(anls) as v from a where g = 'none')
select count(*) filter (where anls > v + 1e-6) as helped, count(*) filter (where anls < v - 1e-6) as hurt, count(*) filter (where anls > v + 1e-6) = 0 and count(*) filter (where anls < v - 1e-6) >= 3 as passed from a, f where g <> 'none'""")
def ablation_gate(spark, d):
    own = {"none": F.col("score") + 40 * F.col("strict").cast("int"), "text": F.col("score"), "layout": F.col("doc_id") % 97, "type": -F.col("score"), "prior": F.col("score") + 39 * F.col("strict").cast("int")}
    x = patch_labels(spark, d).withColumn("m", F.explode(F.array(*[F.struct(F.lit(k).alias("drop_group"), v.cast("long").alias("own")) for k, v in own.items()]))).select("question_id", "doc_id", "strict", "m.*")
    r = M.ranked(x, ["drop_group", "question_id"], "own", "doc_id")
    q = r.groupBy("drop_group", "question_id").agg(F.bool_or(F.col("strict") & (F.col("rank") <= 2)).cast("int").alias("hit"))
    return Gt.ablation_gate(q.groupBy("drop_group").agg(F.avg("hit").alias("anls")), "none")


@query("q130_shortlist", f"""
with {S.PREDS}, x as (select conv_id, turn, question, pred, gold1, gold2, page from preds where route = 'learned'),
f as (select *, conv_id * 1000 + turn as id from x where contains({S.match('page')}, {S.match('gold2')}) and not contains({S.match('pred')}, {S.match('gold2')}))
select id, cast(row_number() over (order by length(question), length(pred) desc, id) as bigint) as place from f order by length(question), length(pred) desc, id limit 20""")
def shortlist(spark, d):
    x = V.predictions(spark, d).where("route = 'learned'").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    gold = T.normalize_match(F.col("gold2"))
    wanted = F.contains(T.normalize_match(F.col("page")), gold) & ~F.contains(T.normalize_match(F.col("pred")), gold)
    return Gt.shortlist(x, wanted, F.length("question"), F.length("pred"), "id", 4, 1).select("id", F.col("place").cast("long").alias("place"))


_LINES = lambda t: t.replace("'", "''").replace("{question}", "' || coalesce(question, '') || '")


@query("q131_prompts", f"""
with {S.QA}
select conv_id, turn, '{_LINES(P.SINGLE)}' as single, md5('{_LINES(P.OVERVIEW)}') as overview, md5('{_LINES(P.WITH_OCR).replace("{evidence}", "' || case when trim(gold1) = '' then '(none)' else trim(gold1) end || '")}') as with_ocr,
  md5('{_LINES(P.CHOICE).replace("{options}", "A. ' || resize || chr(10) || 'B. ' || bm25 || chr(10) || 'C. none of the above' || '").replace("{letters}", "A/B/C")}') as choice,
  md5('{_LINES(P.BINARY).replace("{candidate}", "' || resize || '").replace("{evidence}", "' || case when bm25 = '' then '(none)' else bm25 end || '")}') as binary, 'NONE' as last_choice from qa""")
def prompts(spark, d):
    q = V.questions(spark, d)
    c = F.array("resize", "bm25")
    return q.select(
        "conv_id", "turn", P.filled(P.SINGLE, question=F.col("question")).alias("single"), F.md5(P.filled(P.OVERVIEW, question=F.col("question"))).alias("overview"),
        F.md5(P.with_ocr(F.col("question"), F.array("gold1", F.lit("  ")))).alias("with_ocr"), F.md5(P.choice(F.col("question"), c)).alias("choice"),
        F.md5(P.binary(F.col("question"), F.col("resize"), F.col("bm25"))).alias("binary"), P.choices(c)["C"].alias("last_choice"),
    )


@query("q132_first_filled", "select doc_id, coalesce(nullif(lang, ''), nullif(source, ''), cast(doc_id as varchar), 'unknown') as id from (select doc_id, case when doc_id % 3 = 0 then '' else lang end as lang, case when doc_id % 2 = 0 then null else source end as source from documents)")
def first_filled(spark, d):
    x = V.table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 2 == 0, None).otherwise(F.col("source")).alias("source"))
    return x.select("doc_id", F.coalesce(J.first_filled("lang", "source", "doc_id"), F.lit("unknown")).alias("id"))


@query("q133_semi_left", """
select d.doc_id, coalesce(l.quality, 0) as quality, coalesce(l.toxic, 0)::double * 0.5::double + coalesce(l.quality, 0)::double * 0.25::double as score from documents d left join labels l using (doc_id) where d.source in (select source from documents where doc_id % 50 = 7)""")
def semi_left(spark, d):
    """Rows whose group was asked for, scores joined from the left with missing ones 0."""
    x = V.table(spark, d, "documents")
    x = x.join(x.where("doc_id % 50 = 7").select("source").distinct(), "source", "left_semi").select("doc_id").join(V.table(spark, d, "labels"), "doc_id", "left").na.fill(0)
    return x.select("doc_id", "quality", Sc.weighted({"toxic": 0.5, "quality": 0.25}).alias("score"))


@query("q134_truthy", "select event_id, case when lower(v) in ('true', '1', '1.0') then 1.0 else 0.0 end::double as flag from (select event_id, case event_id % 6 when 0 then 'True' when 1 then '1' when 2 then '1.0' when 3 then 'FALSE' when 4 then 'yes' end as v from events)")
def truthy(spark, d):
    i = F.col("event_id") % 6
    v = F.when(i == 0, "True").when(i == 1, "1").when(i == 2, "1.0").when(i == 3, "FALSE").when(i == 4, "yes")
    return V.table(spark, d, "events").select("event_id", L.truthy(v).alias("flag"))


@query("q135_feature_columns", f"""
with {_FEATS} select image_id, idx, 9 as n_kept, round(text_coverage + text_confidence + ratio + edge_density + entropy + label_value_proximity + same_row_label_value + below_label_relation + q_score, 9) as total from f""")
def feature_columns(spark, d):
    """Sums of the features that an ablation keeps, where columns that tell the answer are refused by the guard and left out first."""
    from .source_queries import features

    x = features(spark, d).withColumn("label_positive", F.col("idx") % 2 == 0).withColumn("any_positive", F.lit(True))
    names = [c for c in x.columns if c not in ("image_id", "idx")]
    try:
        Sc.guard_features(names)
        raise AssertionError("the guard let answers through")
    except ValueError:
        names = Sc.guard_features([c for c in names if c not in Sc.FORBIDDEN])
    kept = L.without_groups(names, ["question_overlap", "bm25", "answer_type"])
    total = F.lit(0.0)
    for c in kept:
        total = total + F.col(c)
    return x.select("image_id", "idx", F.lit(len(kept)).alias("n_kept"), F.round(total, 9).alias("total"))


@query("q136_edge_strip_fallback", f"""
with {S.BOXES}, c as (select *, count(*) filter (where x0 <= 5 or y0 <= 5) over w as edges, count(*) over w as n, row_number() over (partition by image_id order by box_id) - 1 as pos from boxes window w as (partition by image_id)),
e as (select image_id, box_id, row_number() over (partition by image_id order by box_id) as r from c where edges >= 2 and (x0 <= 5 or y0 <= 5))
select image_id, box_id from e where r <= 2 union all select image_id, box_id from c where edges < 2 and (n <= 2 or pos = 0 or pos = n // 2)""")
def edge_strip_fallback(spark, d):
    b = V.boxes(spark, d)
    return Sel.edge_strip(b.withColumn("x", F.col("x0")).withColumn("y", F.col("y0")), ["image_id"], "box_id", 2).select("image_id", "box_id")


@query("q137_reading_order", f"with {S.BOXES} select image_id, box_id, row_number() over (partition by image_id order by y0, x0, box_id) as place from boxes")
def reading_order(spark, d):
    item = F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"), "box_id")
    x = V.boxes(spark, d).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("box_id", item.alias("i")))).alias("b"))
    x = x.select("image_id", F.posexplode(Sel.reading_order(F.transform("b", lambda t: t["i"]))).alias("at", "r"))
    return x.select("image_id", F.col("r.box_id").alias("box_id"), (F.col("at") + 1).cast("long").alias("place"))


@query("q138_row_limits", "select 'all' as how, count(*) as n from documents union all select 'none', 0 union all select 'first', least(25, count(*)) from documents union all select 'val', least(25, count(*)) from documents")
def row_limits(spark, d):
    """Row limits of the two evaluations: 0 or none means all rows for the one, no row for the other."""
    x = V.table(spark, d, "documents").select("doc_id")
    some = lambda how, df: df.agg(F.lit(how).alias("how"), F.count("*").alias("n"))
    out = some("all", L.limited(x, "doc_id", 0, zero_is_all=True)).unionByName(some("none", L.limited(x, "doc_id", 0, zero_is_all=False)))
    return out.unionByName(some("first", L.limited(x, "doc_id", 25))).unionByName(some("val", L.first_rows(x, "doc_id", 25).where("split = 'val'")))


@query("q139_safe_expand", f"""
with {_SCORED}, p as (select *, (idx * 7 % 10) / 10.0::double as proxy, row_number() over (partition by image_id order by score desc, idx) as r from s),
one as (select * from p where r = 1), two as (select * from p where r = 2),
oz as (select c.image_id, arg_min(c.idx, struct_pack(a := -c.proxy, b := -c.score, c := c.idx)) as best, max(c.proxy) as proxy from p c join one a on a.image_id = c.image_id where c.r between 3 and 8 and {_IOU('c', 'a')} < 0.35 group by 1)
select one.image_id, one.idx as first, case when oz.proxy > two.proxy and oz.proxy >= two.proxy + 0.08 then oz.best else two.idx end as second from one join two using (image_id) left join oz using (image_id)""")
def safe_expand(spark, d):
    c = scored_pools(spark, d, proxy=lambda r: (r["idx"] * 7 % 10) / 10.0)
    out = Sel.safe_expanded(F.col("c"), F.slice(Sel.best_first(F.col("c")), 1, 2))
    return c.select("image_id", out.alias("p")).select("image_id", F.col("p")[0]["idx"].alias("first"), F.col("p")[1]["idx"].alias("second"))
