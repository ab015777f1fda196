"""Queries of case rules, tables, anchored selection and generated pools."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import selection as Sel
from ..operators import spatial as Sp
from ..sources import views as V
from . import sqltext as S
from .metric_queries import _PL, patch_labels
from .registry import query
from .routing_queries import LONG
from .spatial_queries import _ASKED, _IOU, _OVERLAP, _SCORED, H, W, patches, pool, scored_pools
from .text_queries import _any


@query("q80_failures", f"with {LONG} select conv_id, turn, route, case when length(pred) < 2 then 'empty_or_short' else 'other' end as kind from x where em < 1")
def failures(spark, d):
    x = V.predictions(spark, d)
    return x.where(T.exact_match(F.col("pred"), F.array("gold1", "gold2")) < 1).select("conv_id", "turn", "route", L.failure_kind(F.col("pred")).alias("kind"))


@query("q81_patch_types", f"""
with {_OVERLAP}, t as (select p.image_id, p.idx, p.y, p.h, coalesce(string_agg(o.text, ' ' order by o.box_id), '') as text from patches p left join o on o.image_id = p.image_id and o.idx = p.idx group by all)
select case when trim(text) = '' then 'blank' when y < 1300 * 0.15 then 'header' when y > 1300 * 0.85 then 'footer' when contains(text, ':') and length(text) < 40 then 'label_value' when length(text) < 15 then 'form_field' else 'paragraph' end as kind, count(*) as n from t group by 1""")
def patch_types(spark, d):
    t = Sp.rows_of(pool(spark, d, "text"))
    return t.groupBy(L.patch_kind(F.col("y"), F.col("h"), F.lit(H), F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


@query("q82_outcomes", f"""
with {LONG}, w as (select conv_id, turn, max(anls) filter (where pos = 1) - max(anls) filter (where pos = 0) as delta from x group by 1, 2)
select conv_id, turn, case when delta > 1e-9 then 'win' when delta < -1e-9 then 'loss' else 'tie' end as outcome from w""")
def outcomes(spark, d):
    g = F.array("gold1", "gold2")
    return V.questions(spark, d).select("conv_id", "turn", L.outcome(T.anls(F.col("bm25"), g) - T.anls(F.col("resize"), g)).alias("outcome"))


@query("q83_miss_patterns", f"""
with {_PL}, r as (select *, row_number() over (partition by question_id order by score desc, doc_id) as a, row_number() over (partition by question_id order by score, doc_id) as b from pl),
m as (select question_id, min(a) filter (where strict) as ra, min(b) filter (where strict) as rb, avg(score) / 97 as prox, avg(soft::int) as ov from r group by 1)
select question_id, case when ra > 2 and (rb is null or rb > 2) then 'both_deep_rank' when ra <= 2 and rb > 2 then 'qe_correct_patch_not_top2' when prox >= 0.7 and ov < 0.5 then 'label_only_no_question_overlap' when ov < 0.3 and prox < 0.3 then 'layout_over_lexical'
  when ra = rb then 'wrong_second_patch_same_first' else 'lexical_neighbor_miss' end as pattern from m""")
def miss_patterns(spark, d):
    r = M.ranked(patch_labels(spark, d), ["question_id"], "score", "doc_id", "a").withColumn("neg", -F.col("score"))
    r = M.ranked(r, ["question_id"], "neg", "doc_id", "b")
    first = lambda c: F.min(F.when(F.col("strict"), F.col(c)))
    m = r.groupBy("question_id").agg(first("a").alias("ra"), first("b").alias("rb"), (F.avg("score") / 97).alias("prox"), F.avg(F.col("soft").cast("int")).alias("ov"))
    same = F.coalesce(F.col("ra") == F.col("rb"), F.lit(False))
    return m.select("question_id", L.miss_pattern(F.col("ra"), F.col("rb"), F.col("prox"), F.col("ov"), F.col("prox"), same).alias("pattern"))


_BUCKET = "case " + " ".join(f"when {_any('lq', ws)} then '{k}'" for k, ws in L.BUCKETS) + f""" when regexp_matches(lq, '{L.ORGANIZATION}') then 'organization'
  when regexp_matches(lq, '{L.ADDRESS}') or contains(lq, 'where') then 'address/location' when regexp_matches(lq, '{L.ID_CODE}') then 'id/code' else 'phrase/other' end"""


@query("q84_answer_type_report", f"""
with {LONG}, b as (select conv_id, turn, {_BUCKET} as bucket, route, anls, em from x)
select bucket, count(distinct conv_id * 1000 + turn) as support, round(avg(anls) filter (where route = 'resize'), 6) as anls_resize, round(avg(anls) filter (where route = 'bm25'), 6) as anls_bm25, round(avg(em) filter (where route = 'resize'), 6) as em_resize from b group by 1""")
def answer_type_report(spark, d):
    g = F.array("gold1", "gold2")
    q = V.questions(spark, d).withColumn("bucket", L.question_bucket(F.col("question")))
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return q.groupBy("bucket").agg(F.count("*").alias("support"), mean(T.anls(F.col("resize"), g), "anls_resize"), mean(T.anls(F.col("bm25"), g), "anls_bm25"), mean(T.exact_match(F.col("resize"), g), "em_resize"))


def _date_sql(x: str) -> str:
    t = f"lower(coalesce({x}, ''))"
    for k, v in L.MONTHS.items():
        t = rf"regexp_replace({t}, '\b{k}[a-z]*\b', '{v}', 'g')"
    return f"trim(regexp_replace({t}, '[^0-9]+', ' ', 'g'))"


@query("q85_grounding_variants", rf"""
with {S.PREDS} select conv_id, turn, route, trim(regexp_replace(pred, '\s+', ' ', 'g')) <> '' and contains(trim(regexp_replace(page, '\s+', ' ', 'g')), trim(regexp_replace(pred, '\s+', ' ', 'g'))) as raw,
  {S.answer('pred')} <> '' and contains({S.answer('page')}, {S.answer('pred')}) as conservative, {S.answer('pred')} <> '' and contains(regexp_replace({S.answer('page')}, '\d', '0', 'g'), regexp_replace({S.answer('pred')}, '\d', '0', 'g')) as num,
  {_date_sql('pred')} <> '' and contains({_date_sql('page')}, {_date_sql('pred')}) as date from preds""")
def grounding_variants(spark, d):
    x = V.predictions(spark, d)
    here = lambda how: (L.grounding_text(F.col("pred"), how) != "") & F.contains(L.grounding_text(F.col("page"), how), L.grounding_text(F.col("pred"), how))
    return x.select("conv_id", "turn", "route", *[here(h).alias(h) for h in ("raw", "conservative", "num", "date")])


@query("q86_route_counts", f"""
with {LONG}, p as (select conv_id, turn, coalesce(arg_min(route, len * 10 + pos) filter (where norm <> ''), 'resize') as route from x group by 1, 2)
select r.route, coalesce(n, 0) as n from (select unnest(['resize', 'bm25', 'learned', 'heuristic']) as route) r left join (select route, count(*) as n from p group by 1) c on c.route = r.route""")
def route_counts(spark, d):
    from ..operators import routing as R
    from .routing_queries import with_candidates

    return L.counts(with_candidates(spark, d).select(R.shortest(F.col("c")).alias("route")), "route", ["resize", "bm25", "learned", "heuristic"])


@query("q87_group_runs", "select source, count(*) as n, row_number() over (order by source) as place from documents group by 1")
def group_runs(spark, d):
    return L.group_runs(V.table(spark, d, "documents"), "source").withColumn("place", F.col("place").cast("long"))


@query("q88_argmax_ties", f"""
with {LONG}, w as (select conv_id, turn, max(anls) filter (where pos = 0) as a0, max(anls) filter (where pos = 1) as a1, max(anls) filter (where pos = 2) as a2 from x group by 1, 2)
select conv_id, turn, case when a0 >= greatest(a0, a1, a2) - 1e-12 then 'resize' when a1 >= greatest(a0, a1, a2) - 1e-12 then 'bm25' else 'learned' end as route from w""")
def argmax_ties(spark, d):
    from .routing_queries import R, wide_scores

    return wide_scores(spark, d).select("conv_id", "turn", L.argmax_route({r: F.col(f"a_{r}") for r in R.ROUTES}, R.ROUTES).alias("route"))


@query("q89_oracle_top", f"""
with {_PL}, r as (select question_id, doc_id, row_number() over (partition by question_id order by score desc, strict desc, doc_id) as rank from pl) select question_id, doc_id, rank from r where rank <= 4""")
def oracle_top(spark, d):
    return Sel.oracle_top(patch_labels(spark, d), ["question_id"], "score", "strict", "doc_id", 4).select("question_id", "doc_id", F.col("rank").cast("long").alias("rank"))


@query("q90_reachability", f"""
with {_PL}, q as (select question_id, bool_or(strict) as s, bool_or(soft) as f, bool_or(strict or soft) as a from pl group by 1)
select avg(s::int) as strict_rate, avg(f::int) as soft_rate, avg(a::int) as any_rate, count(*) as n from q""")
def reachability(spark, d):
    q = patch_labels(spark, d).groupBy("question_id").agg(F.bool_or("strict").alias("s"), F.bool_or("soft").alias("f"), F.bool_or(F.col("strict") | F.col("soft")).alias("a"))
    rate = lambda c, n: F.avg(F.col(c).cast("int")).alias(n)
    return q.agg(rate("s", "strict_rate"), rate("f", "soft_rate"), rate("a", "any_rate"), F.count("*").alias("n"))


@query("q91_random_baseline", f"""
with {_PL}, s as (select pl.*, k.seed from pl, (select unnest(range(1, 6)) as seed) k), r as (select *, row_number() over (partition by question_id, seed order by md5(concat(seed, ':', doc_id)), doc_id) as rank from s),
h as (select question_id, seed, bool_or(strict and rank <= 2)::int as hit from r group by 1, 2), q as (select question_id, avg(hit) as hit from h group by 1)
select round(avg(hit), 9) as mean_hit, count(*) as n from q""")
def random_baseline(spark, d):
    """Mean over seeds per question, then over questions."""
    x = patch_labels(spark, d).withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(5))))
    from pyspark.sql import Window

    w = Window.partitionBy("question_id", "seed").orderBy(F.md5(F.concat_ws(":", F.col("seed").cast("string"), F.col("doc_id").cast("string"))), "doc_id")
    h = x.withColumn("rank", F.row_number().over(w)).groupBy("question_id", "seed").agg(F.bool_or(F.col("strict") & (F.col("rank") <= 2)).cast("int").alias("hit"))
    return h.groupBy("question_id").agg(F.avg("hit").alias("hit")).agg(F.round(F.avg("hit"), 9).alias("mean_hit"), F.count("*").alias("n"))


@query("q92_budget_cost", f"""
with {S.RUNS} select method, budget // 25 as bucket, first(row_no order by row_no) as first_row, round(median(value), 3) as median_value, round(median(budget), 3) as median_budget, count(*) as n from runs group by 1, 2""")
def budget_cost(spark, d):
    r = V.runs(spark, d)
    return r.groupBy("method", F.floor(F.col("budget") / 25).alias("bucket")).agg(F.min("row_no").alias("first_row"), F.round(F.median("value"), 3).alias("median_value"), F.round(F.median("budget"), 3).alias("median_budget"), F.count("*").alias("n"))


@query("q93_set_operations", f"""
with {S.RUNS}, a as (select distinct image_id from runs where method = 'click' and budget < 50), b as (select distinct image_id from runs where method = 'view' and budget >= 50)
select 'both' as kind, image_id from (select * from a intersect select * from b) union all select 'only_a', image_id from (select * from a except select * from b)""")
def set_operations(spark, d):
    r = V.runs(spark, d)
    a, b = r.where("method = 'click' and budget < 50").select("image_id").distinct(), r.where("method = 'view' and budget >= 50").select("image_id").distinct()
    return a.intersect(b).select(F.lit("both").alias("kind"), "image_id").unionByName(a.exceptAll(b).select(F.lit("only_a").alias("kind"), "image_id"))


@query("q94_distinct_counts", "select source, count(distinct lang) as langs, count(distinct doc_id) filter (where lang = 'en') as english from documents group by 1")
def distinct_counts(spark, d):
    return V.table(spark, d, "documents").groupBy("source").agg(F.countDistinct("lang").alias("langs"), F.countDistinct(F.when(F.col("lang") == "en", F.col("doc_id"))).alias("english"))


@query("q95_sweep_leaderboard", f"""
with {_PL}, c as (select unnest([0.0, 0.25, 0.5, 0.75, 1.0])::double as w), s as (select question_id, doc_id, strict, soft, w, w * score / 97 + (1 - w) * (doc_id % 10) / 10.0::double as s from pl, c),
r as (select *, row_number() over (partition by w, question_id order by round(s, 12) desc, doc_id) as rank from s), q as (select w, question_id, bool_or(strict and rank <= 2)::int as st, bool_or((strict or soft) and rank <= 2)::int as an from r group by 1, 2)
select w, avg(st) as strict_rate, avg(an) as any_rate, row_number() over (order by avg(st) desc, avg(an) desc, w) as place from q group by 1""")
def sweep_leaderboard(spark, d):
    """Every configuration scores every candidate once; configurations are a literal list."""
    from pyspark.sql import Window

    x = patch_labels(spark, d).withColumn("w", F.explode(F.array(*[F.lit(v) for v in (0.0, 0.25, 0.5, 0.75, 1.0)])))
    x = x.withColumn("s", F.round(F.col("w") * F.col("score") / 97 + (1 - F.col("w")) * (F.col("doc_id") % 10) / 10.0, 12))
    r = M.ranked(x, ["w", "question_id"], "s", "doc_id")
    top = F.col("rank") <= 2
    q = r.groupBy("w", "question_id").agg(F.bool_or(F.col("strict") & top).cast("int").alias("st"), F.bool_or((F.col("strict") | F.col("soft")) & top).cast("int").alias("an"))
    g = q.groupBy("w").agg(F.avg("st").alias("strict_rate"), F.avg("an").alias("any_rate"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.col("strict_rate").desc(), F.col("any_rate").desc(), "w")).cast("long"))


@query("q96_edge_strip", f"""
with {S.PATCHES}, e as (select image_id, idx, row_number() over (partition by image_id order by idx) as r from patches where y <= 5 or x <= 5) select image_id, idx from e where r <= 3""")
def edge_strip(spark, d):
    from pyspark.sql import Window

    e = patches(spark, d).where("y <= 5 or x <= 5")
    return e.withColumn("r", F.row_number().over(Window.partitionBy("image_id").orderBy("idx"))).where("r <= 3").select("image_id", "idx")


@query("q97_anchor_pair", f"""
with {_SCORED}, f as (select *, row_number() over (partition by image_id order by n desc, idx) as a from s), one as (select * from f where a = 1),
r as (select p.image_id, p.idx, row_number() over (partition by p.image_id order by ({_IOU('p', 'o')} >= 0.35), p.score desc, p.idx) as r from s p join one o on o.image_id = p.image_id and o.idx <> p.idx)
select image_id, 1::bigint as slot, idx from one union all select image_id, r + 1, idx from r where r <= 2""")
def anchor_pair(spark, d):
    c = scored_pools(spark, d, anchor=lambda r: r["n"])
    out = c.select("image_id", F.posexplode_outer(Sel.anchored(F.col("c"), 3)).alias("slot", "k"))
    return out.select("image_id", (F.col("slot") + 1).cast("long").alias("slot"), F.col("k.idx").alias("idx"))


@query("q98_proximity", f"""
with {S.PATCHES}, {S.BOXES}, {_ASKED}, c as (select *, x0 + w / 2.0 as cx, y0 + h / 2.0 as cy from boxes),
l as (select c.image_id, c.box_id as label, c.x0 + c.w as lx, c.cy as ly from c join q using (image_id) where len(q) > 0 and (len(list_filter(q, lambda t: contains({S.norm('text')}, t))) > 0 or contains(text, ':'))),
v as (select c.image_id, c.box_id, c.cx, c.cy, max(case when abs(c.cy - ly) < 25 and c.cx >= lx - 10 then 1.0 when c.cy > ly and abs(c.cx - lx) < 80 then 0.7 end) as s from l join c on c.image_id = l.image_id and c.box_id <> l.label group by all),
h as (select p.image_id, p.idx, max(s) as s from patches p join v on v.image_id = p.image_id and v.s is not null and v.cx >= p.x and v.cx < p.x + p.w and v.cy >= p.y and v.cy < p.y + p.h group by 1, 2)
select p.image_id, p.idx, coalesce(h.s, 0)::double as score from patches p left join h on h.image_id = p.image_id and h.idx = p.idx""")
def proximity(spark, d):
    return Sp.proximity(patches(spark, d), V.boxes(spark, d), V.box_questions(spark, d))


@query("q99_candidate_pool")
def candidate_pool(spark, d):
    return Sp.candidate_pool(V.boxes(spark, d), V.box_questions(spark, d), W, H)
