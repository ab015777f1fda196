"""Queries of ranks, coverage, comparisons, budgets, tables, intervals and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import metrics as M
from ..operators import selection as Sel
from ..sources import views as V
from . import sqltext as S
from .registry import query

_PL = """pl as (select d.doc_id, d.source as question_id, n_chars % 97 as score, coalesce(l.quality, 0) = 1 as strict, coalesce(l.toxic, 0) = 1 as soft from documents d left join labels l using (doc_id))"""


def patch_labels(spark, d):
    """Documents as the candidates of their source's question; labels are the evidence tiers."""
    x = V.table(spark, d, "documents").join(V.table(spark, d, "labels"), "doc_id", "left")
    return x.select("doc_id", F.col("source").alias("question_id"), (F.col("n_chars") % 97).alias("score"), (F.coalesce("quality", F.lit(0)) == 1).alias("strict"), (F.coalesce("toxic", F.lit(0)) == 1).alias("soft"))


@query("q33_tiers_coverage", f"""
with {_PL}, r as (select *, row_number() over (partition by question_id order by score desc, doc_id) as rank from pl)
select question_id, bool_or(strict and rank <= 4) as evidence_strict, bool_or(soft and not strict and rank <= 4) as evidence_soft, bool_or((strict or soft) and rank <= 4) as evidence_any,
  count(*) filter (where strict) as n_strict, count(*) filter (where soft and not strict) as n_soft, count(*) filter (where strict or soft)::double / greatest(1, count(*)) as any_share from r group by question_id""")
def tiers_coverage(spark, d):
    r = M.ranked(patch_labels(spark, d), ["question_id"], "score", "doc_id")
    strict, soft, top = F.col("strict"), F.col("soft") & ~F.col("strict"), F.col("rank") <= 4
    both = F.col("strict") | F.col("soft")
    return r.groupBy("question_id").agg(
        F.bool_or(strict & top).alias("evidence_strict"), F.bool_or(soft & top).alias("evidence_soft"), F.bool_or(both & top).alias("evidence_any"),
        F.count_if(strict).alias("n_strict"), F.count_if(soft).alias("n_soft"), (F.count_if(both) / F.greatest(F.lit(1), F.count("*"))).alias("any_share"),
    )


@query("q34_first_rank_mrr", f"""
with {_PL}, r as (select *, row_number() over (partition by question_id order by score desc, doc_id) as rank from pl)
select question_id, min(rank) filter (where strict)::double as first_rank, coalesce(1.0::double / min(rank) filter (where strict), 0) as reciprocal_rank,
  bool_or(strict and rank <= 1) as coverage_at_1, bool_or(strict and rank <= 2) as coverage_at_2, bool_or(strict and rank <= 4) as coverage_at_4, bool_or(strict and rank <= 8) as coverage_at_8 from r group by question_id""")
def first_rank(spark, d):
    return M.rank_metrics(M.ranked(patch_labels(spark, d), ["question_id"], "score", "doc_id"), ["question_id"], F.col("strict"))


@query("q35_ndcg", f"""
with {_PL}, x as (select *, strict::int + soft::int as rel from pl),
r as (select *, row_number() over (partition by question_id order by score desc, doc_id) as a, row_number() over (partition by question_id order by rel desc, doc_id) as b from x),
g as (select question_id, sum(case when a <= 10 then (pow(2.0, rel) - 1) / log2(a + 1) else 0 end) as dcg, sum(case when b <= 10 then (pow(2.0, rel) - 1) / log2(b + 1) else 0 end) as ideal from r group by question_id)
select question_id, round(case when ideal > 0 then dcg / ideal else 0 end, 9) as ndcg from g""")
def ndcg(spark, d):
    x = patch_labels(spark, d).withColumn("rel", F.col("strict").cast("int") + F.col("soft").cast("int"))
    return M.ndcg(x, ["question_id"], "score", "rel", "doc_id", 10).withColumn("ndcg", F.round("ndcg", 9))


@query("q36_minmax_hybrid", f"""
with {S.RUNS}, s as (select method, row_no, value, budget, min(value) over w as lo, max(value) over w as hi, min(budget) over w as bl, max(budget) over w as bh from runs window w as (partition by method))
select row_no, 0.5::double * case when hi > lo then (value - lo) / (hi - lo) else 0 end + 0.5::double * case when bh > bl then (budget - bl)::double / (bh - bl) else 0 end as hybrid from s""")
def minmax_hybrid(spark, d):
    return V.runs(spark, d).select("row_no", (0.5 * M.min_max("value", ["method"]) + 0.5 * M.min_max("budget", ["method"])).alias("hybrid"))


_LAST = "last_ as (select * from (select *, row_number() over (partition by method, image_id order by row_no desc) as r from runs) where r = 1)"


def last_runs(spark, d):
    return M.keep_last(V.runs(spark, d), ["method", "image_id"], ["row_no"])


@query("q37_paired_diff", f"with {S.RUNS}, {_LAST} select a.image_id, a.value as a, b.value as b, a.value - b.value as diff from last_ a join last_ b on a.image_id = b.image_id where a.method = 'click' and b.method = 'view'")
def paired_diff(spark, d):
    r = last_runs(spark, d)
    return J.paired(r.where("method = 'click'"), r.where("method = 'view'"), ["image_id"], "value")


@query("q38_reader_join", f"""
with {S.RUNS}, f as (select * from (select *, row_number() over (partition by method, image_id order by row_no) as r from runs) where r = 1)
select a.image_id, a.budget as question, coalesce(a.value, 0) as click, coalesce(b.value, 0) as view, coalesce(c.value, 0) as error from f a join f b on a.image_id = b.image_id and b.method = 'view' join f c on c.image_id = a.image_id and c.method = 'error' where a.method = 'click'""")
def reader_join(spark, d):
    from pyspark.sql import Window

    r = V.runs(spark, d).where("method in ('click', 'view', 'error')")
    f = r.withColumn("_r", F.row_number().over(Window.partitionBy("method", "image_id").orderBy("row_no"))).where("_r = 1")
    g = f.groupBy("image_id").agg(*[F.max(F.when(F.col("method") == m, F.col("value"))).alias(m) for m in ("click", "view", "error")], F.max(F.when(F.col("method") == "click", F.col("budget"))).alias("question"), F.countDistinct("method").alias("n"))
    return g.where("n = 3").select("image_id", "question", *[F.coalesce(m, F.lit(0.0)).alias(m) for m in ("click", "view", "error")])


@query("q39_outer_scores", f"""
with {S.RUNS}, a as (select image_id, budget, max(value) as s from runs where method = 'click' group by 1, 2), b as (select image_id, budget, max(value) as t from runs where method = 'purchase' group by 1, 2)
select coalesce(a.image_id, b.image_id) as image_id, coalesce(a.budget, b.budget) as budget, coalesce(s, 0) as strict_score, coalesce(t, 0) as any_score, 0.6::double * coalesce(s, 0) + 0.4::double * coalesce(t, 0) as combined
from a full join b on a.image_id = b.image_id and a.budget = b.budget""")
def outer_scores(spark, d):
    r = V.runs(spark, d)
    one = lambda m, c: r.where(F.col("method") == m).groupBy("image_id", "budget").agg(F.max("value").alias(c))
    x = one("click", "s").join(one("purchase", "t"), ["image_id", "budget"], "full_outer")
    s, t = F.coalesce("s", F.lit(0.0)), F.coalesce("t", F.lit(0.0))
    return x.select("image_id", "budget", s.alias("strict_score"), t.alias("any_score"), (0.6 * s + 0.4 * t).alias("combined"))


@query("q40_bootstrap_md5", f"""
with {S.RUNS}, {_LAST}, x as (select a.method, a.image_id, a.value - b.value as diff from last_ a join last_ b on a.image_id = b.image_id and b.method = 'view' where a.method <> 'view'),
p as (select method, diff, row_number() over (partition by method order by image_id) - 1 as pos, count(*) over (partition by method) as n from x),
w as (select method, b, cast(concat('0x', substr(md5(concat('42:', method, ':', b, ':', pos)), 1, 8)) as bigint) % n as pos from p, range(200) t(b)),
m as (select w.method, b, avg(diff) as m from w join p on p.method = w.method and p.pos = w.pos group by 1, 2)
select x.method, round(avg(diff), 6) as mean, count(*) as n, any_value(round(low, 6)) as low, any_value(round(high, 6)) as high
from x join (select method, quantile_cont(m, 0.025) as low, quantile_cont(m, 0.975) as high from m group by 1) e on e.method = x.method group by x.method""")
def bootstrap_md5(spark, d):
    r = last_runs(spark, d)
    x = r.where("method <> 'view'").join(r.where("method = 'view'").select("image_id", F.col("value").alias("base")), "image_id").withColumn("diff", F.col("value") - F.col("base"))
    out = M.bootstrap(x, ["method"], "diff", "image_id")
    return out.select("method", F.round("mean", 6).alias("mean"), "n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("q41_bootstrap_numpy")
def bootstrap_numpy(spark, d):
    r = last_runs(spark, d)
    x = r.where("method <> 'view'").join(r.where("method = 'view'").select("image_id", F.col("value").alias("base")), "image_id").withColumn("diff", F.col("value") - F.col("base"))
    return M.bootstrap_exact(x.select("method", "image_id", "diff"), ["method"], "diff", "image_id")


@query("q42_budget_matrix", """
with m as (select * from (values ('resize', 'area_0.25'), ('resize', 'area_0.5'), ('jpeg', 'kb_50'), ('jpeg', 'kb_100'), ('webp', 'kb_50'), ('patches', 'patches_2'), ('patches', 'patches_4'), ('original', 'area_1.0')) t(method, budget)),
a as (select distinct method from m union select 'unknown'), b as (select distinct budget from m union select 'reference')
select d.source as dataset, a.method, b.budget, count(*) as samples, max((m.method is null)::int) = 1 as not_applicable from documents d, a, b
left join m on m.method = a.method and m.budget = case when b.budget = 'reference' then 'area_1.0' else b.budget end group by 1, 2, 3""")
def budget_matrix(spark, d):
    """Samples x methods x budgets with the pairs that the allow-list lacks; the lists are literals, so the products are of fixed size."""
    pairs = [("resize", "area_0.25"), ("resize", "area_0.5"), ("jpeg", "kb_50"), ("jpeg", "kb_100"), ("webp", "kb_50"), ("patches", "patches_2"), ("patches", "patches_4"), ("original", "area_1.0")]
    methods, budgets = sorted({a for a, _ in pairs} | {"unknown"}), sorted({b for _, b in pairs} | {"reference"})
    n = V.table(spark, d, "documents").groupBy(F.col("source").alias("dataset")).agg(F.count("*").alias("samples"))
    x = n.select("dataset", "samples", F.explode(F.array(*[F.lit(m) for m in methods])).alias("method")).withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets])))
    own = F.when(F.col("budget") == "reference", "area_1.0").otherwise(F.col("budget"))
    known = F.concat_ws("|", F.col("method"), own).isin(*["|".join(p) for p in pairs])
    return x.select("dataset", "method", "budget", "samples", (~known).alias("not_applicable"))


@query("q43_budget_check", """
select o_orderkey as id, case when t > 0 then abs(a - t) / t <= 0.03 else a = t end as pixel_valid, a <= t as byte_valid, case when t > 0 then a / t else 0 end as utilization, case when t > 0 then a / t else 0 end < 0.7 as underused
from (select o_orderkey, o_totalprice as a, o_totalprice * (0.9::double + (o_custkey % 8) * 0.1::double) * (case when o_orderkey % 11 = 0 then 0 else 1 end) as t from orders)""")
def budget_check(spark, d):
    a = F.col("o_totalprice")
    t = a * (0.9 + (F.col("o_custkey") % 8) * 0.1) * F.when(F.col("o_orderkey") % 11 == 0, 0).otherwise(1)
    b = M.byte_budget(a, t)
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), M.pixel_budget(a, t).alias("pixel_valid"), b["valid"].alias("byte_valid"), b["utilization"].alias("utilization"), b["underused"].alias("underused"))


_META = """m as (select row_no, method, image_id, value, budget, case when row_no % 5 = 0 then null else budget % 7 = 0 end as dry_run, row_no % 13 = 0 as invalid_budget, case budget % 3 when 0 then 'pilot' when 1 then 'paper' else 'debug' end as experiment_stage from runs)"""


def metric_rows(spark, d):
    return V.runs(spark, d).withColumn("dry_run", F.when(F.col("row_no") % 5 == 0, F.lit(None).cast("boolean")).otherwise(F.col("budget") % 7 == 0)).withColumn("invalid_budget", F.col("row_no") % 13 == 0).withColumn("experiment_stage", F.when(F.col("budget") % 3 == 0, "pilot").when(F.col("budget") % 3 == 1, "paper").otherwise("debug"))


@query("q44_eligibility", f"with {S.RUNS}, {_META} select row_no, method, value from m where not coalesce(dry_run, false) and not invalid_budget and experiment_stage in ('pilot', 'paper')")
def eligibility(spark, d):
    return M.eligible(metric_rows(spark, d)).select("row_no", "method", "value")


@query("q45_ocr_summary", f"with {S.RUNS}, {_META} select method, experiment_stage, round(avg(value) filter (where not invalid_budget), 6) as mean_value, count(*) filter (where not invalid_budget) as n, count(*) filter (where invalid_budget) as invalid_excluded, round(avg(budget), 6) as mean_budget from m group by 1, 2")
def ocr_summary(spark, d):
    ok = ~M.flag("invalid_budget")
    return metric_rows(spark, d).groupBy("method", "experiment_stage").agg(F.round(F.avg(F.when(ok, F.col("value"))), 6).alias("mean_value"), F.count_if(ok).alias("n"), F.count_if(~ok).alias("invalid_excluded"), F.round(F.avg("budget"), 6).alias("mean_budget"))


@query("q46_runtime_p90", f"with {S.RUNS} select method, count(*) as n, round(avg(value), 3) as mean, round(median(value), 3) as median, round(quantile_cont(value, 0.9), 3) as p90 from runs group by 1")
def runtime_p90(spark, d):
    return V.runs(spark, d).groupBy("method").agg(F.count("*").alias("n"), F.round(F.avg("value"), 3).alias("mean"), F.round(F.median("value"), 3).alias("median"), F.round(F.percentile("value", F.lit(0.9)), 3).alias("p90"))


@query("q47_cost_median", f"""
with {S.RUNS}, c as (select method, value as ocr, value / 2 as features, budget / 10.0::double as selection, value * 1.5::double as vlm, 0.1::double as load from runs), t as (select method, ocr, vlm, selection, ocr + features + selection + vlm + load as cold, selection + vlm as cached from c)
select method, median(ocr) as ocr, median(vlm) as vlm, round(median(cold), 6) as cold, round(median(cached), 6) as cached from t group by 1""")
def cost_median(spark, d):
    v, b = F.col("value"), F.col("budget") / 10.0
    c = V.runs(spark, d).select("method", v.alias("ocr"), (v * 1.5).alias("vlm"), (v + v / 2 + b + v * 1.5 + 0.1).alias("cold"), (b + v * 1.5).alias("cached"))
    return c.groupBy("method").agg(F.median("ocr").alias("ocr"), F.median("vlm").alias("vlm"), F.round(F.median("cold"), 6).alias("cold"), F.round(F.median("cached"), 6).alias("cached"))


@query("q48_quartile_rank", f"""
with {S.RUNS}, r as (select method, value, row_number() over (partition by method order by value) - 1 as r, count(*) over (partition by method) as n from runs)
select method, max(value) filter (where r = n // 4) as q1, max(value) filter (where r = n // 2) as q2, max(value) filter (where r = (3 * n) // 4) as q3 from r group by 1""")
def quartile_rank(spark, d):
    return M.nearest_rank(V.runs(spark, d), ["method"], "value", {"q1": (1, 4), "q2": (1, 2), "q3": (3, 4)})


@query("q49_dedup_keep_last", f"with {S.RUNS}, {_LAST} select method, image_id, row_no, value from last_")
def dedup_keep_last(spark, d):
    return last_runs(spark, d).select("method", "image_id", "row_no", "value")


@query("q50_union_schema", f"with {S.RUNS} select row_no, method, value, null::bigint as budget from runs where method = 'click' union all select row_no, method, null, budget from runs where method = 'view'")
def union_schema(spark, d):
    r = V.runs(spark, d)
    return r.where("method = 'click'").select("row_no", "method", "value").unionByName(r.where("method = 'view'").select("row_no", "method", "budget"), allowMissingColumns=True)


@query("q61_gap_buckets", f"""
with {_PL}, r as (select *, row_number() over (partition by question_id order by score desc, doc_id) as rank from pl),
b as (select question_id, bool_or(strict) as reach, bool_or(strict and rank <= 2) as at2, bool_or(strict and rank <= 8) as at8, bool_or(soft) as soft from r group by 1),
l as (select unnest(['reach', 'at2', 'at8', 'soft', 'reach_not_at8', 'at8_not_at2']) as name, unnest([reach, at2, at8, soft, reach and not at8, at8 and not at2]) as hit from b)
select name, avg(hit::int) as rate, count(*) filter (where hit) as hits, count(*) as n from l group by 1""")
def gap_buckets(spark, d):
    r = M.ranked(patch_labels(spark, d), ["question_id"], "score", "doc_id")
    s = F.col("strict")
    b = r.groupBy("question_id").agg(F.bool_or(s).alias("reach"), F.bool_or(s & (F.col("rank") <= 2)).alias("at2"), F.bool_or(s & (F.col("rank") <= 8)).alias("at8"), F.bool_or("soft").alias("soft"))
    b = b.withColumn("reach_not_at8", F.col("reach") & ~F.col("at8")).withColumn("at8_not_at2", F.col("at8") & ~F.col("at2"))
    names = ["reach", "at2", "at8", "soft", "reach_not_at8", "at8_not_at2"]
    return b.unpivot([], names, "name", "hit").groupBy("name").agg(F.avg(F.col("hit").cast("int")).alias("rate"), F.count_if("hit").alias("hits"), F.count("*").alias("n"))


@query("q63_contingency", f"""
with {_PL}, a as (select question_id, bool_or(strict) as a from (select *, row_number() over (partition by question_id order by score desc, doc_id) as r from pl) where r <= 2 group by 1),
b as (select question_id, bool_or(strict) as b from (select *, row_number() over (partition by question_id order by score, doc_id) as r from pl) where r <= 2 group by 1)
select count(*) filter (where a and b) as both, count(*) filter (where a and not b) as only_a, count(*) filter (where b and not a) as only_b, count(*) filter (where not a and not b) as neither from a join b using (question_id)""")
def contingency(spark, d):
    x = patch_labels(spark, d)
    hit = lambda df, c: Sel.top_k(df, ["question_id"], "score", "doc_id", 2).groupBy("question_id").agg(F.bool_or("strict").alias(c))
    a, b = hit(x, "a"), hit(x.withColumn("score", -F.col("score")), "b")
    A, B = F.col("a"), F.col("b")
    return a.join(b, "question_id").agg(F.count_if(A & B).alias("both"), F.count_if(A & ~B).alias("only_a"), F.count_if(B & ~A).alias("only_b"), F.count_if(~A & ~B).alias("neither"))


@query("q64_gate_lattice", f"""
with {S.RUNS}, g as (select method, avg(value) as v, count(*) as n, stddev_samp(value) / sqrt(count(*)) as se from runs group by 1), b as (select v, se from g where method = 'view'), k as (select v, se from g where method = 'click')
select g.method, g.n, case when g.v > b.v and g.v - b.v - 1.96::double * sqrt(g.se * g.se + b.se * b.se) > 0 and g.v > k.v and g.v - k.v - 1.96::double * sqrt(g.se * g.se + k.se * k.se) > 0 then 'PASS'
  when (g.v > b.v and g.v - b.v - 1.96::double * sqrt(g.se * g.se + b.se * b.se) > 0) or (g.v > k.v and g.v - k.v - 1.96::double * sqrt(g.se * g.se + k.se * k.se) > 0) then 'PARTIAL' else 'FAIL' end as status from g, b, k""")
def gate_lattice(spark, d):
    """Gates of methods, a row each, against two baselines' aggregates (one row each)."""
    g = V.runs(spark, d).groupBy("method").agg(F.avg("value").alias("v"), F.count("*").alias("n"), (F.stddev_samp("value") / F.sqrt(F.count("*"))).alias("se"))
    base = g.agg(*[F.max(F.when(F.col("method") == m, F.col(c))).alias(f"{m}_{c}") for m in ("view", "click") for c in ("v", "se")])
    x = g.join(F.broadcast(base))
    low = lambda m: F.col("v") - F.col(f"{m}_v") - 1.96 * F.sqrt(F.col("se") * F.col("se") + F.col(f"{m}_se") * F.col(f"{m}_se"))
    status = M.gate_status(F.col("v") > F.col("view_v"), low("view"), F.col("v") > F.col("click_v"), low("click"))
    return x.select("method", "n", status.alias("status"))


@query("q66_split_md5", "select doc_id, cast(concat('0x', substr(md5(cast(doc_id as varchar)), 1, 8)) as bigint) % 5 as fold from documents")
def split_md5(spark, d):
    return V.table(spark, d, "documents").select("doc_id", (F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long") % 5).alias("fold"))


@query("q67_stratified_sample", """
with x as (select doc_id, case when quality = 1 then 'win' when toxic = 1 then 'loss' else 'tie' end as stratum from labels),
r as (select *, row_number() over (partition by stratum order by md5(concat('42:', doc_id)), doc_id) as r from x)
select doc_id, stratum from r where r <= case stratum when 'tie' then 20 else 40 end""")
def stratified_sample(spark, d):
    x = V.table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "win").when(F.col("toxic") == 1, "loss").otherwise("tie").alias("stratum"))
    big, small = x.where("stratum <> 'tie'"), x.where("stratum = 'tie'")
    return Sel.hash_sample(big, ["stratum"], ["doc_id"], 40).unionByName(Sel.hash_sample(small, ["stratum"], ["doc_id"], 20))


@query("q73_resume_antijoin", f"with {S.RUNS}, done as (select distinct image_id from runs where budget < 20 and method = 'error') select row_no, image_id, method from runs r where not exists (select 1 from done d where d.image_id = r.image_id)")
def resume_antijoin(spark, d):
    r = V.runs(spark, d)
    return J.unfinished(r, r.where("budget < 20 and method = 'error'"), "image_id").select("row_no", "image_id", "method")
