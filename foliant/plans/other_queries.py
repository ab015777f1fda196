"""Queries of sources, scores, fuzzy comparisons, fitted rankers and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fuzzy as Z
from ..functions import text as T
from ..operators import models as Mo
from ..operators import scores as Sc
from ..operators import selection as Sel
from ..sources import tables as Tb
from ..sources import views as V
from ..streaming import replay as St
from .registry import query
from .spatial_queries import _IOU, _SCORED, scored, scored_pools


@query("q65_manifest_validate", """
with m as (select doc_id as line, case when doc_id % 17 = 3 then '{bad' when doc_id % 19 = 4 then '' else concat('{"image_id": "', doc_id // 2 * 2, '", "dataset": "d", "split": "val"', case when doc_id % 5 = 0 then '' else concat(', "image_path": "', source, '.png"') end, '}') end as value from documents),
s as (select * from m where trim(value) <> ''), j as (select line, json_extract_string(value, '$.image_id') as image_id, json_extract_string(value, '$.image_path') as p from s where json_valid(value))
select line, null as image_id, 'unreadable' as error from s where not json_valid(value) union all select line, image_id, 'missing image_path' from j where p is null
union all select line, image_id, 'repeated image_id' from (select *, row_number() over (partition by image_id order by line) as r from j) where r > 1""")
def manifest_validate(spark, d):
    i = F.col("doc_id")
    path = F.when(i % 5 == 0, "").otherwise(F.concat(F.lit(', "image_path": "'), F.col("source"), F.lit('.png"')))
    ok = F.concat(F.lit('{"image_id": "'), (F.floor(i / 2) * 2).cast("string"), F.lit('", "dataset": "d", "split": "val"'), path, F.lit("}"))
    lines = V.table(spark, d, "documents").select(i.alias("line"), F.when(i % 17 == 3, "{bad").when(i % 19 == 4, "").otherwise(ok).alias("value"))
    return Tb.check_manifest(lines)


@query("q65b_audit", """
select count(*) as total, count(distinct text) as distinct_ids, count(*) - count(distinct text) as duplicates, count(*) filter (where not (n_chars >= 20)) as missing,
  (count(*) filter (where not (n_chars >= 20)))::double / count(*) as missing_rate, (count(*) filter (where not (n_chars >= 20)))::double / count(*) <= 0.01 and count(*) = count(distinct text) as passed from documents""")
def audit(spark, d):
    return Tb.audit(V.table(spark, d, "documents"), "text", F.col("n_chars") >= 20)


@query("q65c_annotations", """
select concat(conv_id, ':', turn) as image_id, array_to_string(list_filter(string_split(text, ' '), lambda t: t <> ''), ' ') as ocr_gt_text from conversations""")
def annotations(spark, d):
    key = F.concat_ws(":", "conv_id", "turn")
    w = V.table(spark, d, "conversations").select(key.alias("image_id"), F.filter(F.split("text", " "), lambda t: t != "").alias("ws"))
    anns = w.select(F.posexplode("ws").alias("pos", "text"), "image_id").select(F.concat_ws("#", "image_id", "pos").alias("id"), "text")
    imgs = w.select("image_id", F.transform("ws", lambda x, i: F.concat_ws("#", F.col("image_id"), i.cast("string"))).alias("ids"))
    return Tb.join_annotations(imgs, anns)


@query("q66b_path_keys", """
select event_id, case when event_type in ('original', 'resize', 'jpeg', 'webp') then 'single' when event_type = 'overview_only' then 'k0' else concat('k', user_id) end as suffix, regexp_replace(props, '[^A-Za-z0-9._-]+', '_', 'g') as clean from events""")
def path_keys(spark, d):
    return V.table(spark, d, "events").select("event_id", Tb.partition_suffix(F.col("event_type"), F.col("user_id")).alias("suffix"), Tb.clean_id(F.col("props")).alias("clean"))


@query("q26b_patch_score", f"""
with {_SCORED}, g as (select *, n::double / 10 as conf, (idx % 7) / 7.0::double as edge, (idx % 5) / 5.0::double as ent from s)
select image_id, idx, round(0.40::double * score + 0.30::double * conf + 0.15::double * edge + 0.15::double * ent, 9) as patch_score from g""")
def patch_score(spark, d):
    s = scored(spark, d).select("image_id", "idx", F.col("score").alias("text_coverage"), (F.col("n") / 10).alias("text_confidence"), ((F.col("idx") % 7) / 7.0).alias("edge_density"), ((F.col("idx") % 5) / 5.0).alias("entropy"))
    return s.select("image_id", "idx", F.round(Sc.weighted(Sc.PATCH), 9).alias("patch_score"))


@query("q26c_best_pair", f"""
with {_SCORED}, r as (select *, row_number() over (partition by image_id order by score desc, idx) as r from s),
c as (select a.image_id, a.idx as f, b.idx as g, -(0.4::double * greatest(a.score, b.score) + 0.5::double * (a.score + b.score) + 0.1::double * (1 - {_IOU('a', 'b')})) as k from r a join r b on b.image_id = a.image_id and b.idx <> a.idx where a.r <= 3 and b.r <= 8 and {_IOU('a', 'b')} < 0.35)
select image_id, f as first, g as second from (select *, row_number() over (partition by image_id order by k, f, g) as n from c) where n = 1""")
def best_pair(spark, d):
    c = scored_pools(spark, d)
    pair = Sel.let(F.slice(Sel.best_first(F.col("c")), 1, 8), lambda best: Sel.pair(F.slice(best, 1, 3), best))
    return c.select("image_id", F.explode_outer(F.array(pair)).alias("p")).where("p is not null").select("image_id", "p.first", "p.second")  # a filter on the pair itself would compute it again


@query("q68_late_interaction")
def late_interaction(spark, d):
    x = V.questions(spark, d)
    return Z.late_interaction(x, ["conv_id", "turn"], "question", "page")


@query("q69_fuzzy_ratio")
def fuzzy_ratio(spark, d):
    x = V.predictions(spark, d)
    return x.select("conv_id", "turn", "route", F.round(Z.matcher_ratio(F.col("pred"), F.col("gold1")), 9).alias("ratio"))


@query("q70_entity_tokens")
def entity_tokens(spark, d):
    return V.table(spark, d, "conversations").select("conv_id", "turn", F.array_join(Z.entity_tokens(F.col("text")), " ").alias("entities"))


@query("q71_ocr_stub", """
with p as (select page_id as image_id, sha256(coalesce(html, '')) as s from pages), i as (select image_id, s, unnest([0, 2, 4]) as i from p)
select image_id, cast(i // 2 as integer) as box_id, concat('w', cast(concat('0x', substr(s, cast(2 * i + 1 as bigint), 2)) as integer)) as text, cast(concat('0x', substr(s, cast(2 * i + 3 as bigint), 2)) as integer) / 255.0::double as confidence from i""")
def ocr_stub(spark, d):
    p = V.table(spark, d, "pages").select(F.col("page_id").alias("image_id"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))
    return Mo.read_boxes(p).select("image_id", "box_id", "text", "confidence")


@query("q72_lr_ranker")
def lr_ranker(spark, d):
    """Out-of-fold probability of each labelled document from length and token features."""
    x = V.table(spark, d, "documents").join(V.table(spark, d, "labels"), "doc_id")
    t = T.tokens(F.col("text"))
    x = x.select("doc_id", F.col("quality").cast("double").alias("label"), F.log1p(F.col("n_chars")).alias("chars"), F.size(t).cast("double").alias("n"), T.duplicate_ratio(t).alias("dup"), (F.length(F.regexp_replace("text", r"[^\d]", "")) / F.greatest(F.lit(1), F.length("text"))).alias("digits"))
    features = Sc.guard_features(["chars", "n", "dup", "digits"])
    from pyspark.ml.functions import vector_to_array

    out = lambda m: m.select("doc_id", "fold", F.round(vector_to_array("probability")[1], 6).alias("score"))
    return Mo.out_of_fold(x, "doc_id", 3, lambda df: Mo.fit_ranker(df, features, "label"), out)


@query("q74_stream_replay", "select event_type, count(*) as n, round(sum(value), 6) as total from events group by 1")
def stream_replay(spark, d):
    """The events as a resumable stream into a table, then counted: equal to the batch result."""
    run = Tb.work_folder(spark, "replay")
    stream = spark.readStream.schema(St.EVENTS).parquet(f"{d}/events.parquet*")
    St.run_resumable(stream, lambda b: b.select("event_id", "event_type", "value"), "event_id", f"{run}/out", f"{run}/checkpoint")
    return spark.read.parquet(f"{run}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("q75_windows", "select time_bucket(interval '10 minutes', ts) as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2")
def windows(spark, d):
    return St.windowed(V.table(spark, d, "events")).withColumn("total", F.round("total", 6))


@query("q76_sessions", """
with e as (select user_id, ts, case when ts - lag(ts) over w < interval '30 minutes' then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from e)
select user_id, min(ts) as start, max(ts) + interval '30 minutes' as end, count(*) as n from s group by user_id, k""")
def sessions(spark, d):
    return St.sessions(V.table(spark, d, "events"))


