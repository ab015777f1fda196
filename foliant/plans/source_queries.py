"""Queries that write and read again: manifests, tables with changing columns, caches, reports, images, streams; and text forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import pixels as Px
from ..functions import text as T
from ..operators import labels as L
from ..operators import models as Mo
from ..operators import scores as Sc
from ..operators import selection as Sel
from ..operators import spatial as Sp
from ..sources import config as C
from ..sources import tables as Tb
from ..sources import views as V
from ..sources.tables import kept
from . import sqltext as S
from .registry import query
from .spatial_queries import _ASKED, _OVERLAP, _SCORED, patches, pool, scored


@query("q140_manifest_scan", "select cast(doc_id as varchar) as image_id, source as dataset, 'val' as split, lang as question, 2 as n_answers, concat('a', doc_id) as first_answer from documents")
def manifest_scan(spark, d):
    """Documents as manifest lines (answers a list or one value), read again by the typed reader."""
    path = Tb.work_folder(spark, "manifest")
    i = F.concat(F.lit("a"), F.col("doc_id").cast("string"))
    rows = V.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("image_id"), F.col("source").alias("dataset"), F.lit("val").alias("split"), F.lit("p.png").alias("image_path"), F.col("lang").alias("question"), F.array(i, F.lit("b")).alias("answer"))
    rows.write.json(path)
    m = Tb.read_manifest(spark, path)
    return m.select("image_id", "dataset", "split", "question", F.size("answer").alias("n_answers"), F.col("answer")[0].alias("first_answer"))


@query("q141_manifest_build", """
select cast(p.page_id as varchar) as image_id, coalesce(d.lang, '') as ocr_gt_text, 0 as n_answers from pages p left join documents d on d.doc_id = p.page_id and d.doc_id % 3 <> 0 where p.page_id % 5 <> 0 order by p.page_id limit 100""")
def manifest_build(spark, d):
    p = V.table(spark, d, "pages").select(F.col("page_id").cast("string").alias("image_id"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("image_path"), F.col("page_id").alias("line"))
    t = V.table(spark, d, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").cast("string").alias("image_id"), F.col("lang").alias("ocr_gt_text"))
    m = L.build_manifest(p, t, p.where("line % 5 <> 0").select(F.col("image_path").alias("path")), 100)
    return m.select("image_id", "ocr_gt_text", F.size("answer").alias("n_answers"))


@query("q142_prefix_split", """
with k as (select distinct source as image from documents), r as (select image, row_number() over (order by md5(concat('42:', image)), image) as r, count(*) over () as n from k)
select d.doc_id, case when r.r <= greatest(1, cast(floor(n * 0.2::double) as bigint)) then 'val' else 'train' end as split, d.doc_id in (select doc_id from documents order by doc_id limit 30) as first30 from documents d join r on r.image = d.source""")
def prefix_split(spark, d):
    """Image-level split, and the first rows in file order; the three subsets are prefixes of one another."""
    x = V.table(spark, d, "documents").select("doc_id", F.col("source").alias("image"))
    first = L.first_rows(x, "doc_id", 30).select("doc_id", F.lit(True).alias("first30"))
    return L.image_split(x, "image", 0.2).join(first, "doc_id", "left").select("doc_id", "split", F.coalesce("first30", F.lit(False)).alias("first30"))


@query("q143_csv_scan", "select event_type, count(*) as n, round(sum(value), 6) as total, 0::bigint as missing from events group by 1")
def csv_scan(spark, d):
    path = Tb.work_folder(spark, "csv")
    V.table(spark, d, "events").select("event_id", "event_type", "value").write.option("header", True).csv(path)
    x = Tb.read_csv(spark, path, "event_id long, event_type string, value double")
    gone = Tb.read_csv(spark, f"{path}-none", "event_id long").agg(F.count("*").alias("missing"))
    return x.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).join(F.broadcast(gone))


@query("q144_fallback_scan", "select doc_id, quality, null::integer as extra from labels where quality = 1")
def fallback_scan(spark, d):
    """The first existing of several tables, columns that it lacks null."""
    path = Tb.work_folder(spark, "scores")
    V.table(spark, d, "labels").select("doc_id", "quality").write.parquet(path)
    return Tb.first_existing(spark, [f"{path}-none", path, f"{d}/labels.parquet"], "doc_id long, quality int, extra int").where("quality = 1")


@query("q145_newest_scan", "select region_key, name from (select r_regionkey as region_key, r_name as name from region) order by 1")
def newest_scan(spark, d):
    import time

    path = Tb.work_folder(spark, "runs")
    r = V.table(spark, d, "region").select(F.col("r_regionkey").alias("region_key"), F.col("r_name").alias("name"))
    r.limit(0).coalesce(1).write.parquet(f"{path}/a")
    time.sleep(1.1)  # some stores keep whole seconds
    r.coalesce(1).write.parquet(f"{path}/b")
    return Tb.newest(spark, f"{path}/*/*.parquet")


@query("q146_box_cache", f"""
with {S.BOXES} select image_id, count(*) as n, sum(cast(trunc(x0 + 0.7) as bigint)) as x, round(sum(confidence), 6) as confidence, false as missing from boxes where image_id % 3 <> 0 group by 1
union all select image_id, 0, null, null, true from (select distinct image_id from boxes) where image_id % 3 = 0""")
def box_cache(spark, d):
    """Boxes through the cache (coordinates cut to whole pixels), and the pages that it lacks."""
    path = Tb.work_folder(spark, "boxes")
    b = V.boxes(spark, d)
    point = lambda x, y: F.array((F.col("x0") + x).cast("double"), (F.col("y0") + y).cast("double"))
    box = F.array(point(0.7, 0.2), point(40.0, 0.2), point(40.0, 12.9), point(0.7, 12.9))
    Tb.cache_boxes(b.where("image_id % 3 <> 0").select("image_id", F.lit("stub").alias("engine"), "box_id", box.alias("box"), "text", "confidence"), path)
    held = spark.read.parquet(path)
    found = held.groupBy("image_id").agg(F.count("*").alias("n"), F.sum(F.col("box")[0][0]).cast("long").alias("x"), F.round(F.sum("confidence"), 6).alias("confidence"), F.lit(False).alias("missing"))
    none = Tb.cache_misses(V.page_ids(spark, d), held, "stub").select("image_id", F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("x"), F.lit(None).cast("double").alias("confidence"), F.lit(True).alias("missing"))
    return found.unionByName(none)


@query("q147_text_cache", "select image_id, k, case when image_id % 4 = 0 then null else 'hit' end as state, case when image_id % 4 = 0 then null else concat('t', image_id, ' k', k) end as text from (select page_id as image_id, unnest([1, 2]) as k from pages)")
def text_cache(spark, d):
    """Texts of selected patches by (image, method, k): read through the cache, misses listed."""
    path = Tb.work_folder(spark, "texts")
    items = V.table(spark, d, "pages").select(F.col("page_id").alias("image_id"), F.lit("top").alias("method"), F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    text = F.concat(F.lit("t"), F.col("image_id").cast("string"), F.lit(" k"), F.col("k").cast("string"))
    Tb.cache_texts(items.where("image_id % 4 <> 0").withColumn("texts", F.split(text, " ")), path)
    hit, miss = Tb.cached_texts(items, spark.read.parquet(path))
    return hit.select("image_id", "k", F.lit("hit").alias("state"), F.array_join("texts", " ").alias("text")).unionByName(miss.select("image_id", "k", F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("text")))


@query("q148_growing_table", "select doc_id, 1 as a, null::integer as b from documents where doc_id % 2 = 0 union all select doc_id, null, 2 from documents where doc_id % 2 = 1")
def growing_table(spark, d):
    """Rows appended with other columns: the table has them all; writing it anew without leave fails."""
    path, x = Tb.work_folder(spark, "rows"), V.table(spark, d, "documents").select("doc_id")
    Tb.write_rows(x.where("doc_id % 2 = 0").withColumn("a", F.lit(1)), path)
    Tb.write_rows(x.where("doc_id % 2 = 1").withColumn("b", F.lit(2)), path, "append")
    try:
        Tb.write_rows(x, path)
        raise AssertionError("an existing table was overwritten")
    except Exception as e:
        if isinstance(e, AssertionError):
            raise
    return Tb.read_rows(spark, path).select("doc_id", "a", "b")


@query("q149_report_sink", f"with {S.RUNS}, g as (select method, avg(value) > 10 as passed from runs group by 1) select bool_and(passed) as all_passed, count(*) as n, string_agg(method, ',' order by method) as names from g")
def report_sink(spark, d):
    """A gate report as JSON text, read back."""
    g = V.runs(spark, d).groupBy(F.col("method").alias("name")).agg((F.avg("value") > 10).alias("passed"), F.create_map(F.lit("n"), F.count("*").cast("string")).alias("metrics"))
    r = L.gate_report(g).select(F.from_json("report", "results array<struct<name:string,passed:boolean>>, all_passed boolean").alias("r"))
    return r.select(F.col("r.all_passed").alias("all_passed"), F.size("r.results").cast("long").alias("n"), F.array_join(F.array_sort("r.results.name"), ",").alias("names"))


@query("q150_config", """
select concat('regions.', r.r_name, '.', n.n_name) as name, cast(n.n_nationkey as varchar) as value from nation n join region r on r.r_regionkey = n.n_regionkey
union all select concat('weights.', l_returnflag), concat('[', min(l_linenumber), ', ', max(l_linenumber), ']') from lineitem group by l_returnflag union all select 'name', '"tables"'""")
def config(spark, d):
    """A nested configuration made of tables (a row per nation and per return flag), flattened to dotted names."""
    n = V.table(spark, d, "nation").join(V.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    regions: dict[str, dict[str, int]] = {}
    for r in n.select("r_name", "n_name", "n_nationkey").collect():
        regions.setdefault(r["r_name"], {})[r["n_name"]] = r["n_nationkey"]
    modes = V.table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("b")).collect()
    return C.literals(spark, {"name": "tables", "regions": regions, "weights": {r["l_returnflag"]: [r["a"], r["b"]] for r in modes}})


@query("q151_run_identity", "select event_id, true as id_ok, true as time_ok from events")
def run_identity(spark, d):
    """The shape of a run's id and time, which change from run to run."""
    i, t = L.run_identity()
    x = V.table(spark, d, "events").select("event_id", i.alias("i"), t.alias("t"))
    return x.select("event_id", F.rlike("i", F.lit(r"^\d{8}T\d{6}-[0-9a-f]{8}$")).alias("id_ok"), F.col("t").isNotNull().alias("time_ok"))


@query("q152_repaired_answers", f"""
with {S.QA}, o as (select conv_id, turn, resize as pred, case when conv_id % 2 = 0 then {S.anls('resize', 'gold1')} else 0.123 end as old, list_distinct(list_filter([trim(gold1), '', trim(gold2)], lambda x: x <> '')) as golds, gold1, gold2 from qa)
select conv_id, turn, len(golds) as n, round(greatest({S.anls('pred', 'gold1')}, {S.anls('pred', 'gold2')}), 9) as anls, abs(greatest({S.anls('pred', 'gold1')}, {S.anls('pred', 'gold2')}) - old) > 1e-12 as changed from o""")
def repaired_answers(spark, d):
    q = V.questions(spark, d)
    old = F.when(F.col("conv_id") % 2 == 0, T.anls(F.col("resize"), F.array("gold1"))).otherwise(0.123)
    x = q.select("conv_id", "turn", F.col("resize").alias("pred"), old.alias("anls"), F.array(F.concat(F.lit(" "), "gold1"), F.lit("  "), F.concat("gold2", F.lit(" ")), "gold1").alias("answers"))
    return L.repaired(x, "answers", "pred").select("conv_id", "turn", F.size("answers").cast("long").alias("n"), F.round("anls", 9).alias("anls"), "changed")


@query("q153_answer_lists", """
select doc_id, case doc_id % 5 when 0 then 'x|y' when 1 then concat('v', doc_id) when 2 then '0.28' when 3 then 'a b|c' else '' end as answers from documents""")
def answer_lists(spark, d):
    i = F.col("doc_id")
    raw = F.when(i % 5 == 0, '["x", ["y", "x"], " "]').when(i % 5 == 1, F.concat(F.lit("v"), i.cast("string"))).when(i % 5 == 2, "[\"['0.28']\"]").when(i % 5 == 3, "['a b', 'c', 'a b']")
    return V.table(spark, d, "documents").select("doc_id", F.array_join(Tb.answers_of(raw), "|").alias("answers"))


@query("q154_probed_fields", "select event_id, case event_id % 3 when 0 then event_type when 1 then concat('t', event_id) else 'first' end as question from events")
def probed_fields(spark, d):
    """A question under the names that different sources give it."""
    i = F.col("event_id")
    j = F.when(i % 3 == 0, F.to_json(F.struct(F.col("event_type").alias("question")))).when(i % 3 == 1, F.to_json(F.struct(F.lit("").alias("question"), F.concat(F.lit("t"), i.cast("string")).alias("question_text")))).otherwise('{"texts": ["first", "second"]}')
    return V.table(spark, d, "events").select("event_id", Tb.probed(j, ["question", "question_text", "texts"]).alias("question"))


@query("q155_image_source", "select c_custkey as id, cast(1 + c_custkey % 7 as integer) as w, cast(2 + c_custkey % 5 as integer) as h, cast((1 + c_custkey % 7) * (2 + c_custkey % 5) as bigint) as area from customer")
def image_source(spark, d):
    w, h = 1 + F.col("c_custkey") % 7, 2 + F.col("c_custkey") % 5
    head = F.concat(F.lit("P5\n"), w.cast("string"), F.lit(" "), h.cast("string"), F.lit("\n255\n"))
    content = F.encode(F.concat(head, F.repeat(F.lit("~"), (w * h).cast("int"))), "ISO-8859-1")
    return V.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), C.image_size(content).alias("s")).select("id", "s.w", "s.h", "s.area")


_PIXEL = "((c_custkey * 31 + y * 7 + x * x * 3) % 256)"
_GRAY = f"g as (select c_custkey as id, x, y, {_PIXEL} as v from customer, (select unnest(range(0, 8)) as x), (select unnest(range(0, 6)) as y))"


@query("q156_pixel_scores", f"""
with {_GRAY}, dx as (select a.id, avg(abs(b.v - a.v)) as m from g a join g b on a.id = b.id and a.y = b.y and b.x = a.x + 1 group by 1), dy as (select a.id, avg(abs(b.v - a.v)) as m from g a join g b on a.id = b.id and a.x = b.x and b.y = a.y + 1 group by 1),
p as (select id, v, count(*) / 48.0::double as p from g group by 1, 2), e as (select id, -sum(p * log2(p)) / 8 as entropy from p group by 1),
k as (select id, min(x) filter (where v < 60) as x0, max(x) filter (where v < 60) as x1, min(y) filter (where v < 60) as y0, max(y) filter (where v < 60) as y1 from g group by 1)
select id, round((dx.m + dy.m) / 2 / 255, 9) as edge_density, round(entropy, 9) as entropy, cast(case when x0 is null then 0 else greatest(0, x0 - 1) end as integer) as left_, cast(case when x0 is null then 8 else least(8, x1 + 2) - greatest(0, x0 - 1) end as integer) as width,
  cast(case when y0 is null then 6 else least(6, y1 + 2) - greatest(0, y0 - 1) end as integer) as height from dx join dy using (id) join e using (id) join k using (id)""")
def pixel_scores(spark, d):
    """Edge density, entropy and content box of small images by the pixel kernels."""
    import numpy as np
    import pandas as pd

    def run(batches):
        for b in batches:
            out = []
            for i, content in zip(b["id"], b["content"], strict=True):
                gray = C.decode_image(bytes(content))
                x, _, w, h = Px.margin_box(gray, white=60, pad=1)
                out.append((i, round(Px.edge_density(gray), 9), round(Px.entropy(gray), 9), x, w, h))
            yield pd.DataFrame(out, columns=["id", "edge_density", "entropy", "left_", "width", "height"])

    assert np.uint8(255) == 255
    px = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda y: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda x: (F.col("c_custkey") * 31 + y * 7 + x * x * 3) % 256)))
    body = F.unhex(F.array_join(F.transform(px, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    rows = V.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.encode(F.lit("P5\n8 6\n255\n"), "UTF-8"), body).alias("content"))
    return rows.mapInPandas(run, "id long, edge_density double, entropy double, left_ int, width int, height int")


@query("q157_box_polygons", f"""
with {S.BOXES} select image_id, box_id, x0 + w / 2.0 as cx, y0 + h / 2.0 as cy, x0 as hull_x, w as hull_w, cast((x0 - 3) * 2 as integer) as moved_x, cast((y0 + h - 5) * 2 as integer) as moved_y from boxes""")
def box_polygons(spark, d):
    point = lambda x, y: F.array(x.cast("int"), y.cast("int"))
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h")
    b = V.boxes(spark, d).withColumn("p", F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1)))
    c, hull, moved = G.polygon_center(F.col("p")), G.polygon_hull(F.col("p")), G.remap(F.col("p"), F.lit(3), F.lit(5), F.lit(2.0))
    return b.select("image_id", "box_id", c["cx"].alias("cx"), c["cy"].alias("cy"), hull["x"].cast("long").alias("hull_x"), hull["w"].cast("long").alias("hull_w"), moved[0][0].alias("moved_x"), moved[2][1].alias("moved_y"))


_HINTS = "[':', 'total', 'date', 'name', 'amount', 'no.', '#', 'held', 'attended']"


@query("q158_label_value_boxes", f"""
with {S.BOXES}, {_ASKED}, t as (select image_id, box_id, lower(text) as low, {S.words('text')} as ws, q from boxes join q using (image_id))
select image_id, box_id, len(list_filter(q, lambda w: contains(low, w))) > 0 or len(list_filter({_HINTS}, lambda w: contains(low, w))) > 0 as label_like, trim(low) <> '' and (case when regexp_matches(low, '\\d[\\d,./%-]*') then len(ws) between 1 and 6 else len(ws) <= 4 end) as value_like,
  trim(low) <> '' and (case when regexp_matches(low, '\\d[\\d,./%-]*') then len(ws) between 1 and 8 else len(ws) <= 5 end) as wide_value_like from t""")
def label_value_boxes(spark, d):
    """Which boxes look like labels of what is asked and which like values; no page's question asks for a type that a name has."""
    b = V.boxes(spark, d).join(V.box_questions(spark, d), "image_id")
    t, q = F.col("text"), F.lit("")
    return b.select("image_id", "box_id", T.label_like(t, T.content_tokens(F.col("question"))).alias("label_like"), T.value_like(t, q).alias("value_like"), T.value_like(t, q, 8, 5).alias("wide_value_like"))


@query("q159_label_boost", f"""
with {_OVERLAP}, {_ASKED}, t as (select p.image_id, p.idx, coalesce(string_agg(o.text, ' ' order by o.box_id), '') as text from patches p left join o on o.image_id = p.image_id and o.idx = p.idx group by all),
s as (select t.*, {S.words('text')} as ws, q from t join q using (image_id)),
r as (select image_id, idx, lower(text) as low, case when len(q) = 0 or len(ws) = 0 then 0.0 else len(list_filter(q, lambda w: list_contains(ws, w)))::double / len(q) end as ov from s)
select image_id, idx, case when ov < 0.5 then 0.0 when contains(low, ':') or contains(low, 'total') or contains(low, 'date') or contains(low, 'name') or contains(low, 'amount') or contains(low, 'no.') or contains(low, '#') then 0.15 else 0.05 end::double as boost from r""")
def label_boost(spark, d):
    t = Sp.rows_of(pool(spark, d, "text").join(V.box_questions(spark, d).hint("merge"), "image_id"), "question")
    return t.select("image_id", "idx", Sc.label_boost(T.token_overlap(F.col("question"), F.col("text")), F.col("text")).alias("boost"))


_WEIGHED = lambda w: " + ".join(f"{v}::double * {k}" for k, v in w.items())
_FEATS = f"""{_SCORED}, g as (select image_id, idx, score as text_coverage, (n % 10) / 10.0::double as text_confidence, (idx % 4) / 4.0::double as question_overlap, (idx % 6) / 6.0::double as ratio, (idx % 7) / 7.0::double as edge_density, (idx % 5) / 5.0::double as entropy,
  (idx % 3) / 3.0::double as bm25, (idx % 2)::double as answer_type, (idx % 9) / 9.0::double as label_value_proximity, ((idx // 2) % 2)::double as same_row_label_value, ((idx // 3) % 2)::double as below_label_relation from s),
f as (select *, {_WEIGHED(Sc.QUESTION_AWARE)} as q_score from g)"""


def features(spark, d, *more, **options):
    """Scores of scored() patches, and `more` of its columns; options are its own."""
    i = F.col("idx")
    share = lambda k: (i % k).cast("double") / k
    x = scored(spark, d, **options).select("image_id", "idx", *more, F.col("score").alias("text_coverage"), (F.col("n") % 10 / 10.0).alias("text_confidence"), share(4).alias("question_overlap"), share(6).alias("ratio"), share(7).alias("edge_density"), share(5).alias("entropy"), share(3).alias("bm25"), (i % 2).cast("double").alias("answer_type"), share(9).alias("label_value_proximity"), (F.floor(i / 2) % 2).cast("double").alias("same_row_label_value"), (F.floor(i / 3) % 2).cast("double").alias("below_label_relation"))
    return x.withColumn("q_score", Sc.weighted(Sc.QUESTION_AWARE))


@query("q160_weighted_scores", f"""
with {_FEATS} select image_id, idx, q_score as question_aware, {_WEIGHED(Sc.EVIDENCE_V1)} as evidence_v1, {_WEIGHED(Sc.EVIDENCE_V2)} as evidence_v2, {_WEIGHED(Sc.PROXY)} as proxy from f""")
def weighted_scores(spark, d):
    one = lambda w, n: Sc.weighted(w).alias(n)
    return features(spark, d).select("image_id", "idx", F.col("q_score").alias("question_aware"), one(Sc.EVIDENCE_V1, "evidence_v1"), one(Sc.EVIDENCE_V2, "evidence_v2"), one(Sc.PROXY, "proxy"))


@query("q161_selector_registry", f"""
with {_FEATS}, r as (select image_id, idx, row_number() over (partition by image_id order by text_confidence desc, idx) as conf, row_number() over (partition by image_id order by bm25 desc, idx) as bm, row_number() over (partition by image_id order by question_overlap desc, idx) as ov, row_number() over (partition by image_id order by answer_type desc, idx) as aty,
  row_number() over (partition by image_id order by {_WEIGHED(Sc.EVIDENCE_V1)} desc, idx) as v1, count(*) over (partition by image_id) as n from f)
select 'ocr_confidence_topk' as method, image_id, idx from r where conf <= 2 union all select 'bm25_only', image_id, idx from r where bm <= 2 union all select 'question_overlap_topk', image_id, idx from r where ov <= 2 union all select 'answer_type_only', image_id, idx from r where aty <= 2
union all select 'evidence_topk', image_id, idx from r where v1 <= 2 union all select 'uniform', image_id, idx from r where idx in (0, n // 2) union all select 'multiscale_uniform', image_id, idx from r where idx in (0, n // 2)""")
def selector_registry(spark, d):
    """Named selectors over one table of features."""
    x = features(spark, d).withColumn("evidence_v1", Sc.weighted(Sc.EVIDENCE_V1))
    return Sc.select_each(x, ["ocr_confidence_topk", "bm25_only", "question_overlap_topk", "answer_type_only", "evidence_topk", "uniform", "multiscale_uniform"], ["image_id"], 2)


@query("q162_patch_diagnostics", f"""
with {_OVERLAP}, k as (select image_id, idx from patches where idx in (0, 7)), t as (select image_id, sum(w * h) as total from boxes group by 1),
s as (select k.image_id, k.idx, coalesce(sum(o.area), 0)::double / any_value(t.total) as cover from k join t using (image_id) left join o on o.image_id = k.image_id and o.idx = k.idx group by 1, 2),
bz as (select o.image_id, count(distinct o.box_id) as n, bool_or(contains(o.text, 'metal')) as hit from o join k on k.image_id = o.image_id and k.idx = o.idx group by 1)
select s.image_id, coalesce(any_value(bz.n), 0) as n_boxes, round(avg(s.cover), 4) as coverage, coalesce(any_value(bz.hit), false) as answer_in_patches, any_value(f.hit) as answer_on_page from s left join bz using (image_id) join (select image_id, bool_or(contains(text, 'metal')) as hit from boxes group by 1) f using (image_id) group by 1""")
def patch_diagnostics(spark, d):
    return Sp.diagnostics(patches(spark, d).where("idx in (0, 7)"), V.boxes(spark, d), F.lit("metal"))


@query("q163_pool_hash", """
with p as (select c_custkey as id, c_name as q, list_transform(range(0, 2), lambda i: concat('{"x":', c_custkey % 90 + i, ',"y":', i, '}')) as r from customer)
select id, substr(sha256(concat('{"patches":[', array_to_string(r, ','), '],"question":"', substr(q, 1, 32), '"}')), 1, 16) as hash from p""")
def pool_hash(spark, d):
    x, i = F.col("c_custkey") % 90, F.array(F.lit(0), F.lit(1))
    p = F.transform(i, lambda k: F.struct((x + k).alias("x"), k.alias("y")))
    return V.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), Tb.pool_hash(F.col("c_name"), p).alias("hash"))


@query("q164_json_scalars", "select doc_id, concat('[\"', source, '\",\"', lang, '\"]') as text, 2 as n, lang as last from documents")
def json_scalars(spark, d):
    """Answers to JSON text and back."""
    x = V.table(spark, d, "documents").select("doc_id", F.to_json(F.array("source", "lang")).alias("text"))
    back = Tb.as_list(F.col("text"))
    return x.select("doc_id", "text", F.size(back).alias("n"), back[1].alias("last"))


@query("q165_isolated_failures", "select page_id as image_id, case when page_id % 7 = 0 then 'ValueError: empty' end as error, case when page_id % 7 = 0 then 1 else 2 end as n from pages")
def isolated_failures(spark, d):
    """An image that fails gives a row with its error and ends nothing; misses only, as a batch job would run."""
    Mo.register_engine("two_words", _two_words)
    p = V.table(spark, d, "pages").select(F.col("page_id").alias("image_id"), F.encode(F.when(F.col("page_id") % 7 == 0, "").otherwise("some words here"), "UTF-8").alias("content"))
    path = Tb.work_folder(spark, "job")
    Mo.batch_read(p.where("image_id % 2 = 0"), path, "two_words")
    Mo.batch_read(p, path, "two_words")  # only what the first run left
    x = spark.read.parquet(path)
    return x.groupBy("image_id").agg(F.max("error").alias("error"), F.count("*").cast("int").alias("n"))


def _two_words():
    def read(content: bytes) -> list[tuple]:
        if not content:
            raise ValueError("empty")
        return [([[0, 0], [9, 0], [9, 9], [0, 9]], w, 0.5) for w in content.decode().split()[:2]]

    return read


@query("q166_reader_stub", f"with {S.QA} select conv_id, turn, concat('Answer: ', len(string_split(question, ' ')), '.') as raw, cast(len(string_split(question, ' ')) as varchar) as parsed, null::varchar as error from qa")
def reader_stub(spark, d):
    """Prompts through a registered reader in batches: raw output, parsed answer, error."""
    Mo.register_reader("count_words", lambda: lambda prompt, images: f"Answer: {len(prompt.split(' '))}.")
    q = V.questions(spark, d).select("conv_id", "turn", F.col("question").alias("prompt"), F.array().cast("array<binary>").alias("images"))
    x = Mo.read_prompts(q, ["conv_id", "turn"], "count_words")
    return x.select("conv_id", "turn", "raw", T.parse_answer(F.col("raw")).alias("parsed"), "error")


@query("q167_manifest_stream", "select dataset, count(*) as n from (select source as dataset from documents) group by 1")
def manifest_stream(spark, d):
    """Manifest lines as a stream, one file at a time, into a table."""
    path = Tb.work_folder(spark, "lines")
    V.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("image_id"), F.col("source").alias("dataset")).repartition(3).write.json(f"{path}/in")
    from ..streaming import replay as St

    St.run_resumable(St.manifest_stream(spark, f"{path}/in"), lambda b: b.select("image_id", "dataset"), "image_id", f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out").groupBy("dataset").agg(F.count("*").alias("n"))


@query("q168_stub_boxes", f"""
with p as (select page_id as image_id, sha256(coalesce(html, '')) as s from pages), i as (select image_id, s, unnest([0, 2, 4]) as i from p), v as (select image_id, i // 2 as box_id, cast(concat('0x', substr(s, cast(2 * i + 1 as bigint), 2)) as integer) as a, cast(concat('0x', substr(s, cast(2 * i + 3 as bigint), 2)) as integer) as b from i)
select image_id, cast(box_id as integer) as box_id, concat('w', a) as text, b / 255.0::double as confidence, a * 3 as x, b * 4 as y from v""")
def stub_boxes(spark, d):
    p = V.table(spark, d, "pages").select(F.col("page_id").alias("image_id"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))
    return Mo.read_boxes(p).select("image_id", "box_id", "text", "confidence", F.col("box")[0][0].alias("x"), F.col("box")[0][1].alias("y"))


@query("q169_learned_selection", f"""
with {_FEATS}, l as (select image_id, idx, q_score as q, (idx * 7 % 11) / 11.0::double as s from f), m as (select *, min(q) over w as ql, max(q) over w as qh, min(s) over w as sl, max(s) over w as sh from l window w as (partition by image_id)),
h as (select *, 0.5::double * case when qh > ql then (q - ql) / (qh - ql) else 0 end + 0.5::double * case when sh > sl then (s - sl) / (sh - sl) else 0 end as hybrid from m)
select image_id, idx, hybrid, cast(r as bigint) as rank from (select *, row_number() over (partition by image_id order by hybrid desc, idx) as r from h) where r <= 2""")
def learned_selection(spark, d):
    """Out-of-fold scores blended with the question-aware score, the two best per page."""
    from ..operators import metrics as M

    x = features(spark, d).select("image_id", "idx", F.col("q_score").alias("q"), ((F.col("idx") * 7 % 11) / 11.0).alias("s"))
    x = x.withColumn("hybrid", 0.5 * M.min_max("q", ["image_id"]) + 0.5 * M.min_max("s", ["image_id"]))
    return Sel.top_k(x, ["image_id"], "hybrid", "idx", 2).select("image_id", "idx", "hybrid", F.col("rank").cast("long").alias("rank"))


@query("q170_ranker_rows", f"""
with {_FEATS}, p as (select image_id, idx, row_number() over (partition by image_id order by q_score desc, idx) as r, text_coverage, q_score from f)
select image_id, idx, cast(r as bigint) as q_rank, r = 1 as is_top1, r <= 2 as is_top2, text_coverage >= 0.02 as label, case when cast(concat('0x', substr(md5(cast(image_id as varchar)), 1, 8)) as bigint) % 5 = 0 then 'val' else 'train' end as split from p""")
def ranker_rows(spark, d):
    """Rows of a ranker's data set: features with ranks, label and the page's split; label columns are never features."""
    Sc.guard_features([c for c in features(spark, d).columns if c not in ("image_id", "idx")])
    x = features(spark, d).withColumn("q", F.col("q_score"))
    r = F.row_number().over(Window.partitionBy("image_id").orderBy(F.col("q").desc(), "idx")).cast("long")
    fold = F.conv(F.substring(F.md5(F.col("image_id").cast("string")), 1, 8), 16, 10).cast("long") % 5
    x = x.withColumn("q_rank", r)
    return x.select("image_id", "idx", "q_rank", (F.col("q_rank") == 1).alias("is_top1"), (F.col("q_rank") <= 2).alias("is_top2"), (F.col("text_coverage") >= 0.02).alias("label"), F.when(fold == 0, "val").otherwise("train").alias("split"))
