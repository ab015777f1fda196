"""Queries of fitted models, pixel searches, the legacy patch pipeline, charts and connectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pixels as Px
from ..functions import text as T
from ..operators import models as Mo
from ..operators import selection as Sel
from ..sources import config as C
from ..sources import datasource as Ds
from ..sources import views as V
from . import sqltext as S
from .registry import query
from .routing_queries import LONG, with_candidates
from .spatial_queries import _IOU, _SCORED, scored


@query("q200_ridge", """
with x as (select d.doc_id, ln(1 + n_chars) as x, l.quality::double as y from documents d join labels l using (doc_id)), m as (select avg(x) as mx, avg(y) as my from x),
b as (select sum((x - mx) * (y - my)) / (sum((x - mx) * (x - mx)) + 5.0::double) as b, any_value(mx) as mx, any_value(my) as my from x, m) select doc_id, round(my + b * (x - mx), 6) as predicted from x, b""")
def ridge(spark, d):
    x = V.table(spark, d, "documents").join(V.table(spark, d, "labels"), "doc_id").select("doc_id", F.log1p("n_chars").alias("x"), F.col("quality").cast("double").alias("y"))
    return Mo.fit_values(x, ["x"], "y", 5.0).transform(x).select("doc_id", F.round("prediction", 6).alias("predicted"))


@query("q201_out_of_fold_selection", f"""
with {LONG}, tz as (select conv_id, turn, pos, route, len::double as x, anls as y, cast(concat('0x', substr(md5(concat(conv_id, ':', turn)), 1, 8)) as bigint) % 3 as fold from x),
f as (select r.k, tz.* from tz, range(3) r(k) where tz.fold <> r.k), m as (select k, avg(x) as mx, avg(y) as my from f group by 1),
b as (select f.k, any_value(mx) as mx, any_value(my) as my, sum((x - mx) * (y - my)) / (sum((x - mx) * (x - mx)) + 1.0::double) as b from f join m on m.k = f.k group by 1),
p as (select tz.*, my + b * (x - mx) as predicted from tz join b on b.k = tz.fold), g as (select *, max(predicted) over (partition by conv_id, turn) as top from p)
select conv_id, turn, arg_min(route, pos) as route, round(arg_min(predicted, pos), 6) as predicted from g where predicted >= top - 1e-9 group by 1, 2""")
def out_of_fold_selection(spark, d):
    q = with_candidates(spark, d).select("conv_id", "turn", "gold1", "gold2", F.explode("c").alias("c"))
    x = q.select("conv_id", "turn", F.col("c.route").alias("route"), F.length("c.norm").cast("double").alias("len"), T.anls(F.col("c.pred"), F.array("gold1", "gold2")).alias("anls"))
    out = Mo.select_out_of_fold(x, ["conv_id", "turn"], ["len"], "anls", ["resize", "bm25", "learned"])
    return out.select("conv_id", "turn", "route", F.round("predicted", 6).alias("predicted"))


@query("q202_pairwise_rows", f"""
with {LONG} select a.conv_id, a.turn, round(sum(a.len - b.len), 6) as difference, count(*) as n, count(*) filter (where a.anls > b.anls) as better from x a join x b on a.conv_id = b.conv_id and a.turn = b.turn and a.anls <> b.anls group by 1, 2""")
def pairwise_rows(spark, d):
    """Pairs of one question's readers with unlike scores, as a pairwise ranker reads them."""
    q = with_candidates(spark, d).select(F.concat_ws(":", "conv_id", "turn").alias("g"), "conv_id", "turn", "gold1", "gold2", F.explode("c").alias("c"))
    x = q.select("g", F.length("c.norm").cast("double").alias("len"), T.anls(F.col("c.pred"), F.array("gold1", "gold2")).alias("anls"))
    p = Mo.pairwise(x, "g", ["len"], "anls").groupBy("g").agg(F.round(F.sum("len"), 6).alias("difference"), F.count("*").alias("n"), F.sum("label").cast("long").alias("better"))
    key = F.split("g", ":")
    return p.select(key[0].cast("long").alias("conv_id"), key[1].cast("long").alias("turn"), "difference", "n", "better")


@query("q203_quality_search", """
with x as (select c_custkey as id, 40 + c_custkey % 60 as step, 3000 + (c_custkey * 37) % 4000 as target from customer), q as (select id, max(q) as q from x, range(5, 96) t(q) where 900 + q * step <= target group by 1)
select x.id, cast(coalesce(q.q, 5) as integer) as quality, q.q is not null as valid from x left join q using (id)""")
def quality_search(spark, d):
    """The largest quality within a byte budget, with an encoder's size that grows with quality standing in for a codec."""
    import pandas as pd

    def run(batches):
        for b in batches:
            found = [Px.largest_quality(lambda q, s=s: 900 + q * s, t) for s, t in zip(b["step"], b["target"], strict=True)]
            yield pd.DataFrame({"id": b["id"], "quality": [f[0] for f in found], "valid": [f[1] for f in found]})

    k = F.col("c_custkey")
    return V.table(spark, d, "customer").select(k.alias("id"), (40 + k % 60).alias("step"), (3000 + (k * 37) % 4000).alias("target")).mapInPandas(run, "id long, quality int, valid boolean")


_DOT = "case when x = c_custkey % 20 + 2 and y = c_custkey % 10 + 3 then 0 else 255 end"


@query("q204_page_compression", """
with m as (select c_custkey as id, c_custkey % 20 + 2 as cx, c_custkey % 10 + 3 as cy from customer), b as (select id, greatest(0, cx - 8) as x0, least(30, cx + 9) as x1, greatest(0, cy - 8) as y0, least(20, cy + 9) as y1 from m)
select id, cast(x1 - x0 as integer) as margin_w, cast(y1 - y0 as integer) as margin_h, cast(greatest(1, floor((x1 - x0) * 0.5::double)) as integer) as resize_w, cast(greatest(1, floor((y1 - y0) * 0.5::double)) as integer) as resize_h from b""")
def page_compression(spark, d):
    """Pages of one dark dot: the margin crop, and the crop at a quarter of its area."""
    import numpy as np
    import pandas as pd

    def run(batches):
        for b in batches:
            out = []
            for i in b["id"]:
                page = np.full((20, 30), 255, np.uint8)
                page[i % 10 + 3, i % 20 + 2] = 0
                a, z = Px.compressed(page, "margin"), Px.compressed(page, "resize")
                out.append((i, a.shape[1], a.shape[0], z.shape[1], z.shape[0]))
            yield pd.DataFrame(out, columns=["id", "margin_w", "margin_h", "resize_w", "resize_h"])

    return V.table(spark, d, "customer").select(F.col("c_custkey").alias("id")).mapInPandas(run, "id long, margin_w int, margin_h int, resize_w int, resize_h int")


@query("q205_overview_and_patches", f"""
with {_SCORED}, u as (select image_id, count(*) as n, sum(w * h) as px from (select *, count(*) over w as m, row_number() over (partition by image_id order by idx) - 1 as pos from s window w as (partition by image_id)) where pos in (0, m // 4, m // 2, (3 * m) // 4) group by 1),
v as (select *, least(1.0, sqrt(50000.0::double / (1000 * 1300))) as sc from (select 'uniform' as mode, image_id, n, px from u union all select 'overview_only', image_id, 0, 0 from u))
select mode, image_id, n as n_patches, cast(floor(1000 * sc) as integer) as overview_w, cast(floor(1300 * sc) as integer) as overview_h, cast(floor(1000 * sc) * floor(1300 * sc) as bigint) as overview_pixels, cast(px as bigint) as patch_pixels, cast(floor(1000 * sc) * floor(1300 * sc) + px as bigint) as total_pixels from v""")
def overview_and_patches(spark, d):
    p = scored(spark, d).withColumn("patch_score", F.col("score")).withColumn("q_score", F.col("score"))
    pages = V.page_ids(spark, d).select("image_id", F.lit(V.PAGE_W).alias("w"), F.lit(V.PAGE_H).alias("h"))
    one = lambda m: Sel.overview_and_patches(p, pages, m, 4).select(F.lit(m).alias("mode"), "*")
    return one("uniform").unionByName(one("overview_only"))


@query("q206_line_chart", f"""
with {S.RUNS}, g as (select method, budget % 10 as k, avg(value) as v from runs group by 1, 2), e as (select min(k) as a, max(k) as b, min(v) as c, max(v) as d from g),
p as (select method, k, floor((k - a)::double / greatest(b - a, 1e-12) * 400 * 2 + 0.5) / 2 as px, 300 - floor((v - c) / greatest(d - c, 1e-12) * 300 * 2 + 0.5) / 2 as py from g, e)
select method, string_agg(concat(printf('%.1f', px), ',', printf('%.1f', py)), ' ' order by k) as points from p group by 1""")
def line_chart(spark, d):
    r = V.runs(spark, d).groupBy("method", (F.col("budget") % 10).alias("k")).agg(F.avg("value").alias("v"))
    return C.line_chart(r, "method", "k", "v")


@query("q207_connector", "select doc_id as image_id, source as question from documents")
def connector(spark, d):
    """The whole table through a paged client, a page per file or row group, as a remote data set would come."""
    Ds.register_paged(spark, "parquet_pages", Ds.FolderClient)
    C.register_connector("documents", lambda s, folder: s.read.format("parquet_pages").option("path", f"{folder}/documents.parquet").option("columns", "doc_id,source").load())
    return C.connect(spark, "documents", folder=d).select(F.col("doc_id").alias("image_id"), F.col("source").alias("question"))


@query("q208_guided_patches", f"""
with recursive {_SCORED}, l as (select image_id, list(struct_pack(idx := idx, x := x, y := y, w := w, h := h) order by score desc, idx) as c from s group by 1),
k as (select image_id, list_reduce(c, lambda acc, p: case when len(list_filter(acc, lambda k: {_IOU('k', 'p')} >= 0.5)) > 0 then acc else list_append(acc, p) end, c[1:0])[1:4] as kept from (select image_id, list_transform(c, lambda p: p) as c from l))
select image_id, len(kept) as n_patches, cast(list_sum(list_transform(kept, lambda k: k.w * k.h)) as bigint) as patch_pixels from k""")
def guided_patches(spark, d):
    p = scored(spark, d).withColumn("patch_score", F.col("score")).withColumn("q_score", F.col("score"))
    pages = V.page_ids(spark, d).select("image_id", F.lit(V.PAGE_W).alias("w"), F.lit(V.PAGE_H).alias("h"))
    return Sel.overview_and_patches(p, pages, "ocr_guided", 4).select("image_id", "n_patches", "patch_pixels")
