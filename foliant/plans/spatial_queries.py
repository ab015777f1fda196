"""Queries of rectangles, boxes and their selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import selection as Sel
from ..operators import spatial as Sp
from ..sources import views as V
from . import sqltext as S
from .registry import query

W, H = V.PAGE_W, V.PAGE_H


#: Size and step of the grid of a page.
GRID = (W, H, 384, 384, 256, 256)


def pool(spark, d, *more, boxes=None):
    """The grid of every page with what it has of the page's boxes, a row per page: see Sp.grid_pool()."""
    return Sp.grid_pool(V.page_ids(spark, d), V.boxes(spark, d) if boxes is None else boxes, G.grid_rectangles(*GRID), *more)


def patches(spark, d):
    """The grid of every page; hinted, as Spark's estimate of an explode would broadcast it."""
    g = V.page_ids(spark, d).select("image_id", F.posexplode(G.grid(*GRID)).alias("idx", "r"))
    return g.select("image_id", F.col("idx").cast("long").alias("idx"), *[F.col(f"r.{c}").cast("long").alias(c) for c in "xywh"]).hint("merge")


_PB = f"{S.PATCHES}, {S.BOXES}, b as (select *, x0 + w / 2.0 as cx, y0 + h / 2.0 as cy from boxes)"
_OVERLAP = f"""{_PB},
o as (select p.image_id, p.idx, b.box_id, b.confidence, b.text, greatest(0, least(p.x + p.w, b.x0 + b.w) - greatest(p.x, b.x0)) * greatest(0, least(p.y + p.h, b.y0 + b.h) - greatest(p.y, b.y0)) as area
  from patches p join b on p.image_id = b.image_id where least(p.x + p.w, b.x0 + b.w) > greatest(p.x, b.x0) and least(p.y + p.h, b.y0 + b.h) > greatest(p.y, b.y0))"""
_ASKED = f"""q as (select o_orderkey as image_id, {S.content("concat('What is the total of the ', p_name, ' in ', o_orderpriority, '?')")} as q from orders join part on p_partkey = o_orderkey % 64 + 1)"""


@query("q16_grid_patches", f"with {S.PATCHES} select image_id, idx, cast(x as bigint) as x, cast(y as bigint) as y, cast(w as bigint) as w, cast(h as bigint) as h from patches")
def grid_patches(spark, d):
    return patches(spark, d)


@query("q17_strips", """
with p as (select distinct l_orderkey as image_id from lineitem),
s as (
  select 'wide' as kind, x, y, least(512, 1000 - x) as w, least(256, 1300 - y) as h from (select unnest(range(0, 1300, 128)) as y), (select unnest(range(0, 1000, 256)) as x)
  union all select 'tall', x, y, least(256, 1000 - x), least(512, 1300 - y) from (select unnest(range(0, 1300, 256)) as y), (select unnest(range(0, 1000, 128)) as x))
select image_id, kind, count(*) as n, cast(sum(w * h) as bigint) as area, cast(sum(x * 7 + y) as bigint) as place from p, s group by 1, 2""")
def strips(spark, d):
    p = V.page_ids(spark, d)
    wide, tall = G.grid(W, H, 512, 256, 256, 128), G.grid(W, H, 256, 512, 128, 256)
    out = p.select("image_id", F.lit("wide").alias("kind"), F.explode(wide).alias("r")).unionByName(p.select("image_id", F.lit("tall").alias("kind"), F.explode(tall).alias("r")))
    return out.groupBy("image_id", "kind").agg(F.count("*").alias("n"), F.sum(F.col("r.w") * F.col("r.h")).cast("long").alias("area"), F.sum(F.col("r.x") * 7 + F.col("r.y")).cast("long").alias("place"))


@query("q17b_anchors", f"""
with {S.BOXES}, a as (select image_id, box_id, x0 + w / 2.0 as cx, y0 + h / 2.0 as cy from boxes),
c as (select image_id, box_id, greatest(0, least(cast(round_even(cx - 128, 0) as bigint), 999)) as x, greatest(0, least(cast(round_even(cy - 128, 0) as bigint), 1299)) as y from a)
select image_id, box_id, x, y, least(256, 1000 - x) as w, least(256, 1300 - y) as h from c""")
def centred_patches(spark, d):
    c = Sp.centres(V.boxes(spark, d)).withColumn("r", G.centred(F.col("cx"), F.col("cy"), 256, W, H))
    return c.select("image_id", "box_id", *[F.col(f"r.{k}").cast("long").alias(k) for k in "xywh"])


@query("q18_row_bands", f"""
with {S.BOXES}, g as (
  select image_id, floor(floor(y0 + h / 2.0) / 400) as band, count(*) as n, min(x0) as x0, max(x0 + w) as x1, min(y0) as y0, max(y0 + h) as y1 from boxes group by 1, 2)
select image_id, cast(band as bigint) as band, greatest(0, x0 - 8) as x, greatest(0, y0 - 8) as y, greatest(64, x1 - x0 + 16) as w, greatest(32, least(256, y1 - y0 + 16)) as h from g where n >= 3""")
def row_bands(spark, d):
    return Sp.row_bands(V.boxes(spark, d), band=400)


@query("q19_patch_text", f"""
with {_OVERLAP} select p.image_id, p.idx, coalesce(t.text, '') as text from patches p
left join (select image_id, idx, string_agg(text, ' ' order by box_id) as text from o group by 1, 2) t on t.image_id = p.image_id and t.idx = p.idx""")
def patch_text(spark, d):
    return Sp.rows_of(pool(spark, d, "text")).select("image_id", "idx", "text")


@query("q20_patch_coverage_conf", f"""
with {_OVERLAP}, t as (select image_id, sum(w * h) as total from b group by 1), a as (select image_id, idx, sum(area) as area, avg(confidence) as c from o group by 1, 2)
select p.image_id, p.idx, coalesce(a.area, 0)::double / t.total as text_coverage, round(coalesce(a.c, 0), 9) as text_confidence
from patches p left join a on a.image_id = p.image_id and a.idx = p.idx left join t on t.image_id = p.image_id""")
def patch_coverage(spark, d):
    x = Sp.rows_of(pool(spark, d, "confidence"), "total")
    share = F.when(F.col("total") > 0, F.col("area") / F.col("total")).otherwise(0.0)
    return x.select("image_id", "idx", share.alias("text_coverage"), F.round(F.coalesce("confidence", F.lit(0.0)), 9).alias("text_confidence"))


_EDGES = """c as (select *, x0 + w / 2.0 as cx0, y0 + h / 2.0 as cy0 from boxes),
e0 as (select a.image_id, a.box_id as a, b.box_id as b, a.w as aw, abs(a.cx0 - b.cx0) as dx, abs(a.cy0 - b.cy0) as dy, b.cx0 - a.cx0 as r, b.cy0 - a.cy0 as d from c a join c b on a.image_id = b.image_id and a.box_id < b.box_id),
edges as (
  select image_id, a, b, 'same_row' as rel from e0 where dy < 15 and dx < greatest(aw, 50)
  union all select image_id, a, b, 'same_column' from e0 where dx < 15 and dy < 40
  union all select image_id, a, b, 'nearby_right' from e0 where r > 0 and r < 200 and dy < 20
  union all select image_id, a, b, 'nearby_below' from e0 where d > 0 and d < 80 and dx < 40)"""


@query("q21_layout_edges", f"with {S.BOXES}, {_EDGES} select image_id, a, b, rel from edges")
def layout_edges(spark, d):
    return Sp.layout_edges(V.boxes(spark, d))


@query("q22_graph_features", f"""
with {_PB}, {_EDGES}, {_ASKED},
k as (select c.image_id, c.box_id, c.cx0, c.cy0 from c join q using (image_id) where len(list_filter(q, lambda t: contains(lower(text), t))) > 0),
e as (select image_id, a, b, rel from edges union all select image_id, b, a, rel from edges),
n as (select e.image_id, e.rel, c.cx0, c.cy0, sqrt(pow(c.cx0 - k.cx0, 2) + pow(c.cy0 - k.cy0, 2)) as d from e join k on k.image_id = e.image_id and k.box_id = e.a join c on c.image_id = e.image_id and c.box_id = e.b),
m as (select image_id, min(d) as d from n group by 1),
r as (select p.image_id, p.idx, max((n.rel = 'same_row')::int)::double as row, max((n.rel = 'nearby_below')::int)::double as below from patches p join n on n.image_id = p.image_id and cx0 >= x and cx0 < x + w and cy0 >= y and cy0 < y + h group by 1, 2),
i as (select p.image_id, p.idx, count(*) as n from patches p join b on b.image_id = p.image_id and cx >= x and cx < x + p.w and cy >= y and cy < y + p.h group by 1, 2)
select p.image_id, p.idx, coalesce(r.row, 0) as same_row_label_value, coalesce(r.below, 0) as below_label_relation, round(1 / (1 + coalesce(m.d, 0)), 9) as dist_qnode_to_patch,
  round(coalesce(i.n, 0)::double / greatest(1.0, p.h / 20.0)::double, 9) as patch_line_density, coalesce(i.n, 0)::double as patch_box_density
from patches p left join r on r.image_id = p.image_id and r.idx = p.idx left join i on i.image_id = p.image_id and i.idx = p.idx left join m on m.image_id = p.image_id""")
def graph_features(spark, d):
    return Sp.graph_features(patches(spark, d), V.boxes(spark, d), V.box_questions(spark, d))


@query("q23_label_value", f"""
with {S.BOXES}, {_ASKED}, c as (select *, x0 + w / 2.0 as cx, y0 + h / 2.0 as cy from boxes),
a as (select c.* from c join q using (image_id) where len(list_filter(q, lambda t: contains(lower(text), t))) > 0),
p as (select a.image_id, a.box_id as label, c.box_id as value, case when abs(c.cy - a.cy) < 20 and c.cx - a.cx > 0 and c.cx - a.cx < 220 then 'nearby_right'
  when abs(c.cx - a.cx) < 50 and c.cy - a.cy > 0 and c.cy - a.cy < 90 then 'nearby_below' when abs(c.cy - a.cy) < 18 then 'same_row' end as rel
  from a join c on c.image_id = a.image_id and c.box_id <> a.box_id)
select image_id, label, value, rel from (select *, row_number() over (partition by image_id, least(label, value), greatest(label, value) order by label) as r from p where rel is not null) where r = 1""")
def label_value(spark, d):
    return Sp.label_values(V.boxes(spark, d), V.box_questions(spark, d))


@query("q24_row_clusters", f"""
with recursive {S.BOXES}, c as (select image_id, box_id, y0 + h / 2.0::double as cy, median(h) over (partition by image_id) as m, row_number() over (partition by image_id order by y0 + h / 2.0, box_id) as pos from boxes where trim(text) <> ''),
f as (
  select image_id, box_id, pos, m, 0 as row_id, cy::double as s, 1 as n from c where pos = 1
  union all
  select c.image_id, c.box_id, c.pos, c.m, case when abs(c.cy - f.s / f.n) <= 0.6::double * c.m then f.row_id else f.row_id + 1 end,
    case when abs(c.cy - f.s / f.n) <= 0.6::double * c.m then f.s + c.cy else c.cy end, case when abs(c.cy - f.s / f.n) <= 0.6::double * c.m then f.n + 1 else 1 end
  from f join c on c.image_id = f.image_id and c.pos = f.pos + 1)
select image_id, row_id, list_sort(list(box_id)) as members from f group by 1, 2""")
def row_clusters(spark, d):
    return Sp.row_clusters(V.boxes(spark, d))


_SCORED = f"""{_OVERLAP}, a as (select image_id, idx, sum(area) as area, count(*) as n from o group by 1, 2),
s as (select p.image_id, p.idx, p.x, p.y, p.w, p.h, round(coalesce(a.area, 0)::double / (p.w * p.h), 9) as score, coalesce(a.n, 0) as n from patches p left join a on a.image_id = p.image_id and a.idx = p.idx)"""


def scored(spark, d, boxes=None, text=False):
    """Patches with their share of text (score) and how many boxes they touch, with text also their text (see patch_texts()), dealt by page, so
    that no shuffle is needed for a page's pool. boxes are those of V.boxes(), if they are at hand."""
    x = Sp.rows_of(pool(spark, d, *(["text"] if text else []), boxes=boxes))
    return x.select("image_id", "idx", *"xywh", F.round(F.col("area") / (F.col("w") * F.col("h")), 9).alias("score"), "n", *(["text"] if text else [])).hint("merge")


def scored_pools(spark, d, **more):
    """(image_id, c): scored() as a row per page, its patches as structs (idx, x, y, w, h, score, and more: functions of scored()'s columns)."""
    score = lambda r: F.round(r["area"] / (r["w"] * r["h"]), 9)
    item = lambda r: F.struct(*[r[k].alias(k) for k in ("idx", *"xywh")], score(r).alias("score"), *[f(r).alias(k) for k, f in more.items()])
    return pool(spark, d).select("image_id", F.transform("c", item).alias("c"))


_IOU = lambda a, b: f"(greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)))::double / ({a}.w * {a}.h + {b}.w * {b}.h - greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)))"


@query("q25_nms", f"""
with {_SCORED}, l as (select image_id, list(struct_pack(idx := idx, x := x, y := y, w := w, h := h) order by score desc, idx) as c from s group by 1),
k as (select image_id, list_reduce(c, lambda acc, p: case when len(list_filter(acc, lambda k: {_IOU('k', 'p')} >= 0.2)) > 0 then acc else list_append(acc, p) end, c[1:0]) as kept from
  (select image_id, list_transform(c, lambda p: p) as c from l))
select image_id, pos as rank, k.idx as idx from (select image_id, unnest(range(1, len(kept) + 1)) as pos, unnest(kept) as k from k)""")
def nms(spark, d):
    c = scored_pools(spark, d)
    out = c.select("image_id", F.posexplode_outer(Sel.suppress(F.col("c"), 0.2)).alias("rank", "k"))
    return out.select("image_id", (F.col("rank") + 1).cast("long").alias("rank"), F.col("k.idx").alias("idx"))


@query("q26_mmr", f"""
with recursive {_SCORED}, t as (select *, max(score) over (partition by image_id) as top from s),
v as (select *, case when top > 0 then score / top else 0.0 end as rel from t),
r as (
  select image_id, 1::bigint as rank, list_value(min_by(struct_pack(idx := idx, x := x, y := y, w := w, h := h), struct_pack(a := -(0.75::double * rel), b := idx))) as picked from v group by image_id
  union all
  select r.image_id, r.rank + 1, list_append(any_value(r.picked), min_by(struct_pack(idx := v.idx, x := v.x, y := v.y, w := v.w, h := v.h), struct_pack(a := -(0.75::double * v.rel - 0.25::double * list_max(list_transform(r.picked, lambda k: {_IOU('k', 'v')}))), b := v.idx)))
  from r join v on v.image_id = r.image_id where r.rank < 4 and len(list_filter(r.picked, lambda k: k.idx = v.idx)) = 0 group by r.image_id, r.rank)
select image_id, rank, picked[rank].idx as idx from r""")
def mmr(spark, d):
    c = scored_pools(spark, d)
    out = c.select("image_id", F.posexplode_outer(Sel.diverse(F.col("c"), 4)).alias("rank", "k"))
    return out.select("image_id", (F.col("rank") + 1).cast("long").alias("rank"), F.col("k.idx").alias("idx"))


@query("q27_topk", f"with {_SCORED} select image_id, idx, score, cast(rank as bigint) as rank from (select *, row_number() over (partition by image_id order by score desc, idx) as rank from s) where rank <= 3")
def topk(spark, d):
    return Sel.top_k(scored(spark, d), ["image_id"], "score", "idx", 3).select("image_id", "idx", "score", F.col("rank").cast("long").alias("rank"))


@query("q28_uniform", f"""
with {S.PATCHES}, n as (select image_id, idx, count(*) over (partition by image_id) as n from patches)
select image_id, idx from n where n <= 5 or idx in (select cast(floor(i * n.n / 5.0) as bigint) from range(5) t(i))""")
def uniform(spark, d):
    return Sel.uniform(patches(spark, d), ["image_id"], "idx", 5).select("image_id", "idx")


@query("q29_hash_sample", f"""
with {S.PATCHES} select image_id, idx from (select *, row_number() over (partition by image_id order by md5(concat('42:', image_id, ':', idx)), image_id, idx) as r from patches) where r <= 4""")
def hash_sample(spark, d):
    return Sel.hash_sample(patches(spark, d), ["image_id"], ["image_id", "idx"], 4).select("image_id", "idx")


@query("q30_two_stage", f"""
with {_SCORED},
r as (select image_id, idx, row_number() over (partition by image_id order by score desc, idx) as a, row_number() over (partition by image_id order by n desc, idx) as b from s),
l as (select image_id, idx, 0 as k, a as r from r where a <= 3 union all select image_id, idx, 1, b from r where b <= 4),
m as (select image_id, idx, min(k * 1000 + r) as "at" from l group by 1, 2)
select image_id, idx, row_number() over (partition by image_id order by m."at", idx) as place from m""")
def two_stage(spark, d):
    return Sel.union_pool(scored(spark, d), ["image_id"], "idx", {"score": 3, "n": 4}).withColumn("place", F.col("place").cast("long"))


@query("q31_pool_stats", f"""
with {S.BOXES}, b as (select *, x0 + w / 2.0 as cx, y0 + h / 2.0 as cy from boxes),
c as (select image_id, box_id, greatest(0, least(cast(round_even(cx - 192, 0) as bigint), 999)) as x, greatest(0, least(cast(round_even(cy - 192, 0) as bigint), 1299)) as y from b),
px as (select image_id, box_id, x, y, least(384, 1000 - x) as w, least(384, 1300 - y) as h from c),
gx as (select image_id, box_id, unnest(range(((x + 63) // 64) * 64, x + w, 64)) as gx, y, h from px),
pts as (select distinct image_id, gx, unnest(range(((y + 63) // 64) * 64, y + h, 64)) as gy from gx),
cov as (select image_id, count(*)::double / (16 * 21) as c from pts group by 1),
rat as (select image_id, sum(w * h)::double / 1300000 as r, count(*) as n from px group by 1),
z as (select b.*, w * h as s, row_number() over (partition by image_id order by w * h, box_id) as rr, count(*) over (partition by image_id) as nn from b),
z1 as (select *, max(case when rr = nn // 4 + 1 then s end) over (partition by image_id) as p25 from z),
z2 as (select z1.*, exists (select 1 from px p where p.image_id = z1.image_id and floor(cx) >= p.x and floor(cx) < p.x + p.w and floor(cy) >= p.y and floor(cy) < p.y + p.h)::int as hit from z1),
z3 as (select image_id, avg(hit) as cc, coalesce(avg(hit) filter (where s <= p25 or s <= 500), 1.0) as sc from z2 group by 1)
select rat.image_id, coalesce(cov.c, 0) as area_coverage, rat.r as area_ratio, coalesce(z3.cc, 0) as center_coverage, coalesce(z3.sc, 0) as small_coverage, rat.n from rat left join cov using (image_id) left join z3 using (image_id)""")
def pool_stats(spark, d):
    b = V.boxes(spark, d)
    c = Sp.centres(b).withColumn("r", G.centred(F.col("cx"), F.col("cy"), 384, W, H))
    return Sp.pool_stats(c.select("image_id", *[F.col(f"r.{k}").cast("long").alias(k) for k in "xywh"]), b, W, H, step=64, parity=False)


@query("q31c_exact_coverage", f"""
with {S.BOXES}, c as (select image_id, box_id, x0 + w / 2.0 as cx, y0 + h / 2.0 as cy from boxes),
r as (select distinct image_id, greatest(0, least(cast(round_even(cx - 192, 0) as bigint), 999)) as x, greatest(0, least(cast(round_even(cy - 192, 0) as bigint), 1299)) as y from c),
p as (select image_id, x, x + least(384, 1000 - x) as x1, y, y + least(384, 1300 - y) as y1 from r),
e as (select image_id, x as a, lead(x) over (partition by image_id order by x) as b from (select image_id, x from p union select image_id, x1 from p)),
s as (select e.image_id, a, b, y, y1, max(y1) over (partition by e.image_id, a order by y, y1 rows between unbounded preceding and 1 preceding) as top from e join p on p.image_id = e.image_id and p.x <= a and b <= p.x1 where b is not null)
select image_id, sum((b - a) * greatest(0, y1 - greatest(y, coalesce(top, y))))::double / 1300000 as area_coverage from s group by 1""")
def exact_coverage(spark, d):
    b = V.boxes(spark, d)
    c = Sp.centres(b).withColumn("r", G.centred(F.col("cx"), F.col("cy"), 384, W, H))
    p = c.select("image_id", *[F.col(f"r.{k}").cast("long").alias(k) for k in "xywh"])
    return Sp.pool_stats(p, b, W, H, step=None).select("image_id", "area_coverage")


@query("q31b_resize", """
select o_orderkey as image_id, greatest(1, cast(floor((400 + o_custkey % 1000) * sqrt(0.25)) as integer)) as w, greatest(1, cast(floor((300 + o_orderkey % 2000) * sqrt(0.25)) as integer)) as h,
  cast(ceil(sqrt(o_orderkey % 30 + 1)) as integer) as cols, cast(ceil((o_orderkey % 30 + 1) / ceil(sqrt(o_orderkey % 30 + 1))) as integer) as rows from orders""")
def resize_arithmetic(spark, d):
    o = V.table(spark, d, "orders")
    r = G.resized(400 + F.col("o_custkey") % 1000, 300 + F.col("o_orderkey") % 2000, 0.25)
    s = G.sheet(F.col("o_orderkey") % 30 + 1)
    return o.select(F.col("o_orderkey").alias("image_id"), r["w"].alias("w"), r["h"].alias("h"), s["cols"].alias("cols"), s["rows"].alias("rows"))


@query("q32_weak_labels", f"""
with {_OVERLAP}, {_ASKED}, t as (select p.image_id, p.idx, p.x, p.y, p.w, p.h, coalesce(string_agg(o.text, ' ' order by o.box_id), '') as text from patches p left join o on o.image_id = p.image_id and o.idx = p.idx group by all),
a as (select t.*, part.p_name as ans from t join part on p_partkey = t.image_id % 64 + 1),
k as (select a.*, ans <> '' and contains({S.match('text')}, {S.match('ans')}) as exact,
  exists (select 1 from b where b.image_id = a.image_id and contains({S.match('b.text')}, {S.match('a.ans')}) and ((b.cx >= a.x and b.cx < a.x + a.w and b.cy >= a.y and b.cy < a.y + a.h)
    or greatest(0, least(a.x + a.w, b.x0 + b.w) - greatest(a.x, b.x0)) * greatest(0, least(a.y + a.h, b.y0 + b.h) - greatest(a.y, b.y0)) >= 0.5 * b.w * b.h)) as box,
  case when len({S.words('text')}) = 0 then false else len(list_filter({S.words('ans')}, lambda w: list_contains({S.words('text')}, w)))::double / len({S.words('ans')}) >= 0.7 end as soft from a)
select image_id, idx, exact, box, soft, case when exact then 1.0 when box then 0.9 when soft then 0.7 else 0.0 end::double as confidence from k""")
def weak_labels(spark, d):
    b = V.boxes(spark, d)
    ans = V.table(spark, d, "part").select(F.col("p_partkey").alias("_pk"), F.col("p_name").alias("ans"))
    page = V.page_ids(spark, d).join(ans, F.col("image_id") % 64 + 1 == F.col("_pk")).drop("_pk")
    bx = Sp.centres(b).join(ans, F.col("image_id") % 64 + 1 == F.col("_pk")).where(T.contained(F.array("ans"), F.col("text")))
    bx = bx.groupBy("image_id").agg(F.collect_list(F.struct("cx", "cy", G.rect(F.col("x0"), F.col("y0"), F.col("w"), F.col("h")).alias("b"))).alias("_named"))
    t = pool(spark, d, "text").join(page.hint("merge"), "image_id").join(bx.hint("merge"), "image_id", "left")
    hit = lambda v: G.inside(v["cx"], v["cy"], F.col("_c")) | (G.overlap(F.col("_c"), v["b"]) >= 0.5 * v["b"]["w"] * v["b"]["h"])
    t = t.select("image_id", "ans", "_named", F.explode_outer("c").alias("_c")).select("image_id", "ans", F.coalesce(F.exists("_named", hit), F.lit(False)).alias("box"), "_c.*")
    words, own = T.tokens(F.col("text")), T.tokens(F.col("ans"))
    t = t.withColumn("exact", T.contained(F.array("ans"), F.col("text"))).withColumn("soft", F.when(F.size(words) == 0, False).otherwise(F.size(F.filter(own, lambda w: F.array_contains(words, w))) / F.size(own) >= 0.7))
    return t.select("image_id", "idx", "exact", "box", "soft", F.when(F.col("exact"), 1.0).when(F.col("box"), 0.9).when(F.col("soft"), 0.7).otherwise(0.0).alias("confidence"))
