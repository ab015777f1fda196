"""Joins by place on a page. Every join carries the page's key and a grid cell, so it stays a hash or sort-merge join with a residual,
and a page of very many boxes is dealt over tasks cell by cell. Rows per patch are hinted: Spark's estimate of what an explode makes is
far too low, so it would broadcast them. Arrays that cost much are exploded by the outer forms: for the plain ones Spark tests the size of
the array ahead, and so computes it twice.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..sources.tables import kept


#: Side of a grid cell in pixels; most rectangles lie in one to four cells.
CELL = 512


def _in_cells(df: DataFrame, x0: Column, x1: Column, y0: Column, y1: Column) -> DataFrame:
    """df with a row per grid cell (_i, _j) that x0..x1, y0..y1 touches; rows without a place are left out."""
    line = lambda a, b: F.explode_outer(F.sequence(F.floor(a / CELL), F.floor(F.greatest(a, b) / CELL)))  # noqa: E731  compiled, as lambdas are not
    return df.select("*", line(x0, x1).alias("_i")).select("*", line(y0, y1).alias("_j")).where("_i is not null and _j is not null").hint("merge")


def _at(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """df with the grid cell of a point."""
    return df.withColumn("_i", F.floor(x / CELL)).withColumn("_j", F.floor(y / CELL))


def _box(prefix: str = "") -> Column:
    return G.rect(F.col(prefix + "x0"), F.col(prefix + "y0"), F.col(prefix + "w"), F.col(prefix + "h"))


def _holds(text: Column, words: Column) -> Column:
    """Whether text holds one of words as a substring; text is computed once per row."""
    return T.let(text, lambda x: F.exists(words, lambda t: F.contains(x, t)))


def centres(boxes: DataFrame) -> DataFrame:
    return boxes.withColumn("cx", F.col("x0") + F.col("w") / 2).withColumn("cy", F.col("y0") + F.col("h") / 2)


def overlaps(patches: DataFrame, boxes: DataFrame) -> DataFrame:
    """(image_id, idx, box_id, area, confidence, text) of patches (image_id, idx, x, y, w, h) and the boxes that they touch."""
    side = lambda d, x, y: _in_cells(d, F.col(x), F.col(x) + F.col("w"), F.col(y), F.col(y) + F.col("h"))
    p = side(patches.select("image_id", "idx", "x", "y", "w", "h"), "x", "y").select("image_id", "idx", "_i", "_j", G.rect(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("p"))
    b = side(boxes.select("image_id", "box_id", "x0", "y0", "w", "h", "confidence", "text"), "x0", "y0").select("image_id", "box_id", "_i", "_j", _box().alias("b"), "confidence", "text")
    corner = lambda k: F.floor(F.greatest(F.col(f"p.{k}"), F.col(f"b.{k}")) / CELL)  # noqa: E731  of what two rectangles share; a pair counts in its cell only
    x = p.join(b, ["image_id", "_i", "_j"]).where((F.col("_i") == corner("x")) & (F.col("_j") == corner("y")))
    return x.withColumn("area", G.overlap(F.col("p"), F.col("b"))).where("area > 0").select("image_id", "idx", "box_id", "area", "confidence", "text")


def joined_texts() -> Column:
    """The aggregate of overlaps() that joins the texts of touched boxes in box order, blanks skipped."""
    held = F.struct("box_id", F.trim("text").alias("text"))
    return F.array_join(F.sort_array(F.collect_list(F.when(F.trim("text") != "", held)))["text"], " ")


def patch_texts(patches: DataFrame, boxes: DataFrame) -> DataFrame:
    """(image_id, idx, text): texts of the touched boxes in box order, blanks skipped; patches that touch none have an empty text."""
    t = overlaps(patches, boxes).where(F.trim("text") != "").groupBy("image_id", "idx").agg(joined_texts().alias("text"))
    return patches.select("image_id", "idx").join(t, ["image_id", "idx"], "left").select("image_id", "idx", F.coalesce("text", F.lit("")).alias("text")).hint("merge")


def coverage(patches: DataFrame, boxes: DataFrame) -> DataFrame:
    """(image_id, idx, text_coverage, text_confidence): share of the page's box area inside, mean confidence of touched boxes."""
    total = boxes.groupBy("image_id").agg(F.sum(F.col("w") * F.col("h")).alias("total"))
    own = overlaps(patches, boxes).groupBy("image_id", "idx").agg(F.sum("area").alias("area"), F.avg("confidence").alias("confidence"))
    x = patches.select("image_id", "idx").join(own, ["image_id", "idx"], "left").join(total, "image_id", "left")
    share = F.when(F.col("total") > 0, F.coalesce(F.col("area"), F.lit(0)) / F.col("total")).otherwise(0.0)
    return x.select("image_id", "idx", share.alias("text_coverage"), F.coalesce("confidence", F.lit(0.0)).alias("text_confidence")).hint("merge")


def grid_pool(pages: DataFrame, boxes: DataFrame, rects: list[tuple[int, int, int, int]], *more: str) -> DataFrame:
    """(image_id, c, total) of pages (image_id) that share the rectangles rects: c has a struct per rectangle, in order (idx, x, y, w, h, the area
    of its boxes, the number n that it touches; with more also confidence, their mean, and text, their texts as patch_texts() joins
    them), total the area of the page's boxes (null for none).

    A page's boxes are brought together once and meet its rectangles within its row, so no row per rectangle is shuffled or sorted. Pages
    and boxes that are dealt by page alike (V.page_ids(), V.boxes()) are not shuffled again.
    """
    fields = [c for c in ("confidence", "text") if c in more]
    end = lambda a, size: (F.col(a) + F.col(size)).cast("long")
    item = F.struct("box_id", F.col("x0").cast("long").alias("x0"), end("x0", "w").alias("x1"), F.col("y0").cast("long").alias("y0"), end("y0", "h").alias("y1"), *[F.trim("text").alias("text") if c == "text" else F.col(c) for c in fields])
    own = boxes.groupBy("image_id").agg(F.sort_array(F.collect_list(item)).alias("_b"), F.sum(F.col("w") * F.col("h")).alias("total"))
    x = pages.select("image_id").join(own.hint("merge"), "image_id", "left")
    long = lambda v: F.lit(int(v)).cast("long")
    places = F.array(*[F.struct(long(i).alias("idx"), *[long(v).alias(k) for k, v in zip("xywh", r, strict=True)]) for i, r in enumerate(rects)])

    flat = lambda m: F.struct(*[m["r"][k].alias(k) for k in ("idx", *"xywh")], *[m[k].alias(k) for k in ("area", "n", *fields)])
    return x.select("image_id", F.transform(F.transform(places, lambda r: held(r, "_b", fields)), flat).alias("c"), "total")


def held(r: Column, boxes: str, fields: list[str]) -> Column:
    """Rectangle r (x, y, w, h and more) with what it has of the page's boxes (an array x0, x1, y0, y1, fields, in box order)."""
    left, top, right, bottom = r["x"], r["y"], r["x"] + r["w"], r["y"] + r["h"]
    on = lambda b: (b["x0"] < right) & (left < b["x1"]) & (b["y0"] < bottom) & (top < b["y1"]) & (b["x0"] < b["x1"]) & (b["y0"] < b["y1"])
    return T.let(F.coalesce(F.filter(boxes, on), F.filter(boxes, lambda b: F.lit(False))), lambda t: _measured(r, t, fields))


def _measured(r: Column, touched: Column, fields: list[str]) -> Column:
    """A rectangle with what it has of the boxes that it touches (null for a page without any)."""
    part = lambda b: (F.least(b["x1"], r["x"] + r["w"]) - F.greatest(b["x0"], r["x"])) * (F.least(b["y1"], r["y"] + r["h"]) - F.greatest(b["y0"], r["y"]))
    area = F.aggregate(touched, F.lit(0).cast("long"), lambda s, b: s + part(b))
    out = [r.alias("r"), F.coalesce(area, F.lit(0).cast("long")).alias("area"), F.coalesce(F.size(touched), F.lit(0)).cast("long").alias("n")]
    if "confidence" in fields:
        known = F.filter(F.transform(touched, lambda b: b["confidence"]), F.isnotnull)
        mean = T.let(known, lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda s, c: s + c) / F.size(v)))
        out.append(mean.alias("confidence"))
    if "text" in fields:
        some = F.filter(F.transform(touched, lambda b: b["text"]), lambda t: t != "")
        out.append(F.coalesce(F.array_join(some, " "), F.lit("")).alias("text"))
    return F.struct(*out)


def rows_of(pool: DataFrame, *more: str) -> DataFrame:
    """A row per rectangle of grid_pool(), with `more` of its columns; hinted, as Spark's estimate of an explode is far too low."""
    return pool.select("image_id", *more, F.explode_outer("c").alias("_c")).select("image_id", *more, "_c.*").hint("merge")


#: Boxes of a page up to which its pairs of boxes meet page by page; those of denser pages are dealt cell by cell.
DENSE = 256


def _edges(c: DataFrame, *more: str) -> DataFrame:
    """Edges (image_id, a, b, rel) from each box of centres() to later ones of its page, with the centres (ax, ay, bx, by) and more columns (a_, b_) of both ends."""
    c = c.withColumn("_n", F.count("*").over(Window.partitionBy("image_id")))
    ends = {e: [F.col("box_id").alias(e), F.col("cx").alias(e + "x"), F.col("cy").alias(e + "y"), *[F.col(m).alias(f"{e}_{m}") for m in more]] for e in "ab"}
    sides = lambda ok: (c.where(ok).select("image_id", *ends["a"], F.col("w").alias("aw")), c.where(ok).select("image_id", *ends["b"]))
    a, b = sides(F.col("_n") <= DENSE)
    x = a.hint("merge").join(b, "image_id").where("a < b")
    a, b = sides(F.col("_n") > DENSE)
    reach = F.greatest(F.col("aw"), F.lit(200))  # no relation reaches further
    a = _in_cells(a, F.col("ax") - reach, F.col("ax") + reach, F.col("ay") - 80, F.col("ay") + 80)
    x = x.unionByName(a.join(_at(b, F.col("bx"), F.col("by")), ["image_id", "_i", "_j"]).where("a < b").drop("_i", "_j"))
    dx, dy = F.abs(F.col("ax") - F.col("bx")), F.abs(F.col("ay") - F.col("by"))
    right, below = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    rels = F.array_compact(
        F.array(
            F.when((dy < 15) & (dx < F.greatest(F.col("aw"), F.lit(50))), "same_row"),
            F.when((dx < 15) & (dy < 40), "same_column"),
            F.when((right > 0) & (right < 200) & (dy < 20), "nearby_right"),
            F.when((below > 0) & (below < 80) & (dx < 40), "nearby_below"),
        )
    )
    near = (dy < 80) & (dx < F.greatest(F.col("aw"), F.lit(200)))  # of all relations; few pairs are left for the list
    return x.where(near).withColumn("rel", F.explode(rels)).drop("aw")


def layout_edges(boxes: DataFrame) -> DataFrame:
    """Edges (image_id, a, b, rel) from each box to later ones of its page; two boxes may share several relations."""
    return _edges(centres(boxes)).select("image_id", "a", "b", "rel")


def both_ways(edges: DataFrame) -> DataFrame:
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return edges.select("image_id", ways.alias("_e"), "rel").select("image_id", "_e.a", "_e.b", "rel")


#: Columns of graph_features().
GRAPH = ("same_row_label_value", "below_label_relation", "dist_qnode_to_patch", "patch_line_density", "patch_box_density")


def graph_features(patches: DataFrame, boxes: DataFrame, questions: DataFrame) -> DataFrame:
    """Per patch: whether a neighbour of a question box lies in it by row or below, closeness of the nearest neighbour of any
    question box (1 if there is none), boxes inside per line of 20 pixels and boxes inside."""
    x = patches.select("image_id", "idx", "h", G.rect(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("p"))
    return with_graph(x, boxes, questions).select("image_id", "idx", *GRAPH).hint("merge")


def with_graph(x: DataFrame, boxes: DataFrame, questions: DataFrame) -> DataFrame:
    """x (image_id, h, p: a rectangle, and more) with the columns of graph_features()."""
    c = centres(boxes)
    toks = questions.select("image_id", F.array_distinct(T.content_tokens(F.col("question"))).alias("q"))
    asked = c.join(toks.hint("merge"), "image_id").withColumn("asked", F.coalesce(_holds(F.lower("text"), F.col("q")), F.lit(False)))
    # an edge leads from a question box to its other end, or to either if both are
    e = _edges(asked.select("image_id", "box_id", "cx", "cy", "w", "asked"), "asked").where("a_asked or b_asked")
    end = lambda q, v: F.when(F.col(f"{q}_asked"), F.struct(F.col(f"{q}x").alias("qx"), F.col(f"{q}y").alias("qy"), F.col(f"{v}x").alias("cx"), F.col(f"{v}y").alias("cy")))
    near = e.select("image_id", "rel", F.explode_outer(F.array_compact(F.array(end("a", "b"), end("b", "a")))).alias("_e")).select("image_id", "rel", "_e.*")
    # a page's points meet its patches within their rows: no patch is shuffled or sorted but for its page
    d = F.sqrt(F.pow(F.col("cx") - F.col("qx"), 2) + F.pow(F.col("cy") - F.col("qy"), 2))
    points = near.groupBy("image_id").agg(F.min(d).alias("d"), *[F.collect_set(F.when(F.col("rel") == r, F.struct("cx", "cy"))).alias(k) for r, k in (("same_row", "_row"), ("nearby_below", "_below"))])
    own = c.groupBy("image_id").agg(F.collect_list(F.struct("cx", "cy")).alias("_own"))
    # stored, as Spark would deal the patches anew to meet what it has dealt over more partitions
    x = x.join(own.hint("merge"), "image_id", "left").join(kept(points, "points"), "image_id", "left")
    in_p = lambda v: G.inside(v["cx"], v["cy"], F.col("p"))
    held = {k: F.coalesce(F.exists(f"_{k}", in_p).cast("double"), F.lit(0.0)) for k in ("row", "below")}
    n = F.coalesce(F.size(F.filter("_own", in_p)), F.lit(0)).cast("double")
    x = x.withColumn("same_row_label_value", held["row"]).withColumn("below_label_relation", held["below"]).withColumn("dist_qnode_to_patch", F.round(1 / (1 + F.coalesce("d", F.lit(0.0))), 9))
    return x.withColumn("patch_box_density", n).withColumn("patch_line_density", F.round(F.col("patch_box_density") / F.greatest(F.lit(1.0), F.col("h") / 20.0), 9)).drop("_own", "_row", "_below", "d")


def label_values(boxes: DataFrame, questions: DataFrame) -> DataFrame:
    """(image_id, label, value, rel): question-bearing boxes and the others to their right, below or in their row; each
    unordered pair once, the smaller label first come."""
    c = centres(boxes)
    toks = questions.select("image_id", F.array_distinct(T.content_tokens(F.col("question"))).alias("q"))
    a = c.join(toks, "image_id").where(_holds(F.lower("text"), F.col("q"))).select("image_id", F.col("box_id").alias("label"), F.col("cx").alias("lx"), F.col("cy").alias("ly"))
    b = c.select("image_id", F.col("box_id").alias("value"), "cx", "cy")
    dx, dy = F.col("cx") - F.col("lx"), F.col("cy") - F.col("ly")
    rel = (
        F.when((F.abs(dy) < 20) & (dx > 0) & (dx < 220), "nearby_right")
        .when((F.abs(dx) < 50) & (dy > 0) & (dy < 90), "nearby_below")
        .when(F.abs(dy) < 18, "same_row")
    )
    # rows run across the page, so cells are strips here
    strips = F.sequence(F.floor((F.col("ly") - 20) / CELL), F.floor((F.col("ly") + 90) / CELL))
    x = a.withColumn("_j", F.explode(strips)).join(b.withColumn("_j", F.floor(F.col("cy") / CELL)), ["image_id", "_j"]).where("label <> value").withColumn("rel", rel).where("rel is not null")
    w = Window.partitionBy("image_id", F.least("label", "value"), F.greatest("label", "value")).orderBy("label")
    return x.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("image_id", "label", "value", "rel")


def clustered(boxes: DataFrame, *more: str, factor: float = 0.6) -> DataFrame:
    """(image_id, row_id, b) of boxes with a text, b a struct (cy, box_id, and more of their columns): boxes by centre height join the current row while
    they lie within factor * median box height of the running mean of its members' centres; the mean moves, so this is a fold and not a
    gap rule. Boxes carry their columns through the fold, so that a page dealt to one task is not shuffled again."""
    c = centres(boxes).where(F.trim("text") != "")
    g = c.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("cy", "box_id", *more))).alias("b"), F.median("h").alias("m"))
    zero = F.struct(F.lit(-1).alias("row"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        same = (acc["n"] > 0) & (F.abs(b["cy"] - acc["sum"] / acc["n"]) <= factor * F.col("m"))
        row = F.when(same, acc["row"]).otherwise(acc["row"] + 1)
        return F.struct(
            row.alias("row"), F.when(same, acc["sum"] + b["cy"]).otherwise(b["cy"]).alias("sum"), F.when(same, acc["n"] + 1).otherwise(F.lit(1)).alias("n"),
            F.concat(acc["out"], F.array(row)).alias("out"),
        )

    rows = F.aggregate("b", zero, step, lambda acc: acc["out"])
    x = g.select("image_id", F.explode_outer(F.arrays_zip(rows.alias("row_id"), F.col("b").alias("b"))).alias("r"))
    return x.select("image_id", F.col("r.row_id").alias("row_id"), F.col("r.b").alias("b")).hint("merge")


def row_clusters(boxes: DataFrame, factor: float = 0.6) -> DataFrame:
    """(image_id, row_id, members): the boxes of clustered() by row."""
    return clustered(boxes, factor=factor).groupBy("image_id", "row_id").agg(F.sort_array(F.collect_list("b.box_id")).alias("members"))


def row_bands(boxes: DataFrame, band: int = 20, least: int = 3, pad: int = 8) -> DataFrame:
    """Strips around the boxes of a page whose centres share a band of `band` pixels, `least` boxes or more."""
    c = centres(boxes)
    g = c.groupBy("image_id", F.floor(F.floor("cy") / band).alias("band")).agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.max(F.col("x0") + F.col("w")).alias("x1"), F.min("y0").alias("y0"), F.max(F.col("y0") + F.col("h")).alias("y1"))
    w = F.greatest(F.lit(64), F.col("x1") - F.col("x0") + 2 * pad)
    h = F.greatest(F.lit(32), F.least(F.lit(256), F.col("y1") - F.col("y0") + 2 * pad))
    return g.where(F.col("n") >= least).select("image_id", "band", F.greatest(F.lit(0), F.col("x0") - pad).alias("x"), F.greatest(F.lit(0), F.col("y0") - pad).alias("y"), w.alias("w"), h.alias("h"))


def union_area(rects: DataFrame, by: list[str]) -> DataFrame:
    """(by, area) that rects (by, x0, x1, y0, y1: whole numbers, ends exclusive) cover together, overlaps once.

    A sweep over x: between two neighbouring edges of a group the same rectangles lie, whose y intervals are merged by a running
    maximum. Rows grow with the rectangles that cross a strip, not with pixels.
    """
    own = rects.where("x0 < x1 and y0 < y1").select(*by, "x0", "x1", "y0", "y1").distinct()
    edges = own.select(*by, F.explode(F.array("x0", "x1")).alias("_from")).distinct()
    strips = edges.withColumn("_to", F.lead("_from").over(Window.partitionBy(*by).orderBy("_from"))).where("_to is not null")
    x = own.join(strips, by).where("x0 <= _from and _to <= x1")
    ahead = Window.partitionBy(*by, "_from").orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("y1") - F.greatest(F.col("y0"), F.coalesce(F.max("y1").over(ahead), F.col("y0"))))
    return x.withColumn("_part", new * (F.col("_to") - F.col("_from"))).groupBy(*by).agg(F.sum("_part").alias("area"))


def pool_stats(patches: DataFrame, boxes: DataFrame, width: int, height: int, step: int | None = 8, parity: bool = True) -> DataFrame:
    """(image_id, area_coverage, area_ratio, center_coverage, small_coverage, n): how a page's patches cover it.

    Coverage counts lattice points step pixels apart: the area of the patches' ranges of points. With parity a patch marks its own
    lattice from its corner, so only patches aligned to the step count; without, every patch does. With step None it is the exact
    share of the page's pixels, however patches lie.
    """
    p = patches.select("image_id", "x", "y", "w", "h")
    unit = step or 1
    first = lambda v: F.greatest(F.lit(0), F.ceil(F.col(v) / unit)).cast("long")  # noqa: E731  the first point in a patch, and the one behind its last
    last = lambda v, size, most: (F.floor((F.least(F.lit(most), F.col(v) + F.col(size)) - 1) / unit) + 1).cast("long")
    aligned = (F.col("x") % unit == 0) & (F.col("y") % unit == 0) if parity and step else F.lit(True)
    points = p.where(aligned).select("image_id", first("x").alias("x0"), last("x", "w", width).alias("x1"), first("y").alias("y0"), last("y", "h", height).alias("y1"))
    total = len(range(0, width, unit)) * len(range(0, height, unit))
    area = union_area(points, ["image_id"]).select("image_id", (F.col("area") / total).alias("area_coverage"))
    ratio = p.groupBy("image_id").agg((F.sum(F.col("w") * F.col("h")) / (width * height)).alias("area_ratio"), F.count("*").alias("n"))
    c = centres(boxes).withColumn("cx", F.floor("cx")).withColumn("cy", F.floor("cy"))
    hit = c.join(p.select("image_id", G.rect(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("p")), "image_id").where(G.inside(F.col("cx"), F.col("cy"), F.col("p"))).select("image_id", "box_id").distinct().withColumn("hit", F.lit(1))
    size = F.col("w") * F.col("h")
    w = Window.partitionBy("image_id")
    s = c.withColumn("s", size).withColumn("_r", F.row_number().over(w.orderBy("s", "box_id"))).withColumn("_n", F.count("*").over(w))
    s = s.withColumn("p25", F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 4) + 1, F.col("s"))).over(w))
    b = s.join(hit, ["image_id", "box_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    small = (F.col("s") <= F.col("p25")) | (F.col("s") <= 500)
    b = b.groupBy("image_id").agg(F.avg("hit").alias("center_coverage"), F.coalesce(F.avg(F.when(small, F.col("hit"))), F.lit(1.0)).alias("small_coverage"))
    return ratio.join(area, "image_id", "left").join(b, "image_id", "left").select("image_id", F.coalesce("area_coverage", F.lit(0.0)).alias("area_coverage"), "area_ratio", F.coalesce("center_coverage", F.lit(0.0)).alias("center_coverage"), F.coalesce("small_coverage", F.lit(0.0)).alias("small_coverage"), "n")


def candidate_pool(boxes: DataFrame, questions: DataFrame, width: int, height: int, threshold: float = 0.30) -> DataFrame:
    """(image_id, idx, x, y, w, h): a page's candidates from all generators in order, thinned by suppression, numbered anew.

    Generators: squares 256 by 128 and 384 by 192 apart, strips 512 x 256 and 256 x 512 at half overlap, six edge anchors, a square
    around each box, one around each box that shares a content token with the question, a strip per row of boxes. All count
    equal, so the first of two that overlap stays.
    """
    kept = []  # the generators that only know the page come first, so what stays of them is the same for every page
    for r in _page_rectangles(width, height):
        if all(_iou(k, r) < threshold for k in kept):
            kept.append(r)
    held = F.array(*[G.rect(*[F.lit(int(v)) for v in r]) for r in kept])
    cast = lambda a: F.coalesce(F.transform(a, lambda r: G.rect(*[r[k].cast("int") for k in "xywh"])), F.array().cast("array<struct<x:int,y:int,w:int,h:int>>"))
    # what is held is the same for every page, and few squares are free of it: questions, lists and comparisons are for these alone
    around = centres(boxes).select("image_id", "box_id", "text", G.centred(F.col("cx"), F.col("cy"), 256, width, height).alias("r"))
    free = around.where(_apart(kept, threshold)(*[F.col(f"r.{k}") for k in "xywh"]))
    c = free.join(questions.select("image_id", "question").hint("merge"), "image_id", "left")
    shared = F.coalesce(F.size(F.array_intersect(T.content_tokens(F.col("question")), T.tokens(F.col("text")))) > 0, F.lit(False))
    squares = c.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("box_id", "r", shared.alias("s")))).alias("b"))
    strips = row_bands(boxes).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("band", G.clamp(G.rect(*[F.col(k) for k in "xywh"]), width, height).alias("r")))).alias("t"))
    own = F.concat(cast(F.transform("b", lambda x: x["r"])), cast(F.transform(F.filter("b", lambda x: x["s"]), lambda x: x["r"])), cast(F.transform("t", lambda x: x["r"])))
    add = lambda acc, r: F.when(F.exists(acc, lambda k: G.iou(k, r) >= threshold), acc).otherwise(F.concat(acc, F.array(r)))
    more = squares.join(strips.hint("merge"), "image_id", "full").select("image_id", F.posexplode_outer(F.aggregate(own, held, add)).alias("idx", "r")).where(F.col("idx") >= len(kept))
    pool = boxes.select("image_id").distinct().select("image_id", F.posexplode_outer(held).alias("idx", "r")).unionByName(more)
    return pool.select("image_id", "idx", *[F.col(f"r.{k}").alias(k) for k in "xywh"])


def _apart(held: list[tuple[int, int, int, int]], threshold: float):
    """Whether rectangles (x, y, w, h: whole numbers) overlap each of held by less than threshold, in Arrow batches: Spark does not compile
    the lambdas that a list needs, and written out the tests are longer than Java compiles."""

    @F.pandas_udf("boolean")
    def run(x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        x0, y0, w, h = (v.to_numpy(np.int64) for v in (x, y, w, h))
        x1, y1, area, out = x0 + w, y0 + h, w * h, np.ones(len(x), bool)
        for kx, ky, kw, kh in held:
            inter = np.maximum(0, np.minimum(x1, kx + kw) - np.maximum(x0, kx)) * np.maximum(0, np.minimum(y1, ky + kh) - np.maximum(y0, ky))
            out &= inter / np.maximum(1, area + kw * kh - inter) < threshold
        return pd.Series(out)

    return run


def _page_rectangles(width: int, height: int) -> list[tuple[int, int, int, int]]:
    """Rectangles (x, y, w, h) of the generators that need no boxes, in order."""
    out = []
    for w, h, step_x, step_y in ((256, 256, 128, 128), (384, 384, 192, 192), (256, 512, 128, 256), (512, 256, 256, 128)):
        out += [(x, y, min(w, width - x), min(h, height - y)) for y in range(0, height, step_y) for x in range(0, width, step_x)]
    far_x, far_y = max(0, width - 256), max(0, height - 256)
    out += [(x, y, min(256, width - x), min(256, height - y)) for x, y in ((0, 0), (far_x, 0), (0, far_y), (far_x, far_y), (far_x // 2, 0), (far_x // 2, far_y))]
    return out


def _iou(a: tuple, b: tuple) -> float:
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    inter = max(0, w) * max(0, h)
    return inter / (a[2] * a[3] + b[2] * b[3] - inter)


def proximity(patches: DataFrame, boxes: DataFrame, questions: DataFrame) -> DataFrame:
    """(image_id, idx, score): 1 if a box in the patch stands in line right of a label box, .7 if below one, else 0.

    A label box holds a content token of the question as a substring, or a colon.
    """
    c = centres(boxes)
    toks = questions.select("image_id", F.array_distinct(T.content_tokens(F.col("question"))).alias("q")).where(F.size("q") > 0)
    lab = c.join(toks, "image_id").where(F.contains("text", F.lit(":")) | _holds(T.normalize_text(F.col("text")), F.col("q")))
    lab = lab.select("image_id", F.col("box_id").alias("label"), (F.col("x0") + F.col("w")).alias("lx"), F.col("cy").alias("ly"))
    v = lab.join(c.select("image_id", "box_id", "cx", "cy"), "image_id").where("label <> box_id")
    s = F.when((F.abs(F.col("cy") - F.col("ly")) < 25) & (F.col("cx") >= F.col("lx") - 10), 1.0).when((F.col("cy") > F.col("ly")) & (F.abs(F.col("cx") - F.col("lx")) < 80), 0.7)
    v = v.withColumn("s", s).where("s is not null").groupBy("image_id", "box_id", "cx", "cy").agg(F.max("s").alias("s"))
    p = patches.select("image_id", "idx", G.rect(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("p"))
    hit = p.join(v, "image_id").where(G.inside(F.col("cx"), F.col("cy"), F.col("p"))).groupBy("image_id", "idx").agg(F.max("s").alias("score"))
    return p.select("image_id", "idx").join(hit, ["image_id", "idx"], "left").select("image_id", "idx", F.coalesce("score", F.lit(0.0)).alias("score")).hint("merge")


def diagnostics(selected: DataFrame, boxes: DataFrame, answer) -> DataFrame:
    """Per page of selected patches: boxes that any of them touches, their mean text coverage (4 places), and whether the answer
    stands in their text and on the page."""
    o = overlaps(selected, boxes)
    own = coverage(selected, boxes).groupBy("image_id").agg(F.round(F.avg("text_coverage"), 4).alias("coverage"))
    touched = o.groupBy("image_id").agg(F.countDistinct("box_id").alias("n"), F.bool_or(F.contains("text", answer)).alias("hit"))
    page = boxes.groupBy("image_id").agg(F.bool_or(F.contains("text", answer)).alias("answer_on_page"))
    x = own.join(touched, "image_id", "left").join(page, "image_id")
    return x.select("image_id", F.coalesce("n", F.lit(0)).alias("n_boxes"), "coverage", F.coalesce("hit", F.lit(False)).alias("answer_in_patches"), "answer_on_page")
