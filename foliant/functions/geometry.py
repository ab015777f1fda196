"""Rectangles as columns: a rectangle is four columns or a struct (x, y, w, h)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(x, y, w, h) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def clamp(r: Column, width: int | Column, height: int | Column) -> Column:
    """r moved to start inside the page and cut at its far edges; at least one pixel stays."""
    width, height = (F.lit(v) if isinstance(v, int) else v for v in (width, height))
    x = F.greatest(F.lit(0), F.least(r["x"], width - 1))
    y = F.greatest(F.lit(0), F.least(r["y"], height - 1))
    return rect(x, y, F.greatest(F.lit(1), F.least(r["w"], width - x)), F.greatest(F.lit(1), F.least(r["h"], height - y)))


def overlap(a: Column, b: Column) -> Column:
    """Area that two rectangles share."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)


def iou(a: Column, b: Column) -> Column:
    """Share of the union that two rectangles share; most pairs share nothing, which the first test tells."""
    inter = overlap(a, b)
    union = a["w"] * a["h"] + b["w"] * b["h"] - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(0.0)


def polygon_center(points: Column) -> Column:
    """Mean of a polygon's vertices (array of [x, y]) as a struct (cx, cy)."""
    mean = lambda k: F.aggregate(F.transform(points, lambda p: p[k].cast("double")), F.lit(0.0), lambda s, v: s + v) / F.size(points)
    return F.struct(mean(0).alias("cx"), mean(1).alias("cy"))


def polygon_hull(points: Column) -> Column:
    """The axis-aligned rectangle around a polygon."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return rect(F.array_min(xs), F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))


def remap(points: Column, dx: Column, dy: Column, scale: Column) -> Column:
    """A polygon moved by (-dx, -dy), then scaled, cut to whole pixels."""
    return F.transform(points, lambda p: F.array(((p[0] - dx) * scale).cast("int"), ((p[1] - dy) * scale).cast("int")))


def inside(cx: Column, cy: Column, r: Column) -> Column:
    """Half-open: the left and top edges belong to the rectangle."""
    return (cx >= r["x"]) & (cx < r["x"] + r["w"]) & (cy >= r["y"]) & (cy < r["y"] + r["h"])


def resized(w: Column, h: Column, area_ratio: float) -> Column:
    """Width and height at a share of the area, cut to whole pixels, at least one."""
    s = float(area_ratio) ** 0.5
    return F.struct(F.greatest(F.lit(1), (w * s).cast("int")).alias("w"), F.greatest(F.lit(1), (h * s).cast("int")).alias("h"))


def sheet(n: Column) -> Column:
    """Columns and rows of a contact sheet of n pages."""
    cols = F.ceil(F.sqrt(n)).cast("int")
    return F.struct(cols.alias("cols"), F.ceil(n / cols).cast("int").alias("rows"))


def grid(width: int, height: int, w: int, h: int, step_x: int, step_y: int) -> Column:
    """Array of rectangles, row by row, cut at the far edges; a literal, as lambdas over constants would run for every row."""
    return F.array(*[rect(*[F.lit(v) for v in r]) for r in grid_rectangles(width, height, w, h, step_x, step_y)])


def grid_rectangles(width: int, height: int, w: int, h: int, step_x: int, step_y: int) -> list[tuple[int, int, int, int]]:
    """Rectangles (x, y, w, h) of grid(), in order."""
    return [(x, y, max(1, min(w, width - x)), max(1, min(h, height - y))) for y in range(0, height, step_y) for x in range(0, width, step_x)]


def edge_anchors(width: int, height: int, size: int) -> Column:
    """Six squares: four corners, top centre, bottom centre."""
    far_x, far_y = max(0, width - size), max(0, height - size)
    at = [(0, 0), (far_x, 0), (0, far_y), (far_x, far_y), (far_x // 2, 0), (far_x // 2, far_y)]
    return F.array(*[clamp(rect(F.lit(x), F.lit(y), F.lit(size), F.lit(size)), width, height) for x, y in at])


def centred(cx: Column, cy: Column, size: int, width: int, height: int) -> Column:
    """A square around a point, its corner rounded half to even, moved into the page."""
    return clamp(rect(F.bround(cx - size / 2).cast("int"), F.bround(cy - size / 2).cast("int"), F.lit(size), F.lit(size)), width, height)
