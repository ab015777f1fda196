"""Configuration files, paths and images."""

from __future__ import annotations

import json
import os

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load_config(path: str, root: str = ".") -> dict:
    """A YAML or JSON file by absolute or root-relative path; an empty file is an empty dict."""
    with open(path if os.path.isabs(path) else os.path.join(root, path), encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text) if text.strip() else {}
    import yaml

    return yaml.safe_load(text) or {}


def flat(config: dict, prefix: str = "") -> dict[str, object]:
    """Dotted names of a nested configuration's values."""
    out: dict[str, object] = {}
    for k, v in config.items():
        out |= flat(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def literals(spark: SparkSession, config: dict) -> DataFrame:
    """(name, value) of a configuration, values in JSON."""
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in sorted(flat(config).items())], "name string, value string")


class Paths:
    """Places under a root: data (its capitalised twin if only that exists) and outputs, made on demand."""

    def __init__(self, root: str):
        self.root = root

    def repo(self, *parts: str) -> str:
        return os.path.join(self.root, *parts)

    def data(self, *parts: str) -> str:
        lower, upper = self.repo("data", *parts), self.repo("Data", *parts)
        return upper if parts and not os.path.exists(lower) and os.path.exists(upper) else lower

    def outputs(self, *parts: str) -> str:
        path = self.repo("outputs", *parts)
        os.makedirs(os.path.dirname(path) if os.path.splitext(path)[1] else path, exist_ok=True)
        return path


def image_size(content: Column) -> Column:
    """(w, h, area) of a binary PGM or PPM image, from its header alone; null for what is neither.

    Compressed formats need a codec, which is registered like a reader; these two are plain.
    """
    head = F.decode(F.substring(content, F.lit(1), F.lit(64)), "ISO-8859-1")
    w, h = (F.regexp_extract(head, r"^P[56]\s+(\d+)\s+(\d+)\s+255\s", k).try_cast("int") for k in (1, 2))
    return F.when(w.isNotNull(), F.struct(w.alias("w"), h.alias("h"), (w * h).cast("long").alias("area")))


def decode_image(content: bytes) -> np.ndarray:
    """Pixels of a binary PGM (rows, columns) or PPM (rows, columns, 3) image."""
    kind, w, h, top, data = content.split(None, 4)[:5] if content[:2] in (b"P5", b"P6") else (b"", 0, 0, 0, b"")
    if kind not in (b"P5", b"P6") or int(top) != 255:
        raise ValueError("not a binary PGM or PPM image of 8 bits")
    start = len(content) - int(w) * int(h) * (3 if kind == b"P6" else 1)
    pixels = np.frombuffer(content, np.uint8, offset=start)
    return pixels.reshape(int(h), int(w), 3) if kind == b"P6" else pixels.reshape(int(h), int(w))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, w, h, area) of the image files under a path."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return x.withColumn("s", image_size(F.col("content"))).select("path", "content", "s.w", "s.h", "s.area")


def line_chart(rows: DataFrame, series: str, x: str, y: str, width: int = 400, height: int = 300) -> DataFrame:
    """(series, points): polyline points of an SVG chart, x and y scaled to the table's ranges, in x order, half pixels kept."""
    ends = rows.agg(*[f(F.col(c)).alias(f"{n}_{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max))])
    at = lambda c, size: F.floor((F.col(c) - F.col(f"lo_{c}")) / F.greatest(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(1e-12)) * size * 2 + 0.5) / 2
    p = rows.join(F.broadcast(ends)).select(series, F.col(x).alias("_x"), at(x, width).alias("a"), (height - at(y, height)).alias("b"))  # one row
    text = F.concat(F.format_string("%.1f", "a"), F.lit(","), F.format_string("%.1f", "b"))
    g = p.groupBy(series).agg(F.array_sort(F.collect_list(F.struct("_x", text.alias("t")))).alias("p"))
    return g.select(series, F.array_join(F.col("p.t"), " ").alias("points"))


def svg(chart: DataFrame, series: str, width: int = 400, height: int = 300) -> str:
    """The chart's SVG text: a polyline per series, of which a chart has a few."""
    lines = [f'<polyline fill="none" stroke="hsl({i * 67 % 360} 60% 45%)" points="{r["points"]}"><title>{r[series]}</title></polyline>' for i, r in enumerate(chart.orderBy(series).limit(64).collect())]
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}">{"".join(lines)}</svg>'


#: Remote data sets by name: a function from a session and options to rows. None is reachable without its client and a network.
CONNECTORS: dict[str, object] = {}


def register_connector(name: str, load) -> None:
    CONNECTORS[name] = load


def connect(spark: SparkSession, name: str, **options) -> DataFrame:
    if name not in CONNECTORS:
        raise ValueError(f"no connector {name}; register_connector() adds one (known: {', '.join(sorted(CONNECTORS)) or 'none'})")
    return CONNECTORS[name](spark, **options)
