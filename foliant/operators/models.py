"""Readers, OCR engines and rankers behind tables: pluggable functions with deterministic stand-ins, and fitted rankers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: OCR engines by name: a function that makes, once per task, a function from image bytes to boxes (box, text, confidence).
ENGINES: dict[str, Callable[[], Callable[[bytes], list[tuple]]]] = {}


def register_engine(name: str, make: Callable[[], Callable[[bytes], list[tuple]]]) -> None:
    ENGINES[name] = make


def _stub() -> Callable[[bytes], list[tuple]]:
    def read(image: bytes) -> list[tuple]:
        h = hashlib.sha256(image).digest()
        return [([[x, y], [x + 40, y], [x + 40, y + 12], [x, y + 12]], f"w{h[i]}", h[i + 1] / 255) for i in range(0, 6, 2) for x, y in [(h[i] * 3, h[i + 1] * 4)]]

    return read


register_engine("stub", _stub)


def read_boxes(images: DataFrame, engine: str = "stub") -> DataFrame:
    """(image_id, box_id, box, text, confidence, error) of images (image_id, content); an image that fails gives one row with its error."""
    make = ENGINES[engine]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = make()
        for b in batches:
            out = []
            for i, content in zip(b["image_id"], b["content"], strict=True):
                try:
                    out += [(i, k, box, text, conf, None) for k, (box, text, conf) in enumerate(read(bytes(content)))]
                except Exception as e:  # one image must not end the run
                    out.append((i, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["image_id", "box_id", "box", "text", "confidence", "error"])

    kind = images.schema["image_id"].dataType.simpleString()
    return images.select("image_id", "content").mapInPandas(run, f"image_id {kind}, box_id int, box array<array<int>>, text string, confidence double, error string")


def batch_read(images: DataFrame, path: str, engine: str = "stub") -> None:
    """Reads the boxes of those images that the table at path lacks and appends them; rerun, it goes on where it stopped."""
    spark = images.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        images = images.join(spark.read.parquet(path).select("image_id").distinct(), "image_id", "left_anti")
    read_boxes(images, engine).write.mode("append").parquet(path)


#: Readers by name: a function that makes, once per task, a function from a prompt and images to raw output.
READERS: dict[str, Callable[[], Callable[[str, list], str]]] = {}


def register_reader(name: str, make: Callable[[], Callable[[str, list], str]]) -> None:
    READERS[name] = make


def read_prompts(prompts: DataFrame, keys: list[str], reader: str) -> DataFrame:
    """(keys, raw, error) of prompts (keys, prompt, images): a registered reader's raw outputs, batch by batch; a prompt that fails
    gives its error."""
    make = READERS[reader]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = make()
        for b in batches:
            raw, error = [], []
            for prompt, images in zip(b["prompt"], b["images"], strict=True):
                try:
                    raw.append(read(prompt, list(images)))
                    error.append(None)
                except Exception as e:  # one prompt must not end the run
                    raw.append(None)
                    error.append(f"{type(e).__name__}: {e}")
            yield b[keys].assign(raw=raw, error=error)

    kinds = ", ".join(f"{k} {prompts.schema[k].dataType.simpleString()}" for k in keys)
    return prompts.select(*keys, "prompt", "images").mapInPandas(run, f"{kinds}, raw string, error string")


def fit_ranker(df: DataFrame, features: list[str], label: str, weight: str | None = None, reg: float = 0.01):
    """Standardised logistic regression over feature columns; returns a fitted pipeline that adds probability."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    lr = LogisticRegression(featuresCol="scaled", labelCol=label, regParam=reg, maxIter=50, **({"weightCol": weight} if weight else {}))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), lr]).fit(df)


@dataclass
class Linear:
    """A linear model over feature columns."""

    features: list[str]
    weights: list[float]
    intercept: float

    def transform(self, df: DataFrame) -> DataFrame:
        out = F.lit(self.intercept)
        for c, w in zip(self.features, self.weights, strict=True):
            out = out + F.col(c).cast("double") * w
        return df.withColumn("prediction", out)


def fit_values(df: DataFrame, features: list[str], label: str, alpha: float = 1.0) -> Linear:
    """Ridge regression over feature columns (penalty alpha on the sum of squares, none on the intercept).

    Two aggregations give the means and the centred products, a row of a few numbers per pair of features; the
    normal equations are solved on the driver. Rows with a null are left out.
    """
    import numpy as np

    names = [*features, label]
    x = df.select(*[F.col(c).cast("double").alias(c) for c in names]).na.drop()
    mean = x.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in names]).first()
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:] if a != label]
    row = x.agg(*[F.coalesce(F.sum((F.col(a) - mean[a]) * (F.col(b) - mean[b])), F.lit(0.0)) for a, b in pairs]).first()
    held = dict(zip(pairs, row, strict=True))
    gram = np.array([[held[min(a, b, key=names.index), max(a, b, key=names.index)] for b in features] for a in features])
    weights = np.linalg.lstsq(gram + alpha * np.eye(len(features)), np.array([held[a, label] for a in features]), rcond=None)[0]
    return Linear(list(features), weights.tolist(), float(mean[label] - sum(w * mean[c] for w, c in zip(weights, features, strict=True))))


def out_of_fold(df: DataFrame, key: str, folds: int, fit: Callable[[DataFrame], object], output: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Scores of every row by a model that saw no row of its key's fold; folds come from an MD5 of the key."""
    fold = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % folds
    x = df.withColumn("fold", fold)
    parts = [output(fit(x.where(F.col("fold") != k)).transform(x.where(F.col("fold") == k))) for k in range(folds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pairwise(df: DataFrame, group: str, features: list[str], relevance: str) -> DataFrame:
    """Differences of features between a group's rows of unlike relevance, with label 1 if the first is more relevant.

    A stand-in for a listwise ranker: groups are one question's candidates, a bounded pool.
    """
    a = df.select(F.col(group), *[F.col(c).alias(f"a_{c}") for c in features], F.col(relevance).alias("ra"))
    b = df.select(F.col(group), *[F.col(c).alias(f"b_{c}") for c in features], F.col(relevance).alias("rb"))
    x = a.join(b, group).where("ra <> rb")
    return x.select(group, *[(F.col(f"a_{c}") - F.col(f"b_{c}")).alias(c) for c in features], (F.col("ra") > F.col("rb")).cast("double").alias("label"))


def select_out_of_fold(long: DataFrame, keys: list[str], features: list[str], label: str, order: list[str], folds: int = 3, alpha: float = 1.0, slack: float = 1e-9) -> DataFrame:
    """(keys, route, predicted): per question the reader whose label a ridge model, fitted without the question's fold, predicts
    to be largest; readers within slack of the best tie by their place in order. long has a row per question and reader (route)."""
    x = long.withColumn("_key", F.concat_ws(":", *[F.col(k).cast("string") for k in keys]))
    out = lambda m: m.select(*keys, "route", F.col("prediction").alias("predicted"))
    p = out_of_fold(x, "_key", folds, lambda df: fit_values(df, features, label, alpha), out)
    place = F.array_position(F.array(*[F.lit(r) for r in order]), F.col("route"))
    top = p.groupBy(*keys).agg(F.max("predicted").alias("_top"))
    near = p.join(top, keys).where(F.col("predicted") >= F.col("_top") - slack)
    return near.groupBy(*keys).agg(F.min(F.struct(place.alias("place"), F.col("route"), F.col("predicted"))).alias("b")).select(*keys, "b.route", "b.predicted")
