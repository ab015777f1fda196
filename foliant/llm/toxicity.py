"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: n-gram sizes in characters and bits of their hash.
SIZES, BITS = (3, 4, 5, 6), 18
#: Most labelled rows that a fit sees (those with the smallest hashes of their ids), and features that it keeps.
FIT_ROWS, FIT_FEATURES = 12_000, 2_048


class Hasher:
    """Hashed character n-grams of texts with the logarithms of their counts, one text at a time."""

    def hashes(self, text: str | None) -> Iterator[np.ndarray]:
        """Hashes of the n-grams in the lower-cased text, white space as single blanks around each word; long texts in pieces."""
        words = (text or "").lower().split()
        chars = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
        for at in range(0, len(chars), 1 << 16):  # pieces overlap by what the longest n-gram needs
            for n, h in self.rolling(chars[at : at + (1 << 16) + max(SIZES) - 1]):
                own = h[: max(0, min(1 << 16, len(chars) - at - n + 1))]  # those that start in this piece
                yield ((own ^ (own >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes of a text's n-grams; log(1 + count)."""
        counts = np.zeros(1 << BITS, np.int64)
        for h in self.hashes(text):
            counts += np.bincount(h, minlength=1 << BITS)
        out = np.flatnonzero(counts)
        return out, np.log1p(counts[out])

    def among(self, text: str | None, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Those n-grams only that place (by hash) numbers 0 to n - 1, by number; others are -1 there."""
        counts = np.zeros(n, np.int64)
        for h in self.hashes(text):
            at = place[h]
            counts += np.bincount(at[at >= 0], minlength=n)
        out = np.flatnonzero(counts)
        return out, np.log1p(counts[out])

    @staticmethod
    def rolling(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        h = part * np.uint32(0x9E3779B1)
        for n in range(2, min(max(SIZES), len(part)) + 1):
            h = (h[:-1] * np.uint32(0x01000193)) ^ (part[n - 1 :] * np.uint32(0x85EBCA6B))
            if n in SIZES:
                yield n, h


@dataclass
class Model:
    """weights: per hashed n-gram, log-count ratio times the fitted weight (0 where not kept); scores are probabilities.

    fitted is false if the labels lacked a class, so that scores say nothing about a text.
    """

    weights: np.ndarray
    bias: float
    fitted: bool = True

    def score(self, features: np.ndarray, values: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[features] @ values + self.bias, -30, 30))))


def places(kept: np.ndarray) -> np.ndarray:
    """Number of each hash among the kept ones (sorted), -1 if it is none."""
    out = np.full(1 << BITS, -1, np.int32)
    out[kept] = np.arange(len(kept))
    return out


def log_count_ratios(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log ratio of the smoothed shares of toxic and clean texts that hold each feature."""
    return np.log((toxic + 1) / (n_toxic + 2)) - np.log((clean + 1) / (n_clean + 2))


def fit_weights(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, steps: int = 200, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic weights on log counts scaled by ratios; Nesterov steps over all rows, an L2 penalty, no randomness."""
    n, size = len(rows), len(ratios)
    at, row = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(n), [len(r) for r in rows])
    value = ratios[at] * np.concatenate([*values, np.zeros(0)])
    norm = np.sqrt(np.bincount(row, value * value, n).mean() + 1) if n else 1.0
    w, b = np.zeros(size), 0.0
    vw, vb, rate = np.zeros(size), 0.0, 4.0 / norm**2
    for k in range(steps):
        m = k / (k + 3)
        lw, lb = w + m * vw, b + m * vb
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * lw[at], n) + lb, -30, 30)))
        g = np.bincount(at, value * (p - labels)[row], size) / n + penalty * lw
        nw, nb = lw - rate * g, lb - rate * (p - labels).mean()
        vw, vb, w, b = nw - w, nb - b, nw, nb
    return w * ratios, b


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None, features: int | None = FIT_FEATURES) -> Model:
    """Fit on docs (doc_id, text) whose doc_id labels (doc_id, toxic) marks 0 or 1.

    At most FIT_ROWS labelled ids are used; the list of their ids and labels has that proven bound, so it is
    broadcast and no text is shuffled. Counts behind the log-count ratios run over all texts of that sample in the
    executors. The `features` n-grams whose shares in the classes differ most, in standard deviations, go into the linear
    fit (None: all that occur; the driver then holds every n-gram of the sample). Ids labelled twice count by their
    largest label. Without both classes all scores are the base rate.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    own = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
    sample = scratch.table(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS), "labelled")
    rows = scratch.table(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "_toxic"), "texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, found, n = Hasher(), np.zeros((2, 1 << BITS), np.int64), [0, 0]
        for b in batches:
            for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                found[y, hasher.features(t.as_py())[0]] += 1
                n[y] += 1
        held = np.flatnonzero(found.sum(0))
        parts = [pa.array(np.append(held, -1)), pa.array(np.append(found[0, held], n[0])), pa.array(np.append(found[1, held], n[1]))]
        yield pa.RecordBatch.from_arrays(parts, ["feature", "clean", "toxic"])

    counts = rows.mapInArrow(count, "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    table = counts.toPandas()  # at most 2^BITS + 1 rows
    total = table[table.feature < 0][["clean", "toxic"]].sum()
    n_clean, n_toxic = int(total["clean"]), int(total["toxic"])
    if not n_clean or not n_toxic:
        return Model(np.zeros(1 << BITS), float(np.log((n_toxic + 1) / (n_clean + 1))), fitted=False)
    table = table[table.feature >= 0]
    clean, toxic = np.zeros(1 << BITS), np.zeros(1 << BITS)
    clean[table.feature], toxic[table.feature] = table.clean, table.toxic
    ratios = log_count_ratios(toxic, clean, n_toxic, n_clean)
    share = (toxic + clean + 1) / (n_clean + n_toxic + 2)
    evidence = np.abs(toxic / n_toxic - clean / n_clean) / np.sqrt(share * (1 - share))
    kept = np.sort(np.argsort(-evidence, kind="stable")[:features] if features else np.flatnonzero(toxic + clean))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, place = Hasher(), places(kept)
        for b in batches:
            found = []
            for t in b.column(0):
                own, values = hasher.among(t.as_py(), place, len(kept))
                found.append((own.astype(np.int32).tobytes(), values.astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)), b.column(1)], ["held", "value", "toxic"])

    sparse = rows.mapInArrow(reduce, "held binary, value binary, toxic int").orderBy(F.xxhash64("held", "value"), "toxic").limit(FIT_ROWS).toPandas()
    held = [np.frombuffer(x, np.int32) for x in sparse.held]
    weights, bias = fit_weights(held, [np.frombuffer(x, np.float32) for x in sparse.value], sparse.toxic.to_numpy(float), ratios[kept])
    full = np.zeros(1 << BITS)
    full[kept] = weights
    return Model(full, float(bias))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1) appended; null and empty texts score as texts without any n-gram of a word."""
    kept = [c for c in docs.columns if c != "score"]
    used = np.flatnonzero(model.weights)
    held = docs.sparkSession.sparkContext.broadcast((used, model.weights[used].astype(np.float32), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, weights, bias = held.value
        hasher, own, place = Hasher(), Model(weights, bias), places(used)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([own.score(*hasher.among(t.as_py(), place, len(used))) for t in b.column("text")], pa.float64())], [*kept, "score"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*kept).mapInArrow(run, f"{schema}, score double")


def held_out(doc_id: str = "doc_id"):
    """Whether a document's labels are kept from the fit: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores by the FIT_FEATURES n-grams that tell the classes apart best; fit(..., features=None) uses all that occur (README has both)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()).select("doc_id", "toxic")
    out = score(docs, fit(docs, labels)).drop("text")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
