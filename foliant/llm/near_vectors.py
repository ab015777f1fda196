"""Embedding near-dedup by randomly rotated binary codes with stored correction factors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, small_or_shuffled
from .links import Groups
from .vectors import cosines, deal, matrix, norms, usable

#: Different vectors of a block; a tile compares two blocks. Error scales that the confidence bound lies above an estimate.
BLOCK_ROWS, CONFIDENCE = 4096, 3.0


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made: modified Gram-Schmidt in a fixed order."""
    a = np.random.Generator(np.random.PCG64(seed)).standard_normal((dim, dim))
    q, r = np.linalg.qr(a)
    return q * np.sign(np.diag(r))


@dataclass
class Codes:
    """Per vector: its rotated unit vector's signs, packed, and its product with them (the correction factor); as a query, the
    rotated vector in int8 steps with their size and the length of what they leave out."""

    bits: np.ndarray  # (n, dim / 8) bytes
    factor: np.ndarray
    steps: np.ndarray  # (n, dim) int8
    scale: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, a: np.ndarray, turn: np.ndarray | None = None) -> Codes:
        rotated = (a / norms(a)[:, None]) @ (rotation(a.shape[1]) if turn is None else turn).T
        scale = np.abs(rotated).max(1) / 127
        steps = np.rint(rotated / scale[:, None]).astype(np.int8)
        rest = np.sqrt(((rotated - steps * scale[:, None]) ** 2).sum(1))
        return cls(np.packbits(rotated >= 0, axis=1), np.abs(rotated).sum(1) / np.sqrt(a.shape[1]), steps, scale, rest)

    @classmethod
    def from_rows(cls, rows: pd.DataFrame, dim: int) -> Codes:
        block = lambda c, kind: np.frombuffer(b"".join(rows[c]), kind).reshape(len(rows), -1)
        return cls(block("bits", np.uint8), rows["factor"].to_numpy(), block("steps", np.int8), rows["scale"].to_numpy(), rows["rest"].to_numpy())

    def signs(self) -> np.ndarray:
        dim = self.steps.shape[1]
        return (np.unpackbits(self.bits, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))


def estimate(queries: Codes, codes: Codes, part: slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(estimate, error scale, certain upper bound) of the cosines of queries[part] with coded vectors.

    With x the code's unit vector and f = <x, o> the stored factor, <x, q> / f estimates <o, q> without bias; its error
    is around sqrt((1 - f^2) / f^2) / sqrt(dim - 1). The query's steps miss <x, q> by at most their rest, which is added to the
    estimate's error. The part of o beside x has length sqrt(1 - f^2), that of q sqrt(1 - <x, q>^2), so f <x, q> plus
    their product is never exceeded: a bound at full confidence, taken where <x, q> makes it largest.
    """
    q = queries.steps[part].astype(np.float32) * queries.scale[part, None].astype(np.float32)
    dot = (q @ codes.signs().T).astype(np.float64)
    rest, f = queries.rest[part][:, None] + 1e-5, np.minimum(codes.factor, 1.0)[None, :]
    beside = np.sqrt(1 - f * f)
    at = np.clip(f, dot - rest, dot + rest)
    upper = f * at + beside * np.sqrt(np.maximum(0, 1 - at * at)) + 1e-5
    return dot / f, np.broadcast_to(beside / f / np.sqrt(max(1, q.shape[1] - 1)), dot.shape), np.where(np.abs(dot) - rest > 1, 1.0, upper)


def survivors(queries: Codes, codes: Codes, least: float, confidence: float | None, part: slice = slice(None)) -> np.ndarray:
    """Which pairs need an exact cosine: all whose bound reaches least; the bound lies confidence error scales above
    the estimate or, without confidence (the limit of ever more of them), is the certain one."""
    guess, error, upper = estimate(queries, codes, part)
    if confidence is None:
        return upper >= least
    rest = queries.rest[part][:, None] / np.minimum(codes.factor, 1.0)[None, :]
    return np.minimum(upper, guess + rest + confidence * error) >= least


def code_rows(rows: DataFrame) -> DataFrame:
    """rows (_key, group, embedding) with their codes in place of the vectors; a task makes each length's rotation once."""
    schema = "_key string, group string, dim int, bits binary, factor double, steps binary, scale double, rest double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for b in batches:
            keys, groups, vectors = (b.column(i).to_pylist() for i in range(3))
            for d in sorted({len(v) for v in vectors}):
                at = [i for i, v in enumerate(vectors) if len(v) == d]
                turns.setdefault(d, rotation(d))
                c = Codes.of(np.array([vectors[i] for i in at], np.float64), turns[d])
                columns = [pa.array([keys[i] for i in at]), pa.array([groups[i] for i in at]), pa.array([d] * len(at), pa.int32())]
                columns += [pa.array([x.tobytes() for x in c.bits]), pa.array(c.factor), pa.array([x.tobytes() for x in c.steps]), pa.array(c.scale), pa.array(c.rest)]
                yield pa.RecordBatch.from_arrays(columns, ["_key", "group", "dim", "bits", "factor", "steps", "scale", "rest"])

    return rows.select("_key", "group", "embedding").mapInArrow(run, schema)


def _sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    """The rows of a tile's two blocks, in order of their keys, and whether these are one block."""
    low, high = pdf["low"].iloc[0], pdf["high"].iloc[0]
    left = pdf[pdf["own"] == low].sort_values("_key", ignore_index=True)
    return left, (left if low == high else pdf[pdf["own"] == high].sort_values("_key", ignore_index=True)), low == high


def near_vectors(rows: DataFrame, least: float = 0.93, confidence: float | None = CONFIDENCE, scratch: Scratch | None = None) -> DataFrame:
    """rows (vec_id, embedding, label and others) with n_links, component_id, kept; links join equal labels at cosine >= least.

    Vectors that are null, zero or hold null or non-finite components, or whose label is null, link with nothing
    and stay. Equal vectors of a label are one class with a count, so copies are never paired. Each class's code, factor and
    query steps are stored once. Classes of a label are dealt to blocks; every two blocks meet as codes in a tile task, which
    names the rows that have a pair whose estimate and confidence bound reach least. Only those come again with their vectors, to the
    same tiles, where such pairs are recomputed exactly; a tile returns, per class, how many rows it links to and one
    edge to its group, never the pairs. A row's links are its class's other copies and all rows of linked classes.
    Null ids take part but are never the smallest id.
    """
    scratch = scratch or Scratch(rows.sparkSession)
    rows = rows.drop("n_links", "component_id", "kept", "_key")
    good = usable(F.col("embedding")) & F.col("label").isNotNull()
    key = F.when(good, F.md5(F.concat_ws(":", F.col("label").cast("string"), F.array_join(F.transform("embedding", lambda x: (x + F.lit(0).cast("float")).cast("string")), ","))))
    keyed = scratch.table(rows.withColumn("_key", key), "vectors")
    slim = keyed.where("_key is not null")
    classes = slim.groupBy("_key").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding"), F.first("label").alias("label"))
    classes = scratch.table(classes.withColumn("group", F.concat_ws(":", F.col("label").cast("string"), F.size("embedding").cast("string"))), "classes")
    codes = scratch.table(code_rows(classes), "codes")
    dealt = deal(codes, "group", codes.groupBy("group").count(), BLOCK_ROWS, "_key")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("parts", "other")

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, same = _sides(pdf)
        some = [np.zeros(len(left), bool), np.zeros(len(right), bool)]
        if len(left) and len(right):
            a = Codes.from_rows(left, int(left["dim"].iloc[0]))
            b = a if same else Codes.from_rows(right, int(left["dim"].iloc[0]))
            for s in range(0, len(left), 256):
                near = survivors(a, b, least, confidence, slice(s, s + 256))
                if same:
                    near &= np.arange(len(left))[None, :] > np.arange(s, min(s + 256, len(left)))[:, None]
                some[0][s : s + 256] |= near.any(1)
                some[1] |= near.any(0)
        if same:
            some = [some[0] | some[1]]
        return pd.concat([d[m][["_key", "group", "low", "high", "own"]] for d, m in zip((left, right), some, strict=False)], ignore_index=True)

    wanted = scratch.table(dealt.groupBy("group", "low", "high").applyInPandas(first, "_key string, group string, low int, high int, own int"), "wanted")
    wanted = wanted.join(classes.select("_key", "n", "embedding"), "_key")

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, same = _sides(pdf)
        if not len(left) or not len(right):
            return pd.DataFrame({"node": [], "links": [], "root": []})
        a, b, shift = matrix(left["embedding"]), matrix(right["embedding"]), 0 if same else len(left)
        both = left if same else pd.concat([left, right], ignore_index=True)
        names, weight = both["_key"].to_numpy(), both["n"].to_numpy()
        groups, links, na, nb, turn = Groups(len(both)), np.zeros(len(both), np.int64), norms(a), norms(b), rotation(a.shape[1])
        ca = Codes.of(a, turn)
        cb = ca if same else Codes.of(b, turn)
        for s in range(0, len(a), 256):
            i, j = np.nonzero(survivors(ca, cb, least, confidence, slice(s, s + 256)))
            i += s
            if same:
                i, j = i[i < j], j[i < j]
            hit = cosines(a, b, i, j, na, nb) >= least
            i, j = i[hit], j[hit] + shift
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            groups.link(i, j)
        root, some = groups.settle(), links > 0
        return pd.DataFrame({"node": names[some], "links": links[some], "root": names[root[some]]})

    found = scratch.table(wanted.groupBy("group", "low", "high").applyInPandas(tile, "node string, links long, root string"), "links")
    comp = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    out = classes.select("_key", "n", "least").join(links, F.col("_key") == F.col("node"), "left").drop("node")
    out = out.join(comp, F.col("_key") == F.col("node"), "left").select("_key", F.coalesce("component", "_key").alias("root"), "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = scratch.table(out, "linked")
    # written first, so that the join has two plain exchanges and a large component is split over tasks
    ids = scratch.table(out.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    out = scratch.table(out.join(ids, "root").select(F.col("_key").alias("_k"), "n_links", "component_id"), "members")
    joined = keyed.join(small_or_shuffled(out, 128), F.col("_key") == F.col("_k"), "left").drop("_key", "_k")
    joined = joined.withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long")).withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return joined.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("vec_id", "n_links", "component_id", "kept")


ORACLE_SQL = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
n as (select vec_id, label, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) as norm from v),
p as (
  select a.vec_id as a, b.vec_id as b from n a join n b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_reduce(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2]), lambda x, y: x + y) / (a.norm * b.norm) >= 0.93),
r(a, b) as (select a, b from p union select r.a, p.b from r join p on r.b = p.a),
c as (select a, least(a, min(b)) as component_id from r group by a),
l as (select a, count(*) as n_links from p group by a)
select e.vec_id, coalesce(l.n_links, 0) as n_links, coalesce(c.component_id, e.vec_id) as component_id, e.vec_id = coalesce(c.component_id, e.vec_id) as kept
from embeddings e left join l on l.a = e.vec_id left join c on c.a = e.vec_id
"""
