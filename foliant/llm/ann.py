"""Nearest neighbours by a block matrix join: int8 product tiles bound the cosines, survivors are computed exactly."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, numbered, small_or_shuffled
from .vectors import cosines, norms, usable

#: Queries and candidates of a tile, queries whose heaps a task holds at once, and how many times the candidates so far a round adds.
QUERY_ROWS, CANDIDATE_ROWS, OPEN_HEAPS, GROWTH = 4096, 16_384, 50_000, 15


def quantise(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows as int8 codes, scales and the length of what the codes leave out."""
    unit = a / norms(a)[:, None]
    scale = np.abs(unit).max(1) / 127
    code = np.rint(unit / scale[:, None]).astype(np.int8)
    return code, scale, np.sqrt(((unit - code * scale[:, None]) ** 2).sum(1))


def cosine_bounds(q: tuple, c: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all cosines of two quantised blocks.

    With u = u' + e and v = v' + f (codes times scales, and remainders), u.v - u'.v' = e.v + u'.f, so the product of
    the codes is off by at most |e| + (1 + |e|) |f|. Code products are whole numbers below 2^24 for up to 1040
    components, so single precision tiles hold them exactly; longer vectors use double precision.
    """
    kind = np.float32 if q[0].shape[1] * 127 * 127 < 1 << 24 else np.float64
    product = (q[0].astype(kind) @ c[0].astype(kind).T).astype(np.float64) * q[1][:, None] * c[1][None, :]
    slack = q[2][:, None] + (1 + q[2][:, None]) * c[2][None, :] + 1e-9
    return product - slack, product + slack


def code_rows(rows: DataFrame) -> DataFrame:
    """(uid, vec_id, dim, code, scale, rest) of rows (uid, vec_id, embedding): what tiles get in place of the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column(2).to_pylist()
            dims = np.array([len(v) for v in vectors], np.int64)
            codes, scales, rests = [b""] * len(dims), np.zeros(len(dims)), np.zeros(len(dims))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                code, scales[at], rests[at] = quantise(np.array([vectors[i] for i in at], np.float64))
                for i, c in zip(at, code, strict=True):
                    codes[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dims.astype(np.int32)), pa.array(codes, pa.binary()), pa.array(scales), pa.array(rests)], ["uid", "vec_id", "dim", "code", "scale", "rest"])

    return rows.select("uid", "vec_id", "embedding").mapInArrow(run, "uid long, vec_id long, dim int, code binary, scale double, rest double")


def tile_survivors(q: pd.DataFrame, c: pd.DataFrame, k: int) -> pd.DataFrame:
    """(q, c, low, high) of a tile: pairs of uids whose upper bound reaches what k candidates are certain to reach, those of the tile
    or of earlier rounds (column least)."""
    if not len(q) or not len(c):
        return pd.DataFrame({"q": [], "c": [], "low": [], "high": []})
    block = lambda d: (np.frombuffer(b"".join(d["code"]), np.int8).reshape(len(d), -1), d["scale"].to_numpy(), d["rest"].to_numpy())
    qq, cq, out = block(q), block(c), []
    q_uid, c_uid, q_ids, c_ids = q["uid"].to_numpy(), c["uid"].to_numpy(), q["vec_id"].to_numpy(), c["vec_id"].to_numpy()
    least = q["least"].to_numpy(float)
    for s in range(0, len(q), 128):
        part = slice(s, s + 128)
        low, high = cosine_bounds(tuple(x[part] for x in qq), cq)
        own = q_ids[part, None] == c_ids[None, :]
        low[own], high[own] = -np.inf, -np.inf
        kth = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
        kth = np.maximum(kth, least[part])
        i, j = np.nonzero((high >= kth[:, None]) & ~own)
        out.append(pd.DataFrame({"q": q_uid[part][i], "c": c_uid[j], "low": low[i, j], "high": high[i, j]}))
    return pd.concat(out, ignore_index=True)


def survivors(qs: DataFrame, cs: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(q, c) of code_rows(): the pairs that the bounds of all tiles together cannot rule out.

    Candidates come in rounds, each GROWTH times as many as those before, dealt by hash. A round's queries carry the k-th largest lower
    bound found so far, which any later candidate must reach, so a round returns some GROWTH * k pairs a query however many
    tiles it has, and pairs grow with the logarithm of the candidates.
    """
    nq, n = numbered(qs.count(), QUERY_ROWS), cs.count()
    ends = [CANDIDATE_ROWS]
    while ends[-1] < n:
        ends.append(ends[-1] * (GROWTH + 1))
    own = lambda m: F.pmod(F.xxhash64("uid"), F.lit(m)).cast("int")
    place = F.pmod(F.xxhash64(F.lit("round"), "uid"), F.lit(1 << 40)) / (1 << 40) * n
    found, least = None, None
    for begin, end in zip([0, *ends[:-1]], ends, strict=True):
        nc = numbered(min(n, end) - begin, CANDIDATE_ROWS)
        own_q = qs.withColumn("least", F.lit(float("-inf"))) if least is None else qs.join(least.withColumnRenamed("q", "uid"), "uid", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        left = own_q.withColumn("qb", own(nq)).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))
        right = cs.where((place >= begin) & (place < end)).withColumn("cb", own(nc)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
        keys = ("dim", "qb", "cb")
        new = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, b: tile_survivors(a, b, k), "q long, c long, low double, high double")
        found = scratch.table(new if found is None else found.unionByName(new), "survivors")
        best = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.col("low").desc(), "c"))).where(F.col("n") == k)
        least = best.select("q", F.col("low").alias("least"))
        least = least if end == ends[-1] else scratch.table(least, "least")
        found = found.join(least, "q", "left").where("least is null or high >= least").drop("least")
    return found.select("q", "c")


class Heaps:
    """The k best (score, then smaller id) per query."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def add(self, query: int, vec: int, score: float) -> None:
        heap = self.held.setdefault(query, [])
        if len(heap) < self.k:
            heapq.heappush(heap, (score, -vec))
        else:
            heapq.heappushpop(heap, (score, -vec))

    def flush(self) -> pa.RecordBatch:
        """What the heaps hold, each query's best first; they are empty afterwards."""
        rows = [(q, rank, -v, s) for q, heap in self.held.items() for rank, (s, v) in enumerate(sorted(heap, reverse=True), 1)]
        self.held = {}
        columns = zip(*rows, strict=True) if rows else ([], [], [], [])
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], ["query_id", "rank", "vec_id", "score"])


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k candidates of largest cosine, but for its own id.

    Both tables are (vec_id, embedding). Vectors that are null, zero or hold null or non-finite components, and null
    ids, take no part; vectors meet only those of their length. Of equal candidate vectors only those with the k + 1 smallest ids
    can be among a query's k nearest, so no more go on, however many copies there are.

    Queries and candidates are dealt to blocks as int8 codes; every query block meets every candidate block in one tile
    task, which returns the pairs that its bounds cannot rule out (see survivors()). Those that all tiles' bounds together cannot rule out get their
    vectors by a join, are recomputed in double precision and go into heaps of k per query, first per partition, then
    per query. A repeated query id is answered as one query; repeated candidates each count.
    """
    scratch = scratch or Scratch(queries.sparkSession)
    good = lambda d: d.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    q = good(queries).dropDuplicates(["vec_id", "embedding"])
    c = good(candidates).withColumn("_id", F.row_number().over(Window.partitionBy("embedding", "vec_id").orderBy("vec_id"))).where(F.col("_id") <= k)
    c = c.withColumn("_copy", F.dense_rank().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("_copy") <= k + 1).drop("_id", "_copy")
    q, c = (scratch.table(d.withColumn("uid", F.monotonically_increasing_id()), "vectors") for d in (q, c))
    qs, cs = (scratch.table(code_rows(d), "codes") for d in (q, c))
    dim = qs.agg(F.coalesce(F.max("dim"), F.lit(0))).first()[0]
    found = survivors(qs, cs, k, scratch)
    pairs = found.join(c.select(F.col("uid").alias("c"), "vec_id", F.col("embedding").alias("v")), "c")
    wide = q.select(F.col("uid").alias("q"), F.col("vec_id").alias("query_id"), "embedding")
    pairs = pairs.join(small_or_shuffled(wide, 64 + 8 * dim), "q").select("query_id", "embedding", "vec_id", "v")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(k)
        for b in batches:
            dims = np.array(pc.list_value_length(b.column(1)))
            for d in np.unique(dims):
                part = b.take(pa.array(np.flatnonzero(dims == d)))
                x, y = (part.column(i).flatten().to_numpy().astype(np.float64).reshape(-1, d) for i in (1, 3))
                every = np.arange(len(x))
                for row in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), cosines(x, y, every, every, norms(x), norms(y)).tolist(), strict=True):
                    heaps.add(*row)
            if len(heaps.held) > OPEN_HEAPS:
                yield heaps.flush()
        yield heaps.flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps, last = Heaps(k), None
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if row[0] != last and len(heaps.held) > OPEN_HEAPS:
                    yield heaps.flush()
                last = row[0]
                heaps.add(*row)
        yield heaps.flush()

    schema = "query_id long, rank int, vec_id long, score double"
    return pairs.mapInArrow(exact, schema).repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, schema)


def op3_ann(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows.where("vec_id % 50 = 0"), rows, 5)


ORACLE_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
n as (select vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) as norm from v),
s as (
  select q.vec_id as query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]), lambda a, b: a + b) / (q.norm * c.norm) as score
  from n q join n c on c.vec_id <> q.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""
