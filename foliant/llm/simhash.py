"""SimHash near-dedup: fingerprints of word shingles and a Gray-order hierarchical index over them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, small_or_shuffled
from .links import Groups

#: Codes of a Gray range as planned, of a tile at most, children of a node, and queries searched at a time.
RANGE_CODES, TILE_ROWS, FANOUT, QUERIES = 4096, 1 << 14, 16, 256


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """SimHash of a text: A-Z lower-cased, words split at ASCII white space, shingles hashed by XXH64.

    A bit is set if it is set in over half of the hashes, repeats included. Fewer words than a shingle make one
    shingle of all; no words give 0. The whole text counts, 65,536 shingles at a time.
    """
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    shingles = zip(*(w[i : i + n] for i in range(words)), strict=True) if len(w) >= words else [w]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, shingles), repeat(seed)), dtype="<u8", count=n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """df (text and other columns) with fingerprint as a signed long in place of text."""
    df = df.drop("fingerprint")
    kept = [c for c in df.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.array([fingerprint(t.as_py(), words, seed) for t in b.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(values)], [*kept, "fingerprint"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    return df.select(*kept, "text").mapInArrow(run, f"{schema}{', ' if kept else ''}fingerprint long")


def gray_rank(x: Column) -> Column:
    """Position of a 64-bit code in Gray order."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, k))
    return x


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Layout:
    """An order of a code's segments of bits; the first ones (the head) must be equal for two codes to meet in it."""

    def __init__(self, cut: list[int], order: tuple[int, ...], n_head: int):
        parts = [(cut[i], cut[i + 1] - cut[i]) for i in order]
        self.moves, at = [], 64  # (place in the code, place in the laid-out code, mask of the length)
        for start, size in parts:
            at -= size
            self.moves.append((start, at, (1 << size) - 1))
        self.bits = sum(size for _, size in parts[:n_head])

    def of(self, x: Column) -> Column:
        out = None
        for start, at, mask in self.moves:
            own = F.shiftleft(F.shiftrightunsigned(x, start).bitwiseAND(F.lit(mask).cast("long")), at)
            out = own if out is None else out.bitwiseOR(own)
        return out

    def back(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.uint64)
        for start, at, mask in self.moves:
            out |= ((x >> np.uint64(at)) & np.uint64(mask)) << np.uint64(start)
        return out

    def head(self) -> np.uint64:
        return np.uint64(((1 << self.bits) - 1) << (64 - self.bits))


def layouts(most: int, n: int) -> list[Layout]:
    """Layouts in one of which every two codes that differ in at most `most` bits have equal heads.

    The bits are dealt to most + e segments, of which e must be equal; e is the least that gives heads with less than
    TILE_ROWS of n codes each.
    """
    e = 1
    while n >> (64 * e // (most + e)) >= TILE_ROWS and e < 4:
        e += 1
    m = most + e
    cut = [64 * i // m for i in range(m + 1)]
    return [Layout(cut, (*head, *(i for i in range(m) if i not in head)), e) for head in combinations(range(m), e)]


class GrayIndex:
    """Codes in Gray order under levels of nodes; a node holds the bits its codes share (mask, pattern)."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.levels = [(codes, np.full(len(codes), ~np.uint64(0)))]
        every, some = codes, codes
        while len(every) > 1:
            cut = np.arange(0, len(every), FANOUT)
            every, some = np.bitwise_and.reduceat(every, cut), np.bitwise_or.reduceat(some, cut)
            mask = ~(every ^ some)
            self.levels.append((every & mask, mask))

    def search(self, queries: np.ndarray, most: int, head: np.uint64 = np.uint64(0)) -> tuple[np.ndarray, np.ndarray]:
        """Indexes (query, code) of all pairs that differ in at most `most` bits and in none of head.

        From the top, each node adds the differing bits that it shares and its parent does not to the
        parent's count; a group whose count exceeds `most`, or that differs in the head, is dropped whole.
        """
        pattern, mask = self.levels[-1]
        q = np.repeat(np.arange(len(queries)), len(pattern))
        node = np.tile(np.arange(len(pattern)), len(queries))
        known, count = np.zeros(len(q), np.uint64), np.zeros(len(q), np.uint8)
        for depth in range(len(self.levels) - 1, -1, -1):
            pattern, mask = self.levels[depth]
            differ = (queries[q] ^ pattern[node]) & mask[node] & ~known
            count = count + np.bitwise_count(differ)
            keep = np.flatnonzero((count <= most) & (differ & head == 0))
            q, node = q[keep], node[keep]
            if depth == 0:
                break
            width = len(self.levels[depth - 1][0])
            known, count = np.repeat(mask[node], FANOUT), np.repeat(count[keep], FANOUT)
            q, node = np.repeat(q, FANOUT), (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            if width % FANOUT:
                there = node < width
                q, node, known, count = q[there], node[there], known[there], count[there]
        return q, node


def tile_edges(codes: np.ndarray, most: int, head: np.uint64 = np.uint64(0)) -> tuple[np.ndarray, np.ndarray]:
    """Edges (code, smallest-index code of its group) that connect the linked codes of equal heads of a Gray-sorted tile."""
    groups, index = Groups(len(codes)), GrayIndex(codes)
    for k in range(0, len(codes), QUERIES):
        q, hit = index.search(codes[k : k + QUERIES], most, head)
        groups.link(k + q, hit)
    root = groups.settle()
    x = np.flatnonzero(root != np.arange(len(codes)))
    return codes[x], codes[root[x]]


def near_edges(codes: DataFrame, most: int, scratch: Scratch, n: int) -> DataFrame:
    """Edges (a, b) that connect all codes (distinct, column code) linked at `most` or fewer differing bits.

    A Gray-order index over all codes for each layout of their bits (see layouts()): sorted by Gray rank, codes of equal
    heads stand together, so the index is cut into ranges of ranks, a tile task each, by the leading bits of the head, and
    every code goes to one tile per layout. A task builds the nodes over its range and searches them for each of its codes. Ranges
    that hold too many codes are cut by whole heads; a head that still does is dealt by hash to parts, every two of which
    meet in a tile. A tile returns at most one edge per code.
    """
    plans = layouts(most, n)
    bits = min([max(0, (n // RANGE_CODES).bit_length()), *(x.bits for x in plans)])
    top = lambda x, k: F.shiftrightunsigned(x, 64 - k) if k else F.lit(0).cast("long")
    rows = codes.select(F.explode(F.array(*[F.struct(F.lit(i).cast("short").alias("no"), x.of(F.col("code")).alias("code"), top(x.of(F.col("code")), x.bits).alias("head")) for i, x in enumerate(plans)])).alias("x")).select("x.*")
    rows = rows.withColumn("range", top(F.col("code"), bits))
    many = lambda by, most_rows: scratch.table(rows.groupBy("no", by).count().where(F.col("count") > most_rows).select(F.col("no").alias("_no"), F.col(by).alias(f"_{by}"), "count"), "many")
    wide, hot = many("range", TILE_ROWS).drop("count"), many("head", TILE_ROWS)
    rows = rows.join(small_or_shuffled(wide, 16), (F.col("no") == F.col("_no")) & (F.col("range") == F.col("_range")), "left").drop("_no")
    rows = rows.join(small_or_shuffled(hot, 24), (F.col("no") == F.col("_no")) & (F.col("head") == F.col("_head")), "left")
    parts = F.ceil(2 * F.coalesce("count", F.lit(1)) / TILE_ROWS).cast("int")
    rows = rows.select("no", F.col("_range").isNotNull().alias("whole"), F.when(F.col("_range").isNotNull(), F.col("head")).otherwise(F.col("range")).alias("at"), "code", F.pmod(F.xxhash64("code"), parts).cast("int").alias("own"), parts.alias("parts"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = ["no", "whole", "at", "low", "high"]
    rows = rows.select("no", "whole", "at", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "code")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, gray_rank(F.col("code")).bitwiseXOR(F.lit(signed(1 << 63))))
    rows = rows.select("no", F.xxhash64(*keys).alias("tile"), "code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int16), np.zeros(0, np.int64), np.zeros(0, np.uint64)]

        def edges(no: np.ndarray, t: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
            cut = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (no[1:] != no[:-1]), True])
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                plan = plans[int(no[s])]
                a, b = (plan.back(x).view(np.int64) for x in tile_edges(c[s:e], most, plan.head()))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            fresh = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64))
            no, t, c = (np.concatenate(x) for x in zip(held, fresh, strict=True))
            if not len(t):
                continue
            ends = np.flatnonzero((t[1:] != t[:-1]) | (no[1:] != no[:-1]))
            last = int(ends[-1]) + 1 if len(ends) else 0  # the last tile may go on in the next batch
            held = [no[last:], t[last:], c[last:]]
            if last:
                yield from edges(no[:last], t[:last], c[:last])
        if len(held[0]):
            yield from edges(*held)

    return rows.mapInArrow(run, "a long, b long").distinct()


def near_classes(rows: DataFrame, most: int, scratch: Scratch, id_col: str = "doc_id") -> DataFrame:
    """Table (fingerprint, component_id, root) of rows (id, fingerprint): the smallest id that links of equal or near codes
    reach, and a code that stands for the component, whose smallest id another one may share if ids are repeated."""
    classes = scratch.table(rows.groupBy("fingerprint").agg(F.min(id_col).alias("least")), "classes")
    edges = near_edges(classes.select(F.col("fingerprint").alias("code")), most, scratch, classes.count())
    comp = components(edges, scratch)
    found = classes.join(comp, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("root"))
    found = scratch.table(found, "roots")
    ids = found.groupBy("root").agg(F.min("least").alias("component_id"))
    return scratch.table(found.join(ids, "root").select("fingerprint", "component_id", "root"), "members")


def near_duplicates(docs: DataFrame, words: int = 4, most: int = 4, seed: int = 42, scratch: Scratch | None = None) -> DataFrame:
    """docs' columns but text, with fingerprint (long) and component_id (smallest doc_id reachable by links).

    Null and empty texts have fingerprint 0 and link like any other; rows with a null doc_id take part in links but
    not in the smallest id (null if a whole component has none); equal rows are kept as they are.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = scratch.table(with_fingerprint(docs.drop("component_id"), words, seed), "fingerprints")
    members = near_classes(rows, most, scratch).select("fingerprint", "component_id")
    return rows.join(small_or_shuffled(members, 16), "fingerprint")


def keep_one(docs: DataFrame, words: int = 4, most: int = 4, seed: int = 42) -> DataFrame:
    """docs with one row of each near-duplicate component: the one with the smallest doc_id (of equal rows, any one)."""
    scratch = Scratch(docs.sparkSession)
    columns = ["doc_id", F.coalesce("text", F.lit("")), *[c for c in docs.columns if c not in ("doc_id", "text")]]
    # 128 bits, as rows go by it
    key = F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), *columns)), 16, "0") for seed in ("one", "two")])
    near = scratch.table(with_fingerprint(docs.select("doc_id", "text", key.alias("_key")), words, seed), "fingerprints")
    near = near.join(small_or_shuffled(near_classes(near, most, scratch).select("fingerprint", "root"), 16), "fingerprint")
    first = F.struct(F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)).alias("id"), F.col("_key"))
    best = scratch.table(near.groupBy("root").agg(F.min(first)["_key"].alias("_best")).select("_best").distinct(), "best")
    # whole rows are shuffled once, whatever their number, and equal ones then stand side by side; they are written nowhere else
    rows = docs.withColumn("_key", key).join(best.hint("merge"), F.col("_key") == F.col("_best"), "left_semi")
    return rows.dropDuplicates(["_key"]).select(*docs.columns)


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
