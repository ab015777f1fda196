"""Exact removal of repeated byte strings, and shared passages of words, with a sparse suffix array over content-defined anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_or_shuffled
from .suffix_sort import deep_shallow

#: Units of a text that are hashed at a time, contexts of a gram (then of a longer string) that one task sorts, anchors or
#: contexts that a task holds before it sends them on.
PIECE, MOST_CONTEXTS, FLUSH = 1 << 16, 20_000, 20_000
BASE = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Unit:
    """What texts are sequences of. A string of `length` units that starts anywhere else repeats; if apart, only one in another row."""

    no: int
    length: int
    gram: int  # units of an anchor's gram
    width: int  # bytes of a unit in contexts
    apart: bool

    @property
    def reach(self) -> int:
        """What an anchor may be extended by on either side."""
        return self.length - self.gram

    @property
    def step(self) -> int:
        return -(-self.reach // 4)

    def sequence(self, data: bytes) -> np.ndarray:
        """Bytes as they are; words (runs without ASCII white space) by 32-bit hash."""
        if self.width == 1:
            return np.frombuffer(data, np.uint8)
        words = data.split()
        return np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint32, len(words))


BYTES, WORDS = Unit(0, 400, 200, 1, False), Unit(1, 51, 26, 4, True)
UNITS = (BYTES, WORDS)
#: No text with fewer bytes holds a string that any unit looks for.
LEAST_BYTES = min(BYTES.length, 2 * WORDS.length - 1)


def _tables(n: int, seed: int = 5, base: int = BASE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number per byte, and powers of a base and of its inverse modulo 2^64."""
    byte = np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    power, back = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    power[0] = back[0] = 1
    return byte, np.multiply.accumulate(power), np.multiply.accumulate(back)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Hashes of the substrings of a piece; equal strings have equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray, tables: tuple):
        byte, power, self.back = tables
        self.sums = np.zeros(len(data) + 1, np.uint64)
        numbers = byte[data] if data.dtype == np.uint8 else _mix(data.astype(np.uint64) + byte[0])
        np.cumsum(numbers * power[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start])


def _slide(a: np.ndarray, width: int, least) -> np.ndarray:
    """least (np.minimum or np.maximum) over every window of a."""
    n, k = len(a) - width + 1, 1
    while 2 * k <= width:
        a, k = least(a[:-k], a[k:]), 2 * k
    return least(a[:n], a[width - k : width - k + n]) if width > k else a[:n]


def anchors(data: np.ndarray, tables: list[tuple], unit: Unit) -> tuple[np.ndarray, ...]:
    """(position, gram hash, two context hashes, units of the context before and after the gram) of the anchors of a sequence.

    A position is an anchor if its gram has the smallest hash of all grams in some string of unit.length (ties all
    count). So every such string holds an anchor, and two equal ones hold anchors at equal places. The context is the gram with
    unit.reach on either side as far as the text goes; its hashes are independent, 128 bits together.
    """
    n, reach, found = len(data), unit.reach, []
    for c in range(0, max(0, n - unit.length + 1), PIECE):
        base = max(0, c - reach)
        part = data[base : c + PIECE + unit.length + reach]
        hashes = [Hashes(part, t) for t in tables]
        last = min(n, c + PIECE + unit.length - 1) - base  # strings that start in this piece end here
        start = np.arange(c - base, last - unit.gram + 1)
        h = (hashes[0].of(start, start + unit.gram) ^ np.uint64(unit.no << 1)) | np.uint64(1)
        low = _slide(h, reach + 1, np.minimum)
        pad = np.zeros(reach, np.uint64)
        at = np.flatnonzero(_slide(np.concatenate([pad, low, pad]), reach + 1, np.maximum) == h)
        own = start[at]
        left, right = np.minimum(own, reach), np.minimum(n - base - own - unit.gram, reach)
        whole = [x.of(own - left, own + unit.gram + right) + left.astype(np.uint64) for x in hashes]
        found.append((own + base, h[at], *whole, left, right))
    if not found:
        return (np.zeros(0, np.int64), *(np.zeros(0, np.uint64),) * 3, *(np.zeros(0, np.int64),) * 2)
    pos, *others = (np.concatenate(x) for x in zip(*found, strict=True))
    pos, first = np.unique(pos, return_index=True)
    return pos, *(x[first] for x in others)


def _index(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, n_bytes, n_words, sha, anchors) of docs (id, text); an anchor has its unit, gram hash, context hashes, position and
    the units of its context before and after the gram (see anchors())."""
    kind = docs.schema[id_col].dataType.simpleString()
    types = {"u": pa.int8(), "h": pa.int64(), "c": pa.int64(), "c2": pa.int64(), "pos": pa.int32(), "left": pa.int16(), "right": pa.int16()}
    numpy = (np.int8, np.int64, np.int64, np.int64, np.int32, np.int16, np.int16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = PIECE + 4 * max(u.length for u in UNITS)
        tables = [_tables(n), _tables(n, 6, 0xD1342543DE82EF95)]

        def made(ids: pa.Array, size: list, n_words: list, sha: list, ends: list, parts: list) -> pa.RecordBatch:
            columns = [pa.array(np.concatenate(x).view(k) if k is np.int64 else np.concatenate(x).astype(k)) for x, k in zip(zip(*parts, strict=True), numpy, strict=True)]
            values = pa.StructArray.from_arrays(columns, fields=[pa.field(k, t) for k, t in types.items()])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            return pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(n_words, pa.int64()), pa.array(sha), lists], [id_col, "n_bytes", "n_words", "sha", "anchors"])

        for b in batches:
            begin, size, n_words, sha, ends, parts = 0, [], [], [], [0], []
            for i, t in enumerate(b.column(1)):
                data, n_anchors = (t.as_py() or "").encode("utf-8", "surrogatepass"), 0
                for unit in UNITS:
                    seq = unit.sequence(data)
                    pos, *others = anchors(seq, tables, unit)
                    parts.append((np.full(len(pos), unit.no), *others[:3], pos, *others[3:]))
                    n_anchors += len(pos)
                size.append(len(data))
                n_words.append(len(seq))
                sha.append(hashlib.sha256(data).hexdigest())
                ends.append(ends[-1] + n_anchors)
                if ends[-1] >= FLUSH:
                    yield made(b.column(0).slice(begin, i + 1 - begin), size, n_words, sha, ends, parts)
                    begin, size, n_words, sha, ends, parts = i + 1, [], [], [], [0], []
            if size:
                yield made(b.column(0).slice(begin), size, n_words, sha, ends, parts)

    schema = f"`{id_col}` {kind}, n_bytes long, n_words long, sha string, anchors array<struct<u:tinyint,h:long,c:long,c2:long,pos:int,left:smallint,right:smallint>>"
    return docs.select(id_col, "text").mapInArrow(run, schema)


def _matrix(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in rows], np.int64)
    data = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in rows), np.uint8).reshape(-1, width)
    return data, sizes


def _shared(a: np.ndarray, na: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of rows i and j."""
    out = np.empty(len(i), np.int64)
    for k in range(0, len(i), 1 << 15):
        x, y = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
        differ = a[x] != a[y]
        out[k : k + (1 << 15)] = np.minimum(np.where(differ.any(1), differ.argmax(1), a.shape[1]), np.minimum(na[x], na[y]))
    return out


def extensions(group: np.ndarray, left: list[bytes], right: list[bytes], unit: Unit = BYTES, mate: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """How far the string around each gram repeats to the left and right in units, -1 if no string of unit.length does.

    Rows of a group hold the same gram; left is what precedes it, its units reversed, right what follows. With L and R
    shared with another row, a string of unit.length repeats iff L + R >= unit.reach. In suffix order R only falls with
    distance, so the first neighbour on either side that satisfies this has the largest R; the same holds for L in the
    order of the left strings. A row shares most with a next neighbour in either order, which bounds what L, and so R, it can have:
    neighbours are compared at distance 1, 2, ... until every row is settled, its bound is passed or its group ends.
    Rows of equal mate (the only text with their context) do not count for each other where a unit wants another text.
    """
    n, reach = len(group), unit.reach
    a, b = _matrix(left, reach * unit.width), _matrix(right, reach * unit.width)
    sides, most = [], []
    for one in (a, b):
        order = deep_shallow(group, *one)
        g = group[order]
        lcp = np.where(g[1:] == g[:-1], _shared(*one, order[:-1], order[1:]) // unit.width, -1)
        sides.append((order, g, lcp))
        most.append(np.empty(n, np.int64))
        most[-1][order] = np.maximum(np.r_[-1, lcp], np.r_[lcp, -1]) if n else lcp
    best = [np.full(n, -1, np.int64), np.full(n, -1, np.int64)]
    for side, other in ((0, b), (1, a)):
        order, g, lcp = sides[side]
        least = (reach - most[1 - side])[order]  # what a row must share on this side at least
        near = np.full(max(0, n - 1), reach, np.int64)
        up, down = least > most[side][order], least > most[side][order]  # settled towards the end and towards the start of the order
        for t in range(1, n):
            near = np.minimum(near[: n - t], lcp[t - 1 : n - 1])
            up[: n - t] |= near < np.maximum(least[: n - t], 0)
            up[n - t :] = True
            down[t:] |= near < np.maximum(least[t:], 0)
            down[:t] = True
            k = np.flatnonzero(~(up[: n - t] & down[t:]))
            if not len(k):
                if up.all() and down.all():
                    break
                continue
            i, j = order[k], order[k + t]
            hit = near[k] + _shared(*other, i, j) // unit.width >= reach
            if unit.apart:
                hit &= mate[i] != mate[j]
            k, i, j = k[hit], i[hit], j[hit]
            np.maximum.at(best[side], i, near[k])
            np.maximum.at(best[side], j, near[k])
            up[k], down[k + t] = True, True
    return best[0], best[1]


CONTEXT = "u tinyint, h long, gram binary, row long, mate long, pos int, single boolean, left binary, right binary"


def _contexts(texts: DataFrame) -> DataFrame:
    """A row per anchor asked for in texts (row, text, at): gram digest, what precedes (units reversed) and follows.

    single: whether what repeats around it is asked for. The mate is the row of a context that no other row has, else -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int8(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())
        names = ["u", "h", "gram", "row", "mate", "pos", "single", "left", "right"]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for b in batches:
            out: list[tuple] = []
            for row, t, at in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                data, asked = t.as_py().encode("utf-8", "surrogatepass"), at.as_py()
                for unit in UNITS:
                    own = [x for x in asked if x["u"] == unit.no]
                    seq = unit.sequence(data) if own else None
                    for x in own:
                        p, end = x["pos"], x["pos"] + unit.gram
                        gram = hashlib.blake2b(seq[p:end].tobytes(), digest_size=16).digest()
                        out.append((unit.no, x["h"], gram, row, row if x["alone"] else -1, p, x["single"], seq[max(0, p - unit.reach) : p][::-1].tobytes(), seq[end : p + unit.length].tobytes()))
                        if len(out) >= FLUSH:
                            yield made(out)
                            out = []
            if out:
                yield made(out)

    return texts.select("row", "text", "at").mapInArrow(run, CONTEXT)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, row, start, end) of what repeats around single anchors; batches are sorted by (k, u, h, gram), a group each."""
    names = ("k", "u", "h", "gram", "row", "mate", "pos", "single", "left", "right")

    def done(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for no, own in ((u.no, [x for x in rows if x[1] == u.no]) for u in UNITS):
            unit = UNITS[no]
            group = np.repeat(*np.array([(i, len(list(x))) for i, (_, x) in enumerate(groupby(own, key=lambda x: x[:4]))], np.int64).reshape(-1, 2).T)
            low, high = extensions(group, [x[8] for x in own], [x[9] for x in own], unit, np.array([x[5] for x in own], np.int64))
            hit = [i for i, x in enumerate(own) if x[7] and low[i] >= 0]
            parts = ([own[i][4] for i in hit], [own[i][6] - int(low[i]) for i in hit], [own[i][6] + unit.gram + int(high[i]) for i in hit])
            yield pa.RecordBatch.from_arrays([pa.array([no] * len(hit), pa.int8()), *(pa.array(x, pa.int64()) for x in parts)], ["u", "row", "start", "end"])

    held: list[tuple] = []
    for b in batches:
        held += zip(*(b.column(c).to_pylist() for c in names), strict=True)
        if len(held) >= 20_000 and held[0][:4] != held[-1][:4]:
            last = next(i for i in range(len(held) - 1, -1, -1) if held[i][:4] != held[-1][:4]) + 1
            yield from done(held[:last])
            held = held[last:]
    if held:
        yield from done(held)


def _sorted(contexts: DataFrame) -> DataFrame:
    """Spans found by sorting the contexts of every group k, each of which has at most MOST_CONTEXTS."""
    return contexts.repartition("k").sortWithinPartitions("k", "u", "h", "gram", "row", "pos").mapInArrow(_settle, "u tinyint, row long, start long, end long")


def _by_unit(value) -> Column:
    return F.when(F.col("u") == BYTES.no, F.lit(value(BYTES))).otherwise(F.lit(value(WORDS)))


def _head(side: str, units: Column) -> Column:
    return F.substring(F.col(side), F.lit(1), units * _by_unit(lambda u: u.width))


def _held(side: str) -> Column:
    return F.expr(f"length({side}) div if(u = {BYTES.no}, {BYTES.width}, {WORDS.width})").cast("int")


def _settle_hot(contexts: DataFrame, scratch: Scratch) -> DataFrame:
    """The same for grams with more contexts than a task sorts, which meet by longer strings than the gram.

    With s = unit.step, two contexts that share L and R with L + R >= reach share s*j before and reach - s*j - s + 1 after the gram
    for j = L div s. So each context goes to a group per j, keyed by that string; groups of at most MOST_CONTEXTS are sorted.
    What larger ones hold is settled by alignment: every string of unit.length around a gram is a row of its own, counted on the
    map side first, so that no task gathers a group however large.
    """
    reach, step = _by_unit(lambda u: u.reach), _by_unit(lambda u: u.step)
    j = F.explode(F.sequence(F.lit(0), F.expr(f"if(u = {BYTES.no}, {BYTES.reach // BYTES.step}, {WORDS.reach // WORDS.step})")))
    rows = contexts.withColumn("j", j).withColumn("before", F.col("j") * step).withColumn("after", F.greatest(F.lit(0), reach - F.col("before") - step + 1))
    rows = rows.where((_held("left") >= F.col("before")) & (_held("right") >= F.col("after")))
    rows = rows.withColumn("k", F.xxhash64("u", "h", "gram", "j", _head("left", F.col("before")), _head("right", F.col("after")))).drop("j", "before", "after")
    size = rows.groupBy("k").agg(F.count("*").alias("size"), F.max("single").alias("some")).where("size > 1 and some").drop("some").withColumnRenamed("k", "_k")
    rows = scratch.table(rows.join(small_or_shuffled(scratch.table(size, "sizes"), 24), F.col("k") == F.col("_k")).drop("_k"), "hot")
    found = _sorted(rows.where(F.col("size") <= MOST_CONTEXTS).drop("size"))
    left = rows.where(F.col("size") > MOST_CONTEXTS).drop("k", "size").dropDuplicates(["u", "row", "pos"])
    if not left.limit(1).count():
        return found
    r = F.col("r")
    left = left.withColumn("r", F.explode(F.expr(f"sequence(greatest(0, if(u = {BYTES.no}, {BYTES.reach} - length(right), {WORDS.reach} - length(right) div {WORDS.width})), if(u = {BYTES.no}, length(left), length(left) div {WORDS.width}))")))
    left = left.select("u", "h", "gram", "r", F.md5(F.concat(_head("left", r), F.lit(b"|"), _head("right", reach - r))).alias("own"), "row", "mate", "pos", "single")
    keys = ["u", "h", "gram", "r", "own"]
    again = F.when(F.col("u") == BYTES.no, F.col("n") > 1).otherwise(F.col("a") < F.col("b"))
    dup = left.groupBy(*keys).agg(F.count("*").alias("n"), F.min("mate").alias("a"), F.max("mate").alias("b")).where(again).select(*keys)
    hits = left.where("single").join(dup, keys).groupBy("u", "row", "pos").agg(F.max("r").alias("low"), F.min("r").alias("high"))
    return found.unionByName(hits.select("u", "row", (F.col("pos") - F.col("low")).cast("long").alias("start"), (F.col("pos") + _by_unit(lambda u: u.length) - F.col("high")).cast("long").alias("end")))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, removed spans, digest of what is kept) of (row, text, spans)."""
    for b in batches:
        rows, spans, sha = [], [], []
        for row, t, found in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
            data, merged = t.as_py().encode("utf-8", "surrogatepass"), []
            for x in sorted((x["start"], x["end"]) for x in found):
                if merged and x[0] <= merged[-1]["end"]:
                    merged[-1]["end"] = max(merged[-1]["end"], x[1])
                else:
                    merged.append({"start": x[0], "end": x[1]})
            h, at = hashlib.sha256(), 0
            for x in merged:
                h.update(data[at : x["start"]])
                at = x["end"]
            h.update(data[at:])
            rows.append(row)
            spans.append(merged)
            sha.append(h.hexdigest())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(spans, kind), pa.array(sha)], ["row", "removed", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """(id, n_bytes, removed, kept_sha256, shared) of docs (id, text): removed holds the maximal runs (start, end) of bytes
    covered by a string of BYTES.length bytes that also starts elsewhere in docs; shared tells whether the text holds a
    passage of WORDS.length words that another text of docs holds too, whatever its bytes (it is not removed for that).
    Null texts are empty, equal rows are kept as rows.

    Texts that occur more than once stand in the index once; those of at least BYTES.length bytes are removed whole. The
    suffix array is sparse: it holds the suffixes at anchors only (see anchors()), which every repeated string contains.
    Anchors whose gram occurs once go; those whose whole context occurs elsewhere (128 equal bits of hashes) repeat all around;
    the rest meet by gram, where their suffixes are sorted (see extensions()), hot grams by longer strings (see _settle_hot()).
    Texts are shuffled once, those with repeats a second time, contexts without their grams.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = scratch.table(_index(docs, id_col).withColumn("row", F.monotonically_increasing_id()), "index")
    long_ = rows.where(F.col("n_bytes") >= LEAST_BYTES)
    copies = scratch.table(long_.groupBy("sha").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "copies")
    near = small_or_shuffled(copies.withColumnRenamed("sha", "_sha"), 128)
    ones = long_.join(near, F.col("sha") == F.col("_sha"), "left").where("first is null or first = row").drop("first", "_sha")

    held = ones.select("row", F.explode("anchors").alias("a")).select("row", "a.*")
    twice = held.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    # written first, so that the join has two plain exchanges and a gram that very many texts share is split over tasks
    held = scratch.table(held.join(scratch.table(twice, "twice"), "h"), "anchors")
    classes = held.groupBy("u", "h", "c", "c2").agg(F.count("*").alias("n"), F.min(F.struct("row", "pos")).alias("rep"), F.max("row").alias("last"))
    again = F.when(F.col("u") == BYTES.no, F.col("n") > 1).otherwise(F.col("rep.row") < F.col("last"))
    classes = scratch.table(classes.select("u", "h", "c", "c2", "rep", again.alias("again")), "classes")
    full = held.join(classes.where("again").select("u", "h", "c", "c2"), ["u", "h", "c", "c2"])
    full = full.select("u", "row", (F.col("pos") - F.col("left")).cast("long").alias("start"), (F.col("pos") + _by_unit(lambda u: u.gram) + F.col("right")).cast("long").alias("end"))
    own = F.when(F.col("u") == BYTES.no, F.struct("start", "end"))
    full = full.groupBy("row").agg(F.collect_list(own).alias("spans"), F.max(F.col("u") == WORDS.no).alias("flag"))  # bounded by the text's own length
    full = scratch.table(full, "full")
    flagged = scratch.table(full.where("flag").select(F.col("row").alias("_flagged")), "flagged")
    classes = classes.join(small_or_shuffled(flagged, 16), F.col("rep.row") == F.col("_flagged"), "left")
    single = ~F.col("again") & ((F.col("u") == BYTES.no) | F.col("_flagged").isNull())
    classes = scratch.table(classes.select("u", "h", "rep", "again", single.alias("single")), "asked")
    grams = classes.groupBy("h").agg(F.count("*").alias("contexts"), F.count_if("single").alias("singles")).where("contexts > 1 and singles > 0")
    grams = scratch.table(grams.select("h", (F.col("contexts") > MOST_CONTEXTS).alias("hot")), "grams")
    asked = classes.join(grams, "h").select(F.col("rep.row").alias("row"), F.struct("u", "h", F.col("rep.pos").alias("pos"), "single", (~F.col("again")).alias("alone"), "hot").alias("at"))
    asked = asked.groupBy("row").agg(F.collect_list("at").alias("at"))
    spans = full.where(F.size("spans") > 0).select("row", "spans")

    wanted = asked.join(spans, "row", "full_outer").join(ones.select("row", "sha", F.col(id_col).alias("_id")), "row")
    wanted = wanted.select("row", F.col("sha").alias("_sha"), "_id", "at", F.col("spans").alias("spans"))
    text = F.coalesce(F.col("text"), F.lit(""))
    some = docs.select(id_col, text.alias("text")).where(F.octet_length("text") >= LEAST_BYTES).withColumn("sha", F.sha2("text", 256))
    texts = some.join(scratch.table(wanted, "wanted"), (F.col("sha") == F.col("_sha")) & F.col(id_col).eqNullSafe(F.col("_id")))
    texts = scratch.table(texts.select("row", "text", "at", "spans"), "texts")

    part = lambda hot: _contexts(texts.withColumn("at", F.filter("at", lambda x: x["hot"] == F.lit(hot))).where(F.size("at") > 0))
    found = _sorted(part(False).withColumn("k", F.col("h")))
    if grams.where("hot").limit(1).count():
        found = found.unionByName(_settle_hot(scratch.table(part(True), "contexts"), scratch))
    found = scratch.table(found, "found")
    more = found.where(F.col("u") == BYTES.no).distinct().groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("more"))
    none = F.array().cast("array<struct<start:long,end:long>>")
    spans = F.concat(F.coalesce("spans", none), F.coalesce("more", none))
    cut = texts.select("row", "text", "spans").join(more, "row", "left").select("row", "text", spans.alias("spans")).where(F.size("spans") > 0)
    cut = cut.mapInArrow(_cut, "row long, removed array<struct<start:long,end:long>>, kept_sha256 string").dropDuplicates(["row"])
    cut = scratch.table(cut.withColumnRenamed("row", "_row"), "cut")
    flags = flagged.select(F.col("_flagged").alias("_flag")).unionByName(found.where(F.col("u") == WORDS.no).select(F.col("row").alias("_flag"))).distinct()
    flags = scratch.table(flags, "flags")

    out = rows.drop("anchors").join(small_or_shuffled(copies.select(F.col("sha").alias("_sha")), 128), F.col("sha") == F.col("_sha"), "left")
    out = out.join(cut, F.col("row") == F.col("_row"), "left").join(small_or_shuffled(flags, 16), F.col("row") == F.col("_flag"), "left")
    copy = F.col("_sha").isNotNull()
    whole = copy & (F.col("n_bytes") >= BYTES.length)
    every = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    removed = F.when(whole, every).otherwise(F.coalesce("removed", none))
    kept = F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha"))
    shared = F.col("_flag").isNotNull() | (copy & (F.col("n_words") >= WORDS.length))
    return out.select(id_col, "n_bytes", removed.alias("removed"), kept.alias("kept_sha256"), shared.alias("shared"))


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", size.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256", F.col("shared").cast("int").alias("shares_passage"))
