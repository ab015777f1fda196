"""Packing token sequences: pieces of documents into as few sequences as a grouping genetic algorithm finds."""

from __future__ import annotations

import json
import os
import random
import sys
import types
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, numbered

CAPACITY, END_ID = 4096, 1
#: Pieces of a shard (packed by one task at a time), islands of a shard, rounds between migrations, generations a round, solutions an island.
SHARD, ISLANDS, ROUNDS, GENERATIONS, POPULATION = 2048, 3, 3, 12, 8
#: Words whose ids a task remembers at most, characters of a word that it remembers, shards whose worst bins are packed anew together.
MEMO, LONG, MERGE = 500_000, 64, 64
#: A control character that the tokenizer gives an id of its own.
MARK = "\x01"


def _latin(text: str) -> bool:
    """Whether a text is letters of the Latin blocks only, each of which stays one letter in lower case."""
    return text.isalpha() and (text.isascii() or (max(text) < "\u0250" and "\u0130" not in text))


class Memo:
    """Ids of chunks in two generations: when the young one is full it becomes the old one, whose entries return when used."""

    def __init__(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.long: list[str] = []

    def turn(self) -> None:
        """Before a text: long chunks of the one before go, so what is held has a bound in bytes too."""
        for c in self.long:
            self.young.pop(c, None)
        self.long.clear()
        if len(self.young) > MEMO:
            self.young, self.old = {}, self.young


class Tokens:
    """Ids of whole texts as packed little-endian unsigned 32-bit numbers; ids of white-space-free chunks are remembered.

    The tokenizer splits at white space before anything else joins characters, so a text's ids are its chunks' ids in
    order; a comma or full stop after a letter is a unit of its own, and ASCII letters are lower-cased, so such chunks
    share their word's ids. Texts that may hold a special token's string are encoded whole. A worker process keeps
    the tokenizer and its memo from task to task.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has a core of its own
        from tokenizers import Tokenizer

        kept = sys.modules.setdefault("_foliant_tokens", types.ModuleType("_foliant_tokens"))
        if getattr(kept, "path", None) != path:
            kept.path, kept.tokenizer, kept.memo = path, Tokenizer.from_file(path), Memo()
            kept.last = np.zeros(kept.tokenizer.get_vocab_size(), bool)
            kept.last[[i for x, i in kept.tokenizer.get_vocab().items() if x.endswith("</w>")]] = True
            kept.plain = self._plain(kept.tokenizer)
        self.tokenizer, self.plain, self.memo, self.last = kept.tokenizer, kept.plain, kept.memo, kept.last
        self.mark = self._ids(MARK)
        self.ends = {x: self._encode(x) for x in ",."}

    @staticmethod
    def _plain(tokenizer):
        """The tokenizer without its normaliser and patterns, for lower-case words of letters between blanks; itself if a probe differs."""
        from tokenizers import Tokenizer

        own = json.loads(tokenizer.to_str())
        own["normalizer"] = None
        level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        own["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, level]}
        probe, out = "the of internationalisation zq naïve straße übermäßig ñandú çok x", Tokenizer.from_str(json.dumps(own))
        return out if out.encode(probe, add_special_tokens=False).ids == tokenizer.encode(probe, add_special_tokens=False).ids else tokenizer

    def _ids(self, text: str) -> list[int]:
        """Ids without the places in the text, which the fast call leaves out."""
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _encode(self, text: str) -> bytes:
        return np.array(self._ids(text), dtype="<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        text = text or ""
        if "<|" in text:
            return self._encode(text)
        self.memo.turn()
        chunks = text.replace("\n", " ").split(" ")
        young = self.memo.young
        fresh = set(chunks).difference(young)
        if fresh:
            self._learn(fresh)
        return b"".join(map(young.__getitem__, chunks))

    def _learn(self, chunks: set[str]) -> None:
        young, old, ends, parts, fresh = self.memo.young, self.memo.old, self.ends, [], set()
        for c in chunks:
            if c in old:
                young[c] = old[c]
                continue
            end = c[-1:]
            if end in ends and len(c) > 1 and _latin(c[-2]):
                word = c[:-1]
            else:
                word, end = c, ""
            if word.isascii() or _latin(word):
                word = word.lower()
            if len(c) > LONG:
                self.memo.long += (c, word)
            if word not in young:
                fresh.add(word)
            if end or word is not c:
                parts.append((c, word, end))
        if fresh:
            self._encode_all(list(fresh))
        for c, word, end in parts:
            young[c] = young[word] + ends[end] if end else young[word]

    def _encode_all(self, words: list[str]) -> None:
        """Ids of words from two calls. Words of letters are one unit each, whose last id ends a word; the others are joined
        by a mark of one id that no other text has."""
        young, plain = self.memo.young, [w for w in words if (w.isascii() and w.isalpha()) or _latin(w)]
        if plain:
            ids = np.array(self.plain.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, dtype="<u4")
            cut, data = (4 * np.flatnonzero(self.last[ids]) + 4).tolist(), ids.tobytes()
            for w, a, b in zip(plain, [0, *cut[:-1]], cut, strict=True):
                young[w] = data[a:b]
        rest = [w for w in words if w not in young]
        if len(self.mark) != 1 or any(MARK in w for w in rest):
            young.update((w, self._encode(w)) for w in rest)
        elif rest:
            ids = np.array(self._ids(f" {MARK} ".join(rest)), dtype="<u4")
            cut, data = 4 * np.flatnonzero(ids == self.mark[0]), ids.tobytes()
            for w, a, b in zip(rest, [0, *(cut + 4).tolist()], [*cut.tolist(), len(data)], strict=True):
                young[w] = data[a:b]


def pieces(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """A row per piece: df's columns but text, then piece, start, length, ids_crc32 (and ids with keep_ids).

    A document is its ids followed by end_id; longer ones than capacity are cut into full pieces and a rest.
    Null texts are empty. Added columns take the place of input columns of the same name.
    """
    added = ["piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    kept = [c for c in df.columns if c not in ("text", *added)]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), "piece int, start long, length long, ids_crc32 long"] + ["ids array<long>"] * keep_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = Tokens(tokenizer_path), np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            row, found = [], []
            for i, text in enumerate(b.column("text")):
                ids = tokens.ids(text.as_py()) + end
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    row.append(i)
                    found.append((k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part), part))
            taken = b.select(kept).take(pa.array(row, pa.int64()))
            own = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            if keep_ids:
                own.append(pa.array([np.frombuffer(x[4], "<u4").astype(np.int64) for x in found], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([*taken.columns, *own], [*kept, *added])

    return df.select(*kept, "text").mapInArrow(run, schema)


class Bins:
    """Open bins by free space: best_fit() puts an item where least space is left over."""

    def __init__(self, capacity: int, bins: list[list[int]], sizes: list[int]):
        self.capacity, self.sizes = capacity, sizes
        self.bins = bins
        self.free = sorted((capacity - sum(map(sizes.__getitem__, b)), k) for k, b in enumerate(bins))

    def best_fit(self, items: list[int]) -> list[list[int]]:
        """The bins after the items, longest first, have been put into them or into new ones."""
        for i in sorted(items, key=lambda i: (-self.sizes[i], i)):
            at = bisect_left(self.free, (self.sizes[i], -1))
            if at < len(self.free):
                room, k = self.free.pop(at)
                self.bins[k].append(i)
            else:
                room, k = self.capacity, len(self.bins)
                self.bins.append([i])
            if room > self.sizes[i]:
                insort(self.free, (room - self.sizes[i], k))
        return self.bins


def least_bins(sizes: list[int], capacity: int) -> int:
    """No packing has fewer bins: the total, or the items over half a bin (two never share one)."""
    return max(-(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller full ones (sum of squared fills), both to be minimised."""
    size = sizes.__getitem__
    return len(bins), -sum((sum(map(size, b)) / capacity) ** 2 for b in bins)


def cross(a: list[list[int]], b: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Child of two packings: a's well-filled bins go whole into b, bins of b that share an item with them are
    taken apart, and the displaced items are put back by best fit."""
    size = sizes.__getitem__
    fills = sorted(range(len(a)), key=lambda k: (-sum(map(size, a[k])), rng.random()))
    injected = [list(a[k]) for k in fills[: max(1, rng.randint(1, max(1, len(a) // 2)))]]
    held = {i for x in injected for i in x}
    kept, loose = [], []
    for x in b:
        if held.isdisjoint(x):
            kept.append(x.copy())
        else:
            loose += [i for i in x if i not in held]
    return Bins(capacity, injected + kept, sizes).best_fit(loose)


def mutate(a: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Empties some of the worst-filled bins and one other, and puts their items back by best fit."""
    order = sorted(range(len(a)), key=lambda k: sum(map(sizes.__getitem__, a[k])))
    gone = set(order[: rng.randint(1, min(4, len(a)))]) | {rng.randrange(len(a))}
    return Bins(capacity, [list(x) for k, x in enumerate(a) if k not in gone], sizes).best_fit([i for k in gone for i in a[k]])


def evolve(population: list[list[list[int]]], sizes: list[int], capacity: int, generations: int, rng: random.Random) -> list[list[list[int]]]:
    """The population after some generations, best first; ends early at the bound that no packing can beat."""
    rated = sorted(((fitness(p, sizes, capacity), p) for p in population), key=lambda x: x[0])
    least = least_bins(sizes, capacity)
    for _ in range(generations):
        if len(rated[0][1]) <= least:
            break
        a, b = (min(rng.sample(rated, min(2, len(rated))), key=lambda x: x[0])[1] for _ in range(2))
        child = cross(a, b, sizes, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, sizes, capacity, rng)
        rated = sorted([*rated, (fitness(child, sizes, capacity), child)], key=lambda x: x[0])[:POPULATION]
    return [p for _, p in rated]


def start_population(sizes: list[int], capacity: int, rng: random.Random) -> list[list[list[int]]]:
    """Best fit, longest first; then best fit after part of the items was put in at random."""
    every = list(range(len(sizes)))
    out = [Bins(capacity, [], sizes).best_fit(every)]
    while len(out[0]) > least_bins(sizes, capacity) and len(out) < POPULATION:
        first = rng.sample(every, len(every) // 3)
        bins = Bins(capacity, [], sizes)
        for i in first:
            bins.best_fit([i])
        chosen = set(first)
        out.append(bins.best_fit([i for i in every if i not in chosen]))
    return out


def _encode_bins(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.zeros(n, np.int32)
    for k, x in enumerate(bins):
        out[x] = k
    return out


def _decode_bins(own: np.ndarray) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(int(own.max()) + 1)] if len(own) else []
    for i, k in enumerate(own.tolist()):
        out[k].append(i)
    return [x for x in out if x]


def _pack(items: DataFrame, capacity: int, scratch: Scratch) -> DataFrame:
    """items (uid, length, shard) with bin: the best packing that a shard's islands found.

    First every shard is packed by best fit; those that missed the bound go on. Each of their islands is a task that
    evolves its own population, kept whole from round to round; between rounds every island gets the elite of its left neighbour.
    Shards are bounded, so an island's rows are too; rows are ordered by (length, uid), so reruns agree.
    """

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "uid"], ignore_index=True)
        sizes = pdf["length"].tolist()
        bins = Bins(capacity, [], sizes).best_fit(list(range(len(sizes))))
        return pdf.assign(bin=_encode_bins(bins, len(sizes)), done=len(bins) <= least_bins(sizes, capacity))

    schema = "uid long, length long, shard long, bin int"
    packed = scratch.table(items.select("uid", "length", "shard").groupBy("shard").applyInPandas(first, f"{schema}, done boolean"), "packed")
    done, open_ = packed.where("done").drop("done"), packed.where("not done").drop("done")
    if not open_.limit(1).count():
        return done

    def islands(n_round: int):
        def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["length", "uid"], ignore_index=True)
            sizes, rng = pdf["length"].tolist(), random.Random(f"{key[0]}:{key[1]}:{n_round}")
            population = [_decode_bins(x) for x in np.stack(pdf["population"]).T] if "population" in pdf else start_population(sizes, capacity, rng)
            if "migrant" in pdf:
                population.append(_decode_bins(pdf["migrant"].to_numpy()))
            found = evolve(population, sizes, capacity, GENERATIONS, rng)[:POPULATION]
            rows = np.stack([_encode_bins(p, len(sizes)) for p in found], axis=1)
            return pdf[["uid", "length", "shard", "island"]].assign(population=list(rows), used=len(found[0]))

        return run

    state = open_.drop("bin").withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    for k in range(ROUNDS):
        state = scratch.table(state.groupBy("shard", "island").applyInPandas(islands(k), "uid long, length long, shard long, island int, population array<int>, used int"), "islands")
        if k < ROUNDS - 1:
            moved = state.select("uid", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("population")[0].alias("migrant"))
            state = state.drop("used").join(moved, ["uid", "island"])
    best = state.groupBy("shard").agg(F.min(F.struct("used", "island"))["island"].alias("island"))
    found = state.join(best, ["shard", "island"]).select("uid", "length", "shard", F.col("population")[0].alias("bin"))
    return done.unionByName(found)


def pack(items: DataFrame, capacity: int = CAPACITY, scratch: Scratch | None = None) -> DataFrame:
    """items (length and any other columns) with sequence_id and offset: as few sequences of at most capacity as found.

    Full items are sequences of their own. The others are dealt to shards by hash and packed (see _pack); then the
    bins of a shard that are not nearly full are taken apart and, with those of up to MERGE shards, packed anew, level
    by level while that joins shards, so that shards do not each leave a bin half empty. Lengths over capacity are an
    error of the caller (pieces() makes none). Columns sequence_id and offset of the input give way; _packed_uid must not be one. Places in a sequence follow (length, row) and have no gaps.
    """
    scratch = scratch or Scratch(items.sparkSession)
    items = scratch.table(items.drop("sequence_id", "offset").withColumn("_packed_uid", F.monotonically_increasing_id()), "items")
    slim = items.select(F.col("_packed_uid").alias("uid"), F.col("length").cast("long").alias("length"))
    part = slim.where(F.col("length") < capacity)
    n = numbered(part.count(), SHARD)
    shard = part.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(n)))
    settled = slim.where(F.col("length") >= capacity).select("uid", "length", F.lit(0).alias("level"), F.lit(-1).cast("long").alias("shard"), F.col("uid").alias("bin"))
    level = 1
    while True:
        packed = scratch.table(_pack(shard, capacity, scratch), "bins")
        own = lambda rows: rows.select("uid", "length", F.lit(level).alias("level"), "shard", F.col("bin").cast("long").alias("bin"))  # noqa: B023, E731
        fill = packed.groupBy("shard", "bin").agg(F.sum("length").alias("fill"))
        rows = packed.join(fill, ["shard", "bin"])
        full = F.col("fill") >= int(capacity * 0.98)
        rest = rows.where(~full).select("uid", "length")
        fewer = 1 if n == 1 else max(numbered(n, MERGE), numbered(rest.count(), 4 * SHARD))
        if fewer >= n:  # no shards join any more
            settled = settled.unionByName(own(packed))
            break
        settled = settled.unionByName(own(rows.where(full)))
        n, level = fewer, level + 1
        shard = rest.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(n)))

    w = ["level", "shard", "bin"]
    order = Window.partitionBy(*w).orderBy("length", "uid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = settled.select(F.col("uid").alias("_packed_uid"), F.min("uid").over(Window.partitionBy(*w)).alias("sequence_id"), (F.sum("length").over(order) - F.col("length")).alias("offset"))
    return items.join(placed, "_packed_uid").drop("_packed_uid")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = pack(pieces(docs, tokenizer_path()))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
