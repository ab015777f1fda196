"""Language-model scoring by a probabilistic suffix tree over words: contexts of up to two words, grown and used in buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alignment import ROWS, blobs_of, table_of
from .blobs import Numbers, pack, pack_texts, parts_of, split_by, unpack, unpack_texts, vocabulary_parts
from .common import Scratch

#: Characters of texts that a task numbers together, windows of a bucket (of which a task looks at TURN at a time), buckets at
#: least, occurrences from which a context is dealt over buckets.
BLOCK, BUCKET, TURN, LEAST, LARGE = 8_000_000, 1_500_000, 500_000, 16, 750_000
#: Divergence, in nats over all its occurrences, from which a context is a state of its own.
KEEP = 3.0
#: Keys of the end of a text and of its start; no word holds a blank.
END, START = b" end", b" start"


def root_probability(c, n: int, v: int):
    """Of a token seen c times among n of v kinds; one more kind stands for all unseen ones."""
    return (c + 0.5) / (n + 0.5 * (v + 1))


def smoothed(n, total, kinds, shorter):
    """P(next | context): the share n / total, with as much weight as the context has kinds of next tokens for the shorter context's."""
    return (n + kinds * shorter) / (total + kinds)


def divergence(n, total, kinds, shorter):
    """What n occurrences of a next token, each predicted from all others, gain over the shorter context, in nats."""
    kinds = kinds - (n == 1)
    return n * (np.log((n - 1 + kinds * shorter) / (total - 1 + kinds)) - np.log(shorter))


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text leaves 1 when divided by 5."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 1, F.lit(False))


def cut_words(docs: DataFrame, parts: int) -> DataFrame:
    """docs (doc_id, text, held) as blocks: a row (kind 0) with its documents as numbers of words, and rows (kind 1) that ask the
    parts about the block's different words, with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32

        def rows(ids: list, held: list[bool], counts: list[int], found: list[np.ndarray], numbers: Numbers) -> pa.RecordBatch:
            flat = np.concatenate(found).astype(np.int64)
            order = np.argsort(-np.bincount(flat, minlength=len(numbers)), kind="stable")  # frequent ones get small numbers
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            flat, names = rank[flat], list(numbers)
            texts = [names[k] for k in order.tolist()]
            trained = np.bincount(flat[np.repeat(~np.array(held), counts)], minlength=len(texts))
            out = [(0, -1, block, pack(np.array([x or 0 for x in ids], np.int64), np.array([x is not None for x in ids], np.uint8), np.array(held, np.uint8), np.array(counts, np.int64), flat))]
            for to, places in split_by(parts_of(texts, parts)):
                out.append((1, to, block, pack(places, trained[places], *pack_texts([texts[k] for k in places.tolist()]))))
            return table_of(out).to_batches()[0]

        ids, held, counts, found, numbers, size = [], [], [], [], Numbers(), 0
        for b in batches:
            for i, text, out in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                words = (text.as_py() or "").encode().lower().split()  # of bytes: A-Z and ASCII white space only
                words.append(END)
                ids.append(i)
                held.append(out)
                counts.append(len(words))
                found.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                size += 6 * len(words)
                if size >= BLOCK:
                    yield rows(ids, held, counts, found, numbers)
                    ids, held, counts, found, numbers, size, block = [], [], [], [], Numbers(), 0, block + 1
        if ids:
            yield rows(ids, held, counts, found, numbers)

    return docs.select("doc_id", "text", "held").mapInArrow(run, ROWS)


def count_words(parts: int):
    """The task of a part: sums its words' training counts, gives each word a number (frequent ones small ones) and answers every block."""

    def run(table: pa.Table) -> pa.Table:
        numbers, asks = Numbers(), []
        for r, (places, n, lengths, data) in blobs_of(table):
            asks.append((r["block"], r["to"], places, np.fromiter(map(numbers.__getitem__, unpack_texts(lengths, data)), np.int64), n))
        own, n = np.concatenate([x[3] for x in asks]), np.concatenate([x[4] for x in asks])
        total = np.bincount(own, n, len(numbers)).astype(np.int64)
        rank = np.empty(len(total), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(total))
        out = [(0, to, block, pack(places, 1 + rank[k] * parts + to, total[k])) for block, to, places, k, _ in asks]
        return table_of([*out, (1, -1, -1, pack(np.array([total.sum(), (total > 0).sum()])))])

    return run


class Windows:
    """A block's tokens with the two words ahead, as numbers that all blocks share; START stands ahead of a text."""

    def __init__(self, docs: pa.Table, answers: list[tuple[dict, list[np.ndarray]]], ends: int):
        (r, (self.doc_id, self.valid, self.held, self.counts, flat)) = next(blobs_of(docs))
        self.block, flat = r["block"], flat.astype(np.int64)
        places, ids, c = (np.concatenate([x[k] for _, x in answers]).astype(np.int64) for k in range(3))
        word, seen = np.empty(len(places), np.int64), np.empty(len(places), np.int64)
        word[places], seen[places] = ids, c
        word, seen = short(word), short(seen)
        self.local, self.width = short(flat), len(places) + 1
        self.a, self.c = word[flat], seen[flat]
        self.stop = np.cumsum(self.counts, dtype=np.int64)
        first = self.stop - self.counts
        self.doc = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)
        # a context is followed as often as it occurs in training; START as often as texts end
        self.w1, self.n1 = np.roll(self.a, 1), np.roll(self.c, 1)
        self.w1[first], self.n1[first] = 0, ends
        self.w2, self.n2 = np.roll(self.w1, 1), np.roll(self.n1, 1)
        self.w2[first], self.n2[first] = 0, ends
        self.train = self.held[self.doc] == 0

    def large_grams(self, large: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Grams (w2 or -1, w1, a) of contexts of large words only; a token of each; for each token its gram of two and of three words (-1: none)."""
        one = np.flatnonzero(self.n1 > large)
        both = one[self.n2[one] > large]
        l1 = np.where(self.w1 == 0, self.width - 1, np.roll(self.local, 1))
        l2 = np.where(self.w2 == 0, self.width - 1, np.roll(l1, 1))
        in_two, in_three = np.full(len(self.a), -1, np.int32), np.full(len(self.a), -1, np.int32)
        _, first, in_two[one] = np.unique(l1[one].astype(np.int64) * self.width + self.local[one], return_index=True, return_inverse=True)
        _, second, found = np.unique(l2[both].astype(np.int64) * len(one) + in_two[both], return_index=True, return_inverse=True)
        in_three[both] = found + len(first)
        tokens = np.concatenate([one[first], both[second]])
        w2 = np.where(np.arange(len(tokens)) < len(first), -1, self.w2[tokens])
        return np.stack([w2, self.w1[tokens], self.a[tokens]], axis=1).astype(np.int64), tokens, in_two, in_three


def short(a: np.ndarray) -> np.ndarray:
    """a in 32 bits if its numbers fit."""
    return a.astype(np.int32) if not len(a) or int(a.max()) < 1 << 31 else a


def dealt(columns: list[np.ndarray], n: int) -> np.ndarray:
    """A number 0 to n - 1 for each row of whole numbers."""
    h = np.full(len(columns[0]), 0x9E3779B97F4A7C15, np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(n)).astype(np.int64)


def gram_parts(grams: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    """Grams by part: those that end with the same two words are in one."""
    return split_by(dealt([grams[:, 1], grams[:, 2]], parts)) if len(grams) else []


def distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of whole numbers: a row of each kind, and each row's kind."""
    first, at = np.zeros(min(1, len(columns[0])), np.int64), np.zeros(len(columns[0]), np.int64)
    for c in columns:
        kinds, own = np.unique(c, return_inverse=True)
        _, first, at = np.unique(at * len(kinds) + own, return_index=True, return_inverse=True)
    return first, at


class Contexts:
    """Statistics of the large contexts, words and then pairs of words: occurrences, kinds of next tokens, whether they are states."""

    def __init__(self, rows: pd.DataFrame):
        words = rows[rows["s2"] < 0].sort_values("s1")
        self.words, pairs = words["s1"].to_numpy(np.int64), rows[rows["s2"] >= 0]
        key = self._key(self.word(pairs["s2"].to_numpy(np.int64)), self.word(pairs["s1"].to_numpy(np.int64)))
        order = np.argsort(key)
        self.pairs, rows = key[order], pd.concat([words, pairs.iloc[order]], ignore_index=True)
        self.total, self.kinds, self.kept = rows["total"].to_numpy(np.int64), rows["kinds"].to_numpy(np.int64), rows["kept"].to_numpy(bool)

    def _key(self, i2: np.ndarray, i1: np.ndarray) -> np.ndarray:
        return np.where((i2 < 0) | (i1 < 0), -1, i2 * len(self.words) + i1)

    @staticmethod
    def _find(held: np.ndarray, asked: np.ndarray) -> np.ndarray:
        at = np.searchsorted(held, asked)
        return np.where(np.append(held, -2)[at] == asked, at, -1)

    def word(self, w: np.ndarray) -> np.ndarray:
        """Place of each word among the contexts, -1 if it is not large."""
        return self._find(self.words, w)

    def pair(self, w2: np.ndarray, w1: np.ndarray) -> np.ndarray:
        """Place of each pair among the contexts, -1 if it is not large."""
        at = self._find(self.pairs, self._key(self.word(w2), self.word(w1)))
        return np.where(at < 0, -1, at + len(self.words))


class Grams:
    """Distinct (context, next) pairs of a bucket and their contexts, from dense keys per window."""

    def __init__(self, context: np.ndarray, a: np.ndarray, width: int, train: np.ndarray):
        key, first, self.at = np.unique(context.astype(np.int64) * width + a, return_index=True, return_inverse=True)
        self.first, self.context = first, key // width
        self.n = np.bincount(self.at, train, len(key)).astype(np.int64)

    def settle(self, shorter: np.ndarray) -> np.ndarray:
        """Per window its token's probability in its context, if that is a state, or else shorter: per window that in the shorter state."""
        size = int(self.context.max()) + 1 if len(self.context) else 0
        total = np.bincount(self.context, self.n, size)
        kinds, q, some = np.bincount(self.context[self.n > 0], minlength=size), shorter[self.first], (self.n > 0) & (total[self.context] > 1)
        gain = np.bincount(self.context[some], divergence(self.n[some], total[self.context[some]], kinds[self.context[some]], q[some]), size)
        kept = ((total > 1) & (gain >= KEEP))[self.context]
        p = q.copy()
        p[kept] = smoothed(self.n[kept], total[self.context[kept]], kinds[self.context[kept]], q[kept])
        return p[self.at]


class GramCounts:
    """A part's grams (s2 or -1, s1, a) with their training counts n and those of a."""

    def __init__(self, blob: bytes):
        s2, self.s1, self.a, self.n, self.c = (y.astype(np.int64) for y in unpack(blob))
        self.s2, some = s2 - 1, self.n > 0
        self.s2, self.s1, self.a, self.n, self.c = (y[some] for y in (self.s2, self.s1, self.a, self.n, self.c))

    def shorter(self) -> np.ndarray:
        """Count of each gram's last two words, which are a gram of the same part."""
        ids, own = np.unique(np.concatenate([self.s1, self.a]), return_inverse=True)
        key = own[: len(self.s1)] * len(ids) + own[len(self.s1) :]
        two = np.flatnonzero(self.s2 < 0)
        order = two[np.argsort(key[two])]
        return self.n[order[np.minimum(np.searchsorted(key[order], key), len(order) - 1)]]


def large_contexts(grams: DataFrame, large: int, n: int, v: int) -> Contexts:
    """Statistics of contexts that occur over `large` times, from the parts' grams (blob): words (s2 = -1) and pairs of such words.

    Their next tokens are spread over all parts: each part adds up its own, Spark the parts. What comes to the driver is a row per
    context, of which a corpus of n tokens has fewer than 2 n / large.
    """

    def summed(rows) -> pd.DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for x in b.column(0):
                    s2, s1, total, kinds, gain = rows(GramCounts(x.as_py()))
                    first, at = distinct(s2, s1)
                    sums = [np.bincount(at, y, len(first)) for y in (total, kinds, gain)]
                    yield pa.RecordBatch.from_arrays([pa.array(s2[first]), pa.array(s1[first]), *(pa.array(y.astype(float)) for y in sums)], ["s2", "s1", "total", "kinds", "gain"])

        found = grams.mapInArrow(run, "s2 long, s1 long, total double, kinds double, gain double").groupBy("s2", "s1")
        return found.agg(*[F.sum(c).alias(c) for c in ("total", "kinds", "gain")]).toPandas().astype({"total": np.int64, "kinds": np.int64})

    def none(some: np.ndarray) -> np.ndarray:
        return np.zeros(int(some.sum()))

    def words(g: GramCounts) -> tuple[np.ndarray, ...]:
        one = g.s2 < 0
        return g.s2[one], g.s1[one], g.n[one], np.ones(int(one.sum())), none(one)

    def frequent(g: GramCounts) -> tuple[np.ndarray, ...]:
        """Pairs that occur often enough, each as a gram of its first word."""
        one = (g.s2 < 0) & (g.n > large)
        return g.s1[one], g.a[one], g.n[one], none(one), none(one)

    def of(held: Contexts, g: GramCounts, pairs: bool) -> tuple[np.ndarray, np.ndarray]:
        at = held.pair(g.s2, g.s1) if pairs else np.where(g.s2 < 0, held.word(g.s1), -1)
        return np.flatnonzero(at >= 0), at[at >= 0]

    def settled(stats: pd.DataFrame, gains: pd.DataFrame) -> pd.DataFrame:
        return stats.drop(columns="gain").merge(gains[["s2", "s1", "gain"]], on=["s2", "s1"]).assign(kept=lambda x: x["gain"] >= KEEP).drop(columns="gain")

    one = summed(words)
    if not len(one):
        return Contexts(one.assign(kept=False))
    held = Contexts(one.assign(kept=False))

    def word_gains(g: GramCounts) -> tuple[np.ndarray, ...]:
        k, at = of(held, g, False)
        return g.s2[k], g.s1[k], np.zeros(len(k)), np.zeros(len(k)), divergence(g.n[k], held.total[at], held.kinds[at], root_probability(g.c[k], n, v))

    one = settled(one, summed(word_gains))
    pairs = summed(frequent)
    pairs = pairs[pairs["s1"].isin(one["s1"])]
    if not len(pairs):
        return Contexts(one)
    known = Contexts(pd.concat([one, pairs.drop(columns="gain").assign(kept=False)], ignore_index=True))

    def pair_sums(g: GramCounts) -> tuple[np.ndarray, ...]:
        k, _ = of(known, g, True)
        return g.s2[k], g.s1[k], g.n[k], np.ones(len(k)), np.zeros(len(k))

    two = summed(pair_sums)
    both = Contexts(pd.concat([one, two.drop(columns="gain").assign(kept=False)], ignore_index=True))

    def pair_gains(g: GramCounts) -> tuple[np.ndarray, ...]:
        k, at = of(both, g, True)
        q, w = root_probability(g.c[k], n, v), both.word(g.s1[k])
        q = np.where(both.kept[w], smoothed(g.shorter()[k], both.total[w], both.kinds[w], q), q)
        return g.s2[k], g.s1[k], np.zeros(len(k)), np.zeros(len(k)), divergence(g.n[k], both.total[at], both.kinds[at], q)

    return Contexts(pd.concat([one, settled(two, summed(pair_gains))], ignore_index=True))


def score_texts(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """docs (doc_id, text, held) as a row per document with its scores (see op11); documents without held train the model.

    The model is a suffix tree over words: a context of one or two words is a state if predicting each of its next tokens from the others
    beats the shorter state's by KEEP nats over all its occurrences; a state's next-token distribution is its counts, smoothed by
    the shorter state's; a token is scored in the longest state that ends the words ahead of it.

    Documents are numbered in blocks; parts count all words and answer the blocks. Then every window of three
    tokens goes to the bucket of the word ahead, so that a bucket holds whole branches of the tree, grows them, scores its windows and
    returns sums by document. A word that occurs over LARGE times has its next tokens counted in parts, one entry per block and gram, and
    its windows dealt by the word before too; windows of pairs that occur as often never leave their block. Tables of all sizes go that way;
    nothing is left out. Null and empty texts are their end alone; rows without an id or repeated rows are
    documents of their own; without any training text a score is the base score. Other columns are left out. docs must be
    stored (a task that runs again must read the same rows).
    """
    spark, scratch = docs.sparkSession, scratch or Scratch(docs.sparkSession)
    parts = vocabulary_parts(docs.agg(F.sum(F.length("text"))).first()[0] or 0)
    asked = scratch.table(cut_words(docs, parts), "words")
    told = scratch.table(asked.where("kind = 1").groupBy("to").applyInArrow(count_words(parts), ROWS), "counts")

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [unpack(x.as_py())[0].tolist() for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["n", "v"])

    n, v = (x or 0 for x in told.where("kind = 1").select("blob").mapInArrow(sums_of, "n long, v long").agg(F.sum("n"), F.sum("v")).first())
    ends = docs.where(~F.col("held")).count()
    buckets, large = max(LEAST, n // BUCKET + 1), LARGE

    def ask_grams(left: pa.Table, right: pa.Table) -> pa.Table:
        w = Windows(left, list(blobs_of(right)), ends)
        grams, first, in_two, in_three = w.large_grams(large)
        found = np.bincount(in_two[(in_two >= 0) & w.train], minlength=len(grams)) + np.bincount(in_three[(in_three >= 0) & w.train], minlength=len(grams))
        return table_of([(1, to, w.block, pack(*(grams[k] + np.array([1, 0, 0])).T, found[k], w.c[first[k]])) for to, k in gram_parts(grams, buckets)])

    def count_grams(table: pa.Table) -> pa.Table:
        asks = [(r["block"], r["to"], x) for r, x in blobs_of(table)]
        s2, s1, a, found, c = (np.concatenate([x[k] for _, _, x in asks]).astype(np.int64) for k in range(5))
        first, at = distinct(s2, s1, a)
        total, out, s = np.bincount(at, found).astype(np.int64), [], 0
        for block, to, x in asks:
            out.append((2, to, block, pack(total[at[s : s + len(x[0])]])))
            s += len(x[0])
        return table_of([*out, (3, -1, -1, pack(s2[first], s1[first], a[first], total, c[first]))])

    blocks = asked.where("kind = 0").groupBy("block")
    grams = scratch.table(blocks.cogroup(told.where("kind = 0").groupBy("block")).applyInArrow(ask_grams, ROWS).groupBy("to").applyInArrow(count_grams, ROWS), "grams")

    held_contexts = spark.sparkContext.broadcast(large_contexts(grams.where("kind = 3").select("blob"), large, n, v))

    def deal(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, contexts = list(blobs_of(right)), held_contexts.value
        w = Windows(left, [x for x in rows if x[0]["kind"] == 0], ends)
        grams, _, in_two, in_three = w.large_grams(large)
        answers = {r["to"]: x[0] for r, x in rows if r["kind"] == 2}
        found = np.zeros(len(grams) + 1, np.int64)  # the last one is for windows without a gram
        for to, k in gram_parts(grams, buckets):
            found[k] = answers[to]
        p = root_probability(w.c.astype(np.int64), n, v)
        base = np.log10(p)
        # the first word is large: its next token's count is known here, and whether the pair is large too
        one, two = np.full(len(w.a), -1, np.int32), np.full(len(w.a), -1, np.int32)
        one[in_two >= 0], two[in_three >= 0] = contexts.word(w.w1[in_two >= 0]), contexts.pair(w.w2[in_three >= 0], w.w1[in_three >= 0])
        own = (one >= 0) & ((two >= 0) | (w.w1 == 0))  # START has no word ahead
        for context, gram, some in ((one, in_two, own), (two, in_three, own & (two >= 0))):
            k = np.flatnonzero(some)
            k = k[contexts.kept[context[k]]]
            p[k] = smoothed(found[gram[k]], contexts.total[context[k]], contexts.kinds[context[k]], p[k])
        # contexts that occur once in training are no states
        away = ~own & (w.n1 > 1)
        local = np.bincount(w.doc, np.where(away, 0.0, np.log10(p)), len(w.counts))
        k = np.flatnonzero(away)
        to = np.where(one[k] >= 0, dealt([w.w1[k], w.w2[k]], buckets), dealt([w.w1[k], np.zeros(len(k), np.int64)], buckets))
        out = [(0, int(w.block % buckets), w.block, pack(w.doc_id.astype(np.int64), w.valid, w.held, w.counts, np.bincount(w.doc, w.c > 0, len(w.counts)).astype(np.int64), np.bincount(w.doc, base, len(w.counts)), local))]
        for bucket, places in split_by(to):
            x = k[places]
            ids, own_ids = np.unique(np.concatenate([w.w1[x], w.w2[x], w.a[x]]), return_inverse=True)
            w1, w2, a = np.split(own_ids, 3)
            order = np.lexsort((a, w2, w1))
            docs_in, doc = np.unique(2 * w.doc[x] + w.train[x], return_inverse=True)
            seen = np.zeros(len(ids), np.int64)
            seen[a] = w.c[x]
            nexts = np.where(one[x] >= 0, found[in_two[x]] + 1, 0)  # 0: the bucket counts by itself
            diff = lambda y: np.diff(y, prepend=0)
            out.append((1, bucket, w.block, pack(diff(ids), seen, diff(docs_in), diff(w1[order]), w2[order], a[order], doc[order], nexts[order])))
        return table_of(out)

    def score(table: pa.Table) -> pa.Table:
        contexts, out, held = held_contexts.value, [], []
        for r in table.sort_by([("kind", "ascending"), ("block", "ascending")]).to_pylist():
            if r["kind"] == 0:
                out.append((0, r["to"], r["block"], r["blob"]))
            else:
                held.append((r["block"], unpack(r["blob"])))
        if not held:
            return table_of(out)
        names = [np.cumsum(x[0], dtype=np.int64) for _, x in held]
        every = np.unique(np.concatenate(names))
        local = [np.searchsorted(every, y).astype(np.int32) for y in names]
        w1, w2, a = (np.concatenate([y[np.cumsum(x[k], dtype=np.int64) if k == 3 else x[k]] for y, (_, x) in zip(local, held, strict=True)]) for k in (3, 4, 5))
        seen, nexts = (np.concatenate(y) for y in zip(*((x[1][x[5]], x[7]) for _, x in held), strict=True))
        doc_of = [np.cumsum(x[2], dtype=np.int64) for _, x in held]
        train = np.concatenate([(d & 1)[x[6]] for d, (_, x) in zip(doc_of, held, strict=True)])
        held = [(block, x[6]) for block, x in held]  # the rest is in the arrays above
        del names, local
        logs = np.empty(len(a))
        for _, k in split_by(dealt([w1, np.ones(len(w1), np.int8)], len(a) // TURN + 1)):  # a word's windows are in one turn
            p0 = root_probability(seen[k].astype(np.int64), n, v)
            p, known = p0.copy(), nexts[k] > 0
            free = np.flatnonzero(~known)
            if len(free):
                p[free] = Grams(w1[k[free]], a[k[free]], len(every), train[k[free]]).settle(p0[free])
            if known.any():
                one = contexts.word(every[w1[k[known]]])
                q = smoothed(nexts[k[known]].astype(np.int64) - 1, contexts.total[one], contexts.kinds[one], p0[known])
                p[known] = np.where(contexts.kept[one], q, p0[known])
            pair = np.unique(w1[k].astype(np.int64) * len(every) + w2[k], return_inverse=True)[1]
            logs[k] = np.log10(np.where(every[w1[k]] == 0, p, Grams(pair, a[k], len(every), train[k]).settle(p)))
        s = 0
        for (block, doc), d in zip(held, doc_of, strict=True):
            out.append((1, int(table.column("to")[0].as_py()), block, pack(d >> 1, np.bincount(doc, logs[s : s + len(doc)], len(d)))))
            s += len(doc)
        return table_of(out)

    def finish(table: pa.Table) -> pa.Table:
        rows = list(blobs_of(table))
        doc_id, valid, held, counts, known, base, total = rows[0][1]
        total = total.copy()
        for _, (d, x) in rows[1:]:
            np.add.at(total, d.astype(np.int64), x)
        columns = [pa.array(doc_id.astype(np.int64), mask=valid == 0), pa.array(held > 0), *(pa.array(x.astype(np.int64)) for x in (counts, known, np.full(len(counts), n))), pa.array(base), pa.array(total)]
        return pa.table(columns, [c.split()[0] for c in schema.split(", ")])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    both = told.where("kind = 0").unionByName(grams.where("kind = 2"))
    return blocks.cogroup(both.groupBy("block")).applyInArrow(deal, ROWS).groupBy("to").applyInArrow(score, ROWS).groupBy("block").applyInArrow(finish, schema)


def op11_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", held_out().alias("held")))
