"""Alignment of two tokenizers' tokens: different segments are tokenised and aligned once, documents are composed from them."""

from __future__ import annotations

import hashlib
import os
import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import Numbers, flat_slices, pack, pack_texts, parts_of, split_by, sums, unpack, unpack_texts, vocabulary_parts
from .common import Scratch

#: Characters of documents that a task numbers together, and segments that it tokenises at a time.
BLOCK, PIECES = 9_000_000, 8192
#: Characters that some version of a pattern takes for white space, beyond those of Python; and the second tokenizer's blank.
ODD = "\u180e\u200b\u2060\ufeff\u2581"
ROWS = "kind int, to int, block long, blob binary"


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: printable ones stand for themselves, the others follow U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """The two tokenizers and their tokens' bytes; a worker process keeps them from task to task."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has a core of its own
        kept = sys.modules.setdefault("_foliant_pair", types.ModuleType("_foliant_pair"))
        if getattr(kept, "paths", None) != (path_a, path_b):
            from sentencepiece import SentencePieceProcessor
            from tokenizers import Tokenizer

            kept.a, kept.b, kept.paths = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b), (path_a, path_b)
            kept.a.encode_special_tokens = True  # their strings in a text are then ordinary text
            byte, vocabulary = byte_letters(), kept.a.get_vocab()
            kept.bytes_a = [b""] * (max(vocabulary.values()) + 1)
            for x, i in vocabulary.items():
                kept.bytes_a[i] = bytes(map(byte.__getitem__, x)) if all(c in byte for c in x) else x.encode()
            pieces = [kept.b.id_to_piece(i) for i in range(kept.b.get_piece_size())]
            kept.bytes_b = [bytes([int(p[3:5], 16)]) if kept.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
            kept.lens = [np.fromiter(map(len, x), np.int64, len(x)) for x in (kept.bytes_a, kept.bytes_b)]
            kept.shown = [f"{i}{end}".encode() for n, ends in ((len(kept.bytes_a), ",|"), (len(kept.bytes_b), ",;")) for i in range(n) for end in ends]
            kept.shown_lens = np.fromiter(map(len, kept.shown), np.int64, len(kept.shown))
        self.kept = kept

    def joinable(self) -> str:
        """Characters after which some token of either vocabulary goes on with a blank: text must not be split there."""
        found = {t.decode(errors="ignore")[-1:] for x in (*self.kept.bytes_a, *self.kept.bytes_b) for t in x.split(b" ")[:-1]}
        return "".join(sorted(found - {"", " "}))

    def align(self, pieces: list[str]) -> tuple[np.ndarray, ...]:
        """Of a blank and each piece: whether both tokenizers keep its bytes, counts of A and B tokens, all A ids, all B ids, and per
        A token twice the B tokens it shares a byte with, plus 1 if it shares the first with the token ahead (0 for pieces that fail)."""
        if len(pieces) > PIECES:
            return tuple(np.concatenate(x) for x in zip(*(self.align(pieces[i : i + PIECES]) for i in range(0, len(pieces), PIECES)), strict=True))
        k = self.kept
        a = [e.ids for e in k.a.encode_batch_fast([" " + p for p in pieces], add_special_tokens=False)]
        b = k.b.encode(pieces, num_threads=1)
        na, nb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        ids_a, ids_b = (np.fromiter((i for x in xs for i in x), np.int64, int(n.sum())) for xs, n in ((a, na), (b, nb)))
        want = [b" " + p.encode() for p in pieces]
        kept = np.ones(len(pieces), bool)
        for ids, n, tokens in ((ids_a, na, k.bytes_a), (ids_b, nb, k.bytes_b)):
            if b"".join(map(tokens.__getitem__, ids.tolist())) != b"".join(want) or (sums(self.lens(ids, tokens), np.cumsum(n)) != np.fromiter(map(len, want), np.int64, len(want))).any():
                ends = np.cumsum(n).tolist()
                own = ids.tolist()
                kept &= np.fromiter((b"".join(map(tokens.__getitem__, own[s:e])) == w for s, e, w in zip([0, *ends[:-1]], ends, want, strict=True)), bool, len(want))
        codes = np.zeros(len(ids_a), np.int64)
        some_a, some_b = np.repeat(kept, na), np.repeat(kept, nb)
        end_a, end_b = np.cumsum(k.lens[0][ids_a[some_a]]), np.cumsum(k.lens[1][ids_b[some_b]])
        low = np.searchsorted(end_b, end_a - k.lens[0][ids_a[some_a]], "right")
        high = np.searchsorted(end_b - k.lens[1][ids_b[some_b]], end_a, "left") - 1
        shared = np.concatenate([[0], low[1:] == high[:-1]])[: len(low)]
        codes[some_a] = 2 * (high - low + 1) + shared
        return kept, na, nb, ids_a.astype(np.int32), ids_b.astype(np.int32), codes.astype(np.int32)

    def lens(self, ids: np.ndarray, tokens: list[bytes]) -> np.ndarray:
        return self.kept.lens[0 if tokens is self.kept.bytes_a else 1][ids]


def segments(text: str, joins: re.Pattern) -> list[str]:
    """The text with a blank ahead, split at blanks that open a run of white space, each segment without its first blank.

    joins finds a blank behind a character that may be joined with it (white space, or what joinable() names). White space
    at the end stays with what is ahead.
    """
    parts = text.split(" ")
    if text[:1] != " " and not text[-1:].isspace() and not joins.search(text):
        return parts
    out = [parts[0]]
    for p in parts[1:]:
        if out[-1] == "" or joins.match(out[-1][-1] + " "):
            out[-1] += " " + p
        else:
            out.append(p)
    while len(out) > 1 and (not out[-1] or out[-1].isspace()):
        last = out.pop()
        out[-1] += " " + last
    return out


def joining(joinable: str) -> re.Pattern:
    return re.compile(rf"[\s{ODD}{re.escape(joinable)}] ")


def cut(docs: DataFrame, parts: int, joinable: str) -> DataFrame:
    """docs (doc_id, text) as blocks of many documents: a row (kind 0) with its documents as numbers of segments, and
    rows (kind 1) that ask the parts about the block's different segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joins, block = joining(joinable), TaskContext.get().partitionId() << 32

        def rows(ids: list, counts: list[int], found: list[np.ndarray], numbers: Numbers) -> pa.RecordBatch:
            flat = np.concatenate([*found, np.zeros(0, np.int32)]).astype(np.int64)
            order = np.argsort(-np.bincount(flat, minlength=len(numbers)), kind="stable")  # frequent ones get small numbers
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            names = list(numbers)
            texts = [names[k].encode() for k in order.tolist()]
            out = [(0, -1, pack(np.array([x or 0 for x in ids], np.int64), np.array([x is not None for x in ids], np.uint8), np.array(counts, np.int64), rank[flat]))]
            for to, places in split_by(parts_of(texts, parts)):
                out.append((1, to, pack(places, *pack_texts([texts[k] for k in places.tolist()]))))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([block] * len(out), pa.int64()), pa.array([x[2] for x in out], pa.binary())], ["kind", "to", "block", "blob"])

        ids, counts, found, numbers, size = [], [], [], Numbers(), 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py() or ""
                own = list(map(numbers.__getitem__, segments(text, joins))) if text else []
                ids.append(i)
                counts.append(len(own))
                found.append(np.array(own, np.int32))
                size += len(text) + 50
                if size >= BLOCK:
                    yield rows(ids, counts, found, numbers)
                    ids, counts, found, numbers, size, block = [], [], [], Numbers(), 0, block + 1
        if ids:
            yield rows(ids, counts, found, numbers)

    return docs.select("doc_id", "text").mapInArrow(run, ROWS)


def blobs_of(table: pa.Table) -> Iterator[tuple[dict, list[np.ndarray]]]:
    """The rows of a group, ordered, with the arrays of their blobs."""
    for r in table.sort_by([(c, "ascending") for c in table.column_names if c != "blob"]).to_pylist():
        yield r, unpack(r.pop("blob"))


def table_of(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["kind", "to", "block", "blob"])


def align_tokens(docs: DataFrame, path_a: str, path_b: str, scratch: Scratch | None = None) -> DataFrame:
    """docs (doc_id, text) as a row per document: doc_id, counts of tokens, groups and links, and groups_sha256 (see op13).

    Documents are numbered in blocks; each different segment of all documents is tokenised and aligned once, in the part that its hash names, and
    goes back to every block that has it. Blocks then compose documents, ask parts for the numbers of documents
    that hold each of the block's id pairs, and sum these. What a block asks about is pre-aggregated, so the most frequent
    segment or pair is one entry per block. Null and empty texts, and texts whose bytes either tokenizer changes, have zeros and
    an empty groups_sha256. Repeated rows are documents of their own; other columns are left out. docs must be stored (a task that
    runs again must read the same rows).
    """
    scratch = scratch or Scratch(docs.sparkSession)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = vocabulary_parts(chars)
    asked = scratch.table(cut(docs, parts, Pair(path_a, path_b).joinable()), "segments")

    def learn(table: pa.Table) -> pa.Table:
        numbers, asks = Numbers(), []
        for r, (places, lengths, data) in blobs_of(table):
            asks.append((r["block"], places, np.array([numbers[t] for t in unpack_texts(lengths, data)], np.int64)))
        kept, na, nb, a, b, codes = Pair(path_a, path_b).align([t.decode() for t in numbers])
        at_a, at_b, out = np.cumsum(na) - na, np.cumsum(nb) - nb, []
        for block, places, own in asks:
            in_a = flat_slices(at_a[own], na[own])
            out.append((0, 0, block, pack(places, kept[own].astype(np.uint8), na[own], nb[own], a[in_a], b[flat_slices(at_b[own], nb[own])], codes[in_a])))
        return table_of(out)

    aligned = asked.where("kind = 1").groupBy("to").applyInArrow(learn, ROWS)

    def compose(left: pa.Table, right: pa.Table) -> pa.Table:
        pair = Pair(path_a, path_b).kept
        (doc_id, valid, counts, numbers) = next(blobs_of(left))[1]
        held = [x for _, x in blobs_of(right)] or [[np.zeros(0, np.int64)] * 7]
        places, kept, na, nb, a, b, codes = (np.concatenate([x[k] for x in held]).astype(np.int32) for k in range(7))
        block = left.column("block")[0].as_py()
        where = np.empty(len(places), np.int32)
        where[places] = np.arange(len(places))
        own = where[numbers]
        del held
        # pieces that a tokenizer changes have no codes; their documents are blanked below
        ok_a, ok_b = np.repeat(kept, na) > 0, np.repeat(kept, nb) > 0
        na, nb, a, b, codes = na * kept, nb * kept, a[ok_a], b[ok_b], codes[ok_a]
        span, shared = codes >> 1, codes & 1
        high = np.cumsum(span - shared) - 1
        link_b, group_a = flat_slices(high - span + 1, span), np.cumsum(1 - shared) - 1
        group_b = np.zeros(len(b), np.int32)
        group_b[link_b] = np.repeat(group_a, span)
        n_groups = int(group_a[-1]) + 1 if len(a) else 0
        in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        shown = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = (np.concatenate([np.diff(g) > 0, [True]])[: len(g)] for g in (group_a, group_b))
        shown[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]] = 2 * a + last_a
        shown[np.arange(len(b)) + np.cumsum(in_a)[group_b]] = 2 * len(pair.bytes_a) + 2 * b + last_b
        text = b"".join(map(pair.shown.__getitem__, shown.tolist()))
        ends = np.cumsum(sums(pair.shown_lens[shown], np.cumsum(na + nb))).tolist()
        piece_text = [text[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
        links = sums(span, np.cumsum(na))
        pairs, pid = np.unique((np.repeat(a, span).astype(np.int64) << 32) | b[link_b], return_inverse=True)
        del link_b, group_a, group_b, shown, text, high
        stop = np.cumsum(counts, dtype=np.int64)
        good = (sums(1 - kept[own], stop) == 0) & (counts > 0)
        totals = [np.where(good, sums(x[own], stop), 0) for x in (na, nb, sums(1 - shared, np.cumsum(na)), links)]
        start, holders, shas = np.cumsum(links) - links, np.zeros(len(pairs), np.int64), []
        for s, e, fine in zip((stop - counts).tolist(), stop.tolist(), good.tolist(), strict=True):
            if fine:
                mine = own[s:e]
                shas.append(hashlib.sha256(b"".join([piece_text[k] for k in mine.tolist()])[:-1]).digest())
                mine = np.unique(mine)
                holders[np.unique(pid[flat_slices(start[mine], links[mine])])] += 1
        out = [(0, -1, block, pack(doc_id.astype(np.int64), valid, counts, good.astype(np.uint8), *totals, own, links, pid, pairs >> 32, np.frombuffer(b"".join(shas), np.uint8)))]
        some = np.flatnonzero(holders)
        for to, k in split_by((pairs[some] * 0x9E3779B1 >> 16) % parts):
            out.append((1, to, block, pack(some[k], pairs[some[k]] >> 32, pairs[some[k]] & 0xFFFFFFFF, holders[some[k]])))
        return table_of(out)

    state = scratch.table(asked.where("kind = 0").groupBy("block").cogroup(aligned.groupBy("block")).applyInArrow(compose, ROWS), "composed")

    def total(table: pa.Table) -> pa.Table:
        asks = [(r["block"], x) for r, x in blobs_of(table)]
        key = np.concatenate([(a.astype(np.int64) << 32) | b for _, (_, a, b, _) in asks])
        keys, at = np.unique(key, return_inverse=True)
        n = np.bincount(at, np.concatenate([x[3] for _, x in asks])).astype(np.int64)
        out, s = [], 0
        for block, x in asks:
            out.append((0, -1, block, pack(x[0], n[at[s : s + len(x[0])]])))
            s += len(x[0])
        ids, first = np.unique(keys >> 32, return_index=True)
        return table_of([*out, (1, -1, -1, pack(ids, np.maximum.reduceat(n, first)))])

    counted = scratch.table(state.where("kind = 1").groupBy("to").applyInArrow(total, ROWS), "counted")
    scratch.drop(asked)

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                ids, n = unpack(x.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(n.astype(np.int64))], ["id", "n"])

    # at most as many rows as A has ids
    tops = counted.where("kind = 1").select("blob").mapInArrow(highest, "id long, n long").groupBy("id").agg(F.max("n").alias("n")).toPandas()
    top = np.zeros(int(tops["id"].max()) + 1 if len(tops) else 1, np.int64)
    top[tops["id"]] = tops["n"]
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        doc_id, valid, counts, good, n_a, n_b, n_groups, n_links, own, links, pid, pair_a, shas = next(blobs_of(left))[1]
        n = np.zeros(len(pair_a), np.int64)
        for _, (k, found) in blobs_of(right):
            n[k] = found
        best = (n > 0) & (n == top[np.minimum(pair_a, len(top) - 1)])
        stop, by_piece = np.cumsum(counts, dtype=np.int64), np.cumsum(links, dtype=np.int64)
        found = [np.where(good, sums(sums(x[pid], by_piece)[own], stop), 0) for x in (best.astype(np.int64), n)]
        raw, sha, at = shas.tobytes(), [], 0
        for fine in good.tolist():
            sha.append(raw[at : at + 32].hex() if fine else "")
            at += 32 * fine
        columns = [pa.array(doc_id.astype(np.int64), mask=valid == 0), *(pa.array(x.astype(np.int64)) for x in (n_a, n_b, n_groups, n_links, *found)), pa.array(sha, pa.string())]
        return pa.table(columns, [c.split()[0] for c in schema.split(", ")])

    return state.where("kind = 0").groupBy("block").cogroup(counted.where("kind = 0").groupBy("block")).applyInArrow(finish, schema)


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    return align_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), *tokenizer_paths())
