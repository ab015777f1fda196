import hashlib
import random
from collections import Counter

import pytest

from foliant.llm import alignment

from . import data


def tokens_by_hand(text):
    """Whole texts through both tokenizers: (id, bytes) of A and B, or None where bytes change."""
    pair = alignment.Pair(*alignment.tokenizer_paths()).kept
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    both = [[(i, own[i]) for i in ids] for ids, own in ((a, pair.bytes_a), (b, pair.bytes_b))]
    return both if text and all(b"".join(x for _, x in t) == (" " + text).encode() for t in both) else None


def by_hand(rows):
    found, holders = [], Counter()
    for doc_id, text in rows:
        both, links, groups = tokens_by_hand(text or "") if text else None, [], []
        if both:
            spans = []
            for t in both:
                at, own = 0, []
                for i, x in t:
                    own.append((at, at + len(x), i))
                    at += len(x)
                spans.append(own)
            a, b = spans
            i = j = 0
            while i < len(a) and j < len(b):
                links.append((a[i][2], b[j][2]))
                if a[i][1] == b[j][1]:
                    groups.append((i + 1, j + 1))
                    i, j = i + 1, j + 1
                elif a[i][1] < b[j][1]:
                    i += 1
                else:
                    j += 1
            holders.update(set(links))
        else:
            a = b = []
        shown = [",".join(str(x[2]) for x in a[s:e]) + "|" + ",".join(str(x[2]) for x in b[u:v]) for (s, u), (e, v) in zip([(0, 0), *groups], groups, strict=False)]
        found.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(shown).encode()).hexdigest() if a else ""))
    top = {}
    for (x, _), n in holders.items():
        top[x] = max(n, top.get(x, 0))
    return [(d, na, nb, g, len(x), sum(holders[p] == top[p[0]] for p in x), sum(holders[p] for p in x), s) for d, na, nb, g, x, s in found]


ODD = ["a ", " a", "a  b ", "\na", " \n b", "x\xa0 y", "a\u2581b", "a\u2581 b", "  ", " ", "\t", "x\x00y z", "<|endoftext|> <s> </s>", "\u3000 x", "e\u0301 \u0301 b", "a \u200d b", "\U0001f642 \U0001f642\U0001f3fd x", "don't  'll go", "x" * 400 + " y", "a\r\n b\r c", "1 22  333   4444", "\x85 a\x1c b", "\u180e a\u200b b", "\ufeff bom"]


def test_splits_keep_tokens():
    pair = alignment.Pair(*alignment.tokenizer_paths())
    joins, rng = alignment.joining(pair.joinable()), random.Random(5)
    signs = [" ", " ", " ", "\n", "\t", "\xa0", "\u2581", "\u3000", "a", "the", "ing", "'s", ".", "12", "\xe9", "\u65e5\u672c", "\U0001f642", "\u0301", "<s>", "\u2581\u2581", "  ", "\r", "\x1f", "\u180e", "\u2028"]
    texts = ODD + ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 14))) for _ in range(4000)]
    for t in texts:
        own = alignment.segments(t, joins)
        assert " ".join(own) == t
        assert [i for p in own for i in pair.kept.a.encode(" " + p, add_special_tokens=False).ids] == pair.kept.a.encode(" " + t, add_special_tokens=False).ids, t
        assert [i for p in own for i in pair.kept.b.encode(p)] == pair.kept.b.encode(t), t
    assert sum(len(alignment.segments(t, joins)) > 1 for t in texts) > 1000


@pytest.mark.parametrize("block", [9_000_000, 3000])
def test_equals_whole_texts(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    monkeypatch.setattr(alignment, "PIECES", 8192 if block > 3000 else 17)
    monkeypatch.setattr(alignment, "vocabulary_parts", lambda chars: 3)
    rows = [(r[0], r[1]) for r in data.documents()] + [(900 + i, t) for i, t in enumerate(ODD)] + [(-5, "negative id"), (980, "word " * 5000)]
    spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_a int, block string").repartition(3).write.parquet(f"{tmp_path}/d")
    got = alignment.align_tokens(spark.read.parquet(f"{tmp_path}/d"), *alignment.tokenizer_paths())
    assert Counter(tuple(r) for r in got.collect()) == Counter(by_hand(rows))


def test_empty(spark):
    assert alignment.align_tokens(data.empty(spark), *alignment.tokenizer_paths()).count() == 0


def test_query_equals_whole_texts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert Counter(tuple(r) for r in alignment.op13_alignment(spark, sf_dir).collect()) == Counter(by_hand(rows))
