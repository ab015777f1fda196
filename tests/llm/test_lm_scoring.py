import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from foliant.llm import lm_scoring

from . import data


def tokens_by_hand(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w] + [None]


def by_hand(rows):
    """A suffix tree of dictionaries over whole texts."""
    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows]
    texts = [tokens_by_hand(t) for _, t in rows]
    c = Counter(w for t, h in zip(texts, held, strict=True) if not h for w in t)
    n, v, nexts = sum(c.values()), len(c), defaultdict(Counter)
    contexts = lambda t, i: [(), (t[i - 1],) if i else ("start",), (t[i - 2] if i > 1 else "start", t[i - 1]) if i else None]
    for t, h in zip(texts, held, strict=True):
        if not h:
            for i, w in enumerate(t):
                for k in contexts(t, i)[1:]:
                    if k:
                        nexts[k][w] += 1
    root = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
    states = {}

    def p(w, k):
        """In the longest state that ends k."""
        if not k:
            return root(w)
        if not states.get(k):
            return p(w, k[1:])
        own = nexts[k]
        return (own[w] + len(own) * p(w, k[1:])) / (sum(own.values()) + len(own))

    for size in (1, 2):
        for k, own in nexts.items():
            total, kinds = sum(own.values()), len(own)
            if len(k) == size and total > 1:
                gain = sum(m * (math.log((m - 1 + (kinds - (m == 1)) * p(w, k[1:])) / (total - 1 + kinds - (m == 1))) - math.log(p(w, k[1:]))) for w, m in own.items())
                states[k] = gain >= lm_scoring.KEEP
    out = []
    for (d, _), h, t in zip(rows, held, texts, strict=True):
        longest = lambda i: contexts(t, i)[2] or contexts(t, i)[1]  # noqa: B023, E731
        out.append((d, h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10(root(w)) for w in t), sum(math.log10(p(w, longest(i))) for i, w in enumerate(t))))
    return out, sum(states.values())


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[6]))


@pytest.mark.parametrize("block,bucket,large", [(8_000_000, 1_500_000, 750_000), (4000, 900, 40), (9000, 500, 3)])
def test_equals_brute_force(spark, tmp_path, monkeypatch, block, bucket, large):
    for name, x in (("BLOCK", block), ("BUCKET", bucket), ("LARGE", large), ("TURN", bucket // 3)):
        monkeypatch.setattr(lm_scoring, name, x)
    rows = [(r[0], r[1]) for r in data.documents()] + [(2000 + i, "over and over " * 30 + f"Again \x0b\x0c\x1c x{i} \x85y") for i in range(20)]
    spark.createDataFrame([(d, t, "x", 1.0) for d, t in rows], "doc_id long, text string, n string, score double").repartition(3).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d").withColumn("held", lm_scoring.held_out())
    want, states = by_hand(rows)
    got = ordered(tuple(r) for r in lm_scoring.score_texts(docs).collect())
    assert states > 20 and len(got) == len(want)
    for a, b in zip(got, ordered(want), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)


def test_odd_tables(spark, tmp_path):
    assert lm_scoring.score_texts(data.empty(spark).withColumn("held", F.lit(False))).count() == 0
    spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    got = lm_scoring.score_texts(spark.read.parquet(f"{tmp_path}/d").withColumn("held", F.lit(True))).orderBy("doc_id").collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)] and all(r["score"] == 0 for r in got)


def test_query_predicts_better_than_base(spark, sf_dir):
    rows = lm_scoring.op11_lm_score(spark, sf_dir).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 200 and held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) for r in rows)
