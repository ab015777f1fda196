"""Small tables with what can go wrong: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, spans string, score string, length string, fingerprint string"


def words(rng, n, vocabulary=400):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(2 + v % 6)) + str(v) for v in (rng.randrange(vocabulary) for _ in range(n)))


def documents(seed=1):
    rng = random.Random(seed)
    rows, base = [], words(rng, 300)
    for i in range(60):
        rows.append((i, words(rng, rng.choice([3, 40, 120, 400])), "en", f"s{i % 4}"))
    rows += [(100 + i, base, "en", "s0") for i in range(5)]  # exact copies
    rows += [(200 + i, base.replace("a", "b", i), "en", "s1") for i in range(1, 4)]  # near copies
    rows += [(300 + i, words(rng, 30) + " " + base[: 450 + 40 * i] + " " + words(rng, 30), "en", "s2") for i in range(4)]  # a shared passage
    rows += [(400, None, "en", "s0"), (401, "", None, None), (None, None, None, None), (None, "lone words here", "en", None), (402, "   \n\t ", "en", "s0"), (403, "x" * 3000, "en", "s3"), (404, "é ß 日本 " * 300, "fr", "s3")]
    rows += [(50, rows[50][1], "en", "s2")] * 3  # repeated rows
    return [(d, t, lang, s, None if t is None else len(t), "a", "b", "c", "d", "e") for d, t, lang, s in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)
