import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import ann, near_vectors, warc
from foliant.llm.common import Scratch, components, shared_path
from foliant.llm.vectors import usable

VEC = "vec_id long, embedding array<float>, label int, n_links string, rank string"


def vectors(seed=1, dim=16):
    rng = np.random.default_rng(seed)
    rows, centres = [], rng.standard_normal((6, dim))
    for i in range(240):
        v = centres[i % 6] + 0.25 * rng.standard_normal(dim)
        rows.append((i, [float(np.float32(x)) for x in v], i % 3))
    same = rows[7][1]
    rows += [(300 + i, same, 1) for i in range(40)] + [(400, same, 2)]  # copies, and one with another label
    rows += [(500, None, 1), (501, [0.0] * dim, 1), (502, [float("nan")] + [1.0] * (dim - 1), 1), (503, [None] + [1.0] * (dim - 1), 1), (504, [float("inf")] + [1.0] * (dim - 1), 1), (505, same, None), (506, [1.0, 2.0], 1), (507, [-0.0] + [1.0] * (dim - 1), 1), (508, [0.0] + [1.0] * (dim - 1), 1)]
    rows += [rows[3], (None, rows[5][1], 2)]
    return [(*r, "x", "y") for r in rows]


def good(v):
    return v is not None and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)


def cosine(a, b):
    return float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))


def usable_by_hand(v):
    return bool(good(v))


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(ann, "CANDIDATE_ROWS", 50)
    rows = [r for r in vectors() if r[0] is not None][:-1]
    df = spark.createDataFrame(rows, VEC).repartition(3)
    got = {}
    for r in ann.nearest(df.where("vec_id % 20 = 0"), df, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    have = [(r[0], np.array(r[1], float)) for r in rows if good(r[1])]
    for i, v in have:
        if i % 20 == 0:
            near = sorted(((-cosine(v, w), j) for j, w in have if j != i and len(w) == len(v)))[:5]
            mine = sorted(got.get(i, []))
            assert [s for _, _, s in mine] == pytest.approx([-c for c, _ in near], abs=1e-12)
            assert [r for r, _, _ in mine] == list(range(1, len(near) + 1))
            assert all(cosine(v, dict(have)[j]) == pytest.approx(s, abs=1e-12) for _, j, s in mine)
    assert ann.nearest(df.limit(0), df, 5).count() == 0 and ann.nearest(df.where("vec_id = 0"), df.limit(0), 5).count() == 0


def test_survivors_stay_level_as_tiles_double(spark, monkeypatch):
    monkeypatch.setattr(ann, "CANDIDATE_ROWS", 64)
    monkeypatch.setattr(ann, "GROWTH", 3)
    rng, scratch, found = np.random.default_rng(11), Scratch(spark), []
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(48)]) for i in range(4096)]
    for n in (1024, 2048, 4096):
        df = scratch.table(spark.createDataFrame(rows[:n], "vec_id long, embedding array<float>").withColumn("uid", F.col("vec_id")))
        codes = scratch.table(ann.code_rows(df))
        found.append(ann.survivors(scratch.table(codes.where("vec_id < 40")), codes, 5, scratch).count() / 40)
    assert all(x >= 5 for x in found) and found[-1] < 1.5 * found[0] + 5


def test_ties_go_to_smaller_ids(spark):
    df = spark.createDataFrame([r for r in vectors() if r[0] is not None], VEC)
    got = ann.nearest(df.where("vec_id = 320"), df, 5).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [7, 300, 301, 302, 303]
    got = ann.nearest(df.where("vec_id = 300"), df.unionByName(df.where("vec_id in (300, 301)")), 5).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [7, 301, 301, 302, 303]  # repeated candidates each count


def test_tiles_get_codes_only(spark):
    df = spark.createDataFrame([r for r in vectors(dim=64) if r[0] is not None and usable_by_hand(r[1])], VEC).withColumn("uid", F.monotonically_increasing_id())
    rows = ann.code_rows(df).collect()
    assert all(len(r["code"]) == r["dim"] for r in rows) and "embedding" not in rows[0]


def test_cosine_bounds():
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal((40, 64)), rng.standard_normal((50, 64))
    low, high = ann.cosine_bounds(ann.quantise(a), ann.quantise(b))
    exact = np.array([[cosine(x, y) for y in b] for x in a])
    assert (low <= exact).all() and (exact <= high).all() and (high - low).max() < 0.05


def links_by_hand(rows, least=0.93):
    n = len(rows)
    ok = [good(r[1]) and r[2] is not None for r in rows]
    links, root = [0] * n, list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and cosine(np.array(rows[i][1], float), np.array(rows[j][1], float)) >= least:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[find(i)] = min(ids.get(find(i), 1 << 60), r[0])
    return sorted((str(r[0]), links[i], str(ids.get(find(i)))) for i, r in enumerate(rows))


@pytest.mark.parametrize("block", [2048, 20])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(near_vectors, "BLOCK_ROWS", block)
    rows = vectors()
    got = near_vectors.near_vectors(spark.createDataFrame(rows, VEC).repartition(3)).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got) == links_by_hand(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert near_vectors.near_vectors(spark.createDataFrame([], VEC)).count() == 0


@pytest.mark.parametrize("confidence", [None, 3.0, 0.5])
def test_code_estimates(confidence):
    rng = np.random.default_rng(4)
    a = rng.standard_normal((300, 64))
    b = np.concatenate([a[:100] + 0.2 * rng.standard_normal((100, 64)), rng.standard_normal((200, 64))])
    codes, queries = near_vectors.Codes.of(b), near_vectors.Codes.of(a)
    guess, error, upper = near_vectors.estimate(queries, codes)
    exact = np.array([[cosine(x, y) for y in b] for x in a])
    assert (upper >= exact).all()
    assert abs((guess - exact).mean()) < 0.005 and (np.abs(guess - exact) <= 4 * error).mean() > 0.999
    near = near_vectors.survivors(queries, codes, 0.93, confidence)
    assert near.mean() < 0.05
    assert near[exact >= 0.93].mean() >= (1.0 if confidence is None or confidence > 1 else 0.9)  # recall against brute force
    r = near_vectors.rotation(32)
    assert np.allclose(r @ r.T, np.eye(32))


def test_recall_with_noisy_copies(spark):
    rng = np.random.default_rng(8)
    rows = [r["embedding"] for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect() if good(r["embedding"])]
    a = np.array(rows, float)
    a = np.concatenate([a, *(a + s * np.linalg.norm(a, axis=1)[:, None] * rng.standard_normal(a.shape) / 8 for s in (0.2, 0.3, 0.38))])
    unit = a / np.linalg.norm(a, axis=1)[:, None]
    want = unit @ unit.T >= 0.93
    codes = near_vectors.Codes.of(a)
    near = near_vectors.survivors(codes, codes, 0.93, near_vectors.CONFIDENCE)
    assert want.sum() > 2 * len(a) and near[want].mean() >= 0.9999 and near.mean() < 0.02


def test_usable(spark):
    df = spark.createDataFrame(vectors(), VEC)
    assert [r["u"] for r in df.select("vec_id", usable(F.col("embedding")).alias("u")).collect()] == [bool(good(r[1])) for r in vectors()]


def test_components(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, 201), (300, 300), (None, 5), (201, 202), (201, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(101)}, 200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


PAGES = "page_id long, url string, html string, record_type string"


def pages():
    big = "<p>é</p>" * 20
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, "short"), (4, "http://c\r\nX: y", "short"), (5, "u", None), (6, "u", ""), (None, "u", big), (0, "u", big), (0, "v", big), (9, "w", "x" * 300_000), (10, "w", "x" * 99), (11, "w", "x" * 99)]
    return [(*r, "z") for r in rows]


@pytest.mark.parametrize("width", [97, 4096, 1 << 20])
def test_warc_round_trip(spark, width):
    scratch = Scratch(spark)
    df = spark.createDataFrame(pages(), PAGES).repartition(2)
    archives = warc.write_archives(warc.plan_revisits(df, scratch), shared_path(spark, "warc"), scratch)
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"] is not None and bytes(r["payload"])) for r in warc.read_archives(spark, archives, width=width).collect()), key=str)
    want = []
    for i, _, html, _ in pages():
        data = (html or "").encode()
        again = len(data) == 180 and i in (1, 2)
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 0 if again else None, False if again else data))
    assert got == sorted(want, key=str)


def test_warc_empty_and_false_magic(spark, tmp_path):
    scratch = Scratch(spark)
    archives = warc.write_archives(warc.plan_revisits(spark.createDataFrame([], PAGES), scratch), shared_path(spark, "warc"), scratch)
    assert warc.read_archives(spark, archives).count() == 0
    junk = warc.MAGIC + b"\0" * 20 + warc.member(b"not a record") + warc.member(warc.record(1, "u", b"x", hashlib.sha256(b"x").hexdigest(), None, False)) + warc.MAGIC
    p = tmp_path / "a.warc.gz"
    p.write_bytes(junk)
    files = spark.createDataFrame([(str(p), len(junk))], "path string, size long")
    assert [r["page_id"] for r in warc.read_archives(spark, files, width=7).collect()] == [1]


@pytest.mark.parametrize("width", [4096, 1 << 20])
def test_warc_long_urls(spark, width):
    scratch, noise = Scratch(spark), np.random.default_rng(5).bytes(100_000).hex()
    rows = [(1, "data:" + noise, "<p>a</p>"), (2, "http://a/" + "x" * 5_000_000, "<p>b</p>"), (3, "data:" + noise, None), (4, "u", "<p>c</p>")]
    archives = warc.write_archives(warc.plan_revisits(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1), scratch), shared_path(spark, "warc"), scratch)
    got = {r["page_id"]: (r["url"], bytes(r["payload"])) for r in warc.read_archives(spark, archives, width=width).collect()}
    assert got == {i: (url, (html or "").encode()) for i, url, html in rows}
