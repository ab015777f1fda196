from collections import Counter

import corpus_pipeline as P
from foliant.llm import mixing

from . import data
from .test_text_operators import WORD, fingerprint_by_hand, groups_by_hand, spans_by_hand


def test_stages(spark, sf_dir):
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash", "secrets", "mix", "pack"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = dict(P.STAGES)
    kept = stage["toxicity"](spark, docs, sf_dir)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    rows = sorted(kept.collect())
    root = groups_by_hand([fingerprint_by_hand(r["text"]) for r in rows], 4)
    want = sorted({min(r["doc_id"] for r, g in zip(rows, root, strict=True) if g == k) for k in set(root)})
    once = stage["simhash"](spark, kept, sf_dir)
    assert sorted(r["doc_id"] for r in once.collect()) == want and once.columns == docs.columns
    clean = stage["secrets"](spark, once, sf_dir)
    before, after = ({r["doc_id"]: r for r in x.collect()} for x in (once, clean))
    assert set(before) == set(after) and clean.columns == docs.columns
    for i, r in after.items():
        assert (r["text"] == before[i]["text"]) == (not spans_by_hand(before[i]["text"])) and r["n_chars"] == len(r["text"])
    mixed = stage["mix"](spark, clean, sf_dir)
    taken = Counter()
    for r in mixing.mix_sources(mixing.documents_to_mix(clean)).collect():
        taken[r["doc_id"]] += r["taken"]
    got = Counter()
    for r in mixed.collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert got == +taken and mixed.columns == docs.columns
    packed = stage["pack"](spark, mixed, sf_dir).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in mixed.collect())


def test_odd_rows_pass_every_stage(spark, sf_dir):
    docs = data.frame(spark)
    for _, stage in P.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), stage(spark, docs, sf_dir).schema)
    assert docs.count() > 0


def test_labels_without_both_classes_drop_nothing(spark, tmp_path):
    docs = data.frame(spark)
    for name, labels in (("none", []), ("unusable", [(1, None), (None, 1)]), ("toxic", [(i, 1) for i in range(20)]), ("clean", [(i, 0) for i in range(20)])):
        spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        kept = P.drop_toxic(spark, docs, f"{tmp_path}/{name}")
        assert kept.columns == docs.columns and Counter(kept.collect()) == Counter(docs.collect())
