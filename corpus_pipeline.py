"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Every stage sees all rows that its predecessor kept and, but for the last, returns the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import mixing, packing, secret_scan, simhash, toxicity
from foliant.llm.common import Scratch

#: Score from which a document goes.
TOXIC = 0.3
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def same_columns(stage: Callable) -> Callable:
    """A stage that returns the columns of docs, those beyond OWN untouched whatever their names are."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        held = {c: c if c in OWN else f"_extra{i}_" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.select(*[F.col(f"`{c}`").alias(h) for c, h in held.items()]), sf_dir)
        return out.select(*[F.col(h).alias(c) for c, h in held.items()])

    return run


@same_columns
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs scored below TOXIC by a classifier fitted on the labels table (without the ids that are held out).

    Labels without both classes say nothing about a text; then every document stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out()).select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model).where(F.col("score") < TOXIC).select(*docs.columns) if model.fitted else docs


@same_columns
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash links: the one with the smallest doc_id."""
    return simhash.keep_one(docs)


@same_columns
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with every secret in text replaced by a mask; no document goes."""
    return secret_scan.redact(secret_scan.scan_secrets(docs)).select(*docs.columns)


@same_columns
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as often as the mix of their sources takes them; one document per source may be cut at a word."""
    return mixing.apply_mix(mixing.mix_sources(mixing.documents_to_mix(docs))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of docs with its place in a sequence."""
    return packing.pack(packing.pieces(docs, packing.tokenizer_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("secrets", redact_secrets),
    ("mix", mix),
    ("pack", pack),
]
#: SQL can express neither the classifier nor the packing; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages."""
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
