"""License scans: an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_or_shuffled

#: Words are runs of digits, letters a-z and characters beyond ASCII, after A-Z are lower-cased.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Least words of a block, step from one such block to the next, share of a template's words that a block must hold.
BLOCK, STEP, CONTAINMENT = 64, 32, 0.8

#: Phrases whose consecutive words count as places, and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Sentences of public licenses and of notices that name them, and their labels.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2.0"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache-2.0"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("under the terms of the gnu affero general public license as published by the free software foundation", "agpl"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa-4.0"),
    ("the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", "cc0-1.0"),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "bsl-1.0"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "zlib"),
)


@dataclass(frozen=True)
class Template:
    no: int
    label: str
    words: tuple[str, ...]  # distinct, in the global order once ordered() has run
    least: int  # words that a block must share with it
    length: int  # words with repeats

    @classmethod
    def of(cls, no: int, text: str, label: str, containment: float) -> Template:
        words = tuple(dict.fromkeys(text.split()))
        return cls(no, label, words, math.ceil(containment * len(words) - 1e-9), len(text.split()))

    def ordered(self, rank: dict[str, int]) -> Template:
        return Template(self.no, self.label, tuple(sorted(self.words, key=lambda w: (rank[w], w))), self.least, self.length)


def words_of(text: Column) -> Column:
    """Array of the words of a text; lower() also folds letters beyond ASCII, which are word characters either way."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD, " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def phrase_places(words: Column, phrase: str) -> Column:
    """Starts (from 0) of the places in words where the words of a phrase stand consecutively."""
    w = phrase.split()
    at = F.sequence(F.lit(0), F.size(words) - len(w))
    hit = lambda i: F.forall(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("x")) for k, x in enumerate(w)]), lambda p: F.get(words, i + p["k"]) == p["x"])
    every = F.forall(F.array(*[F.lit(x) for x in w]), lambda x: F.array_contains(words, x)) & (F.size(words) >= len(w))
    return F.when(every, F.filter(at, hit)).otherwise(F.array().cast("array<int>"))


def may_hold(held: Column, templates: list[Template]) -> Column:
    """Whether a column of a text's template words has enough of some template; no block has more than its text."""
    every = F.array(*[F.struct(F.array(*[F.lit(w) for w in t.words]).alias("w"), F.lit(t.least).alias("n")) for t in templates])
    return F.exists(every, lambda t: F.size(F.array_intersect(held, t["w"])) >= t["n"])


def block_size(templates: list[Template]) -> tuple[int, int]:
    """Words of a block and step to the next: as many words in a row as the longest template has lie in one block."""
    longest = max(t.length for t in templates)
    width = max(BLOCK, 2 * longest)
    return width, width - max(longest, STEP + 1) + 1


def template_hits(docs: DataFrame, templates: list[Template], vocabulary: list[str], key: str) -> DataFrame:
    """(key, label, share) of every text block of docs (key, text) that holds a template's words to its threshold.

    Blocks are the lines and the whole text irrespective of line breaks, what is longer cut as block_size() says.
    A block's words come in the global order, rarest first. A pair is a candidate if a word of the
    block's prefix equals one of the template's prefix (prefix filter), the block has words enough (length filter) and
    what follows both positions still suffices (positional filter); candidates are verified on the whole sets.
    """
    spark = docs.sparkSession
    least = min(t.least for t in templates)
    order = F.array(*[F.lit(w) for w in vocabulary])
    width, step = block_size(templates)
    lines = docs.select(key, F.explode(F.array_distinct(F.concat(F.array("text"), F.split("text", r"[\r\n]+")))).alias("line"))
    starts = lambda words: F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - width + step), F.lit(step))
    cut = lambda words: F.transform(starts(words), lambda at: F.array_intersect(order, F.slice(words, at, F.lit(width))))
    # the outer transform binds the words of a line, so that they are split once and not for every block
    blocks = lines.select(key, F.explode(F.get(F.transform(F.array(words_of(F.col("line"))), cut), F.lit(0))).alias("set"))
    sets = blocks.where(F.size("set") >= least).distinct()
    index = [(w, j, t.no, len(t.words), t.least, list(t.words), t.label) for t in templates for j, w in enumerate(t.words[: len(t.words) - t.least + 1])]
    right = spark.createDataFrame(index, "word string, j int, no int, size int, least int, template array<string>, label string")
    left = sets.select(key, "set", F.posexplode(F.slice("set", F.lit(1), F.size("set") - least + 1)).alias("i", "word"))
    n = F.size("set")
    pairs = left.join(F.broadcast(right), "word").where((n >= F.col("least")) & (F.col("i") <= n - F.col("least")) & (F.least(n - F.col("i"), F.col("size") - F.col("j")) >= F.col("least")))
    same = F.size(F.array_intersect("set", "template"))
    return pairs.where(same >= F.col("least")).select(key, "label", (same / F.col("size")).alias("share")).groupBy(key, "label").agg(F.max("share").alias("share"))


def scan_licenses(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, containment: float = CONTAINMENT, id_col: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """(id, n_words, base, base_labels, hits): places of each phrase (start, label) and template labels with their shares.

    Null texts are empty. A word's global rank is the number of documents with it, counted over all documents for
    the words of the templates (no other word can be shared). Equal rows share a verdict; each is returned.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    docs = docs.select(F.col(id_col), F.coalesce("text", F.lit("")).alias("text")).withColumn("_key", F.xxhash64(F.col(id_col), F.coalesce("text", F.lit(""))))
    own = [Template.of(i, t, label, containment) for i, (t, label) in enumerate(templates)]
    vocabulary = sorted({w for t in own for w in t.words})
    words = docs.select(id_col, "_key", words_of(F.col("text")).alias("words"))
    place = lambda p, label: F.transform(phrase_places(F.col("words"), p), lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))
    base = F.array_sort(F.concat(*[place(p, label) for p, label in phrases]))
    held = F.array_intersect(F.array(*[F.lit(w) for w in vocabulary]), F.col("words"))
    slim = scratch.table(words.select(id_col, "_key", F.size("words").cast("long").alias("n_words"), base.alias("base"), held.alias("held")), "words")
    # a row per template word at most
    counts = {r["word"]: r["n"] for r in slim.select(F.explode("held").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    ordered = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(ordered)}
    # texts without enough of any template's words are out before they are cut into blocks
    able = scratch.table(slim.where(may_hold(F.col("held"), own)).select("_key").distinct(), "able")
    some = docs.select("_key", "text").join(small_or_shuffled(able, 16), "_key", "left_semi")
    found = template_hits(some, [t.ordered(rank) for t in own], ordered, "_key")
    found = found.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("label", "share"))).alias("hits"))
    found = scratch.table(found.withColumnRenamed("_key", "_k"), "hits")
    none = F.array().cast("array<struct<label:string,share:double>>")
    return slim.drop("held").join(small_or_shuffled(found, 64 + 48 * len(templates)), F.col("_key") == F.col("_k"), "left").select(id_col, "n_words", "base", F.coalesce("hits", none).alias("hits"))


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    out = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.array_distinct(F.transform("base", lambda b: b["label"]))
    every = F.array_distinct(F.concat(base, F.transform("hits", lambda h: h["label"])))
    starts = F.transform("base", lambda b: b["start"].cast("long"))
    best = F.array_max(F.transform("hits", lambda h: h["share"]))
    return out.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )


def _oracle_sql() -> str:
    """The same rows by plain SQL: every block of every text against every template."""
    own = [Template.of(i, t, label, CONTAINMENT) for i, (t, label) in enumerate(TEMPLATES)]
    width, step = block_size(own)
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    place = lambda p, label: f"select doc_id, i - 1 as start, '{label}' as label from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from n where text like '%{p.split()[0]}%') where " + " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split()))
    word = "'" + NOT_WORD.replace("[", "[^") + "'"
    return f"""
with d as (select doc_id, lower(coalesce(text, '')) as text from documents),
n as (select doc_id, text, regexp_extract_all(text, {word}) as w from d),
b as ({' union all '.join(place(p, label) for p, label in PHRASES)}),
base as (select doc_id, count(*) as n_base, min(start) as first_word, max(start) as last_word, string_agg(distinct label, ',' order by label) as base_labels, list(distinct label) as own from b group by doc_id),
l as (select doc_id, w from n union all select doc_id, regexp_extract_all(unnest(regexp_split_to_array(text, '[\r\n]+')), {word}) as w from d),
t(words, least, size, label) as (values {', '.join(f"({listed(t.words)}, {t.least}, {len(t.words)}, '{t.label}')" for t in own)}),
k as (select distinct doc_id, list_sort(list_distinct(list_filter(w[i : i + {width - 1}], lambda x: list_contains({listed(sorted({w for t in own for w in t.words}))}, x)))) as words
  from (select doc_id, w, unnest(range(1, greatest(1, len(w) - {width - step}) + 1, {step})) as i from l)),
h as (select doc_id, label, max(len(list_intersect(k.words, t.words)) / t.size) as share from k join t on len(k.words) >= t.least and len(list_intersect(k.words, t.words)) >= t.least group by doc_id, label),
hits as (select doc_id, list(label) as found, max(share) as share from h group by doc_id)
select n.doc_id, cast(len(n.w) as bigint) as n_words, coalesce(n_base, 0) as n_base, cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word, coalesce(base_labels, '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(found, [])))), ','), '') as labels,
  case when n_base > 0 then 1.0 else coalesce(share, 0.0) end::double as score
from n left join base using (doc_id) left join hits using (doc_id)
"""


ORACLE_SQL = _oracle_sql()
