"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import views as V
from . import sqltext as S
from .registry import query


@query("q02_normalize_tokens", f"""
select doc_id, md5({S.norm('text')}) as norm, cast(len({S.words('text')}) as bigint) as n_tokens,
  case when len({S.words('text')}) = 0 then 0.0::double else 1.0 - len(list_distinct({S.words('text')}))::double / len({S.words('text')}) end as duplicate_ratio
from documents""")
def normalize_tokens(spark, d):
    x = V.table(spark, d, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("n")).withColumn("t", T.split_words(F.col("n")))
    return x.select("doc_id", F.md5("n").alias("norm"), F.size("t").cast("long").alias("n_tokens"), T.duplicate_ratio(F.col("t")).alias("duplicate_ratio"))


@query("q03_merge_distinct_tokens", rf"""
with t as (select doc_id, pos, w from (select doc_id, {S.words('text')} as ws from documents) a, unnest(ws) with ordinality as u(w, pos)),
f as (select doc_id, w, min(pos) as pos from t group by doc_id, w)
select d.doc_id, coalesce(md5(m), md5('')) as merged from documents d left join (select doc_id, string_agg(w, ' ' order by pos) as m from f group by doc_id) g using (doc_id)""")
def merge_distinct(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.md5(T.merge_tokens(F.array(F.coalesce("text", F.lit(""))))).alias("merged"))


@query("q04_exact_match", f"""
with {S.PREDS} select conv_id, turn, route, case when {S.answer('pred')} in ({S.answer('gold1')}, {S.answer('gold2')}) then 1.0 else 0.0 end::double as em from preds""")
def exact_match(spark, d):
    return V.predictions(spark, d).select("conv_id", "turn", "route", T.exact_match(F.col("pred"), F.array("gold1", "gold2")).alias("em"))


@query("q05_anls", f"""
with {S.PREDS} select conv_id, turn, route, greatest({S.anls('pred', 'gold1')}, {S.anls('pred', 'gold2')}) as anls from preds""")
def anls(spark, d):
    return V.predictions(spark, d).select("conv_id", "turn", "route", T.anls(F.col("pred"), F.array("gold1", "gold2")).alias("anls"))


@query("q06_cer", f"""
with {S.PREDS} select conv_id, turn, route,
  case when {S.norm('gold1')} = '' then case when {S.norm('pred')} = '' then 0.0 else 1.0 end else {S.edits(S.norm('pred'), S.norm('gold1'))}::double / length({S.norm('gold1')}) end as cer
from preds""")
def cer(spark, d):
    return V.predictions(spark, d).select("conv_id", "turn", "route", T.cer(F.col("pred"), F.col("gold1")).alias("cer"))


@query("q07_word_prf", f"""
with {S.PREDS},
t as (select conv_id, turn, route, {S.words('pred')} as p, {S.words('gold1')} as g from preds),
m as (select *, list_sum(list_transform(list_distinct(g), lambda w: least(len(list_filter(p, lambda x: x = w)), len(list_filter(g, lambda x: x = w)))))::double as hit from t),
r as (select *, case when len(g) = 0 then (len(p) = 0)::int::double else coalesce(hit, 0) / len(g) end as word_recall, case when len(p) = 0 then (len(g) = 0)::int::double else coalesce(hit, 0) / len(p) end as word_precision from m)
select conv_id, turn, route, word_recall, word_precision, case when word_precision + word_recall = 0 then 0.0 else 2 * word_precision * word_recall / (word_precision + word_recall) end as word_f1 from r""")
def word_prf(spark, d):
    x = V.predictions(spark, d).withColumn("word_recall", T.word_recall(F.col("pred"), F.col("gold1"))).withColumn("word_precision", T.word_precision(F.col("pred"), F.col("gold1")))
    return x.select("conv_id", "turn", "route", "word_recall", "word_precision", T.f1(F.col("word_precision"), F.col("word_recall")).alias("word_f1"))


_BOX_TEXT = f"""{S.BOXES},
page as (select image_id, string_agg(text, ' ' order by box_id) as text from boxes group by image_id),
q as (select o_orderkey as image_id, concat('What is the total of the ', p_name, ' in ', o_orderpriority, '?') as question from orders join part on p_partkey = o_orderkey % 64 + 1),
t as (select image_id, {S.content('question')} as q, {S.words('text')} as d, {S.norm('text')} as n from page join q using (image_id))"""


def _page_questions(spark, d):
    parts = V.boxes(spark, d).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("box_id", "text"))).alias("b"))
    return parts.select("image_id", F.array_join(F.col("b.text"), " ").alias("text")).join(V.box_questions(spark, d), "image_id")


@query("q08_bm25_degenerate", f"""
with {_BOX_TEXT}
select image_id, round(case when len(q) = 0 or len(d) = 0 then 0.0 else coalesce(list_sum(list_transform(q, lambda w: len(list_filter(d, lambda x: x = w)) * 2.5 / (len(list_filter(d, lambda x: x = w)) + 1.5))), 0) / len(q) end::double, 9) as bm25 from t""")
def bm25(spark, d):
    return _page_questions(spark, d).select("image_id", F.round(T.bm25_degenerate(F.col("question"), F.col("text")), 9).alias("bm25"))


@query("q09_overlap", f"""
with {_BOX_TEXT}
select image_id, case when len(q) = 0 or len(d) = 0 then 0.0 else len(list_filter(q, lambda w: list_contains(d, w)))::double / len(q) end as token_share,
  case when len(q) = 0 then 0.0 else len(list_filter(q, lambda w: contains(n, w)))::double / len(q) end as substring_share from t""")
def overlap(spark, d):
    x = _page_questions(spark, d)
    return x.select("image_id", T.token_overlap(F.col("question"), F.col("text")).alias("token_share"), T.substring_overlap(F.col("question"), F.col("text")).alias("substring_share"))


def _any(x: str, ws) -> str:
    return "(" + " or ".join(f"contains({x}, '{w}')" for w in ws) + ")"


_QTYPE = "case " + " ".join(f"when {_any('lq', ws)} then '{k}'" for k, ws in T.QUESTION_TYPES.items()) + " when starts_with(lq, 'what is the') or starts_with(lq, 'what are') then 'value' else 'phrase' end"


@query("q10_answer_type", rf"""
with q as (select d.doc_id, lower(b.text) as lq, lower(coalesce(d.text, '')) as lt from documents d join benchmark b on b.item_id = d.doc_id % (select max(item_id) + 1 from benchmark))
select doc_id, case when {_any('lq', ('date', 'when', 'year', 'month', 'day'))} then regexp_matches(lt, '{T.DATE_PATTERN}')
  when {_any('lq', ('amount', 'price', 'cost', 'total', 'fee'))} then regexp_matches(lt, '{T.CURRENCY_PATTERN}')
  when {_any('lq', ('percent', '%'))} then regexp_matches(lt, '{T.PERCENT_PATTERN}') when contains(lq, 'email') then regexp_matches(lt, '{T.EMAIL_PATTERN}')
  when {_any('lq', ('yes', 'no'))} then {_any('lt', ('yes', 'no'))} else false end::int::double as score from q""")
def answer_type(spark, d):
    b = V.table(spark, d, "benchmark").select(F.col("item_id").alias("k"), F.col("text").alias("question"))
    n = b.agg((F.max("k") + 1).alias("n"))
    x = V.table(spark, d, "documents").join(F.broadcast(n)).join(b, F.col("doc_id") % F.col("n") == F.col("k"))
    return x.select("doc_id", T.answer_type_score(F.col("question"), F.col("text")).alias("score"))


@query("q11_question_type", f"with q as (select doc_id, lower(coalesce(text, '')) as lq from documents) select doc_id, {_QTYPE} as qtype from q")
def question_type(spark, d):
    return V.table(spark, d, "documents").select("doc_id", T.question_type(F.col("text")).alias("qtype"))


PTYPE = rf"""case when len(list_filter(string_split({S.answer('pred')}, ' '), lambda w: w <> '')) = 0 then 'empty'
  when regexp_matches(pred, '{T.PREDICTION_PERCENT}') then 'percent' when regexp_matches(pred, '{T.PREDICTION_AMOUNT}') then 'amount' when regexp_matches(pred, '{T.PREDICTION_DATE}') then 'date'
  when regexp_matches(pred, '\d') and len(list_filter(string_split({S.answer('pred')}, ' '), lambda w: w <> '')) <= 3 then 'numeric'
  when (regexp_matches(pred, '\b([Mm]r|[Mm]rs|[Mm]s|[Dd]r|[Pp]rof)\.?\b|[A-Z][a-z]+\s+[A-Z][a-z]+') or (len(list_filter(string_split({S.answer('pred')}, ' '), lambda w: w <> '')) <= 4 and not regexp_matches(pred, '\d'))) and regexp_matches(pred, '(^|\s)[A-Z]') then 'person'
  else 'phrase' end"""


@query("q12_pred_type", f"with {S.PREDS} select conv_id, turn, route, {PTYPE} as ptype from preds")
def pred_type(spark, d):
    return V.predictions(spark, d).select("conv_id", "turn", "route", T.prediction_type(F.col("pred")).alias("ptype"))


_TRIM = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


@query("q13_parse_answer", rf"""
with {S.PREDS},
a as (select conv_id, turn, route, concat('user x', chr(10), 'assistant ', case pos when 0 then 'Answer: ' when 1 then 'The answer is: ' else '"' end, pred, case pos when 2 then '"' else '.' end, chr(10), 'because') as raw from preds),
b as (select *, {_TRIM("list_last(string_split_regex(raw, '(?i)\\bassistant\\b'))".replace(chr(92) * 2, chr(92)))} as x from a),
c as (select *, case when contains(x, 'Answer:') then {_TRIM("substr(x, instr(x, 'Answer:') + 7)")} else x end as y from b),
e as (select *, case when contains(y, 'answer:') then {_TRIM("substr(y, instr(y, 'answer:') + 7)")} else y end as y1 from c),
f as (select *, {_TRIM("string_split(y1, chr(10))[1]")} as z from e),
g as (select *, {_TRIM(r"regexp_replace(z, '^(?i)the answer is[:\s]*', '')")} as z1 from f),
h as (select *, {_TRIM(r"regexp_replace(z1, '^(?i)answer[:\s]*', '')")} as z2 from g),
i as (select *, {_TRIM(r"regexp_replace(z2, '^(?i)response[:\s]*', '')")} as z3 from h),
j as (select *, {_TRIM(r"regexp_replace(z3, '^(?i)final answer[:\s]*', '')")} as z4 from i),
k as (select *, case when length(z4) >= 2 and z4[1] = z4[-1] and z4[1] in ('"', '''') then {_TRIM("substr(z4, 2, length(z4) - 2)")} else z4 end as z5 from j)
select conv_id, turn, route, {_TRIM(rf"regexp_replace({_TRIM(r"regexp_replace(z5, '[.,;:!?]+$', '')")}, '\s+', ' ', 'g')")} as parsed from k""")
def parse_answer(spark, d):
    lead = F.when(F.col("pos") == 0, "Answer: ").when(F.col("pos") == 1, "The answer is: ").otherwise('"')
    raw = F.concat(F.lit("user x\nassistant "), lead, F.col("pred"), F.when(F.col("pos") == 2, '"').otherwise("."), F.lit("\nbecause"))
    return V.predictions(spark, d).select("conv_id", "turn", "route", T.parse_answer(raw).alias("parsed"))


_TRI = lambda x: f"list_distinct(list_transform(range(1, greatest(1, length({x}) - 2) + 1), lambda i: substr({x}, i, 3)))"


@query("q14_trigram_jaccard", f"""
with n as (select distinct p_name as name from part), t as (select name, {_TRI('name')} as g from n)
select a.name as a, b.name as b, len(list_intersect(a.g, b.g))::double / len(list_distinct(list_concat(a.g, b.g))) as jaccard
from t a join t b on string_split(a.name, ' ')[2] = string_split(b.name, ' ')[2] and a.name < b.name""")
def trigram_jaccard(spark, d):
    n = V.table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    n = n.select("name", F.element_at(F.split("name", " "), 2).alias("noun"), T.trigrams(F.col("name")).alias("g"))
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, (F.col("a.noun") == F.col("b.noun")) & (F.col("a.name") < F.col("b.name"))).select(F.col("a.name").alias("a"), F.col("b.name").alias("b"), T.jaccard(F.col("a.g"), F.col("b.g")).alias("jaccard"))


_CODES = lambda ws: f"array_to_string(list_transform({ws}, lambda w: chr(cast(32 + list_position(v, w) as integer))), '')"


@query("q13b_wer", f"""
with {S.PREDS}, t as (select conv_id, turn, route, {S.words('pred')} as p, {S.words('gold1')} as g from preds), v as (select *, list_distinct(list_concat(g, p)) as v from t)
select conv_id, turn, route, case when len(g) = 0 then case when len(p) = 0 then 0.0 else 1.0 end else levenshtein({_CODES('p')}, {_CODES('g')})::double / len(g) end::double as wer from v""")
def wer(spark, d):
    """Predictions and references have fewer than 94 distinct words together, which the SQL writes as ASCII characters."""
    return V.predictions(spark, d).select("conv_id", "turn", "route", T.wer(F.col("pred"), F.col("gold1")).alias("wer"))


@query("q15_containment_join", f"""
with b as (select item_id, {S.match('text')} as needle from benchmark), d as (select doc_id, {S.match('text')} as hay from documents)
select doc_id, item_id from d join b on needle <> '' and contains(hay, needle)""")
def containment_join(spark, d):
    """Both sides meet by shingles of inner words or by first characters."""
    from ..operators.joins import containment

    return containment(V.table(spark, d, "documents").select("doc_id", "text"), V.table(spark, d, "benchmark").select("item_id", F.col("text").alias("needle")))
