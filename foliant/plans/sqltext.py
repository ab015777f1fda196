"""Fragments of the checking SQL (DuckDB): normalisers and the views that stand in for pages, questions and readers."""

from __future__ import annotations

PUNCT = r"[!-/:-@\[-`{-~]"


def norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '{PUNCT}', '', 'g'), '\s+', ' ', 'g'))"


def answer(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '^\s+|\s+$', '', 'g'), '{PUNCT}', '', 'g'), '\s+', ' ', 'g')"


def match(x: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({x}, '')), '\s+', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split({norm(x)}, ' '), lambda t: t <> '')"


STOP = "['a','an','and','are','as','at','be','by','did','do','does','for','from','had','has','have','how','in','is','it','its','of','on','or','that','the','this','to','was','were','what','when','where','which','who','why','with']"


def content(x: str) -> str:
    return f"list_filter({words(x)}, lambda t: length(t) > 1 and not list_contains({STOP}, t))"


def edits(p: str, g: str) -> str:
    """Edit distance by code points: levenshtein() counts bytes, so the letters beyond ASCII of the lower-cased tables become capitals first."""
    one = lambda x: f"translate({x}, 'ßäçèéêíñóöü', 'ABCDEFGHIJK')"
    return f"levenshtein({one(p)}, {one(g)})"


def anls(p: str, g: str) -> str:
    p, g = answer(p), answer(g)
    share = f"({edits(p, g)}::double / greatest(length({p}), length({g})))"
    return f"(case when {p} = '' and {g} = '' then 1.0 when {p} = '' or {g} = '' then 0.0 when {share} < 0.5 then 1.0 - {share} else 0.0 end)::double"


BOXES = """boxes as (
  select l_orderkey as image_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 as box_id,
    (l_partkey * 37) % 900 as x0, (l_suppkey * 53) % 1200 as y0, cast(40 + 4 * l_quantity as bigint) as w, cast(12 + 4 * l_linenumber as bigint) as h,
    round(1 - l_discount, 4) as confidence, p_name as text
  from lineitem join part on p_partkey = l_partkey)"""

QA = r"""qa0 as (
  select u.conv_id, u.turn, u.text as question, a.text as page, list_filter(string_split(regexp_replace(a.text, '\s+', ' ', 'g'), ' '), lambda t: t <> '') as ws
  from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1
  where u.role = 'user' and a.role = 'assistant'),
qa as (
  select conv_id, turn, question, page, array_to_string(ws[1:8], ' ') as gold1, array_to_string(ws[1:5], ' ') as gold2,
    case when conv_id % 3 = 0 then concat(array_to_string(ws[1:5], ' '), ' extra') else array_to_string(ws[1:5], ' ') end as resize,
    case when conv_id % 7 = 0 then '' else array_to_string(ws[1:8], ' ') end as bm25,
    case when conv_id % 2 = 0 then array_to_string(ws[1:3], ' ') when conv_id % 5 = 0 then 'unknown 42' else array_to_string(ws[2:6], ' ') end as learned
  from qa0)"""

PREDS = QA + """,
preds as (
  select conv_id, turn, question, page, gold1, gold2, 0 as pos, 'resize' as route, resize as pred from qa
  union all select conv_id, turn, question, page, gold1, gold2, 1, 'bm25', bm25 from qa
  union all select conv_id, turn, question, page, gold1, gold2, 2, 'learned', learned from qa)"""

RUNS = """runs as (
  select event_type as method, user_id as image_id, event_id as row_no, value, cast(json_extract_string(props, '$.k') as bigint) as budget from events)"""

PATCHES = """patches as (
  select p.image_id, row_number() over (partition by p.image_id order by y, x) - 1 as idx, x, y, least(384, 1000 - x) as w, least(384, 1300 - y) as h
  from (select distinct l_orderkey as image_id from lineitem) p,
    (select unnest(range(0, 1300, 256)) as y) ys, (select unnest(range(0, 1000, 256)) as x) xs)"""
