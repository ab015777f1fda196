"""Secret scans: trigram queries derived from each rule's pattern, postings intersected, candidates verified."""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_or_shuffled

#: What a query of a pattern without mandatory trigrams is.
EVERY: frozenset[frozenset[str]] = frozenset([frozenset()])
#: Exact strings that a part of a pattern may stand for, and clauses that a query may have, before it is coarsened.
MOST_STRINGS, MOST_CLAUSES = 64, 64


@dataclass(frozen=True)
class Rule:
    """A named pattern (syntax shared by Java and Python, no look-behind); spans whose group is shorter than least are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
#: Published shapes of other credentials.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]+", 0, 39),
)


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _both(a: frozenset, b: frozenset) -> frozenset:
    out = frozenset(x | y for x in a for y in b)
    out = frozenset(x for x in out if not any(y < x for y in out))
    return out if len(out) <= MOST_CLAUSES else min(a, b, key=len)


def _either(a: frozenset, b: frozenset) -> frozenset:
    out = a | b
    out = frozenset(x for x in out if not any(y < x for y in out))
    return out if len(out) <= MOST_CLAUSES else EVERY


def _clauses(strings: set[str]) -> frozenset:
    return frozenset(_grams(s) for s in strings) if strings and all(len(s) >= 3 for s in strings) else EVERY


def trigram_query(pattern: str) -> frozenset[frozenset[str]]:
    """Alternatives (OR) of trigram sets (AND) one of which the lower-cased text of every match must contain.

    Walks the parsed pattern left to right keeping the strings that the part just read can be exactly; where
    they stop being known (repeats, large classes) their trigrams are added to the query and reading starts anew.
    """

    def walk(seq) -> tuple[set[str] | None, frozenset]:
        exact, query = {""}, EVERY
        for i, (op, arg) in enumerate(seq):
            own, own_query = one(op, arg)
            if own is not None and len(exact) * len(own) <= MOST_STRINGS:
                exact = {a + b for a in exact for b in own}
                query = _both(query, own_query)
            else:
                query, exact = _both(_both(query, _clauses(exact)), own_query), None
                rest = walk(seq[i + 1 :])
                return None, _both(query, rest[1] if rest[0] is None else _both(rest[1], _clauses(rest[0])))
        return exact, query

    def one(op, arg) -> tuple[set[str] | None, frozenset]:
        if op is sre.LITERAL:
            return {chr(arg).lower()}, EVERY
        if op is sre.IN:
            chars: set[str] = set()
            for kind, x in arg:
                if kind is sre.LITERAL:
                    chars.add(chr(x).lower())
                elif kind is sre.RANGE and x[1] - x[0] < 8:
                    chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    return None, EVERY
            return (chars, EVERY) if len(chars) <= 8 else (None, EVERY)
        if op is sre.SUBPATTERN:
            return walk(list(arg[3]))
        if op is sre.BRANCH:
            parts = [walk(list(x)) for x in arg[1]]
            if all(x[0] is not None for x in parts) and sum(len(x[0]) for x in parts) <= MOST_STRINGS:
                query = parts[0][1]
                for x in parts[1:]:
                    query = _either(query, x[1])
                return set().union(*(x[0] for x in parts)), query
            query = None
            for own, q in parts:
                q = q if own is None else _both(q, _clauses(own))
                query = q if query is None else _either(query, q)
            return None, query
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, body = arg
            own, query = walk(list(body))
            if own is not None and high == 1 and low == 0:
                return own | {""}, EVERY
            if low == 0:
                return None, EVERY
            return None, query if own is None else _both(query, _clauses(own))
        if op is sre.AT:
            return {""}, EVERY
        return None, EVERY

    exact, query = walk(list(parser.parse(pattern)))
    return query if exact is None else _both(query, _clauses(exact))


def matches(text: Column, rule: Rule) -> Column:
    """Array of (start, end, kind) of a rule in text: leftmost non-overlapping matches, then the length test; code points."""
    found = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.length).alias("all"),
        F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length).alias("own"),
    )
    empty = F.array().cast("array<struct<start:int,end:int,kind:string,own:int>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(x["all"], F.lit(0))
        span = F.struct(begin.alias("start"), end.alias("end"), F.lit(rule.kind).alias("kind"), F.coalesce(x["own"], F.lit(-1)).alias("own"))
        return F.struct(end.alias("at"), F.when(span["own"] >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(found, start, step, lambda acc: acc["out"])
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, id_col: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """docs with spans: array of (start, end, kind) by start, then by the rules' order; null texts count as empty.

    Index: for each trigram that some rule needs, the posting list of the documents whose lower-cased text holds
    it, as a table (trigram, document). Each clause of a rule's query intersects its lists: its postings are
    counted per document and all must be there. Candidates are verified with the pattern on the whole text.
    Rules whose query has no mandatory trigram are matched in every text. A document here is its id together
    with a hash of its text, so repeated or null ids are told apart; equal rows share their postings and verdict.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.drop("spans")
    text = F.coalesce(F.col("text"), F.lit(""))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    clauses = [(k, i, sorted(c)) for k, q in queries.items() if q != EVERY for i, c in enumerate(sorted(q, key=sorted))]
    grams = sorted({g for _, _, c in clauses for g in c})
    key = F.xxhash64(F.col(id_col), text)
    every = F.array(*[F.struct(F.lit(i).cast("short").alias("no"), F.lit(g).alias("gram")) for i, g in enumerate(grams)])
    held = lambda low: F.transform(F.filter(every, lambda g: F.contains(low, g["gram"])), lambda g: g["no"])
    # the outer transform binds the lower-cased text, and the outer explode infers no filter that would repeat the search
    listed = F.explode_outer(F.get(F.transform(F.array(F.lower(text)), held), F.lit(0)))
    postings = scratch.table(docs.select(key.alias("_doc"), listed.alias("gram")).where("gram is not null"), "postings")
    need = spark.createDataFrame([(grams.index(g), j, len(c)) for j, (_, _, c) in enumerate(clauses) for g in c], "gram int, clause int, n int")
    kind_of = F.create_map(*[x for j, (k, _, _) in enumerate(clauses) for x in (F.lit(j), F.lit(k))])
    hits = postings.distinct().join(F.broadcast(need), "gram").groupBy("_doc", "clause").agg(F.count("*").alias("have"), F.min("n").alias("n"))
    found = scratch.table(hits.where("have = n").groupBy("_doc").agg(F.collect_set(kind_of[F.col("clause")]).alias("_kinds")), "candidates")
    scratch.drop(postings)
    rows = docs.withColumn("_key", key).join(small_or_shuffled(found, 64 + 32 * len(rules)), F.col("_key") == F.col("_doc"), "left").drop("_key", "_doc")
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    spans = []
    for n, r in enumerate(rules):
        test = F.array_contains(F.col("_kinds"), r.kind) if queries[r.kind] != EVERY else F.lit(True)
        hit = test & F.rlike(text, F.lit(_quick(r)))
        spans.append(F.when(hit, F.transform(matches(text, r), lambda s, n=n: F.struct(s["start"], F.lit(n).alias("no"), s["end"], s["kind"]))).otherwise(F.array().cast("array<struct<start:int,no:int,end:int,kind:string>>")))
    every = F.array_sort(F.concat(*spans))
    out = F.when(F.size(every) > 0, F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).otherwise(none)
    return rows.withColumn("spans", out).drop("_kinds")


def _quick(rule: Rule) -> str:
    """A cheaper pattern that is found wherever a match long enough exists: a run's length is put into its repeat."""
    m = re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)
    return f"{m[1]}{{{rule.least}}}" if m and rule.group == 0 else rule.pattern


def redact(scanned: DataFrame, mask: str = "[REDACTED]") -> DataFrame:
    """scanned with every span in text replaced by mask, overlapping spans by one; n_chars follows if it is there."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        piece = F.when(fresh, F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), piece.alias("out"))

    clean = F.aggregate("spans", zero, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    out = scanned.withColumn("text", F.when(F.size("spans") > 0, clean).otherwise(F.col("text")))
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast(out.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop("spans")


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scan_secrets(docs)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE_RULES]))
    return out.select("doc_id", *[count(r.kind) for r in BASE_RULES], F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def _spans_sql(no: int, r: Rule) -> str:
    p = r.pattern.replace("'", "''")
    return f"""
  select doc_id, {no} as no, '{r.kind}' as kind, gap, whole, own,
    list_transform(range(1, len(whole) + 1), lambda i: list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i-1], lambda x: length(x))), 0)) as starts, {r.least} as least
  from (select doc_id, string_split_regex(text, '{p}') as gap, regexp_extract_all(text, '{p}') as whole, regexp_extract_all(text, '{p}', {r.group}) as own from d where regexp_matches(text, '{p}'))"""


ORACLE_SQL = f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
f as ({' union all '.join(_spans_sql(i, r) for i, r in enumerate(BASE_RULES + MORE_RULES))}),
x as (select doc_id, no, kind, least, unnest(starts) as start, unnest(whole) as whole, unnest(own) as own from f),
s as (select doc_id, no, kind, start, concat(kind, ':', cast(start as bigint), ':', cast(start + length(whole) as bigint)) as span from x where length(own) >= least),
g as (
  select doc_id, count(*) filter (where kind = 'assign') as a, count(*) filter (where kind = 'access') as b, count(*) filter (where kind = 'hex') as c,
    string_agg(span, ',' order by start, no) filter (where no < {len(BASE_RULES)}) as base, string_agg(span, ',' order by start, no) as spans from s group by doc_id)
select d.doc_id, coalesce(a, 0) as n_assign, coalesce(b, 0) as n_access, coalesce(c, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g using (doc_id)
"""
