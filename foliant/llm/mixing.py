"""Mixing sources to target weights by hash-random keys, distributed prefix sums and exact cuts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small_or_shuffled, word_count

KEY_BITS = 60


def source_targets(stats: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """Targets of stats (source, source_size): adds weight and target.

    Sources in code point order, null last, take weights in turn and share the sum of all sizes; a target
    stops at cap times its source's size and the excess is reshared by weight. The fixed point of that
    is min(cap * size, level * weight) with one common level, found by one prefix sum over cap * size / weight.
    The table has a row per source (a configuration-sized table), so its windows are not partitioned.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    given = F.array(*[F.lit(float(w)) for w in weights])
    s = stats.withColumn("weight", F.element_at(given, (F.pmod(turn - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("ratio", F.lit(cap) * F.col("source_size") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    s = s.withColumn("full", F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("open", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.lit(cap) * F.col("full")) / F.col("open"))
    s = s.withColumn("level", F.coalesce(F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every), F.max("ratio").over(every)))
    return s.select("source", "source_size", "weight", F.least(F.lit(cap) * F.col("source_size"), F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target"))


def random_key(*columns: str, seed: int = 7):
    """A key that only depends on the named columns' values: the first 60 bits of an MD5."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 15), 16, 10).cast("long")


def mix_sources(df: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, scratch: Scratch | None = None) -> DataFrame:
    """Mix df (source, size, key and any other columns) to the targets of source_targets().

    Adds source_size, target and taken: within a source, rows lie in key order on a line that repeats, epoch
    after epoch, up to the budget (the rounded target); taken is what of the row's size lies before the cut.
    Taken sizes of a source add up to its budget exactly (0 where the source has no words).

    Keys are uniform, so their leading bits are equal ranges: about sqrt(rows) ranges per source are summed
    (map-side first), prefix sums over the range totals tell the range that holds the cut, and prefix sums over its rows the row. Other
    rows only compare themselves with their source's cut, so no column but source, size and key is shuffled, and no
    window holds more than about sqrt(rows) rows of any source, however much of the input one source has.
    Null sources are a source of their own. Null or negative sizes count as 0. Rows that tie in key are ordered
    by size; rows equal in both are interchangeable. Added columns take the place of input columns of the same name.
    """
    scratch = scratch or Scratch(df.sparkSession)
    df = df.drop("source_size", "target", "taken").withColumn("size", F.greatest(F.coalesce(F.col("size").cast("long"), F.lit(0)), F.lit(0)))
    cuts = _cuts(scratch.table(df.select("source", "size", "key"), "mix"), weights, cap, scratch)
    rows = df.join(small_or_shuffled(cuts, 128), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    place, cut = F.struct("key", "size"), F.struct(F.col("_key").alias("key"), F.col("_size").alias("size"))
    if cuts.where("_equal > 1").limit(1).count():  # only rows at a cut need an order among equal ones
        at = F.coalesce(place == cut, F.lit(False))
        turn = F.row_number().over(Window.partitionBy("source").orderBy("key", "size"))
        rows = rows.where(~at).withColumn("_turn", F.lit(1)).unionByName(rows.where(at).withColumn("_turn", turn))
    else:
        rows = rows.withColumn("_turn", F.lit(1))
    rest = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("_rest") - (F.col("_turn") - 1) * F.col("size")))
    last = F.when(place < cut, F.col("size")).when(place == cut, rest).otherwise(0)
    return rows.withColumn("taken", (F.col("_epochs") * F.col("size") + last).cast("long")).drop("_epochs", "_key", "_size", "_rest", "_equal", "_turn")


def _cuts(slim: DataFrame, weights: Sequence[float], cap: float, scratch: Scratch) -> DataFrame:
    """A row per source (_s) of slim (source, size, key): source_size, target, whole epochs, and the key and size at which the epoch after
    them is cut, how many rows have both, and what is left for them. Sources without words have no cut."""
    bits = max(1, slim.count().bit_length() // 2)
    span = F.shiftright(F.col("key"), KEY_BITS - bits)
    spans = scratch.table(slim.groupBy("source", span.alias("_span")).agg(F.sum("size").alias("_n")), "spans")
    stats = source_targets(spans.groupBy("source").agg(F.sum("_n").alias("source_size")), weights, cap)
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    stats = stats.withColumn("_epochs", epochs).withColumn("_left", (budget - epochs * F.col("source_size")).cast("long"))
    stats = scratch.table(stats.select(F.col("source").alias("_s"), "source_size", "target", "_epochs", "_left"), "targets")
    own = F.col("source").eqNullSafe(F.col("_s"))
    before = F.sum("_n").over(Window.partitionBy("source").orderBy("_span")) - F.col("_n")
    held = spans.withColumn("_before", before).join(small_or_shuffled(stats, 64), own).where("_before <= _left and _left < _before + _n")
    held = scratch.table(held.select("_s", F.col("_span").alias("_k"), (F.col("_left") - F.col("_before")).alias("_left")), "cut-spans")
    rows = slim.withColumn("_span", span).join(small_or_shuffled(held, 64), own & (F.col("_span") == F.col("_k")))
    rows = rows.groupBy("_s", "_left", "key", "size").agg(F.count("*").alias("_equal"))
    total = F.col("size") * F.col("_equal")
    rows = rows.withColumn("_rest", F.col("_left") - (F.sum(total).over(Window.partitionBy("_s").orderBy("key", "size")) - total))
    cut = rows.where((F.col("_rest") >= 0) & (F.col("_rest") < total)).select(F.col("_s").alias("_t"), F.col("key").alias("_key"), F.col("size").alias("_size"), "_rest", "_equal")
    return scratch.table(stats.join(cut, F.col("_s").eqNullSafe(F.col("_t")), "left").drop("_t", "_left"), "cuts")


def documents_to_mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """docs with size (words of the whole text, null: 0) and key."""
    return docs.withColumn("size", word_count(F.col("text"))).withColumn("key", random_key("doc_id", "text", seed=seed))


def apply_mix(mixed: DataFrame) -> DataFrame:
    """Rows of mixed as often as it takes them: whole epochs, then the words before the cut; untaken rows go."""
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    rest = (F.col("taken") - F.col("size") * whole).cast("int")
    copies = F.filter(F.flatten(F.array(F.array_repeat(F.lit(-1), whole), F.array(rest))), lambda x: x != 0)
    out = mixed.withColumn("_part", F.explode(copies))
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"), F.lit(0))
    out = out.withColumn("text", F.when(F.col("_part") < 0, F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.greatest(F.col("_part"), F.lit(1))), "")))
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.when(F.col("_part") < 0, F.col("n_chars")).otherwise(F.length("text").cast(out.schema["n_chars"].dataType)))
    return out.drop("_part")


def op1_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    rows = scratch.table(documents_to_mix(docs).select("doc_id", "source", "size", "key"), "sizes")
    return mix_sources(rows, scratch=scratch).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
with d as (
  select doc_id, source, cast(length(regexp_replace(regexp_replace(coalesce(text, ''), '^[\x20\x09-\x0D]+', ''), '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*', 'x', 'g')) as bigint) as size,
    cast(concat('0x', substr(md5(concat('7:', coalesce(cast(doc_id as varchar), ''), ':', coalesce(text, ''))), 1, 15)) as bigint) as key
  from documents),
s as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as turn from d group by source),
w as (select *, case (turn - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight from s),
r as (select *, 3.0::double * source_size / weight as ratio from w),
l as (
  select *, (sum(source_size) over () - 3.0::double * coalesce(sum(source_size) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following) as level from r),
m as (select max(level) as level from l where level <= ratio),
t as (select source, source_size, least(3.0::double * source_size, coalesce(m.level, 0) * weight) as target from l, m),
p as (
  select d.doc_id, d.size, t.source_size, t.target, cast(floor(t.target + 0.5) as bigint) as budget,
    sum(d.size) over (partition by d.source order by d.key, d.size rows between unbounded preceding and current row) - d.size as start
  from d join t on d.source is not distinct from t.source),
q as (select *, case when source_size > 0 then budget // source_size else 0 end as epochs from p)
select doc_id, size, source_size, target,
  cast(epochs * size + greatest(0, least(size, budget - epochs * source_size - start)) as bigint) as taken
from q
"""
