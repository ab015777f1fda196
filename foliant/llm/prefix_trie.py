"""The prefix trie of conversations: digest-keyed nodes, and sums over subtrees by pointer jumping."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Turns whose digests one task chains in a row, conversations that share a head, most turns of a head + 1, ids in a chunk.
CHAIN, FAMILY, HEADS, CHUNK = 1024, 100, 6, 512


def positions(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """Turns (conv_id, turn, role, text, ...) with pos, counted from 0 in each conversation by turn (null first), role, text.

    All turns are sorted by ranges, so a conversation or a run of equal turns of any length is dealt over tasks; a turn's
    place is its place in its range plus the conversation's turns in earlier ranges.
    """
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = scratch.table(turns.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order, "_tie").withColumn("_range", F.spark_partition_id()), "turns")
    before = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("conv_id", "_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("conv_id", "_range").orderBy(*order[1:], "_tie")) - 1
    return dealt.withColumn("_place", place).join(counts.drop("_n"), ["conv_id", "_range"]).withColumn("pos", F.col("_place") + F.col("_before")).drop("_place", "_before", "_range", "_tie")


def head_turns(conv_id):
    """Turns that a conversation takes from the head of its family: unsigned crc32 of its decimal id, modulo HEADS."""
    return F.pmod(F.crc32(conv_id.cast("string")), F.lit(HEADS))


def rebuilt(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id), and turns as rebuilt they hold them: conv_id, pos (from 0), digest (SHA-256 of role and text), chars.

    Texts are left behind here: whatever follows moves digests. The first turns of a family's first conversation go to at most
    FAMILY conversations each.
    """
    text = F.concat(F.lit("t"), F.length("role").cast("string"), F.lit(":"), "role", "text")
    own = positions(turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv_id is not null"), scratch)
    own = scratch.table(own.select("conv_id", "pos", F.unhex(F.sha2(text, 256)).alias("digest"), F.length("text").cast("long").alias("chars")), "own")
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    convs = own.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", head_turns(F.col("conv_id"))).withColumn("_family", family)
    heads = own.where((F.col("conv_id") == family) & (F.col("pos") < HEADS - 1)).select(F.col("conv_id").alias("_family"), "pos", "digest", "chars")
    held = heads.groupBy("_family").agg(F.count("*").alias("_held"))
    convs = scratch.table(convs.join(held, "_family", "left").withColumn("_held", F.least("h", F.coalesce("_held", F.lit(0)))), "conversations")
    first = convs.join(heads, "_family").where("pos < h").select("conv_id", "pos", "digest", "chars")
    rest = own.join(convs.select("conv_id", "h", "_held"), "conv_id").where("pos >= h").select("conv_id", (F.col("_held") + F.col("pos") - F.col("h")).alias("pos"), "digest", "chars")
    return convs.select("conv_id"), scratch.table(first.unionByName(rest), "rebuilt")


def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, pos, digest) sorted by both: digest becomes the chained digest within a block of CHAIN positions, before the one ahead."""
    block, run = None, None
    for b in batches:
        digests, before = [], []
        for c, p, d in zip(b.column("conv_id").to_pylist(), b.column("pos").to_pylist(), b.column("digest").to_pylist(), strict=True):
            if block != (c, p // CHAIN):
                block, run = (c, p // CHAIN), None
            before.append(run)
            run = d if run is None else hashlib.sha256(run + d).digest()
            digests.append(run)
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("pos"), pa.array(digests, pa.binary()), pa.array(before, pa.binary())], ["conv_id", "pos", "digest", "before"])


def prefix_digests(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (conv_id, pos, digest) as conv_id, pos, digest of the sequence up to pos, before (that up to pos - 1; null at 0).

    Sequences have equal digests if and only if they are equal (up to SHA-256). Blocks of CHAIN positions are chained by
    themselves, so a conversation of any length is dealt over tasks; the blocks' last digests are the rows of a next, CHAIN times smaller level.
    """
    sorted_rows = rows.select("conv_id", "pos", "digest").withColumn("_block", F.expr(f"pos div {CHAIN}")).repartition("conv_id", "_block").sortWithinPartitions("conv_id", "pos")
    own = scratch.table(sorted_rows.select("conv_id", "pos", "digest").mapInArrow(chain, "conv_id long, pos long, digest binary, before binary"), "chains")
    if (own.agg(F.max("pos")).first()[0] or 0) < CHAIN:
        return own
    own = own.withColumn("_block", F.expr(f"pos div {CHAIN}"))
    last = own.where(F.col("pos") % CHAIN == CHAIN - 1).select("conv_id", F.col("_block").alias("pos"), "digest")
    ends = prefix_digests(last, scratch).select("conv_id", F.col("pos").alias("_block"), F.col("digest").alias("_end"))
    ahead = ends.select("conv_id", (F.col("_block") + 1).alias("_block"), F.col("_end").alias("_up"))
    joined = lambda d: F.unhex(F.sha2(F.concat("_up", d), 256))
    out = own.join(ahead, ["conv_id", "_block"], "left").join(ends, ["conv_id", "_block"], "left")
    digest = F.when(F.col("pos") % CHAIN == CHAIN - 1, F.col("_end")).when(F.col("_up").isNull(), F.col("digest")).otherwise(joined("digest"))
    before = F.when(F.col("_up").isNull(), F.col("before")).when(F.col("before").isNull(), F.col("_up")).otherwise(joined("before"))
    return scratch.table(out.select("conv_id", "pos", digest.alias("digest"), before.alias("before")), "digests")


def id_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, conv_id) sorted by both as (node, first, ids): up to CHUNK ids each as one comma-joined text."""
    node, ids = None, []

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["node", "first", "ids"])

    for b in batches:
        for k, c in zip(b.column("node").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
            if ids and (k != node or len(ids) == CHUNK):
                yield packed()
                ids = []
            node = k
            ids.append(c)
    if ids:
        yield packed()


def hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by node and first as (node, sha): the digest of all ids of a node, of which one chunk is held at a time."""
    node, run = None, None

    def ended() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([run.hexdigest()])], ["node", "sha"])

    for b in batches:
        for k, ids in zip(b.column("node").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if k == node:
                run.update(b"," + ids.encode())
            else:
                if run is not None:
                    yield ended()
                node, run = k, hashlib.sha256(ids.encode())
    if run is not None:
        yield ended()


def ends_digests(ends: DataFrame, scratch: Scratch) -> DataFrame:
    """ends (node, conv_id) as node, sha: SHA-256 of the node's ids in ascending order, comma-joined.

    A digest over a list is sequential by definition. Many tasks sort and pack the ids of a node into chunks; what one task
    streams for a node is chunks, a CHUNK-th of the rows, of which it holds a batch.
    """
    dealt = scratch.table(ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(id_chunks, "node binary, first long, ids string"), "chunks")
    return dealt.repartition("node").sortWithinPartitions("node", "first").select("node", "ids").mapInArrow(hash_chunks, "node binary, sha string")


def subtree_sums(nodes: DataFrame, values: list[str], root: Column, scratch: Scratch) -> DataFrame:
    """nodes (node, parent, values) as node, values: each value summed over the node's subtree, itself included; root is the node on top.

    Pointer jumping: after round k a node holds the sum over descendants less than 2^k below it and its ancestor 2^k above. A
    round adds to each node what the nodes 2^k below have summed (one aggregation by ancestor, partial on the map side) and doubles
    the jump (one join), so rounds grow with the logarithm of the depth.
    """
    t = scratch.table(nodes.select("node", F.col("parent").alias("jump"), *values), "jumps")
    while not t.where("jump is not null").isEmpty():
        below = t.where("jump is not null").groupBy(F.col("jump").alias("node")).agg(*[F.sum(v).alias(f"_{v}") for v in values])
        above = t.select(F.col("node").alias("jump"), F.col("jump").alias("_next"))
        # only rows that have not reached the root look up a further jump: neither it nor null gathers rows
        ended = F.col("jump").isNull() | (F.col("jump") == root)
        going = t.where(~ended).join(above, "jump", "left").drop("jump").withColumnRenamed("_next", "jump")
        both = going.unionByName(t.where(ended).withColumn("jump", F.lit(None).cast("binary"))).join(below, "node", "left")
        new = scratch.table(both.select("node", "jump", *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values]), "jumps")
        scratch.drop(t)
        t = new
    return t.drop("jump")


def prefix_trie(turns: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The trie of the rebuilt conversations of turns (conv_id, turn, role, text), a row per node; other columns are left out.

    Turns without a conv_id belong to no conversation and are left out. Null roles and texts are empty. Turns of equal number are
    ordered by role and text; repeated rows are turns of their own. An empty table has no node, not even a root. A
    conversation whose rebuilt form has no turn ends at the root. Nodes are keyed by the digest of their
    sequence; (conv_id, depth) names a node too, as conv_id is the smallest member.
    """
    scratch = scratch or Scratch(turns.sparkSession)
    convs, seq = rebuilt(turns, scratch)
    root = F.unhex(F.lit(""))
    digests = prefix_digests(seq, scratch)
    steps = digests.join(seq.select("conv_id", "pos", "chars"), ["conv_id", "pos"]).select("conv_id", (F.col("pos") + 1).alias("depth"), F.col("digest").alias("node"), F.coalesce("before", root).alias("parent"), "chars")
    steps = scratch.table(steps.unionByName(convs.select("conv_id", F.lit(0).cast("long").alias("depth"), root.alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("chars"))), "steps")
    lengths = steps.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    nodes = steps.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"))
    children = nodes.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children.where("node is not null"), "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = scratch.table(nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("chars")), "nodes")
    sums = subtree_sums(nodes, ["n_leaves", "saved_tokens"], root, scratch)
    ends = scratch.table(steps.join(lengths, ["conv_id", "depth"]).select("node", "conv_id"), "ends")
    by_node = ends.groupBy("node").agg(F.count("*").alias("_n"), F.min("conv_id").alias("_only"))
    several = ends.join(by_node.where("_n > 1").select("node"), "node", "left_semi")
    named = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.drop("n_leaves", "saved_tokens").join(sums, "node").join(by_node, "node", "left").join(ends_digests(several, scratch), "node", "left")
    out = out.where("parent is not null").join(named, "parent", "left").unionByName(out.where("parent is null"), allowMissingColumns=True)
    sha = F.coalesce("sha", F.sha2(F.coalesce(F.col("_only").cast("string"), F.lit("")), 256))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", sha.alias("ends_sha256"))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


ORACLE_SQL = """
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos
  from conversations where conv_id is not null),
c as (
  select conv_id, conv_id - conv_id % 100 as family, count(*) as n,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(conv_id as varchar), ''), lambda x: cast(ord(x) as bigint))),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda s, z: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295) % 6 as h
  from t group by conv_id),
seq as (
  select c.conv_id, t.pos, t.role, t.text from c join t on t.conv_id = c.family and t.pos < c.h
  union all
  select c.conv_id, least(c.h, coalesce(f.n, 0)) + t.pos - c.h, t.role, t.text
  from c join t on t.conv_id = c.conv_id and t.pos >= c.h left join c f on f.conv_id = c.family),
steps as (
  select conv_id, pos + 1 as depth, length(text) as chars, list((role, text)) over (partition by conv_id order by pos) as prefix from seq
  union all select conv_id, 0, 0, [] from c),
m as (
  select conv_id, depth, chars, min(conv_id) over (partition by depth, prefix) as node, max(depth) over (partition by conv_id) = depth as last from steps),
n as (
  select node, depth, count(*) as n_convs, (count(*) - 1) * max(chars) as own,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where last), '')) as ends_sha256
  from m group by node, depth),
p as (select n.*, m.node as parent from n left join m on m.conv_id = n.node and m.depth = n.depth - 1),
k as (select parent as node, depth - 1 as depth, count(*) as n_children from p where depth > 0 group by all),
q as (select p.*, coalesce(k.n_children, 0) as n_children from p left join k using (node, depth)),
s as (
  select m.node, m.depth, sum(q.own) as saved_tokens, count(*) filter (where q.n_children = 0) as n_leaves
  from q join m on m.conv_id = q.node and m.depth <= q.depth group by m.node, m.depth)
select q.node as conv_id, cast(q.depth as bigint) as depth, q.parent as parent_conv_id, q.n_convs, q.n_children, cast(s.n_leaves as bigint) as n_leaves,
  cast(s.saved_tokens as bigint) as saved_tokens, q.ends_sha256
from q join s using (node, depth)
"""
