"""Conversation prefix trie by whole-sequence collapse.

Identical rebuilt conversations are collapsed first into one weighted sequence with the list of the
conversations that end in it, so that a group of copies, whatever its size, costs one sequence from then on.
Sequences that are proper prefixes of others are dropped by an anti-join, which leaves the leaves. Every
distinct sequence then gives each of its prefixes its weight, and the prefixes are added up into nodes.

A prefix is named by its depth and by two 64-bit words, the XOR of hashes of (position, turn) over its turns:
XOR is associative, so a conversation of any length is hashed by range buckets with what the buckets before
leave, and no task holds it whole.

Defined results: rows without a conv_id are left out; null roles and texts are empty; turns are ordered by
turn (null first), then by an MD5 of role and text, so repeated rows are turns of their own in a fixed order;
an empty table has no nodes; other columns are never read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wearline.llm.common import WORD, arrow_schema, partitions, stage, to_batch
from wearline.operators.rank import BUCKET, KEY, add_order_buckets, global_row_number

#: conversations that share a beginning, and how many different lengths the shared part may have
GROUP, SHARES = 20, 4
#: bytes of an end list that travel as one row
PIECE = 1 << 16
NODE = ["depth", "p1", "p2"]


def turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, n, key, words)``: each conversation's turns numbered from 1; ``key`` stands for role and text."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")]
    key = F.md5(F.concat(F.octet_length(text[0]).cast("string"), F.lit(":"), *text).cast("binary"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(F.col("turn").isNotNull(), F.col("turn"), key.alias("key")).alias("at"),
        F.regexp_count(text[1], F.lit(WORD)).cast("bigint").alias("words"))
    numbered = global_row_number(rows, "at", by=["conv_id"], out="n")
    return numbered.select("conv_id", "n", F.col("at.key").alias("key"), "words")


def shared_turns() -> Column:
    """How many turns a conversation takes from its group's first one."""
    return F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARES


def rebuild(conversations: DataFrame) -> DataFrame:
    """``(conv_id, depth, key, words)``: every conversation's rebuilt turns, and a row of depth 0 for each."""
    own = stage(turns(conversations), "turns").withColumn("h", shared_turns()).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
    first = own.where(f"conv_id % {GROUP} = 0 and n < {SHARES}").select(F.col("conv_id").alias("base"), "n", "key", "words")
    roots = own.where("n = 1")
    taken = roots.select("conv_id", "h", "base").join(first, "base").where("n <= h").select("conv_id", F.col("n").alias("depth"), "key", "words")
    length = first.groupBy("base").agg(F.max("n").alias("have"))
    rest = own.where("n > h").join(length, "base", "left").select(
        "conv_id", (F.col("n") - F.col("h") + F.least("h", F.coalesce("have", F.lit(0)))).alias("depth"), "key", "words")
    top = roots.select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit("").alias("key"), F.lit(0).cast("bigint").alias("words"))
    return top.unionByName(taken).unionByName(rest)


#: an associative aggregate, and how two of its results become one
ADD = (F.sum, Column.__add__)
XOR = (F.bit_xor, Column.bitwiseXOR)


def running(rows: DataFrame, key: str, by: str, what: dict[str, tuple[Column, tuple]]) -> DataFrame:
    """Add ``{name: (column, ADD or XOR)}``, gathered over all rows of the group up to each row in ``key`` order; the
    range buckets that a group spans are joined by what the buckets before them gathered."""
    b = add_order_buckets(rows.withColumns({c: v for c, (v, _) in what.items()}), key, by=[by])
    group = Window.partitionBy(by)
    w = Window.partitionBy(by, BUCKET).orderBy(KEY).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = b.withColumns({c: gather(F.col(c)).over(w) for c, (_, (gather, _)) in what.items()})
    if not b.schema[BUCKET].nullable:  # all in one bucket
        return inside.drop(BUCKET, KEY)
    per = b.groupBy(by, BUCKET).agg(*[gather(F.col(c)).alias(c) for c, (_, (gather, _)) in what.items()])
    per = per.withColumn("_spans", F.count("*").over(group)).where("_spans > 1")  # at most two rows a bucket
    before = group.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select(F.col(by).alias("_by"), F.col(BUCKET).alias("_at"), *[gather(F.col(c)).over(before).alias(f"_c_{c}") for c, (_, (gather, _)) in what.items()])
    got = inside.join(F.broadcast(carried), (F.col(by) == F.col("_by")) & (F.col(BUCKET) == F.col("_at")), "left")
    both = {c: F.when(F.col(f"_c_{c}").isNull(), F.col(c)).otherwise(plus(F.col(c), F.col(f"_c_{c}"))) for c, (_, (_, plus)) in what.items()}
    return got.withColumns(both).drop(BUCKET, KEY, "_by", "_at", *[f"_c_{c}" for c in what])


def end_lists(ends: DataFrame, group: str = "rep", member: str = "conv_id") -> DataFrame:
    """``(group, ends_sha256)``: SHA-256 of a group's members, ascending and comma-joined. Range tasks join
    sorted members into pieces, one task streams a group's pieces through the digest: a piece is all it holds."""
    piece = arrow_schema(f"{group} bigint, first bigint, piece string")
    digest = arrow_schema(f"{group} bigint, ends_sha256 string")

    def join(batches):
        at, held, size = None, [], 0

        def row():
            return to_batch({group: [at], "first": [held[0]], "piece": [",".join(map(str, held))]}, piece)

        for batch in batches:
            for g, m in zip(batch.column(group).to_pylist(), batch.column(member).to_pylist(), strict=True):
                if held and (g != at or size >= PIECE):
                    yield row()
                    held, size = [], 0
                at = g
                held.append(m)
                size += 20
        if held:
            yield row()

    def digests(batches):
        at, state = None, None
        for batch in batches:
            done = []
            for g, p in zip(batch.column(group).to_pylist(), batch.column("piece").to_pylist(), strict=True):
                if g != at:
                    if state:
                        done.append((at, state.hexdigest()))
                    at, state = g, hashlib.sha256(p.encode())
                else:
                    state.update(b"," + p.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done]) for i in (0, 1)], schema=digest)
        if state:
            yield to_batch({group: [at], "ends_sha256": [state.hexdigest()]}, digest)

    sorted_ = ends.select(group, member).repartitionByRange(partitions(ends.sparkSession), group, member).sortWithinPartitions(group, member)
    pieces = sorted_.mapInArrow(join, f"{group} bigint, first bigint, piece string")
    dealt = pieces.repartition(partitions(ends.sparkSession), group).sortWithinPartitions(group, "first")
    return dealt.mapInArrow(digests, f"{group} bigint, ends_sha256 string")


def collapse(walks: DataFrame) -> DataFrame:
    """Whole sequences: ``(rep, depth, p1, p2, total, weight, ends_sha256)``, one row per distinct sequence, ``rep``
    its smallest conversation."""
    last = walks.groupBy("conv_id").agg(F.max("depth").alias("depth"), F.max_by(F.struct("p1", "p2", "upto"), "depth").alias("s"))
    last = stage(last.select("conv_id", "depth", "s.p1", "s.p2", F.col("s.upto").alias("total")), "ends")
    whole = stage(last.groupBy(*NODE).agg(F.min("conv_id").alias("rep"), F.count("*").alias("weight"), F.first("total").alias("total")), "sequences")
    members = last.join(whole.select(*NODE, "rep"), NODE).select("conv_id", "rep")
    return whole.join(end_lists(members), "rep")


def prefix_trie(rebuilt: DataFrame) -> DataFrame:
    """One row per node of the trie of ``(conv_id, depth, key, words)``: ``conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256``.

    What a subtree saves, the sum of (members - 1) * words over its nodes, is the words below the node summed over
    members, less each node's words once. The first part adds up by sequences. For the second every node belongs to the
    sequence of its smallest member; a sequence's nodes are the lower end of its path, so that part is one difference
    of running word counts a sequence.
    """
    inner = F.col("depth") > 0
    zero = F.lit(0).cast("bigint")
    hashes = {"f1": F.when(inner, F.xxhash64("depth", "key")).otherwise(zero), "f2": F.when(inner, F.xxhash64("key", F.lit(1), "depth")).otherwise(zero)}
    rows = rebuilt.withColumns(hashes).drop("key")
    walks = stage(running(rows, "depth", "conv_id", {"p1": (F.col("f1"), XOR), "p2": (F.col("f2"), XOR), "upto": (F.col("words"), ADD)}), "walks")
    whole = stage(collapse(walks), "collapsed")
    paths = walks.join(whole.select(F.col("rep").alias("conv_id"), F.col("depth").alias("length"), "total", "weight"), "conv_id")
    paths = stage(paths.select(F.col("conv_id").alias("rep"), *NODE, "f1", "f2", "words", (F.col("upto") - F.col("words")).alias("above"), "length", "total", "weight"), "paths")
    inside = paths.where("depth < length").select(*NODE).distinct()
    leaves = whole.join(inside, NODE, "left_anti").select("rep", F.lit(1).cast("bigint").alias("leaf"))
    nodes = stage(paths.join(leaves, "rep", "left").groupBy(*NODE).agg(
        F.sum("weight").alias("n_convs"), F.min("rep").alias("conv_id"), F.coalesce(F.sum("leaf"), zero).alias("n_leaves"), F.first("above").alias("above"),
        F.first("f1").alias("f1"), F.first("f2").alias("f2"), F.sum(F.col("weight") * (F.col("total") - F.col("above"))).alias("walked")), "nodes")
    owned = nodes.groupBy(F.col("conv_id").alias("rep")).agg(F.min("above").alias("own_above"))
    once = paths.join(owned, "rep").groupBy(*NODE).agg(F.sum(F.col("total") - F.greatest("above", "own_above")).alias("once"))
    parent = nodes.where(inner).select(F.col("depth") - 1, F.col("p1").bitwiseXOR(F.col("f1")), F.col("p2").bitwiseXOR(F.col("f2"))).toDF(*NODE)
    children = parent.groupBy(*NODE).agg(F.count("*").alias("n_children"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    ends = whole.select(*NODE, "ends_sha256")
    out = nodes.withColumns({"q1": F.col("p1").bitwiseXOR(F.col("f1")), "q2": F.col("p2").bitwiseXOR(F.col("f2"))})
    out = out.join(once, NODE, "left").join(children, NODE, "left").join(ends, NODE, "left").join(above, ["depth", "q1", "q2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves",
                      (F.col("walked") - F.coalesce("once", zero)).alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))

