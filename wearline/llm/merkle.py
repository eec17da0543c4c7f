"""Merkle dataset manifest as a postorder append log.

Every list of nodes (a source's documents, the sources) is cut into aligned blocks of ``WIDE`` = 3**9 consecutive
nodes. One builder takes a block, reads its leaves in order and appends digests to the block's log in the order in
which nodes are completed: a leaf when it arrives, a run's parent as soon as the run is full, the short runs at the end.
Where a node stands in that log has a closed form from the sizes of the subtrees before it (``place``), so a proof
needs no pointers: it reads its siblings at computed positions. The tops of the blocks are the leaves of the next
round's blocks, until each list has one node; every round divides the nodes by 19,683, so two or three rounds do.

Logs are staged tables with one row a block (at most 0.9 MB of digests); a task holds one block. Proofs go down the
same rounds: a block hands each of its children the siblings found in its log and its own path to the root.

Defined results: a null field is ``-`` in the leaf, a null text has nothing to delete; ties and repeated rows of an id are
ordered by leaf digest, null ids come first; a null source is a source of its own, first in order; an empty table has
no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import arrow_map, arrow_schema, stage, to_batch
from wearline.operators.rank import global_row_number

FAN, LEVELS = 3, 9
WIDE = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(c: Column) -> Column:
    """A field of a leaf: ``-`` if null, else its UTF-8 length, a colon and the value."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaves(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, leaf, seen)``: the leaf of every row, and that of the row as it is found after tampering."""
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = F.when(odd, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    head = [encoded(F.col(c)) for c in FIELDS[:-1]]

    def digest(text: Column) -> Column:
        return F.sha2(F.concat(*head, encoded(text)).cast("binary"), 256)

    rows = docs.select(*[F.col(c) for c in FIELDS]).withColumn("found", found)
    return rows.select("doc_id", "source", digest(F.col("text")).alias("leaf"),
                       F.when(F.col("text") == F.col("found"), F.lit(None)).when(F.col("text").isNotNull(), digest(F.col("found"))).alias("seen"))


def h(text: bytes) -> bytes:
    return hashlib.sha256(text).hexdigest().encode()


def height(n: int) -> int:
    """Levels above ``n`` nodes until one is left, a block's at most."""
    up = 0
    while n > 1:
        n, up = -(-n // FAN), up + 1
    return up


def place(level: int, index, n: int):
    """Position in the log of a block of ``n`` leaves of node ``index`` of ``level``.

    A full node follows its last leaf and the nodes that leaf completes below it; before that leaf stand the leaves
    and all subtrees that were full by then, i // 3 + i // 9 + ... of them. The short nodes, one a level at most,
    come after everything else, lowest first."""
    index = np.asarray(index, np.int64)
    last = (index + 1) * FAN**level - 1
    full = last + sum(last // FAN**m for m in range(1, LEVELS + 1)) + level
    lowest = next((m for m in range(1, LEVELS + 1) if n % FAN**m), LEVELS + 1)
    short = n + sum(n // FAN**m for m in range(1, LEVELS + 1)) + level - lowest
    return np.where(last < n, full, short)


def build(digests: list[bytes], up: int) -> list[bytes]:
    """The log of one block: its nodes in the order of completion, ``up`` levels above the leaves."""
    log: list[bytes] = []
    open_: list[list[bytes]] = [[] for _ in range(up + 1)]
    for d in digests:
        log.append(d)
        open_[0].append(d)
        level = 0
        while level < up and len(open_[level]) == FAN:
            log.append(h(b"".join(open_[level])))
            open_[level + 1].append(log[-1])
            open_[level], level = [], level + 1
    for level in range(up):
        if open_[level]:
            log.append(h(b"".join(open_[level])))
            open_[level + 1].append(log[-1])
    return log


def siblings(log: list[bytes], n: int, up: int) -> list[list[bytes]]:
    """Per leaf, level by level: where it stands in its run (one digit) and the other nodes' digests, left to right."""
    out: list[list[bytes]] = [[] for _ in range(n)]
    size = n
    for level in range(up):
        at = place(level, np.arange(size), n).tolist()
        step = []
        for i in range(size):
            first = i - i % FAN
            step.append(b"%d" % (i % FAN) + b"".join(log[at[k]] for k in range(first, min(first + FAN, size)) if k != i))
        for leaf in range(n):
            out[leaf].append(step[leaf // FAN**level])
        size = -(-size // FAN)
    return out


def fold(digest: bytes, path: list[bytes]) -> bytes:
    """The root that a digest and its siblings lead to."""
    for step in path:
        cut = 1 + 64 * int(step[:1])
        digest = h(step[1:cut] + digest + step[cut:])
    return digest


def blocks(nodes: DataFrame, label: str) -> DataFrame:
    """``(grp, block, up, log, ids, seen)`` of nodes ``(grp, idx, n, digest, id, seen)``: one builder a block."""
    schema = arrow_schema("grp string, block bigint, n bigint, up int, log binary, ids array<bigint>, seen array<string>")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        n = table.column("n")[0].as_py()
        up = min(LEVELS, height(n))
        log = build([d.encode() for d in table.column("digest").to_pylist()], up)
        row = to_batch({"grp": [key[0].as_py()], "block": [key[1].as_py()], "n": [n], "up": [up], "log": [bytes.fromhex(b"".join(log).decode())],
                        "ids": [table.column("id").to_pylist()], "seen": [table.column("seen").to_pylist()]}, schema)
        return pa.Table.from_batches([row])

    cut = nodes.withColumn("block", F.floor(F.col("idx") / WIDE).cast("bigint"))
    made = cut.groupBy("grp", "block").applyInArrow(run, "grp string, block bigint, n bigint, up int, log binary, ids array<bigint>, seen array<string>")
    return stage(made, f"log-{label}")


def rounds(nodes: DataFrame, label: str) -> list[DataFrame]:
    """The logs of all rounds, lowest first; the last has one block for every group."""
    out = [blocks(nodes, label)]
    while not out[-1].where(f"n > {WIDE}").isEmpty():
        below = out[-1].select("grp", F.col("block").alias("idx"), F.ceil(F.col("n") / WIDE).cast("bigint").alias("n"), top().alias("digest"),
                               F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("string").alias("seen"))
        out.append(blocks(below, f"{label}-{len(out)}"))
    return out


def top() -> Column:
    """A block's last digest, which is its highest node."""
    return F.lower(F.hex(F.substring("log", -32, 32)))


def hand_down(logs: DataFrame, paths: DataFrame | None) -> DataFrame:
    """``(grp, idx, path)`` for every child of the blocks; ``paths`` holds the blocks' own (none above the last round)."""
    held = _own(logs).withColumn("path", F.lit("")) if paths is None else _joined(logs, paths)

    def of(batch: pa.RecordBatch):
        for r in batch.to_pylist():
            yield {"grp": [r["grp"]] * r["n"], "idx": [r["block"] * WIDE + i for i in range(r["n"])], "path": [b",".join(p).decode() for p in block_paths(r)]}

    return arrow_map(held, of, "grp string, idx bigint, path string")


def block_paths(row: dict) -> list[list[bytes]]:
    """The steps from each leaf of a block to the root."""
    above = row["path"].encode().split(b",") if row["path"] else []
    log = [row["log"][i:i + 32].hex().encode() for i in range(0, len(row["log"]), 32)]
    return [[*s, *above] for s in siblings(log, row["n"], row["up"])]


def _own(logs: DataFrame) -> DataFrame:
    return logs.select("grp", "block", "up", "log", F.size("ids").alias("n"), "ids", "seen")


def _joined(logs: DataFrame, paths: DataFrame) -> DataFrame:
    """Blocks with the path of their top, which is child ``block`` of the round above."""
    p = paths.select(F.col("grp").alias("_g"), F.col("idx").alias("_i"), "path")
    return _own(logs).join(p, F.col("grp").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_i"))).drop("_g", "_i")


def paths_of(logs: list[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """Paths of the blocks of the lowest round, from its top to the end of ``above`` (the paths of whole groups)."""
    paths = above
    for r in reversed(logs[1:]):
        paths = hand_down(r, paths)
    return paths


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``."""
    rows = leaves(docs).withColumn("at", F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"), F.col("leaf"), F.coalesce("seen", F.lit(""))))
    rows = stage(global_row_number(rows, "at", by=["source"], out="n").select("source", "doc_id", "leaf", "seen", (F.col("n") - 1).alias("idx")), "leaves")
    sizes = rows.groupBy("source").agg(F.count("*").alias("n"))
    sized = rows.join(sizes.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    logs = rounds(sized.select(F.col("source").alias("grp"), "idx", "n", F.col("leaf").alias("digest"), F.col("doc_id").cast("bigint").alias("id"), "seen"), "documents")

    tops = logs[-1].select("grp", top().alias("digest")).withColumn("at", F.struct(F.col("grp").isNotNull(), F.col("grp")))
    tops = stage(global_row_number(tops, "at", out="n").select("grp", "digest", (F.col("n") - 1).alias("idx")), "subroots")
    count = tops.count()
    if not count:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    whole = tops.select(F.lit("").alias("grp"), "idx", F.lit(count).cast("bigint").alias("n"), "digest", F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("string").alias("seen"))
    up = rounds(whole, "sources")
    root = up[-1].select(top().alias("root")).first()[0]

    by_source = hand_down(up[0], paths_of(up)).select("idx", "path")
    groups = stage(tops.join(by_source, "idx").select("grp", F.lit(0).cast("bigint").alias("idx"), "path", F.col("digest").alias("subroot")), "source-paths")
    held = _joined(logs[0], paths_of(logs, groups))
    subroots = groups.select(F.col("grp").alias("_g"), "subroot")
    held = held.join(subroots, F.col("grp").eqNullSafe(F.col("_g"))).drop("_g")

    def of(batch: pa.RecordBatch):
        for r in batch.to_pylist():
            at = place(0, np.arange(r["n"]), r["n"]).tolist()
            own = [r["log"][32 * i:32 * i + 32].hex() for i in at]
            paths = block_paths(r)
            folded = [fold((seen or leaf).encode(), p).decode() for leaf, seen, p in zip(own, r["seen"], paths, strict=True)]
            yield {"doc_id": r["ids"], "leaf": own, "subroot": [r["subroot"]] * r["n"], "root": [root] * r["n"],
                   "proof_sha256": [h(b"".join(s[1:] for s in p)).decode() for p in paths], "folded_root": folded, "verified": [f == root for f in folded]}

    return arrow_map(held, of, "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
