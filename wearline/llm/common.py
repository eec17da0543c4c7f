"""Helpers shared by the training-data operators: staged tables, words, hashes, components."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.session import ensure_checkpoint_dir

#: one word: a run of bytes other than space and \x09-\x0D (what ``bytes.split()`` splits on)
WORD = r"[^\x20\x09-\x0D]+"
#: odd multipliers of the 64-bit hashes
MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and read it back: lineage ends there, later
    jobs reuse the files, and a lost executor costs only its running tasks."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def per_worker(kind: str, key, make: Callable[[], object]):
    """The one object that a Python worker keeps from task to task. This package travels by value, so every task has globals
    of its own; a module of the worker itself outlives them. Another kind or key replaces the object: a worker lives
    through all stages of a program, and what an earlier stage remembered (the codec's units) would stay beside a later one's."""
    name = "_wearline_worker"
    module = sys.modules.setdefault(name, types.ModuleType(name))
    if getattr(module, "held", (None,))[0] != (kind, key):
        module.held = (None,)  # the old one goes before the new one is made
        pa.default_memory_pool().release_unused()
        module.held = ((kind, key), make())
    return module.held[1]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_column(df: DataFrame, text: str = "text"):
    """The text as bytes, null as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (in place on a copy) so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * MIX1
    h ^= h >> np.uint64(29)
    h = h * MIX2
    return h ^ (h >> np.uint64(32))


class Roller:
    """Hashes of arbitrary slices of a byte buffer: prefix sums of table[b] * BASE**i
    (mod 2**64), so a slice costs one subtraction and one multiplication."""

    BASE = 0x9E3779B97F4A7C15 | 1
    INV = pow(BASE, -1, 1 << 64)

    def __init__(self, salt: int = 0):
        self.table = np.random.default_rng(7 + salt).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.pow = self.inv = np.ones(1, np.uint64)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out, have = np.ones(n, np.uint64), 1
        while have < n:
            more = min(have, n - have)
            out[have:have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
            have += more
        return out

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data) + 1
        if len(self.pow) < n:
            self.pow, self.inv = self._powers(self.BASE, n), self._powers(self.INV, n)
        out = np.zeros(n, np.uint64)
        np.cumsum(self.table[data] * self.pow[:n - 1], out=out[1:])
        return out

    def slices(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.inv[start] + (end - start).astype(np.uint64))


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict] | dict | None], schema: str) -> DataFrame:
    """``mapInArrow`` with ``fn(batch) -> dict of column -> values`` (or an iterator of them)."""
    arrow = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                got = fn(batch)
                for cols in [got] if isinstance(got, dict) else got or ():
                    yield to_batch(cols, arrow)

    return df.mapInArrow(run, schema)


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def to_batch(cols: dict, schema: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for f in schema:
        v = cols[f.name]
        arrays.append(v.cast(f.type) if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def text_slices(batch: pa.RecordBatch, limit: int = 1 << 20, name: str = "text"):
    """``(a, b, texts)`` of consecutive ranges of rows of about ``limit`` bytes, so that of a batch only one range is held as Python objects."""
    column = batch.column(name).cast(pa.binary())
    start, held = 0, 0
    for i, n in enumerate(pa.compute.binary_length(column).to_pylist(), 1):
        held += n or 0
        if held >= limit or i == len(column):
            yield start, i, column.slice(start, i - start).to_pylist()
            start, held = i, 0


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of many texts at once: a buffer with the texts one after another, and of each word its
    document's row, first byte and end."""

    roller = Roller()

    def __init__(self, data: list[bytes], lower: bool = False):
        buffer = np.frombuffer(b" ".join([*data, b""]), np.uint8)
        self.buffer = _LOWER[buffer] if lower else buffer
        edge = np.diff(np.concatenate([[True], _SPACE[buffer], [True]]).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        lengths = np.array([len(x) + 1 for x in data], np.int64)
        self.base = np.cumsum(lengths) - lengths
        self.doc = np.searchsorted(self.base, self.start, side="right") - 1
        self.count = np.bincount(self.doc, minlength=len(data))
        self.first = np.cumsum(self.count) - self.count

    def hashes(self) -> np.ndarray:
        return self.roller.slices(self.roller.prefix(self.buffer), self.start, self.end)


def sliced(data: list[bytes], limit: int = 1 << 22):
    """Consecutive ranges of rows of about ``limit`` bytes (one row at least)."""
    start, held = 0, 0
    for i, x in enumerate(data):
        held += len(x)
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(data):
        yield start, len(data)


#: links that one task may join
LOCAL_LINKS = 1 << 20


def arrow_map_all(df: DataFrame, fn: Callable[[pa.Table], dict], schema: str) -> DataFrame:
    """``fn`` on a table of a size that is known to fit one task."""
    arrow = arrow_schema(schema)

    def run(batches):
        rows = list(batches)
        if rows:
            yield to_batch(fn(pa.Table.from_batches(rows)), arrow)

    return df.coalesce(1).mapInArrow(run, schema)


def least_reachable(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest row reachable over the links (a, b) for each of ``n`` rows."""
    low = np.arange(n)
    while True:
        before = low.copy()
        m = np.minimum(low[a], low[b])
        np.minimum.at(low, a, m)
        np.minimum.at(low, b, m)
        low = low[low]
        if (low == before).all():
            return low


def _classes(links: pa.Table) -> dict:
    u, v = (np.array(links.column(c).to_pylist()) for c in ("u", "v"))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    low = least_reachable(at[:len(u)], at[len(u):], len(nodes))
    return {"node": nodes.tolist(), "component": nodes[low].tolist()}


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected link table: one row ``(node, component)`` per
    node that has a link, ``component`` the smallest node reachable.

    Alternating large-star / small-star rounds (each at most as many links as before), all
    joins and aggregations on Spark; every round is staged in the shared folder, and the
    loop ends when a round leaves the links as they were (compared by an order-free hash).
    A table of at most ``LOCAL_LINKS`` distinct links (16 MB) needs no rounds: one task joins them.
    Null ends and self links are ignored; an empty table gives an empty result.
    """
    link = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    link = stage(link.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")

    def mark(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = mark(link)
    if seen[0] <= LOCAL_LINKS:
        kind = link.schema["u"].dataType.simpleString()
        return stage(arrow_map_all(link, _classes, f"node {kind}, component {kind}"), "components")
    for _ in range(max_rounds):
        both = link.unionByName(link.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # staged, so that either side of the joins is an exchange of its own and a hub's rows can be split
        low = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v")
        large = stage(large.distinct(), "large")
        low = stage(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        link = stage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = mark(link)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return link.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        link.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
