"""Embedding near-duplicates by lattice hashing.

Each of ``TABLES`` tables projects a unit vector at random to ``BLOCKS`` points of eight dimensions and decodes
each to the nearest point of the E8 lattice; the points together are the vector's home cell. It also probes the
``PROBES`` neighbouring cells that lie closest, one lattice step away in one block. Two vectors meet in a cell
that is home to one and home to or probed by the other, and are linked there if their cosine, in double
precision, reaches the threshold.

First only ids are shuffled, to find the cells where vectors meet; the vectors go to those cells alone. Cells of
more than ``BLOCK`` members are compared block by block in as many tasks. A link that is found in several cells
counts in the first of them, which both ends' cells tell without exchanging pairs; tasks give sums for each
vector and its class, so groups are not expanded into pairs. Equal vectors are one representative with a weight.

Defined results: a vector that is null, empty, zero, or holds a null or non-finite component links with nothing;
vectors of different length are not compared; a null id links with nothing, its component is null and it is kept;
other columns, labels included, are never read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import arrow_map, arrow_schema, components, least_reachable, mix, partitions, stage, to_batch

TABLES, BLOCKS, PROBES, SCALE, BLOCK = 12, 3, 4, 0.45, 256


def nearest(y: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row of eight coordinates: the nearer of the two cosets' nearest points, each
    rounded coordinate by coordinate and mended to an even sum where rounding costs least."""

    def even(z):
        r = np.rint(z)
        off = z - r
        worst = np.abs(off).argmax(1)
        odd = np.flatnonzero(r.sum(1) % 2)
        w = worst[odd]
        r[odd, w] += np.where(off[odd, w] >= 0, 1, -1)
        return r

    a, b = even(y), even(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1))[:, None], a, b)


def steps() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            whole.append(v)
    half = [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(whole + half)


_STEPS = steps()
_ODD = np.random.default_rng(31).integers(0, 1 << 63, (TABLES * 4, 8 * 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def cells(unit: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Home cells (row, table) and probed cells (row, table, probe) as 64-bit names."""
    n, dim = unit.shape
    home, near = np.empty((n, tables), np.int64), np.empty((n, tables, probes), np.int64)
    for t in range(tables):
        y = (unit @ np.random.default_rng((dim, t)).normal(0, scale, (dim, 8 * blocks))).reshape(n * blocks, 8)
        c = nearest(y)
        gain = ((y - c) @ _STEPS.T).reshape(n, blocks * len(_STEPS))
        twice = (2 * c).astype(np.int64).reshape(n, 8 * blocks)
        odd = _ODD[t][:8 * blocks]
        plain = (twice.view(np.uint64) * odd).sum(1) + np.uint64(dim * 1_000_003 + t)
        home[:, t] = mix(plain).view(np.int64)
        best = np.argsort(-gain, 1, kind="stable")[:, :probes]
        delta = (2 * _STEPS).astype(np.int64).view(np.uint64)
        for p in range(probes):
            block, step = best[:, p] // len(_STEPS), best[:, p] % len(_STEPS)
            moved = (delta[step] * odd.reshape(blocks, 8)[block]).sum(1)
            near[:, t, p] = mix(plain + moved).view(np.int64)
    return home, near


def unit_vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for those that link with nothing."""
    out: list[np.ndarray | None] = []
    for v in column:
        a = None if not v.is_valid or not len(v.values) or v.values.null_count else np.asarray(v.values.cast(pa.float64()))
        if a is not None and np.isfinite(a).all() and (top := np.abs(a).max()) > 0:
            a = a / top  # so that no square over- or underflows
            out.append(a / np.sqrt((a * a).sum()))
        else:
            out.append(None)
    return out


def meets(ha, hb, pa_, pb) -> np.ndarray:
    """Whether pairs meet in each table: equal homes, or one's home among the other's probes."""
    return (ha == hb) | (pa_ == hb[..., None]).any(-1) | (pb == ha[..., None]).any(-1)


def near_classes(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", column: str = "embedding",
                 tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``."""
    spark = vectors.sparkSession
    parts = partitions(spark)
    kind = vectors.schema[id_col].dataType.simpleString()

    def unit(batch: pa.RecordBatch):
        units = unit_vectors(batch.column("v"))
        body = [None if u is None else u.tobytes() for u in units]
        return {"vec_id": batch.column("vec_id"), "u": body}

    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(column).alias("v"))
    named = arrow_map(rows, unit, f"vec_id {kind}, u binary").withColumn("k1", F.xxhash64("u")).withColumn("k2", F.xxhash64(F.lit(7), "u"))
    named = stage(named, "units")
    valid = named.where("u is not null and vec_id is not null")
    reps = valid.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("u").alias("u"))

    def place(batch: pa.RecordBatch):
        units = [np.frombuffer(u) for u in batch.column("u").to_pylist()]
        home, near = [None] * len(units), [None] * len(units)
        for dim in {len(u) for u in units}:
            at = [i for i, u in enumerate(units) if len(u) == dim]
            for lo in range(0, len(at), 2000):
                h, p = cells(np.array([units[i] for i in at[lo:lo + 2000]]), tables, blocks, probes, scale)
                for i, x, y in zip(at[lo:lo + 2000], h, p, strict=True):
                    home[i], near[i] = x, y.ravel()
        return {c: batch.column(c) for c in ("k1", "k2", "rep", "n", "u")} | {"home": home, "near": near}

    reps = stage(arrow_map(reps, place, f"k1 bigint, k2 bigint, rep {kind}, n bigint, u binary, home array<bigint>, near array<bigint>"), "cells")
    homes = reps.select("rep", F.posexplode("home").alias("table", "cell"), F.lit(1).alias("own"))
    nears = reps.select("rep", F.posexplode("near").alias("at", "cell"), F.lit(0).alias("own"))
    nears = nears.select("rep", F.floor(F.col("at") / probes).cast("int").alias("table"), "cell", "own")
    visits = homes.unionByName(nears)
    live = visits.groupBy("table", "cell").agg(F.sum("own").alias("owners"), F.count("*").alias("members")).where("owners > 0 and members > 1")
    live = stage(live.select("table", "cell", F.ceil(F.col("members") / BLOCK).alias("nb")), "live")
    met = visits.join(live, ["table", "cell"]).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("nb")))
    met = met.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    met = met.select("rep", "table", "cell", "own", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    full = met.join(reps.select("rep", "n", "u", "home", "near"), "rep")
    schema = arrow_schema(f"rep {kind}, links bigint, low {kind}")
    names = ["table", "cell", "i", "j", "b", "rep", "own", "n", "u", "home", "near"]

    def work(key: tuple, group: list[tuple]) -> dict | None:
        table, cell, i, j = key
        ids, n = [g[5] for g in group], np.array([g[7] for g in group])
        side, own = np.array([g[4] for g in group]), np.array([g[6] for g in group], bool)
        u = np.array([np.frombuffer(g[8]) for g in group])
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        a, b = np.nonzero(u[left] @ u[right].T >= threshold)
        a, b = left[a], right[b]
        keep = ((a < b) if i == j else np.ones(len(a), bool)) & (own[a] | own[b])
        a, b = a[keep], b[keep]
        if not len(a):
            return None
        home = np.array([g[9] for g in group], np.int64)
        near = np.array([g[10] for g in group], np.int64).reshape(len(group), tables, probes)
        counts = np.zeros(len(group), np.int64)
        order = np.array(ids)
        for lo in range(0, len(a), 20_000):
            x, y = a[lo:lo + 20_000], b[lo:lo + 20_000]
            met_in = meets(home[x], home[y], near[x], near[y])
            hx, hy = home[x, table], home[y, table]
            both = (near[y, table] == hx[:, None]).any(1) & (near[x, table] == hy[:, None]).any(1)
            first = np.where(both & (hx != hy), np.where(order[x] < order[y], hx, hy) == cell, True) & (met_in.argmax(1) == table)
            np.add.at(counts, x[first], n[y[first]])
            np.add.at(counts, y[first], n[x[first]])
        rank = np.argsort(order, kind="stable")  # rows in order of ids, so that the smallest row is the smallest id
        place_ = np.empty(len(rank), np.int64)
        place_[rank] = np.arange(len(rank))
        low = least_reachable(place_[a], place_[b], len(rank))
        used = np.unique(np.concatenate([a, b]))
        return {"rep": order[used], "links": counts[used], "low": order[rank[low[place_[used]]]]}

    def run(batches):
        key, group = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if row[:4] != key:
                    if len(group) > 1 and (got := work(key, group)):
                        yield to_batch(got, schema)
                    key, group = row[:4], []
                group.append(row)
        if len(group) > 1 and (got := work(key, group)):
            yield to_batch(got, schema)

    from pyspark.sql.pandas.types import from_arrow_schema

    to = F.pmod(F.xxhash64("table", "cell") + F.col("i") * 31 + F.col("j"), F.lit(parts)).cast("int")
    found = stage(full.select(*names).repartitionById(parts, to).sortWithinPartitions(*names[:6]).mapInArrow(run, from_arrow_schema(schema)), "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("rep").alias("a"), F.col("low").alias("b"))).withColumnRenamed("node", "rep")
    state = reps.select("k1", "k2", "rep", "n").join(links, "rep", "left").join(groups, "rep", "left")
    state = stage(state.select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("c")), "state")
    linked = F.col("u").isNotNull() & F.col("vec_id").isNotNull()
    out = named.join(state, ["k1", "k2"], "left").select(
        "vec_id", F.when(linked, F.col("n_links")).otherwise(0).cast("long").alias("n_links"), F.when(linked, F.col("c")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
