"""MinHash near-duplicates: circulant MinHash, banding, exact Jaccard verification.

Two permutations make a whole signature: the first scatters a shingle over a circle of ``CIRCLE`` places,
the second ranks the places, and coordinate k is the smallest rank found k places further on. Documents
with equal shingle sets are one representative (the smallest id). Representatives that share a band are
candidates; a bucket links its members to its smallest one only, and connected candidates are compared
group by group on their full sets, so neither buckets nor groups are expanded into pairs.

Inside a group one pivot is compared with all members; members linked to it need no more comparisons with
each other, and every other member is compared with all. Groups of more than ``BLOCK`` members are cut into
blocks: links within blocks first, then among the blocks' pivots, and at last every member outside the
group's largest class against all blocks. All three together find every link that joins two classes. In the
last round both sides are blocked: a block of members outside meets one block of all at a time, so neither side
of a task's group grows with the candidate group.

Defined results: null texts are empty; a document without words has no shingles, links with nothing and is
kept; a document with fewer words than a shingle has its whole sequence as the only one; rows with one id
are one node; a null id links with nothing, has a null component and is kept; columns other than the id and
the text are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import Words, arrow_map, arrow_schema, components, mix, partitions, per_worker, sliced, stage, text_column, text_slices, to_batch

BANDS, ROWS, CIRCLE, BLOCK = 40, 6, 1 << 20, 512
#: bytes of text hashed at once: a byte takes some 50 more in sums and powers, in every worker
HASHED = 1 << 18
_ODD = np.random.default_rng(11).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: list[bytes], width: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes."""
    out: list[np.ndarray] = []
    for a, b in sliced(data, HASHED):
        w = Words(data[a:b], lower=True)
        h = w.hashes()
        n = len(h)
        if n >= width:
            run = mix(sum(h[j:n - width + 1 + j] * _ODD[j] for j in range(width)))
        else:
            run = np.zeros(0, np.uint64)
        for first, count in zip(w.first.tolist(), w.count.tolist(), strict=True):
            if count >= width:
                s = np.sort(run[first:first + count - width + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif count:
                whole = (h[first:first + count] * _ODD[:count]).sum(keepdims=True)
                out.append(mix(whole ^ _ODD[60 - count % 8]))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


class Signer:
    """Circulant MinHash signatures, as band keys."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows, k = bands, rows, bands * rows
        rng = np.random.default_rng(12)
        ranks = rng.permutation(CIRCLE).astype(np.uint32)
        self.scatter = rng.permutation(CIRCLE).astype(np.uint32)
        self.windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[:k]]), k)
        self.salt = rng.integers(0, 1 << 63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def bands_of(self, shingles: np.ndarray) -> np.ndarray:
        place = self.scatter[shingles & np.uint64(CIRCLE - 1)]
        least = np.full(self.bands * self.rows, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(place), 1024):
            np.minimum(least, self.windows[place[i:i + 1024]].min(0), out=least)
        return mix((least.reshape(self.bands, self.rows).astype(np.uint64) * self.salt).sum(1)).view(np.int64)


def signed(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """``(doc_id, n_shingles, s1, s2, bands)``; ``s1, s2`` name the shingle set."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def of(batch: pa.RecordBatch):
        signer = per_worker("signer", (bands, rows), lambda: Signer(bands, rows))
        for a, b, data in text_slices(batch):
            sets = shingle_sets(data, width)
            yield {"doc_id": batch.column("doc_id").slice(a, b - a), "n_shingles": [len(s) for s in sets],
                   "s1": [int(s.sum().view(np.int64)) if len(s) else 0 for s in sets],
                   "s2": [int(mix(s ^ _ODD[62]).sum().view(np.int64)) if len(s) else 0 for s in sets],
                   "bands": [signer.bands_of(s) if len(s) else [] for s in sets]}

    return arrow_map(docs.select("doc_id", text_column(docs).alias("text")), of,
                     f"doc_id {kind}, n_shingles bigint, s1 bigint, s2 bigint, bands array<bigint>")


class Group:
    """Members of one block with their sets, for comparisons of one with all."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.n = np.array([len(s) for s in sets], np.int64)
        self.flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.row = np.repeat(np.arange(len(sets)), self.n)

    def linked(self, shingles: np.ndarray, num: int, den: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(shingles, self.flat), max(len(shingles) - 1, 0))
        both = np.bincount(self.row, shingles[at] == self.flat, len(self.n)) if len(shingles) else np.zeros(len(self.n))
        return den * both >= num * (self.n + len(shingles) - both)

    def links(self, num: int, den: int) -> list[tuple[int, int]]:
        """Pairs of rows that join the members into their classes, one for each member beyond the first of
        its class. Found from the star of one pivot (the largest of a few) and all links of every member
        outside it, which are used as they are found and not listed."""
        m = len(self.sets)
        if m < 2:
            return []
        tries = {i: self.linked(self.sets[i], num, den) for i in range(0, m, max(1, m // 4))}
        pivot = max(tries, key=lambda i: tries[i].sum())
        low = np.arange(m)
        low[tries[pivot]] = np.flatnonzero(tries[pivot])[0]
        for i in np.flatnonzero(~tries[pivot]).tolist():
            got = np.flatnonzero(tries[i] if i in tries else self.linked(self.sets[i], num, den))
            ends = np.unique(np.append(low[got], low[i]))
            if len(ends) > 1:
                low[np.isin(low, ends)] = ends[0]
        return [(int(j), i) for i, j in enumerate(low) if i != j]


def _blocks(members: DataFrame, docs: DataFrame, width: int, num: int, den: int, kind: str, cross: bool = False) -> DataFrame:
    """Links ``(a, b)`` within the blocks of ``members (rep, component, block[, other, foreign, cls])``; the rows of
    a block come to one task in order. With ``cross``, members marked foreign, a block ``other`` of them at a time,
    are compared with the others, and linked once with each class of theirs."""
    spark = docs.sparkSession
    schema = arrow_schema(f"a {kind}, b {kind}")
    rows = members.hint("merge").join(docs.select(F.col("doc_id").alias("rep"), text_column(docs).alias("text")), "rep")
    parts = partitions(spark)
    names = ["component", "block", "other", "rep", "foreign", "cls", "text"]
    rows = rows.withColumns({} if cross else {"other": F.lit(0).cast("long"), "foreign": F.lit(False), "cls": F.col("rep")}).select(*names)
    to = F.pmod(F.pmod(F.xxhash64("component"), F.lit(parts)) + F.col("block") + 31 * F.col("other"), F.lit(parts)).cast("int")

    def work(ids: list, foreign: list, cls: list, data: list[bytes]) -> dict:
        sets = shingle_sets(data, width)
        if cross:
            own = [i for i, f in enumerate(foreign) if not f]
            group, (_, kind_of) = Group([sets[i] for i in own]), np.unique([cls[i] for i in own], return_inverse=True)
            got = []
            for i in (i for i, f in enumerate(foreign) if f):
                hit = np.flatnonzero(group.linked(sets[i], num, den)) if own else []
                got += [(i, own[int(hit[k])]) for k in np.unique(kind_of[hit], return_index=True)[1]] if len(hit) else []
        else:
            got = Group(sets).links(num, den)
        got = [(ids[i], ids[j]) for i, j in got if ids[i] != ids[j]]
        return {"a": [x for x, _ in got], "b": [y for _, y in got]}

    def run(batches):
        key, group = None, []
        for batch in (b.slice(at, BLOCK) for b in batches for at in range(0, b.num_rows, BLOCK)):
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if row[:3] != key:
                    if len(group) > 1:
                        yield to_batch(work(*(list(c) for c in list(zip(*group))[3:])), schema)
                    key, group = row[:3], []
                group.append(row)
        if len(group) > 1:
            yield to_batch(work(*(list(c) for c in list(zip(*group))[3:])), schema)

    from pyspark.sql.pandas.types import from_arrow_schema

    return rows.repartitionById(parts, to).sortWithinPartitions("component", "block", "other", "rep").mapInArrow(run, from_arrow_schema(schema))


def verified(candidates: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links that join the members ``(rep, component)`` of each candidate group into their classes."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sizes = candidates.groupBy("component").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK)
    rows = stage(candidates.join(sizes, "component").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))), "members")
    links = stage(_blocks(rows.drop("n", "blocks"), docs, width, num, den, kind), "links")
    large = rows.where("blocks > 1")
    if not large.limit(1).count():
        return links

    def classed(links: DataFrame) -> DataFrame:
        """Members of the groups of several blocks with the smallest member of their class so far."""
        found = components(links)
        got = large.withColumnRenamed("component", "grp").join(found, F.col("rep") == F.col("node"), "left")
        return stage(got.select("grp", "rep", "block", "blocks", F.coalesce("component", "rep").alias("cls")), "classes")

    # the blocks' pivots among each other
    pivots = classed(links).select("grp", "cls").distinct()
    several = pivots.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1")
    top = pivots.join(several, "grp").select(F.col("cls").alias("rep"), F.col("grp").alias("component"), F.pmod(F.xxhash64("cls"), F.ceil(F.col("n") / BLOCK)).alias("block"))
    links = stage(links.unionByName(_blocks(top, docs, width, num, den, kind)), "links")
    # what is still outside its group's largest class meets every block
    now = classed(links)
    largest = now.groupBy("grp", "cls").agg(F.count("*").alias("n")).groupBy("grp").agg(F.max_by("cls", F.struct("n", "cls")).alias("largest"))
    now = stage(now.join(largest, "grp"), "classes")
    meet = meetings(now)
    return stage(links.unionByName(_blocks(meet, docs, width, num, den, kind, cross=True)), "links")


def meetings(members: DataFrame) -> DataFrame:
    """``(rep, component, block, other, foreign, cls)``: who meets whom in the last round. ``members (grp, rep, block,
    blocks, cls, largest)`` outside their group's largest class form blocks ``other`` of about ``BLOCK``; each of
    these meets each block of all members under a key of its own."""
    out = members.where("cls <> largest")
    sides = out.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).alias("others"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    part = F.pmod(F.xxhash64(F.lit(3), "rep"), F.col("others"))
    foreign = out.join(sides, "grp").select("rep", F.col("grp").alias("component"), every("blocks").alias("block"), part.alias("other"), F.lit(True).alias("foreign"), "cls")
    own = members.join(sides, "grp").select("rep", F.col("grp").alias("component"), "block", every("others").alias("other"), F.lit(False).alias("foreign"), "cls")
    return own.unionByName(foreign)


def classes(docs: DataFrame, width: int = 2, num: int = 80, den: int = 100, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``. Documents are linked when
    ``den * intersection >= num * union`` of their shingle sets."""
    docs = docs.select("doc_id", "text")
    marks = stage(signed(docs, width, bands, rows), "signatures")
    named = marks.where("n_shingles > 0 and doc_id is not null")
    reps = stage(named.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "sets")
    banded = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    firsts = banded.groupBy("band", "key").agg(F.min("rep").alias("first"), F.count("*").alias("n")).where("n > 1").select("band", "key", "first")
    pairs = banded.join(firsts, ["band", "key"]).where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b"))
    groups = components(pairs)
    candidates = groups.select(F.col("node").alias("rep"), "component")
    links = verified(candidates, docs.where("doc_id is not null"), width, num, den)
    # equal sets under several ids of one representative need no link; ids with several sets join them. Tables with a row a document or a
    # set are never broadcast: their files may be small, the rows that the driver would gather are not
    node = components(links).select(F.col("node").alias("rep"), "component")
    named_sets = reps.select("s1", "s2", "n_shingles", "rep").join(node.hint("merge"), "rep", "left").select("s1", "s2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    same = named.select("s1", "s2", "n_shingles", "doc_id").join(named_sets.hint("merge"), ["s1", "s2", "n_shingles"])
    final = stage(same.select("doc_id", "component_id"), "components")
    final = final.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = marks.select("doc_id", "n_shingles").join(final.hint("merge"), "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each class; of rows that agree in id and text one stays. Columns as they were."""
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    gone = classes(docs, width, num, den).where("not kept").select(F.col("doc_id").alias("_id")).distinct()
    kept = docs.join(gone, docs["doc_id"] == F.col("_id"), "left_anti").withColumn("_key", key)
    return kept.dropDuplicates(["doc_id", "_key"]).drop("_key")
