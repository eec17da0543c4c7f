"""Document fingerprints: randomised edit embedding, bit sampling, banding and verification.

Embedding. All documents share one random walk: at step ``j`` the walk writes the character it stands on
and moves on if the shared coin of (step, character) says so. Texts a small edit distance apart soon walk
in step again, so edit distance becomes Hamming distance of the written strings. A character's stay is a
lookup of the next step whose coin moves it, so a text of n characters costs n lookups; the walks of many
documents run side by side.

Fingerprint. Steps are sampled at places fixed for all documents: half of ``SAMPLES`` in the upper half of
the level ``[0, 2**level)`` that holds three times the text's length, a quarter in the quarter below, and so
on, each list the beginning of a longer one. So two documents of different levels still share the samples of
the higher level. A sample is four bits of the character (0 beyond the end). Likeness is the share of equal
samples among those that either document has.

Defined results: null texts are empty; two empty documents are alike (1.0); documents with equal ids are
ordered by a hash of the text; null ids come last; the document after the last is the first; a lone document
is its own next; columns other than the id and the text are never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import arrow_map, arrow_schema, components, partitions, stage, to_batch

SAMPLES, PERIOD, KINDS = 256, 4096, 256
#: characters that walk side by side at once
SLICE = 1 << 22


def _coins() -> np.ndarray:
    """For each character class and step of the period: the steps a character stays before its coin moves it."""
    coin = np.random.default_rng(20).integers(0, 2, (KINDS, PERIOD), dtype=np.uint8)
    coin[:, 0] |= coin.sum(1) == 0
    stay = np.zeros((KINDS, PERIOD), np.int32)
    run = np.argmax(np.concatenate([coin, coin], 1) == 1, 1).astype(np.int32)  # from the period's end into the next
    for j in range(PERIOD - 1, -1, -1):
        run = np.where(coin[:, j] == 1, 0, run + 1)
        stay[:, j] = run
    return stay.ravel()


def _places(octave: int) -> np.ndarray:
    """The sampled steps of [2**(octave-1), 2**octave), in the order in which levels take them."""
    low = (1 << octave) >> 1
    return low + (np.random.default_rng(1000 + octave).random(SAMPLES) * max(low, 1)).astype(np.int64)


_STAY = _coins()
_PLACES = [_places(o) for o in range(48)]


def level_of(n: int) -> int:
    return (3 * n).bit_length()


def counts(level: int) -> list[int]:
    """How many samples a level takes of each octave up to its own."""
    return [SAMPLES >> (level - o + 1) if o < level else SAMPLES // 2 for o in range(level + 1)]


def sampled(level: int) -> np.ndarray:
    return np.concatenate([_PLACES[o][:n] for o, n in enumerate(counts(level))]) if level else np.zeros(0, np.int64)


def classes(chars: np.ndarray) -> np.ndarray:
    return np.where(chars < 128, chars, 128 + ((chars * np.uint32(2654435761)) >> np.uint32(25)))


def nibbles(chars: np.ndarray) -> np.ndarray:
    return (((chars * np.uint32(0x9E3779B1)) >> np.uint32(12)) % np.uint32(15) + np.uint32(1)).astype(np.uint8)


def walk(chars: list[np.ndarray], start: np.ndarray) -> list[np.ndarray]:
    """The step at which each character's stay begins, and at the end the step after the last stay."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(chars)
    order = np.argsort([-len(x) for x in chars], kind="stable")
    a = 0
    while a < len(order):  # slices of bounded size, of documents of like length
        b, held = a, 0
        while b < len(order) and (b == a or held < SLICE):
            held += len(chars[order[b]])
            b += 1
        part = order[a:b]
        n = np.array([len(chars[i]) for i in part], np.int64)
        alive = len(part) - np.searchsorted(n[::-1], np.arange(int(n[0])), side="right")
        offset = np.concatenate([[0], np.cumsum(alive)])
        first = np.cumsum(n) - n
        t = np.arange(held) - np.repeat(first, n)
        at = offset[t] + np.repeat(np.arange(len(part)), n)
        row = np.empty(held, np.int64)
        row[at] = classes(np.concatenate([chars[i] for i in part])) * np.int64(PERIOD)
        steps = np.empty(held, np.int64)
        j = start[part].astype(np.int64)
        off = offset.tolist()
        for k in range(len(off) - 1):
            lo, hi = off[k], off[k + 1]
            now = j[:hi - lo]
            steps[lo:hi] = now
            now += _STAY[row[lo:hi] + (now & (PERIOD - 1))]
            now += 1
        steps = steps[at]
        for r, i in enumerate(part):
            out[i] = np.append(steps[first[r]:first[r] + n[r]], j[r])
        a = b
    return out


def fingerprint(marks: np.ndarray, begins: np.ndarray, level: int) -> np.ndarray:
    """The samples of one embedded text: the mark of the character written at each sampled step."""
    at = np.searchsorted(begins, sampled(level), side="right") - 1
    return np.append(marks, 0)[np.minimum(at, len(marks))]


def as_text(level: int, samples: np.ndarray) -> str:
    return f"{level:02x}" + "".join(map("0123456789abcdef".__getitem__, samples.tolist()))


def from_text(text: str) -> tuple[int, np.ndarray]:
    return int(text[:2], 16), np.array([int(c, 16) for c in text[2:]], np.uint8)


def likeness(la: int, a: np.ndarray, lb: int, b: np.ndarray) -> float:
    """Share of equal samples among those that either has; samples of both at the higher level."""
    if la > lb:
        la, a, lb, b = lb, b, la, a
    if la < lb:
        ends = np.cumsum(counts(la)) if la else np.zeros(1, int)
        take = []
        for o, n in enumerate(counts(lb)):
            take.append(a[ends[o] - counts(la)[o]:ends[o]][:n] if la and o <= la else np.zeros(n, np.uint8))
            if len(take[-1]) < n:
                take[-1] = np.append(take[-1], np.zeros(n - len(take[-1]), np.uint8))
        a = np.concatenate(take)
    either = (a > 0) | (b > 0)
    return float((a == b)[either].mean()) if either.any() else 1.0


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fingerprints(texts: list[str]) -> list[tuple[int, np.ndarray]]:
    chars = [characters(t) for t in texts]
    begins = walk(chars, np.zeros(len(chars), np.int64))
    return [(level_of(len(c)), fingerprint(nibbles(c), b, level_of(len(c)))) for c, b in zip(chars, begins, strict=True)]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, th, n_chars, fingerprint)`` of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def of(batch: pa.RecordBatch):
        texts = batch.column("text").to_pylist()
        return {"doc_id": batch.column("doc_id"), "th": batch.column("th"), "n_chars": [len(t) for t in texts],
                "fingerprint": [as_text(*f) for f in fingerprints(texts)]}

    text = F.coalesce(F.col(text_col), F.lit(""))
    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")), of,
                     f"doc_id {kind}, th bigint, n_chars bigint, fingerprint string")


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """Rows ``(doc_id, th, text, slot, halo)``, dealt by slot and sorted, so that every document is followed by
    the next one: slots are ranges of ids (null ids: of text hashes), and a slot's last row (``halo``) is the
    first document of the slot after it. One shuffle of the texts; the driver holds the slots' first keys."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"))
    got = docs.agg(F.percentile_approx(F.col("doc_id").cast("double"), [i / parts for i in range(1, parts)] or [0.5], max(10_000, 4 * parts))).first()[0]
    splits = [-float("inf"), *sorted(set(got or [])), float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="_x", outputCol="_b").transform(
        keyed.withColumn("_x", F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)))) if len(splits) > 2 else keyed.withColumn("_b", F.lit(0.0)).withColumn("_x", F.lit(0.0))
    by_hash = len(splits) + F.floor((F.col("th") / F.lit(2.0 ** 63) + 1) / 2 * parts)
    ranged = ranged.withColumn("slot", F.when(F.col("doc_id").isNull(), by_hash).otherwise(F.col("_b")).cast("int")).drop("_b", "_x")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("th").alias("h"))
    firsts = sorted((r.slot, r.f) for r in ranged.groupBy("slot").agg(F.min(order).alias("f")).collect())  # a row a slot
    if not firsts:
        return ranged.withColumn("halo", F.lit(False))
    kind = docs.schema["doc_id"].dataType.simpleString()
    first_ids = ranged.sparkSession.createDataFrame([(s, firsts[k - 1][0], f.i, f.h) for k, (s, f) in enumerate(firsts)], f"slot int, before int, _i {kind}, _h bigint")
    marked = ranged.join(F.broadcast(first_ids), "slot")  # a row a slot
    is_first = F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("th") == F.col("_h"))
    own = F.struct(F.col("slot").alias("slot"), F.lit(False).alias("halo"))
    out = marked.withColumn("_to", F.explode(F.when(is_first, F.array(own, F.struct(F.col("before").alias("slot"), F.lit(True).alias("halo")))).otherwise(F.array(own))))
    out = out.select("doc_id", "th", "text", "_to.slot", "_to.halo")
    return out.repartitionById(parts, F.pmod(F.col("slot"), F.lit(parts)).cast("int")).sortWithinPartitions("slot", "halo", F.col("doc_id").isNull(), "doc_id", "th")


def edits(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``. The edited text keeps the document's first half and continues with the beginning of the next
    document; its walk continues the document's own."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = arrow_schema(f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

    def work(rows: list[tuple]) -> dict:
        """All rows but the last are documents or halos; each document's next is the row after it."""
        texts = [r[1] for r in rows]
        chars = [characters(t) for t in texts]
        begins = walk(chars, np.zeros(len(chars), np.int64))
        marks, levels = [nibbles(c) for c in chars], [level_of(len(c)) for c in chars]
        prints = [fingerprint(m, b, lv) for m, b, lv in zip(marks, begins, levels, strict=True)]
        which = [i for i in range(len(rows) - 1) if not rows[i][3]]
        keep = [len(chars[i]) - len(chars[i]) // 2 for i in which]
        more = [chars[i + 1][:len(chars[i]) // 2] for i in which]
        went = walk(more, np.array([begins[i][k] for i, k in zip(which, keep, strict=True)], np.int64))
        cols: dict = {f.name: [] for f in schema}
        for i, k, x, w in zip(which, keep, more, went, strict=True):
            level = level_of(k + len(x))
            other = fingerprint(np.concatenate([marks[i][:k], nibbles(x)]), np.concatenate([begins[i][:k], w]), level)
            cols["doc_id"].append(rows[i][0])
            cols["n_chars"].append(len(chars[i]))
            cols["edited_sha256"].append(hashlib.sha256((texts[i][:k] + texts[i + 1][:len(x)]).encode("utf-8", "surrogatepass")).hexdigest())
            cols["fingerprint"].append(as_text(levels[i], prints[i]))
            cols["edited_fingerprint"].append(as_text(level, other))
            cols["near_edited"].append(likeness(levels[i], prints[i], level, other))
            cols["near_next"].append(likeness(levels[i], prints[i], levels[i + 1], prints[i + 1]))
        return cols

    def run(batches):
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "slot", "halo")), strict=True):
                rows.append(row)
                held += len(row[1])
                if held >= SLICE and len(rows) > 1:
                    yield to_batch(work(rows), schema)
                    rows, held = rows[-1:], len(rows[-1][1])
        if len(rows) > 1:
            yield to_batch(work(rows), schema)

    from pyspark.sql.pandas.types import from_arrow_schema

    dealt = with_next(docs, parts or partitions(docs.sparkSession))
    return dealt.select("doc_id", "text", "slot", "halo").mapInArrow(run, from_arrow_schema(schema))


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance by bit vectors of the shorter text."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    peq: dict[str, int] = {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    pv, mv, dist = full, 0, len(a)
    for c in b:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        dist += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) | 1, mh << 1
        pv, mv = (mh | (full & ~(xv | ph))) & full, ph & xv & full
    return dist


def near_classes(docs: DataFrame, similarity: float = 0.8, bands: int = 32, width: int = 8) -> DataFrame:
    """``(doc_id, class_id)`` of documents linked by an edit similarity (1 - distance / longer length) of at least
    ``similarity``. Equal texts are one representative (the smallest id); representatives whose sampled bits agree
    in a band at a common level are compared with the band's first one; links are verified by the edit distance of the whole texts. Null ids are left out."""
    prints = fingerprint_documents(docs.where("doc_id is not null"))
    prints = stage(prints, "prints")
    reps = prints.groupBy("th").agg(F.min("doc_id").alias("rep"), F.first("fingerprint").alias("fingerprint"))

    def keys(batch: pa.RecordBatch):
        chosen = {}
        out: dict = {"band": [], "rep": []}
        for rep, text in zip(batch.column("rep").to_pylist(), batch.column("fingerprint").to_pylist(), strict=True):
            level, samples = from_text(text)
            for lv in (level, level + 1):  # a neighbour one level up samples half as densely
                s = samples if lv == level else np.concatenate([samples[e - n:e][:m] if o <= level else np.zeros(m, np.uint8) for o, (e, n, m) in enumerate(
                    zip([*np.cumsum(counts(level)), 0], [*counts(level), 0], counts(lv), strict=True))]) if level else samples
                live = np.flatnonzero(s)
                if lv not in chosen:
                    rng = np.random.default_rng(lv)
                    chosen[lv] = [rng.permutation(sum(counts(lv)) or 1)[:width] for _ in range(bands)]
                for b, at in enumerate(chosen[lv]):
                    if len(live) and at.max() < len(s):
                        out["band"].append(f"{lv}:{b}:" + bytes(s[at]).hex())
                        out["rep"].append(rep)
        return out

    kind = docs.schema["doc_id"].dataType.simpleString()
    banded = stage(arrow_map(reps.select("rep", "fingerprint"), keys, f"band string, rep {kind}"), "bands")
    firsts = banded.groupBy("band").agg(F.min("rep").alias("first"), F.count("*").alias("n")).where("n > 1")
    pairs = banded.join(firsts, "band").where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    texts = docs.select(F.col("doc_id").alias("i"), F.coalesce("text", F.lit("")).alias("t")).dropDuplicates(["i"])
    both = pairs.join(texts.withColumnsRenamed({"i": "a", "t": "ta"}), "a").join(texts.withColumnsRenamed({"i": "b", "t": "tb"}), "b")

    def verify(batch: pa.RecordBatch):
        cols = [batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb")]
        got = [(a, b) for a, b, x, y in zip(*cols, strict=True) if edit_distance(x, y) <= (1 - similarity) * max(len(x), len(y))]
        return {"a": [g[0] for g in got], "b": [g[1] for g in got]}

    links = arrow_map(both, verify, f"a {kind}, b {kind}")
    groups = components(links)
    members = prints.select("doc_id", "th").join(reps.select("th", "rep"), "th")
    return members.join(groups, members["rep"] == groups["node"], "left").select("doc_id", F.coalesce("component", "rep").alias("class_id"))
