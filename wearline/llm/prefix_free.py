"""Suffix-array deduplication of byte strings by prefix-free parsing.

Parsing. A rolling hash of ``GRAM`` bytes triggers a phrase wherever it is the smallest of its neighbourhood,
the neighbourhood being all places of one window of ``length`` bytes at which a phrase could begin and still
have ``KEY`` bytes inside the window. So every window holds a trigger, and equal windows hold it at the same
place. A window is then a dictionary part (the end of the phrase before the trigger, at most ``REACH`` bytes)
and a parse part (what follows the trigger).

Which triggers matter. Triggers are classed by the ``KEY`` bytes that follow them. A class with one member
holds no repeat. Members whose whole context (dictionary part and parse part at full reach) occurs again have
all their windows repeated. Only members with a context of their own in a class of several are sent on, with
one representative of each context that occurs again.

Order. In the class's task two suffix arrays are built, of the dictionary parts (read backwards from the
trigger) and of the parse parts, each with the common lengths of neighbours. For a window with o bytes before
its trigger, contexts agree if they lie in one run of dictionary neighbours with o bytes in common and in one
run of parse neighbours with length - o in common: both arrays together give the corpus order of all windows
of the class. Classes of more than ``HOT`` contexts, such as a passage that a third of all documents quote, are
not gathered: their windows go out by hash, the equal ones of a chunk as one.

Texts are never shuffled. 128 bits of hash name a context, 96 a hot window.

Defined results: null texts are empty; ids are integers or null; texts shorter than ``length`` lose nothing;
rows with one id are documents of their own; columns other than the id and the text are never read.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from wearline.llm.chunks import ask, answer, bucket_count, bucket_edges, covered, pack, packed_answers, read_answers, sliding_min, small, told, unpack
from wearline.llm.common import MIX1, MIX2, Roller, arrow_map, mix

LENGTH, GRAM, KEY, HOT = 200, 8, 64, 1024
_PLACE = np.uint64((1 << 28) - 1)
_rollers = [Roller(1), Roller(2)]


class Parse:
    """The triggers of one chunk and their contexts."""

    def __init__(self, data: list[bytes], length: int, key: int):
        self.length, self.reach = length, length - key
        lengths = np.array([len(x) for x in data], np.int64)
        self.ends = np.cumsum(lengths)
        self.base = self.ends - lengths
        raw = b"".join(data)
        self.n = len(raw)
        self.buffer = np.frombuffer(raw, np.uint8)
        grams = np.ndarray((self.n,), "<u8", raw + bytes(8), strides=(1,)) * MIX1
        grams ^= grams >> np.uint64(32)
        grams *= MIX2
        packed = (grams & ~_PLACE) | np.arange(self.n, dtype=np.uint64)
        # windows begin at base .. end - length
        room = np.maximum(lengths - length + 1, 0)
        starts = np.repeat(self.base - (np.cumsum(room) - room), room) + np.arange(room.sum())
        if key < GRAM:
            raise ValueError(f"a trigger's key must hold its {GRAM} bytes")
        least = sliding_min(packed, self.reach + 1)[starts] if len(starts) else np.zeros(0, np.uint64)
        # a window's trigger; the windows of one trigger are neighbours
        trigger = (least & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.diff(trigger, prepend=-1))
        self.x = trigger[first]
        #: first and last window of each trigger
        self.from_, self.to = starts[first], starts[np.append(first[1:], len(trigger))[:len(first)] - 1]
        doc = np.searchsorted(self.ends, self.x, side="right")
        self.left = np.minimum(self.reach, self.x - self.base[doc]) if len(self.x) else self.x
        self.right = np.minimum(length, self.ends[doc] - self.x) if len(self.x) else self.x
        self.prefix = _rollers[0].prefix(self.buffer)
        self.key = _rollers[0].slices(self.prefix, self.x, self.x + key)
        context = _rollers[0].slices(self.prefix, self.x - self.left, self.x + self.right)
        context = mix(context + self.left.astype(np.uint64) * MIX2)
        order = np.lexsort((context, self.key))
        k, c = self.key[order], context[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])]) if len(k) else np.zeros(0, bool)
        self.keys, self.contexts = k[new], c[new]
        #: record of each trigger, a trigger of each record, and whether a record has several
        self.record = np.empty(len(k), np.int64)
        self.record[order] = np.cumsum(new) - 1
        self.one = order[new]
        self.several = np.bincount(self.record, minlength=len(self.keys)) > 1 if len(k) else np.zeros(0, bool)
        #: offsets of a trigger in the windows that fit its document
        self.low, self.high = np.maximum(0, length - self.right), np.minimum(self.reach, self.left)

    def context_bytes(self, at: np.ndarray) -> tuple:
        """Keys and both parts of the contexts of some triggers; bytes are raised by one (UTF-8 leaves room), so that
        0 stands beyond a text's edge. The part before the trigger is read backwards."""
        x, left, right = self.x[at], self.left[at], self.right[at]
        back, ahead = np.arange(self.reach), np.arange(self.length)
        top = max(self.n - 1, 0)
        before = self.buffer[np.clip(x[:, None] - 1 - back, 0, top)] + np.uint8(1)
        before[back >= left[:, None]] = 0
        after = self.buffer[np.clip(x[:, None] + ahead, 0, top)] + np.uint8(1)
        after[ahead >= right[:, None]] = 0
        return self.key[at], before, left.astype(np.int16), after, right.astype(np.int16)

    def windows(self, at: np.ndarray):
        """The windows of some triggers: first bytes and hashes."""
        n = self.to[at] - self.from_[at] + 1
        begin = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.from_[at], n)
        if not len(begin):
            return begin, begin.view(np.uint64), begin.astype(np.uint32)
        second = _rollers[1].slices(_rollers[1].prefix(self.buffer), begin, begin + self.length)
        return begin, _rollers[0].slices(self.prefix, begin, begin + self.length), second.astype(np.uint32)


def _runs(first: np.ndarray, second: np.ndarray):
    """Sorted distinct pairs: order, whether a pair is new, and the pair's number for each."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    number = np.empty(len(a), np.int64)
    number[order] = np.cumsum(new) - 1
    return order, new, number


#: what becomes of a trigger: nothing; all its windows are repeated; its context is sent (and repeated or not);
#: its windows are sent by hash (and repeated or not)
NONE, REPEATED, SENT, REPEATED_SENT, HASHED, REPEATED_HASHED = range(6)


def _class_codes(kind: int, chunks: list[int], payloads: list):
    keys, contexts = np.concatenate([p[0] for p in payloads]), np.concatenate([p[1] for p in payloads])
    seen = np.concatenate([1 + np.unpackbits(p[2], count=len(p[0])).astype(np.int64) for p in payloads])
    order, new, number = _runs(keys, contexts)
    occurs = np.bincount(number, seen) if len(seen) else np.zeros(0)
    first = order[new]  # the record that stands for each context
    _, cls = np.unique(keys[first], return_inverse=True)
    distinct, alone = np.bincount(cls), np.bincount(cls, occurs == 1)
    lone, again = (occurs == 1) & (distinct[cls] > 1), occurs > 1
    hot = distinct[cls] > HOT
    codes = np.where(again, REPEATED, NONE)[number]
    stands = np.where(lone, np.where(hot, HASHED, SENT), np.where(again & (alone[cls] > 0), np.where(hot, REPEATED_HASHED, REPEATED_SENT), np.where(again, REPEATED, NONE)))
    codes[first] = stands
    codes, at = codes.astype(np.uint8), 0
    for p in payloads:
        yield small(codes[at:at + len(p[0])])
        at += len(p[0])


def common(rows: np.ndarray, lengths: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of rows of bytes within their classes, and how much each has in common with the one before it
    (-1 at the beginning of a class)."""
    head = keys.astype(">u8").view(np.uint8).reshape(-1, 8)
    whole = np.ascontiguousarray(np.concatenate([head, rows], 1))
    order = np.argsort(whole.view(f"S{whole.shape[1]}").ravel(), kind="stable")
    a, k, n = rows[order], keys[order], lengths[order]
    have = np.full(len(order), -1, np.int64)
    if len(order) > 1:
        differ = a[1:] != a[:-1]
        shared = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
        have[1:] = np.where(k[1:] == k[:-1], np.minimum(shared, np.minimum(n[1:], n[:-1])), -1)
    return order, have


def repeated_offsets(keys, before, left, after, right, length: int) -> np.ndarray:
    """For each context the largest and the smallest offset (-1: none) of a window that another context holds."""
    m, reach = len(keys), before.shape[1]
    out = np.full((m, 2), -1, np.int16)
    lo, lcs = common(before, left.astype(np.int64), keys)
    ro, lcp = common(after, right.astype(np.int64), keys)
    for o in range(reach + 1):
        valid = (left >= o) & (right >= length - o)
        if valid.sum() < 2:
            continue
        g, r = np.empty(m, np.int64), np.empty(m, np.int64)
        g[lo], r[ro] = np.cumsum(lcs < o), np.cumsum(lcp < length - o)
        at = np.flatnonzero(valid)
        _, inverse, counts = np.unique(g[at] * (m + 1) + r[at], return_inverse=True, return_counts=True)
        hit = at[counts[inverse] > 1]
        out[hit, 0] = o
        out[hit, 1] = np.where(out[hit, 1] < 0, o, out[hit, 1])
    return out


def _order_classes(length: int):
    def reply(kind: int, chunks: list[int], payloads: list):
        if kind == 0:
            parts = [pickle.loads(zstandard.decompress(p)) for p in payloads]
            got = repeated_offsets(*[np.concatenate([p[i] for p in parts]) for i in range(5)], length)
            sizes = [len(p[0]) for p in parts]
        else:
            seen = np.concatenate([1 + np.unpackbits(p[2], count=len(p[0])).astype(np.int64) for p in payloads])
            _, _, number = _runs(np.concatenate([p[0] for p in payloads]), np.concatenate([p[1] for p in payloads]))
            got = (np.bincount(number, seen)[number] > 1).astype(np.uint8)
            sizes = [len(p[0]) for p in payloads]
        at = 0
        for n in sizes:
            yield small(got[at:at + n])
            at += n

    return reply


def dedup_bytes(docs: DataFrame, length: int = LENGTH, with_text: bool = False, chunk_bytes: int | None = None, key: int = KEY) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (with ``with_text`` also the kept bytes
    and the removed ``spans``). Bytes covered by a string of ``length`` bytes that also starts anywhere else go."""
    chunks = pack(docs, "bytes", chunk_bytes)
    buckets = bucket_count(chunks)

    def send_triggers(row):
        p = Parse(unpack(row["blob"]), length, key)
        edges = bucket_edges(p.keys, buckets)
        for b in np.flatnonzero(np.diff(edges)).tolist():
            lo, hi = edges[b], edges[b + 1]
            yield b, 0, (p.keys[lo:hi], p.contexts[lo:hi], np.packbits(p.several[lo:hi]))

    def coded(row):
        p = Parse(unpack(row["blob"]), length, key)
        return p, packed_answers(row["classes"], bucket_edges(p.keys, buckets), np.uint8)

    def hashed(p, codes):
        """Windows of the hot classes' contexts, and the distinct ones in order."""
        begin, h1, h2 = p.windows(p.one[codes >= HASHED])
        return begin, h1, h2, *_runs(h1, h2)

    def send_contexts(row):
        p, codes = coded(row)
        sent = np.flatnonzero((codes == SENT) | (codes == REPEATED_SENT))
        edges = bucket_edges(p.keys[sent], buckets)
        for b in np.flatnonzero(np.diff(edges)).tolist():
            yield b, 0, zstandard.compress(pickle.dumps(p.context_bytes(p.one[sent[edges[b]:edges[b + 1]]]), 5), 3)
        _, h1, h2, order, new, number = hashed(p, codes)
        a, b2, several = h1[order[new]], h2[order[new]], np.bincount(number) > 1 if len(number) else np.zeros(0, bool)
        edges = bucket_edges(a, buckets)
        for b in np.flatnonzero(np.diff(edges)).tolist():
            lo, hi = edges[b], edges[b + 1]
            yield b, 1, (a[lo:hi], b2[lo:hi], np.packbits(several[lo:hi]))

    classes = answer(ask(chunks, buckets, send_triggers), _class_codes)
    once = told(chunks, classes, "classes")
    orders = answer(ask(once, buckets, send_contexts), _order_classes(length))

    def ranges(row):
        """The parse, and first byte and end of everything repeated."""
        p, codes = coded(row)
        code = codes[p.record]
        full = np.flatnonzero(np.isin(code, (REPEATED, REPEATED_SENT, REPEATED_HASHED)) & (p.low <= p.high))
        start, end = [p.x[full] - p.high[full]], [p.x[full] - p.low[full] + length]
        sent = np.flatnonzero((codes == SENT) | (codes == REPEATED_SENT))
        edges, got = bucket_edges(p.keys[sent], buckets), read_answers(row["orders"], 0)
        for b, v in got.items():
            offsets = np.frombuffer(zstandard.decompress(v), np.int16).reshape(-1, 2)
            x = p.x[p.one[sent[edges[b]:edges[b + 1]]]]
            hit = offsets[:, 0] >= 0
            start.append(x[hit] - offsets[hit, 0])
            end.append(x[hit] - offsets[hit, 1] + length)
        if (codes >= HASHED).any():
            begin, h1, _, order, new, number = hashed(p, codes)
            again = packed_answers(row["orders"], bucket_edges(h1[order[new]], buckets), np.uint8, 1)[number] > 0
            start.append(begin[again])
            end.append(begin[again] + length)
        return p, np.concatenate(start), np.concatenate(end)

    def finish(batch: pa.RecordBatch):
        for row in batch.to_pylist():
            p, start, end = ranges(row)
            gone = covered(p.n, start, end)
            cols: dict = {"doc_id": row["ids"], "n_bytes": (p.ends - p.base), "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": [], "spans": []}
            for a, b in zip(p.base.tolist(), p.ends.tolist(), strict=True):
                g = gone[a:b]
                edge = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8)))
                kept = p.buffer[a:b][~g].tobytes()
                cols["n_removed"].append(int(g.sum()))
                cols["n_spans"].append(len(edge) // 2)
                cols["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    cols["kept"].append(kept)
                    cols["spans"].append([{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)])
            yield cols

    final = told(once, orders, "orders")
    return arrow_map(final, finish, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
                     + (", kept binary, spans array<struct<start:bigint,end:bigint>>" if with_text else ""))
