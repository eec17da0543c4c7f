"""Substring deduplication of word windows by prefix-partitioned suffix trees.

The suffix that begins at a word matters down to the depth of a window. A suffix is named by the prefix that
its window is found by: the ``PREFIX`` words whose hash is smallest in the window (so equal windows have equal
prefixes, and one word in seven begins a prefix). Prefixes that occur once have no repeats below them and are
left out; the others split the suffixes into groups of a bucket's size, and a prefix with more than ``HEAVY``
holders is lengthened to the whole window. A group's suffixes, sorted, are its subtree; nodes as deep as a
window with several leaves are the repeats, and their first leaf in document order is the one that stays.

Two exchanges of hashes (64 bits of the prefix and 64 of the window); the texts are never shuffled.

Defined results: null texts have no words; ids are integers, a null id comes last; rows with one id are
ordered by their text, equal rows as they are stored; documents with fewer words than a window lose none;
columns other than the id and the text are never read.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wearline.llm.chunks import ask, answer, bucket_count, bucket_edges, covered, pack, packed_answers, sliding_min, small, told, unpack
from wearline.llm.common import Words, arrow_map, mix

WINDOW, PREFIX, HEAVY = 20, 8, 64
_PLACE = np.uint64((1 << 28) - 1)
_ODD = np.random.default_rng(21).integers(0, 1 << 63, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _runs(h: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    n = len(h) - width + 1
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out += h[j:n + j] * _ODD[salt, j]
    return mix(out)


class Suffixes:
    """The suffixes of one chunk that are as deep as a window."""

    def __init__(self, data: list[bytes], window: int):
        self.words, self.window = Words(data), window
        h = self.words.hashes()
        n = len(h) - window + 1
        doc = self.words.doc
        self.start = np.flatnonzero(doc[:max(n, 0)] == doc[window - 1:]) if n > 0 else np.zeros(0, np.int64)
        self.prefix_keys, self.prefix_of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(self.start):
            prefix = min(PREFIX, window)
            grams = _runs(h, prefix)
            packed = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
            at = (sliding_min(packed, window - prefix + 1)[self.start] & _PLACE).astype(np.int64)
            # one entry per place at which a prefix begins; a key held at two places occurs twice
            places = np.unique(at)
            self.prefix_keys, inverse, counts = np.unique(grams[places], return_inverse=True, return_counts=True)
            self.several = counts > 1
            self.prefix_of = inverse[np.searchsorted(places, at)]
            self.h = h
        else:
            self.several = np.zeros(0, bool)

    def groups(self, codes: np.ndarray):
        """The distinct suffixes whose prefix occurs again: sorted group and window hashes, the place of the
        first in the chunk, and for every such suffix its start and its number among the distinct ones."""
        code = codes[self.prefix_of]
        live = np.flatnonzero(code)
        if not len(live):
            none = np.zeros(0, np.int64)
            return none.view(np.uint64), none.view(np.uint64), none, none, none
        start = self.start[live]
        deep, other = _runs(self.h, self.window)[start], _runs(self.h, self.window, 1)[start]
        group = np.where(code[live] == 2, other, self.prefix_keys[self.prefix_of[live]])
        order = np.lexsort((deep, group))  # stable: equal suffixes in document order
        g, d = group[order], deep[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        return g[new], d[new], start[order[new]], start, number


def _prefix_codes(kind: int, chunks: list[int], payloads: list):
    """0: the prefix occurs once; 1: again; 2: again, and has many holders."""
    keys = np.concatenate([p[0] for p in payloads])
    seen = np.concatenate([1 + np.unpackbits(p[1], count=len(p[0])).astype(np.int64) for p in payloads])
    _, inverse = np.unique(keys, return_inverse=True)
    total = np.bincount(inverse, seen)[inverse]
    codes, at = np.where(total > HEAVY, 2, total > 1).astype(np.uint8), 0
    for p in payloads:
        yield small(codes[at:at + len(p[0])])
        at += len(p[0])


def _first_leaves(kind: int, chunks: list[int], payloads: list):
    """1 for each distinct suffix of a chunk if no other chunk holds an earlier one."""
    group, deep = np.concatenate([p[0] for p in payloads]), np.concatenate([p[1] for p in payloads])
    doc = np.concatenate([p[3][p[2]] for p in payloads])
    sender = np.repeat(np.arange(len(payloads)), [len(p[0]) for p in payloads])
    order = np.lexsort((sender, doc, deep, group))
    g, d = group[order], deep[order]
    first = np.zeros(len(order), np.uint8)
    first[order] = np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])]) if len(order) else False
    at = 0
    for p in payloads:
        yield small(first[at:at + len(p[0])])
        at += len(p[0])


def _doc_numbers(ids: list) -> np.ndarray:
    last = np.iinfo(np.int64).max
    return np.array([last if i is None else i for i in ids], np.int64)


def dedup_windows(docs: DataFrame, window: int = WINDOW, with_text: bool = False, chunk_bytes: int | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256`` (with ``with_text`` also ``kept``, the words
    that stay, joined by one space). A word goes if it lies in a window of ``window`` words that also begins
    earlier: in a document of smaller id, or before in the same one."""
    chunks = pack(docs, "words", chunk_bytes)
    buckets = bucket_count(chunks)

    def send_prefixes(row):
        s = Suffixes(unpack(row["blob"]), window)
        edges = bucket_edges(s.prefix_keys, buckets)
        for b in np.flatnonzero(np.diff(edges)).tolist():
            lo, hi = edges[b], edges[b + 1]
            yield b, 0, (s.prefix_keys[lo:hi], np.packbits(s.several[lo:hi]))

    def regroup(row):
        s = Suffixes(unpack(row["blob"]), window)
        return s, s.groups(packed_answers(row["prefixes"], bucket_edges(s.prefix_keys, buckets), np.uint8))

    def send_suffixes(row):
        s, (group, deep, place, _, _) = regroup(row)
        edges, doc, numbers = bucket_edges(group, buckets), s.words.doc[place], _doc_numbers(row["ids"])
        for b in np.flatnonzero(np.diff(edges)).tolist():
            lo, hi = edges[b], edges[b + 1]
            used, at = np.unique(doc[lo:hi], return_inverse=True)
            yield b, 0, (group[lo:hi], deep[lo:hi], at.astype(np.uint32 if len(used) > 65535 else np.uint16), numbers[used])

    prefixes = answer(ask(chunks, buckets, send_prefixes), _prefix_codes)
    once = told(chunks, prefixes, "prefixes")
    leaves = answer(ask(once, buckets, send_suffixes), _first_leaves)

    def finish(batch: pa.RecordBatch):
        for row in batch.to_pylist():
            s, (group, _, place, start, number) = regroup(row)
            first = packed_answers(row["leaves"], bucket_edges(group, buckets), np.uint8).astype(bool)
            later = ~(first[number] & (start == place[number])) if len(start) else np.zeros(0, bool)
            gone = covered(len(s.words.doc), start[later], start[later] + window)
            cols: dict = {"doc_id": row["ids"], "n_words": s.words.count, "n_removed": [], "kept_sha256": [], "kept": []}
            for data, a, n in zip(unpack(row["blob"]), s.words.first.tolist(), s.words.count.tolist(), strict=True):
                words, out = data.split(), gone[a:a + n]
                lost = int(out.sum())
                kept = b" ".join(compress(words, ~out) if lost else words)
                cols["n_removed"].append(lost)
                cols["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    cols["kept"].append(kept.decode())
            yield cols

    final = told(once, leaves, "leaves")
    return arrow_map(final, finish, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept string" if with_text else ""))
