"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed on the driver; its bytes (a fixed file) travel to the tasks, where
the normaliser, the metaspace marker, the piece model (unigram scores, or merges ranked by the
scores of a BPE model) and the byte fallback are rebuilt once per worker and kept from task to task.

A piece never holds a marker after another character (checked when the model is read), so no
segmentation crosses from a character to a marker. Texts are cut there into units; every distinct
unit is encoded once, in multithreaded batches, and a text's ids are those of its units in order.
Without that property the unit is the whole text.

Parity with the sentencepiece library is verified for every document: each of its units is encoded
by both libraries, must get the same ids, and must be given back by decoding them.

Every document's own ids are decoded, from a table of the bytes that each piece stands for (ids whose bytes are no
UTF-8, and models with cleaning rules of their own, go through the library's decoder); the digest and the round trip
are of that text.

Defined results: null and empty texts have no ids and decode to the empty text; characters without
a piece become byte pieces; texts of any length are processed whole in bounded slices; columns
other than the id and the text are never read.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import arrow_map, per_worker

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: characters worked on at once, bytes of units and their ids that a worker remembers
SLICE, REMEMBER = 1 << 19, 64 << 20
#: bytes that one remembered unit takes besides its characters and ids (dictionary entry, string, offsets)
ENTRY = 180
#: units encoded as one pre-split text, and at once
GROUP, BATCH = 1000, 20_000
_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def parse(model: bytes):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(model)
    return proto


def merges(pieces: dict[str, float]) -> list[tuple[str, str]]:
    """The merges of a BPE model: every split of a piece into two pieces, best piece first."""
    ids = {p: i for i, p in enumerate(pieces)}
    found = []
    for piece, score in pieces.items():
        splits = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in ids and piece[i:] in ids]
        found += [(-score, ids[piece], ids[a], ids[b], a, b) for a, b in splits]
    return [x[-2:] for x in sorted(found)]


def build(model: bytes):
    """The rebuilt ``tokenizers.Tokenizer`` of a SentencePiece model."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    proto = parse(model)
    spec, norm = proto.trainer_spec, proto.normalizer_spec
    fallback = any(p.type == _BYTE for p in proto.pieces)
    vocab = {p.piece: i for i, p in enumerate(proto.pieces)}
    if spec.model_type == _UNIGRAM:
        core = models.Unigram([(p.piece, p.score) for p in proto.pieces], unk_id=spec.unk_id, byte_fallback=fallback)
    elif spec.model_type == _BPE:
        ranked = merges({p.piece: p.score for p in proto.pieces if p.type in (_NORMAL, _USER)})
        core = models.BPE(vocab, ranked, unk_token=proto.pieces[spec.unk_id].piece, fuse_unk=True, byte_fallback=fallback)
    else:
        raise ValueError(f"model type {spec.model_type} is neither unigram nor BPE")
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(norm.precompiled_charsmap)] if norm.precompiled_charsmap else []
    if norm.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if norm.add_dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    out.add_tokens([AddedToken(p.piece, normalized=True) for p in proto.pieces if p.type == _USER])
    ends = [decoders.Strip(" ", 1, 0)] if norm.add_dummy_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *ends])
    return out


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer, decoders

        proto = parse(model)
        self.tokenizer = build(model)
        self.peer = sentencepiece.SentencePieceProcessor(model_proto=model)
        bytes_ = np.array([p.type == _BYTE for p in proto.pieces])
        self.is_byte = bytes_
        #: UTF-8 bytes of each piece, as it is cut from a normalised text
        self.width = np.where(bytes_, 1, [len(p.piece.encode()) for p in proto.pieces])
        #: bytes that each piece is decoded to, one after another, and where they begin
        plain = [bytes([int(p.piece[1:-1], 16)]) if p.type == _BYTE else p.piece.replace(MARK, " ").encode() for p in proto.pieces]
        self.bytes = np.frombuffer(b"".join(plain), np.uint8)
        self.size = np.array([len(x) for x in plain], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.prefix = MARK if proto.normalizer_spec.add_dummy_prefix else ""
        plain = not (proto.normalizer_spec.remove_extra_whitespaces or proto.normalizer_spec.precompiled_charsmap)
        inside = any(MARK in p.piece.lstrip(MARK) for p in proto.pieces)
        user = any(p.type == _USER for p in proto.pieces)
        cuts = plain and bytes_.any() and not inside and not user
        self.units = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall if cuts else None
        if self.units:
            self.unit_tokenizer = Tokenizer(self.tokenizer.model)
            self.unit_tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        self._forget()

    def _forget(self) -> None:
        #: unit -> its number; by number: where its ids end in ``flat``, and whether both libraries agree and decoding gives it back
        self.known: dict[str, int] = {}
        self.flat, self.end, self.good = Column(np.int32), Column(np.int64), Column(bool)
        self.end.add(np.zeros(1, np.int64))
        self.held = 0

    def normalise(self, text: str) -> str:
        if self.units is None:
            return self.tokenizer.normalizer.normalize_str(text)
        return self.prefix + text.replace(" ", MARK) if text else ""

    def plain(self, text: str) -> str:
        """What decoding a text's ids has to give."""
        return self.normalise(text).replace(MARK, " ").removeprefix(" " if self.prefix else "")

    def _one(self, unit: str) -> tuple[list[int], bool]:
        """A unit by itself: ids, and whether all agrees."""
        ours = self.unit_tokenizer.encode(unit, add_special_tokens=False).ids
        peer = self.peer.encode(unit.removeprefix(self.prefix)) if unit != self.prefix else [self.peer.piece_to_id(MARK)]
        return ours, ours == peer and self.unit_tokenizer.decode(ours, skip_special_tokens=False) == unit.replace(MARK, " ")

    def _learn(self, units: set[str]) -> None:
        """Encode the units not known yet: groups of them in one multithreaded batch, checked group by group
        (units one after another are a text too), a group that differs unit by unit."""
        if self.held > REMEMBER:
            self._forget()
        new = [u for u in units if u not in self.known]
        for at in range(0, len(new), BATCH):
            groups = [new[i:i + GROUP] for i in range(at, min(at + BATCH, len(new)), GROUP)]
            ours = [e.ids for e in self.unit_tokenizer.encode_batch_fast(groups, is_pretokenized=True, add_special_tokens=False)]
            whole = ["".join(g) for g in groups]
            back = self.unit_tokenizer.decode_batch(ours, skip_special_tokens=False)
            # the units of a group that don't begin with a marker would run together, as a text's first unit may
            apart = [all(u[0] == MARK for u in g) and not any(a[-1] == MARK for a in g) for g in groups]
            peers = self.peer.encode([w.removeprefix(self.prefix) for w in whole], num_threads=2)
            for g, ids, w, d, p, fit in zip(groups, ours, whole, back, peers, apart, strict=True):
                got, ends = np.array(ids, np.int32), np.cumsum([len(u.encode()) for u in g])
                have = np.cumsum(self.width[got])
                last = np.searchsorted(have, ends)
                if fit and ids == p and d == w.replace(MARK, " ") and len(have) and have[-1] == ends[-1] and (have[last] == ends).all():
                    self._add(g, got, last + 1, np.ones(len(g), bool))
                else:
                    single = [self._one(u) for u in g]
                    self._add(g, np.concatenate([np.array(x, np.int32) for x, _ in single]), np.cumsum([len(x) for x, _ in single]), np.array([ok for _, ok in single]))

    def _add(self, units: list[str], ids: np.ndarray, ends: np.ndarray, good: np.ndarray) -> None:
        n = len(self.known)
        self.known.update(zip(units, range(n, n + len(units)), strict=True))
        self.end.add(self.end.rows[self.end.n - 1] + ends)
        self.flat.add(ids)
        self.good.add(good)
        self.held += ENTRY * len(units) + sum(map(len, units)) + 4 * len(ids)

    def _cut(self, text: str) -> list[str]:
        """A normalised text in slices that end where a unit does."""
        out, at = [], 0
        while len(text) - at > SLICE:
            end = re.compile(f"[^{MARK}]{MARK}").search(text, at + SLICE - 1)
            if not end:
                break
            out.append(text[at:end.start() + 1])
            at = end.start() + 1
        return [*out, text[at:]]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bool]]:
        """Ids of each text, and whether both libraries agree on them and decode them to the text."""
        if self.units is None:
            ours = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            peers, back = self.peer.encode(texts, num_threads=2), self.tokenizer.decode_batch(ours, skip_special_tokens=False)
            return [(np.array(a, np.int32), a == b and d == self.plain(t)) for a, b, d, t in zip(ours, peers, back, texts, strict=True)]
        out: list[list] = [[] for _ in texts]
        pieces = [(i, piece) for i, t in enumerate(texts) for piece in self._cut(self.normalise(t))]
        for a, b in slices([len(p) for _, p in pieces]):
            units = [self.units(p) for _, p in pieces[a:b]]
            self._learn(set(chain.from_iterable(units)))
            flat, start, good = self.flat.rows, self.end.rows, self.good.rows
            at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(units)), np.int64)
            n = start[at + 1] - start[at]
            ids = flat[np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            edge = np.cumsum([len(u) for u in units])
            ends = np.concatenate([[0], np.cumsum(n)])
            for (i, _), lo, hi in zip(pieces[a:b], edge - [len(u) for u in units], edge, strict=True):
                out[i].append((ids[ends[lo]:ends[hi]], bool(good[at[lo:hi]].all())))
        return [(p[0][0] if len(p) == 1 else np.concatenate([x for x, _ in p]), all(ok for _, ok in p)) for p in out]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        if self.units is None:
            return self._library(ids)
        every = np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64)
        size = self.size[every]
        ends = np.cumsum(size)
        data = self.bytes[np.repeat(self.at[every] - (ends - size), size) + np.arange(size.sum())].tobytes()
        edge = np.concatenate([[0], ends])[np.cumsum([0, *map(len, ids)])]
        out = []
        for x, a, b in zip(ids, edge, edge[1:], strict=False):
            try:
                out.append(data[a:b].decode().removeprefix(" " if self.prefix else ""))
            except UnicodeDecodeError:
                out += self._library([x])
        return out

    def _library(self, ids: list[np.ndarray]) -> list[str]:
        return self.tokenizer.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)


class Column:
    """Rows of one type that grow in place."""

    def __init__(self, kind):
        self.rows, self.n = np.zeros(1 << 12, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros(max(len(more), len(self.rows) // 2), self.rows.dtype)])
        self.rows[self.n:self.n + len(more)] = more
        self.n += len(more)


def codec(model: bytes) -> Codec:
    """The worker's codec: made by its first task, found by all later ones."""
    return per_worker("codec", hashlib.sha256(model).digest(), lambda: Codec(model))


def slices(lengths: list[int], limit: int = SLICE):
    """Consecutive ranges of rows of about ``limit`` characters (one row at least)."""
    start, held = 0, 0
    for i, n in enumerate(lengths):
        held += n
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per document: id, ``n_tokens``, ``n_fallback`` (byte pieces), ``ids_sha256`` (of the ids as
    little-endian 32-bit numbers), ``decoded_sha256``, ``round_trip`` (decoding gives the text as the model
    normalises it), ``parity``; with ``with_ids`` also ``ids`` and the decoded text."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"doc_id {kind}, n_tokens bigint, n_fallback bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean, parity boolean"
              + (", ids array<int>, decoded string" if with_ids else ""))

    def of(batch: pa.RecordBatch):
        tool = codec(model)
        column, ids_of = batch.column("text"), batch.column("doc_id")
        for a, b in slices(pa.compute.utf8_length(column).to_pylist()):
            texts = column.slice(a, b - a).to_pylist()
            got = tool.encode(texts)
            arrays = [g[0] for g in got]
            decoded = tool.decode(arrays)
            cols = {
                "doc_id": ids_of.slice(a, b - a), "n_tokens": [len(x) for x in arrays],
                "n_fallback": [int(tool.is_byte[x].sum()) for x in arrays],
                "ids_sha256": [hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in arrays],
                "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in decoded],
                "round_trip": [d == tool.plain(t) for d, t in zip(decoded, texts, strict=True)],
                "parity": [g[1] for g in got],
            }
            yield cols | ({"ids": arrays, "decoded": decoded} if with_ids else {})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return arrow_map(rows, of, schema)


def decode(rows: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of id arrays: ``(doc_id, text)``; null arrays decode to the empty text, null or unknown ids
    within one are left out."""
    kind = rows.schema[id_col].dataType.simpleString()

    def of(batch: pa.RecordBatch):
        tool = codec(model)
        size = tool.tokenizer.get_vocab_size()
        ids = [np.array([i for i in x or () if i is not None and 0 <= i < size], np.int32) for x in batch.column("ids").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "text": tool.decode(ids)}

    return arrow_map(rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")), of, f"doc_id {kind}, text string")
