"""op1, op9 and op10: exact recursions, proper probabilities, held-out accuracy, parity and round trips."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF01, SF001
from tests.llm.cases import docs, empty, null_id
from wearline.llm import hmm, quality
from wearline.llm import sentencepiece_backend as pieces
from wearline.llm.common import arrow_map
from wearline.sources.tables import table


def forward_backward(m, x):
    n, k = len(x), len(m.start)
    a, b = np.zeros((n, k)), np.ones((n, k))
    a[0] = m.start * m.emit[x[0]]
    for t in range(1, n):
        a[t] = a[t - 1] @ m.move * m.emit[x[t]]
    for t in range(n - 2, -1, -1):
        b[t] = m.move @ (m.emit[x[t + 1]] * b[t + 1])
    like = a[-1].sum()
    moves = sum((np.outer(a[t], m.emit[x[t + 1]] * b[t + 1]) * m.move / like for t in range(n - 1)), np.zeros((k, k)))
    return np.log10(like), a * b / like, moves


def test_recursions_match_plain_forward_backward():
    rng, size, k = np.random.default_rng(1), 30, 4
    m = hmm.Model.first(np.ones(size) / size, k, 3)
    seqs = [rng.integers(0, size, n).astype(np.int32) for n in (1, 2, 5, 9, 9, 40)]
    emit, move, start, out = np.zeros((size, k)), np.zeros((k, k)), np.zeros(k), np.zeros(len(seqs))
    for rows, part in hmm.slices_of(seqs):
        part.expected(m, emit, move, start)
        out[rows] = part.forward(m)[0]
    e, v, s = np.zeros((size, k)), np.zeros((k, k)), np.zeros(k)
    for i, x in enumerate(seqs):
        like, post, moves = forward_backward(m, x)
        assert abs(like - out[i]) < 1e-5
        np.add.at(e, x, post)
        v, s = v + moves, s + post[0]
    assert np.allclose(e, emit, atol=1e-4) and np.allclose(v, move, atol=1e-4) and np.allclose(s, start, atol=1e-4)


def brute_base(rows):
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    words = [(i, [*(t or "").encode().lower().split(), b"\n"]) for i, t in rows]
    count = Counter(w for i, ws in words if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    out = [(i, held[i], len(ws), sum(w in count for w in ws), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in words]
    return sorted(out, key=repr)


def assert_base(got, want):
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (repr(r.doc_id), r.n_tokens, r.base_score)), sorted(want, key=lambda r: (repr(r[0]), r[2], r[5])), strict=True):
        assert (g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens) == w[:5] and g.base_score == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        assert math.isfinite(g.score)


def test_language_model_counts_and_gain(spark, monkeypatch):
    df = table(spark, SF001, "documents")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    for lookup, head in ((1 << 20, 1 << 15), (200, 50)):  # few words travel with the tasks: the rest is joined
        monkeypatch.setattr(hmm, "LOOKUP", lookup)
        monkeypatch.setattr(hmm, "HEAD", head)
        got = hmm.score(df, states=3, rounds=2).collect()
        assert_base(got, brute_base(rows))
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_language_model_edges(spark):
    for df in (docs(spark, extra=True), null_id(spark), empty(spark)):
        assert_base(hmm.score(df, states=2, rounds=1).collect(), brute_base([(r.doc_id, r.text) for r in df.collect()]))
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:2]  # nothing to learn from
    df = spark.createDataFrame([(i, "some words") for i in held], "doc_id long, text string")
    assert_base(hmm.score(df, states=2, rounds=1).collect(), brute_base([(i, "some words") for i in held]))


def test_language_model_is_a_distribution(spark):
    """Over all texts of one word of a closed vocabulary and the end, the model's probabilities of the next token sum to 1."""
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 != 1]
    df = spark.createDataFrame([(i, " ".join(["a", "b", "c"][: 1 + i % 3])) for i in ids], "doc_id long, text string").withColumn(
        "text", F.coalesce("text", F.lit(""))).withColumn("held_out", F.lit(False))
    alphabet = hmm.Alphabet(hmm.count_words(df.select(F.col("text").cast("binary").alias("text"))))
    assert alphabet.prior.sum() == pytest.approx(1.0)
    model = hmm.Model.first(alphabet.prior, 3)
    assert np.allclose(model.emit.sum(0), 1) and np.allclose(model.move.sum(1), 1)
    updated = model.update(np.ones(3), np.ones((3, 3)), model.emit * 10, alphabet.prior)
    assert np.allclose(updated.emit.sum(0), 1) and np.allclose(updated.move.sum(1), 1) and updated.start.sum() == pytest.approx(1)


def test_training_raises_the_likelihood(spark):
    df = table(spark, SF001, "documents").select("doc_id", F.col("text").cast("binary").alias("text")).withColumn("held_out", F.lit(False))
    vocab = hmm.count_words(df.select("text")).cache()
    alphabet = hmm.Alphabet(vocab)
    _, history = hmm.train(hmm.encode(df, alphabet), alphabet, 3, 4)
    assert all(b > a for a, b in zip(history, history[1:], strict=False))


def test_quality_held_out(spark):
    d, labels = table(spark, SF01, "documents"), table(spark, SF01, "labels")
    got = quality.score(d, labels)
    assert got.count() == d.count() and got.where("score < 0 or score > 1 or predicted <> int(score >= 0.7)").count() == 0
    both = got.join(labels, "doc_id").where("held_out").select((F.col("predicted") == F.col("quality")).cast("int").alias("right"), "quality").groupBy("quality").avg("right").collect()
    assert all(r["avg(right)"] > 0.9 for r in both)
    flags = {r.doc_id: r.held_out for r in got.select("doc_id", "held_out").collect()}
    assert flags == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in flags}


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1), (10, 1), (12, 0), (12, 1), (8, 0), (9, 0), (13, None), (None, 1), (16, 7)], "doc_id long, quality int")
    for df in (docs(spark, extra=True), null_id(spark), empty(spark)):
        assert quality.score(df, labels).count() == df.count()
        kept = quality.reject_junk(df, labels)
        assert kept.columns == df.columns and kept.count() <= df.count()
    none = quality.score(docs(spark), labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]
    single = quality.score(docs(spark), spark.createDataFrame([(1, 1), (10, 1)], "doc_id long, quality int")).select("score").distinct().collect()
    assert [r.score for r in single] == [1.0]


def test_discriminant_matches_densities():
    rng = np.random.default_rng(0)
    parts = {c: (500.0, rng.normal(size=quality.D), np.cov(rng.normal(size=(3 * quality.D, quality.D)).T)) for c in (0, 1)}
    model = quality.Discriminant(parts, pooled=0.0, ridge=0.0)
    x = rng.normal(size=(5, quality.D))

    def log_density(c):
        _, m, s = parts[c]
        return np.array([-0.5 * (v - m) @ np.linalg.solve(s, v - m) - 0.5 * np.linalg.slogdet(s)[1] for v in x])

    assert np.allclose(model.score(x), 1 / (1 + np.exp(log_density(0) - log_density(1))))


HARD = ["", " ", "a ", "  x  y ", "▁a\n\nb <s> <0x41> \U0001F600 é", "a" * 3000, " " * 5000, "▁▁ x▁", "naïve café\t\x00 end", "</s><unk>"]


@pytest.fixture(scope="module")
def model():
    return pieces.read_model(pieces.MODEL)


def test_encoding_equals_the_other_library(spark, model, monkeypatch):
    import sentencepiece

    peer = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = HARD + [r.text for r in table(spark, SF001, "documents").limit(60).collect()]
    codec = pieces.Codec(model)
    got = codec.encode(texts)
    assert [a.tolist() for a, _ in got] == peer.encode(texts) and all(ok for _, ok in got)
    assert codec.decode([a for a, _ in got]) == [codec.plain(t) for t in texts]
    monkeypatch.setattr(pieces, "SLICE", 700)
    monkeypatch.setattr(pieces, "REMEMBER", 50)
    monkeypatch.setattr(pieces, "GROUP", 7)
    again = pieces.Codec(model).encode(texts)
    assert all((a[0] == b[0]).all() for a, b in zip(got, again, strict=True))


def test_wrong_ids_fail_the_round_trip(spark, model, monkeypatch):
    """The decoded text comes from the ids, not from the input; bytes that are no UTF-8 take the library's way."""
    codec = pieces.Codec(model)
    (ids, _), (other, _) = codec.encode(["every id of this text counts", "x"])
    assert codec.decode([np.concatenate([ids, other]), ids[:-1]]) != ["every id of this text counts"] * 2
    torn = np.array([codec.tokenizer.token_to_id("<0xE2>")], np.int32)
    assert codec.decode([torn, ids]) == [codec.tokenizer.decode(torn.tolist()), "every id of this text counts"]

    encode = pieces.Codec.encode
    monkeypatch.setattr(pieces.Codec, "encode", lambda self, t: [(x[::-1], ok) for x, ok in encode(self, t)])
    rows = pieces.encode(docs(spark, data=[(1, "the ids of this one are turned round", None, None, None)]), model).collect()
    assert [r.round_trip for r in rows] == [False]


def test_later_tasks_find_the_codec(spark, model):
    import os

    def of(batch):
        tool = pieces.codec(model)
        tool.tasks = getattr(tool, "tasks", 0) + 1
        yield {"pid": [os.getpid()], "tasks": [tool.tasks]}

    got = arrow_map(spark.range(0, 120, 1, 60), of, "pid long, tasks long").collect()
    workers = {r.pid for r in got}
    assert sum(r.tasks == 1 for r in got) <= len(workers) and max(r.tasks for r in got) > 1


def test_memory_of_units_is_bounded(model, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBER", 200_000)
    codec = pieces.Codec(model)
    for k in range(6):
        codec.encode([" ".join(f"u{k}x{i}" for i in range(800))])
        assert codec.held <= 200_000 + 800 * (pieces.ENTRY + 60) and codec.flat.n <= len(codec.flat.rows)


def test_encode_and_decode_tables(spark, model):
    for df in (docs(spark, extra=True), null_id(spark), empty(spark)):
        out = pieces.encode(df, model)
        assert out.count() == df.count() and out.where("not (parity and round_trip)").count() == 0
        back = pieces.decode(out, model)
        want = Counter((r.doc_id, (r.text or "").replace(pieces.MARK, " ")) for r in df.collect())
        assert Counter((r.doc_id, r.text) for r in back.collect()) == want
    odd = spark.createDataFrame([(1, None), (2, [5, None, -1, 10**6])], "doc_id long, ids array<int>")
    assert {r.doc_id: len(r.text) > 0 for r in pieces.decode(odd, model).collect()} == {1: False, 2: True}


def tiny_unigram() -> bytes:
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.trainer_spec.model_type = 1
    m.trainer_spec.byte_fallback = True
    m.trainer_spec.unk_id = 0
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces = "identity", True, False
    m.normalizer_spec.escape_whitespaces = True
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *[(f"<0x{i:02X}>", 0, 6) for i in range(256)],
                               ("▁", -2.0, 1), ("▁the", -3.0, 1), ("▁t", -5.0, 1), ("h", -4.0, 1), ("e", -4.0, 1), ("he", -4.5, 1), ("c", -4.0, 1), ("a", -4.0, 1), ("t", -4.0, 1), ("at", -4.2, 1)]:
        p = m.pieces.add()
        p.piece, p.score, p.type = piece, score, kind
    return m.SerializeToString()


def test_unigram_models_are_rebuilt_too():
    import sentencepiece

    data = tiny_unigram()
    peer, codec = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Codec(data)
    texts = ["the cat", "hat  the", "the ☃ that", ""]
    got = codec.encode(texts)
    assert [a.tolist() for a, _ in got] == peer.encode(texts)
    assert codec.decode([a for a, _ in got]) == texts
