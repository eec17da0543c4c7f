"""op6 and op8 against brute force: repeated byte strings and repeated word windows."""

import hashlib
import random
from collections import Counter

import pytest

from tests.llm.cases import by_id, docs, empty, null_id
from tests.conftest import SF001
from wearline.llm import prefix_free, suffix_trees
from wearline.sources.tables import table


def brute_bytes(rows, length):
    seen = Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        seen.update(b[k:k + length] for k in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                gone[k:k + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def brute_words(rows, window):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            x = tuple(w[k:k + window])
            if x in seen:
                gone[k:k + window] = [True] * window
            seen.add(x)
        kept = b" ".join(a for a, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def random_docs(spark):
    rnd = random.Random(2)
    rows = [(i, "".join(rnd.choice("ab ") for _ in range(rnd.randrange(0, 60)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a" * 100), (103, "a" * 100), (104, "é€" * 30), (105, "x" + "é€" * 30 + "y"), (106, "\x00" * 40), (107, "\x00" * 20 + "b")]
    return spark.createDataFrame(rows, "doc_id long, text string")


BYTES = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
WORDS = ("n_words", "n_removed", "kept_sha256")


@pytest.mark.parametrize("hot", [1024, 3])
def test_bytes_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(prefix_free, "HOT", hot)
    df = random_docs(spark)
    got = by_id(prefix_free.dedup_bytes(df, 20, chunk_bytes=500, key=8), *BYTES)
    assert got == brute_bytes([(r.doc_id, r.text) for r in df.collect()], 20)


def test_bytes_whole_table(spark):
    df = table(spark, SF001, "documents")
    got = by_id(prefix_free.dedup_bytes(df, chunk_bytes=60_000), *BYTES)
    assert got == brute_bytes([(r.doc_id, r.text) for r in df.collect()], 200)


def test_bytes_edges(spark):
    for df in (docs(spark, extra=True), null_id(spark), empty(spark)):
        got = by_id(prefix_free.dedup_bytes(df, 100), *BYTES)
        assert got == brute_bytes([(r.doc_id, r.text) for r in df.collect()], 100)


def test_bytes_text_and_spans(spark):
    df = spark.createDataFrame([(1, "A" + "b" * 30 + "C"), (2, "D" + "b" * 30)], "doc_id long, text string")
    got = {r.doc_id: r for r in prefix_free.dedup_bytes(df, 20, with_text=True, key=8).collect()}
    assert bytes(got[1].kept) == b"AC" and [(s.start, s.end) for s in got[1].spans] == [(1, 31)] and bytes(got[2].kept) == b"D"


@pytest.mark.parametrize(("window", "heavy"), [(5, 4096), (5, 3), (12, 4096)])
def test_words_match_brute_force(spark, monkeypatch, window, heavy):
    monkeypatch.setattr(suffix_trees, "HEAVY", heavy)
    df = random_docs(spark)
    got = by_id(suffix_trees.dedup_windows(df, window, chunk_bytes=300), *WORDS)
    assert got == brute_words([(r.doc_id, r.text) for r in df.collect()], window)


def test_words_whole_table(spark):
    df = table(spark, SF001, "documents")
    got = by_id(suffix_trees.dedup_windows(df, chunk_bytes=60_000), *WORDS)
    assert got == brute_words([(r.doc_id, r.text) for r in df.collect()], 20)


def test_words_edges(spark):
    for df in (docs(spark, extra=True), null_id(spark), empty(spark)):
        got = by_id(suffix_trees.dedup_windows(df), *WORDS)
        assert got == brute_words([(r.doc_id, r.text) for r in df.collect()], 20)


def test_words_text(spark):
    df = spark.createDataFrame([(1, "a b  c d e"), (2, "x a b c y")], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in suffix_trees.dedup_windows(df, 3, with_text=True).collect()}
    assert got == {1: "a b c d e", 2: "x y"}
