"""op2, op3 and op4 against brute force."""

import hashlib
import random

import numpy as np
import pytest

from tests.conftest import SF001
from tests.llm.cases import DOCS, by_id, docs, empty, null_id
from wearline.llm import edit_fingerprint as edit
from wearline.llm import lattice, minhash
from wearline.llm.common import components
from wearline.sources.tables import table


class Union:
    def __init__(self, nodes):
        self.up = {i: i for i in nodes}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("local", [1 << 20, -1])
def test_components(spark, monkeypatch, local):
    from wearline.llm import common
    monkeypatch.setattr(common, "LOCAL_LINKS", local)
    rnd = random.Random(3)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(400, 450)] + [(None, 3), (7, None), (9, 9)]
    union = Union({x for e in edges for x in e if x is not None})
    for a, b in edges:
        if a is not None and b is not None:
            union.link(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: union.find(x) for x in got}
    assert {x for x in union.up if any(union.find(x) == union.find(y) and x != y for y in union.up)} <= set(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_sets(rows, width):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(s)
    union = Union([i for i in sets if i is not None])
    flat = [(i, s) for i, ss in sets.items() if i is not None for s in ss]
    for x, (i, a) in enumerate(flat):
        for j, b in flat[:x]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                union.link(i, j)
    return sorted(((i, len(s), union.find(i) if i is not None else None, i is None or union.find(i) == i) for i, ss in sets.items() for s in ss), key=repr)


NEAR = ("n_shingles", "component_id", "kept")


@pytest.mark.parametrize("width", [2, 5])
def test_minhash_whole_table(spark, width):
    df = table(spark, SF001, "documents")
    assert by_id(minhash.classes(df, width), *NEAR) == brute_sets([(r.doc_id, r.text) for r in df.collect()], width)


def test_minhash_edges(spark):
    for df in (docs(spark, extra=True), null_id(spark), empty(spark)):
        assert by_id(minhash.classes(df), *NEAR) == brute_sets([(r.doc_id, r.text) for r in df.collect()], 2)


def test_minhash_broadcasts_no_table_with_a_row_a_document(spark):
    plan = minhash.classes(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_minhash_groups_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rnd = random.Random(1)
    rows = []
    for i in range(60):
        w = [f"w{k}" for k in range(60)]
        for _ in range(rnd.randrange(1, 5)):
            w[rnd.randrange(60)] = f"z{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(minhash.classes(df), *NEAR) == brute_sets(rows, 2)


def test_minhash_last_round_bounds_both_sides(spark, monkeypatch):
    """A candidate group in which hardly anything links: nearly all members are outside its largest class."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    seen, blocks = [], minhash._blocks

    def spy(members, *args, cross=False):
        if cross:
            keys = [c for c in ("component", "block", "other") if c in members.columns]
            seen.extend(r["count"] for r in members.groupBy(*keys, "foreign").count().collect())
        return blocks(members, *args, cross=cross)

    monkeypatch.setattr(minhash, "_blocks", spy)
    rnd = random.Random(2)
    rows = []
    for i in range(160):  # two pages share about half of their words' pairs
        rows.append((i, " ".join([f"w{k}" for k in range(70)] + [f"z{rnd.randrange(10**6)}" for _ in range(28)])))
    rows += [(200 + i, rows[i][1] + " end") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(minhash.classes(df), *NEAR) == brute_sets(rows, 2)
    assert seen and max(seen) < 3 * 16


def test_keep_one_leaves_one_of_each_class(spark):
    df = docs(spark, extra=True)
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert len(ids) == len(set(ids)) and {1, 2, 3, 4, 10} <= set(ids) and not {5, 6, 11, 12} & set(ids)


def brute_vectors(rows, threshold=0.95):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    union, n = Union([i for i, _ in ok]), {i: 0 for i, _ in ok}
    for k, (i, a) in enumerate(ok):
        for j, b in ok[:k]:
            if len(a) == len(b) and (a / np.abs(a).max()) @ (b / np.abs(b).max()) >= threshold * np.linalg.norm(a / np.abs(a).max()) * np.linalg.norm(b / np.abs(b).max()):
                union.link(i, j)
                n[i] += 1
                n[j] += 1
    return {i: (n.get(i, 0), union.find(i) if i in n else i) for i, _ in rows}


@pytest.mark.parametrize("block", [256, 8])
def test_lattice(spark, monkeypatch, block):
    monkeypatch.setattr(lattice, "BLOCK", block)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 16))
    rows = [(i, (base[i % 12] + rng.normal(size=16) * 0.05 * (i % 5)).tolist()) for i in range(120)]
    rows += [(200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, [None] + [1.0] * 15), (204, []), (205, [1e300] * 16), (206, [1.0] * 16),
             (207, [1.0] * 3), (208, [2.0] * 3), (209, [float("inf")] * 16)] + [(300 + i, base[0].tolist()) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as cell", "'x' as rep", "2 as label")
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_classes(df).collect()}
    want = brute_vectors(rows)
    assert set(got) == set(want)
    links = sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in got) and sum(n for n, _ in got.values()) >= 0.98 * links
    assert sum(got[i] != want[i] for i in got) <= 3
    assert lattice.near_classes(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_lattice_null_id_and_floats(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [2.0, 4.0])], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_classes(df).collect()}
    assert got == {None: (0, None, True), 1: (1, 1, True), 2: (1, 1, False)}


def test_e8_decoding_is_nearest():
    y = np.random.default_rng(0).normal(0, 2, (300, 8))
    c = lattice.nearest(y)
    assert len(lattice._STEPS) == 240
    best = ((y - c) ** 2).sum(1)
    assert all((((y - c - s) ** 2).sum(1) >= best - 1e-9).all() for s in lattice._STEPS)


def brute_edits(rows):
    src = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0))
    prints, out = edit.fingerprints([t for _, t in src]), {}
    for k, (i, t) in enumerate(src):
        nxt, half = src[(k + 1) % len(src)][1], len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        (other,) = edit.fingerprints([edited])
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), edit.as_text(*prints[k]), edit.as_text(*other), edit.likeness(*prints[k], *other),
                  edit.likeness(*prints[k], *prints[(k + 1) % len(src)]))
    return out


EDIT = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@pytest.mark.parametrize("parts", [1, 7])
def test_edit_fingerprints(spark, parts):
    df = table(spark, SF001, "documents")
    got = {r.doc_id: tuple(r[c] for c in EDIT) for r in edit.edits(df, parts).collect()}
    assert got == brute_edits([(r.doc_id, r.text) for r in df.collect()])
    assert sum(r[4] > r[5] for r in got.values()) > 0.95 * len(got)


def test_edit_edges(spark):
    rows = [r for k, r in enumerate(docs(spark, extra=True).collect()) if k != 15]  # one row per id
    df = spark.createDataFrame([tuple(r)[:5] for r in rows], DOCS)
    got = {r.doc_id: tuple(r[c] for c in EDIT) for r in edit.edits(df).collect()}
    assert got == brute_edits([(r.doc_id, r.text) for r in rows])
    assert edit.edits(null_id(spark)).count() == null_id(spark).count() and edit.edits(empty(spark)).count() == 0
    lone = edit.edits(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert lone.near_next == 1.0 and lone.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()


def test_edit_distance_and_classes(spark):
    assert edit.edit_distance("kitten", "sitting") == 3 and edit.edit_distance("", "abc") == 3 and edit.edit_distance("flaw", "lawn") == 2
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abcdefgh ") for _ in range(300)) for _ in range(6)]
    rows = [(k * 10 + j, t if j == 0 else t[:j * 20] + "xy" + t[j * 20 + j:]) for k, t in enumerate(texts) for j in range(4)] + [(900, None), (901, ""), (902, texts[0])]
    got = {r.doc_id: r.class_id for r in edit.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 10 * 10 for i in range(60) if i % 10 < 4} | {900: 900, 901: 900, 902: 0}
