"""op12: the postorder log, proofs and the manifest against a level-by-level tree."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.conftest import SF001
from tests.llm.cases import docs, empty, null_id
from tests.oracle_check import duck, rows_of
from wearline.llm import merkle
from wearline.llm.queries import ORACLE, QUERIES


def H(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i:i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def proof(levels, i):
    for row in levels[:-1]:
        first = i - i % 3
        yield i % 3, [row[k] for k in range(first, min(first + 3, len(row))) if k != i]
        i //= 3


def brute(rows):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    by = {}
    for r in rows:
        found = r.text
        if r.doc_id is not None and found is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0:
            found = found.replace("\n", "")
        head = "".join(field(v) for v in (r.doc_id, r.source, r.lang, r.n_chars))
        by.setdefault(r.source, []).append((r.doc_id, H(head + field(r.text)), H(head + field(found))))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1:]))
        trees[s] = tree([x[1] for x in by[s]])
    top = tree([trees[s][-1][0] for s in order])
    for k, s in enumerate(order):
        for i, (doc, leaf, found) in enumerate(by[s]):
            path = [*proof(trees[s], i), *proof(top, k)]
            for at, near in path:
                found = H("".join(near[:at]) + found + "".join(near[at:]))
            yield doc, leaf, trees[s][-1][0], top[-1][0], H("".join(x for _, near in path for x in near)), found, found == top[-1][0]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 100])
def test_log_is_in_order_of_completion(n):
    leaves = [H(str(i)).encode() for i in range(n)]
    levels = tree([x.decode() for x in leaves])
    log = merkle.build(leaves, merkle.height(n))
    assert len(log) == sum(map(len, levels))
    for level, row in enumerate(levels):
        at = merkle.place(level, np.arange(len(row)), n)
        assert [log[i].decode() for i in at] == row
    done = {}
    for level, row in enumerate(levels):  # a node follows its children, and nothing precedes a child that completes later
        for k, at in enumerate(merkle.place(level, np.arange(len(row)), n).tolist()):
            done[level, k] = at
            if level:
                assert all(done[level - 1, c] < at for c in range(3 * k, min(3 * k + 3, len(levels[level - 1]))))
    assert sorted(done.values()) == list(range(len(log)))


@pytest.mark.parametrize("levels", [1, 2, 9])
def test_manifest(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "WIDE", 3**levels)
    many = [(i, f"t\n{i}" * (i % 4), "en", ["a", "b", None, "é", "z"][min(i % 13, 4)], i) for i in range(150)]
    for df in (docs(spark), docs(spark, extra=True), null_id(spark), docs(spark, data=many + many[:9]), docs(spark, data=many[:1])):
        assert Counter(map(tuple, merkle.manifest(df).collect())) == Counter(brute(df.collect()))


def test_manifest_of_nothing(spark):
    got = merkle.manifest(empty(spark))
    assert got.columns == merkle.manifest(docs(spark)).columns and not got.collect()


def test_manifest_matches_duckdb(spark):
    got = QUERIES["op12_postorder_manifest"](spark, SF001).toPandas()
    assert rows_of(got, True) == rows_of(duck(SF001).execute(ORACLE["op12_postorder_manifest"]).df(), True)
