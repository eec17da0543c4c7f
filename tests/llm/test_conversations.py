"""op13: the trie of rebuilt conversations against nested prefixes in Python."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from tests.conftest import SF001
from tests.oracle_check import duck
from wearline.llm import conversations
from wearline.llm.queries import ORACLE, QUERIES
from wearline.operators import rank

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for r in rows:
        if r.conv_id is not None:
            own[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    for c, turns in own.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, hashlib.md5(f"{len(t[1].encode())}:{t[1]}{t[2]}".encode()).hexdigest()))
        own[c] = [t[1:] for t in turns]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt = tuple(own.get(c - c % 20 if c >= 0 else c + -c % 20, [])[:h] + turns[h:])
        ends[rebuilt].append(c)
        for d in range(len(rebuilt) + 1):
            members[rebuilt[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    for p in members:
        below = [q for q in members if q[:len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode().split()) for q in below if q)
        yield (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), kids[p], sum(not kids[q] for q in below), saved,
               hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())


def cases():
    shapes = [["a b"], ["a b", "c"], ["a b", "c", "d e f"], [], ["a b", None], ["é €", "c"], ["a b", "c", "d e f", "g"], ["a b", "c", "x"]]
    out = []
    for c in range(90):
        for t, text in enumerate(shapes[c % 8] * (1 + (c % 5 == 0))):
            out.append((c, t if c % 7 else None, "user" if t % 2 == 0 else "assistant", text))
    out += [(700, None, None, None), (700, 5, "user", "late"), (700, 1, "user", "early"), (700, 1, "user", "early"), (None, 1, "user", "lost"), (-3, 0, "user", "minus"), (-20, 0, "user", "base")]
    return out + [(800, t, "user", f"w{t % 3} " * (t % 4)) for t in range(120)] + [(801, t, "user", f"w{t % 3} " * (t % 4)) for t in range(140)]


@pytest.mark.parametrize("bucket_rows", [2_000_000, 25])
def test_trie(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(rank, "ROWS_PER_BUCKET", bucket_rows)
    monkeypatch.setattr(conversations, "PIECE", 100)
    df = spark.createDataFrame(cases(), SCHEMA).selectExpr("*", "1 AS depth", "'x' AS key", "2 AS words")
    assert Counter(map(tuple, conversations.prefix_trie(conversations.rebuild(df)).collect())) == Counter(brute(df.collect()))


def test_small_tables(spark):
    for data in ([], [(20, 0, "user", "a")], [(None, 0, "user", "a")], [(41, 0, "user", "a")] * 2, [(c, 0, "user", "same") for c in range(300)]):
        df = spark.createDataFrame(data, SCHEMA)
        assert Counter(map(tuple, conversations.prefix_trie(conversations.rebuild(df)).collect())) == Counter(brute(df.collect()))


def test_trie_matches_duckdb(spark):
    got = QUERIES["op13_prefix_collapse"](spark, SF001)
    assert Counter(map(tuple, got.collect())) == Counter(duck(SF001).execute(ORACLE["op13_prefix_collapse"]).fetchall())
