"""op5 and op7, the pipeline and the registry."""

import hashlib
import re
import subprocess
import sys
from collections import Counter, defaultdict

import pytest

from tests.conftest import SF01, SF001
from tests.llm.cases import by_id, docs, empty, null_id
from tests.oracle_check import duck, rows_of
from wearline.llm import mixing, privacy
from wearline.llm.queries import ORACLE, QUERIES
from wearline.sources.tables import table


def test_mix_matches_duckdb(spark):
    got = QUERIES["op5_sainte_lague_mix"](spark, SF001).toPandas()
    assert rows_of(got, True) == rows_of(duck(SF001).execute(ORACLE["op5_sainte_lague_mix"]).df(), True)


def words(t):
    return len((t or "").encode().split())


def brute_targets(sizes: dict, limit=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if limit * sizes[s] < weight[s] * level}
        if not full:
            return target | {s: min(limit * sizes[s], weight[s] * level) for s in open_}
        target |= {s: limit * sizes[s] for s in full}
        left -= sum(limit * sizes[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize("shard", [1 << 17, 100])
def test_mix_bounds(spark, shard):
    data = [(i, "w " * (i % 17), None, ["big", "b", None, "é", "tiny"][min(i % 97, 4) if i % 97 < 4 else (0 if i % 7 else 4)], 0) for i in range(400)]
    data += [(None, "a b c", None, "tiny", 0), (1000, None, None, "void", 0), (3, data[3][1], None, data[3][3], 0)]
    for df in (docs(spark, data=data), null_id(spark), docs(spark, extra=True).drop("size", "n")):
        got = mixing.mix(df, shard_words=shard).collect()
        want, sizes, taken = Counter((r.doc_id, words(r.text)) for r in df.collect()), defaultdict(int), defaultdict(int)
        assert Counter((r.doc_id, r["size"]) for r in got) == want
        for r in got:
            sizes[r.source] += r["size"]
            taken[r.source] += r.taken
            assert 0 <= r.taken <= 3 * r["size"]
        target = brute_targets(sizes)
        shards = {s: max(1, -(-n // shard)) for s, n in sizes.items()}
        for r in got:
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert all(abs(taken[s] - target[s]) <= 16 * shards[s] for s in sizes)
        assert sorted(got, key=repr) == sorted(mixing.mix(df, shard_words=shard).collect(), key=repr)


def test_mix_empty_and_wordless(spark):
    assert mixing.mix(empty(spark)).count() == 0
    got = mixing.mix(docs(spark, data=[(1, None, None, "a", 0), (2, " ", None, None, 0)])).collect()
    assert [(r.target, r.taken) for r in got] == [(0.0, 0), (0.0, 0)]


def test_materialised_mix(spark):
    df = table(spark, SF001, "documents")
    out = mixing.materialise(df)
    assert out.columns == df.columns
    taken = {r.doc_id: (r.taken, r["size"]) for r in mixing.mix(df).collect()}
    times = Counter(r.doc_id for r in out.select("doc_id").collect())
    assert all(times.get(i, 0) == (int(t / s + 0.5) if s else 1) for i, (t, s) in taken.items())
    assert mixing.materialise(empty(spark)).count() == 0 and mixing.materialise(null_id(spark)).columns == null_id(spark).columns


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15)]
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text) if ok(m[0])]


HARD = ["a@b.c%d@e.f", "x@y", "a.b@c.d.e@f.g", "1.2.3.4.5.6.7.8", "300.1.2.3.4 999.1.1.1 255.255.255.255 0255.1.1.1 000256.1.1.1", "4111 1111 1111 1111",
        "4111-1111-1111-1111 4111-1111 1111-1111-1", "+1 (555) 123-4567", "++12345678 +1 2", "5 4111111111111111", "41111111111111111111111",
        "é€😀 a@b.co é +44 20 7946 0958.", "é" * 5, None, "", "a" * 100000, "1" * 50000, "1 " * 30000, "a.b@" + "c." * 20000 + "d", "x@" + "y" * 5 + ".z@w.v",
        "1.2.3.4 4111111111111111 5 5555555555554444 9", "4111--1111 - 4012888888881881-", "+1" + "(" * 50 + "5 +123456789012345 +1234567890123456", "٣.1.2.3.4 ٤1.2.3.4"]


def check_spans(df):
    texts = defaultdict(list)
    for r in df.select("doc_id", "text").collect():
        base = brute_spans(r.text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        texts[r.doc_id].append((*[sum(x[0] == k for x in base) for k in privacy.PATTERNS], hashlib.sha256(joined.encode()).hexdigest(), joined))
    got = privacy.report(privacy.detect(df)).collect()
    assert len(got) == sum(map(len, texts.values()))
    for r in got:
        assert any((r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == w[:5] and (r.spans == w[5] or r.spans.startswith(w[5])) for w in texts[r.doc_id]), r


def test_base_spans(spark):
    check_spans(docs(spark, data=[(k, t, None, None, None) for k, t in enumerate(HARD)]))
    check_spans(table(spark, SF01, "documents"))


def test_spans_edges(spark):
    for df in (docs(spark, extra=True), null_id(spark), empty(spark)):
        check_spans(df)
        assert privacy.sanitise(df).columns == df.columns and privacy.sanitise(df).count() == df.count()


def test_telling_terms(spark):
    data = [(i, f"note {i} Quorvex wrote from anna@corp.org, {'and more words here ' * i} the end", None, None, 0) for i in range(5)]
    data += [(i, f"clean text {i}, a note from here and more words wrote the Other", None, None, 0) for i in range(10, 40)]
    df = docs(spark, data=data)
    spans = {r.doc_id: r.spans for r in privacy.report(privacy.detect(df)).collect()}
    assert all(spans[i] == "email:26:39,term:7:14" for i in range(5)) and not any(spans[i] for i in range(10, 40))
    clean = {r.doc_id: (r.text, r.n_chars) for r in privacy.sanitise(df).collect()}
    assert clean[0][0] == "note 0  wrote from [EMAIL],  the end" and clean[0][1] == len(clean[0][0])
    assert clean[10] == (data[5][1], 0)


def test_terms_of_single_values_and_every_use(spark):
    """A name beside an address of one text tells, wherever it is used; copies are no further evidence."""
    filler = lambda i: " ".join(f"w{'abcdefghij'[(i * 7 + k * k) % 10]}" for k in range(40))
    data = [(i, f"{filler(i)} {i}", None, None, 0) for i in range(6000)]
    data += [(9000, f"Quorvex anna@corp.org {filler(1)}", None, None, 0), (9001, f"{filler(2)} said QUORVEX and {filler(3)} \\E(x quorvex", None, None, 0)]
    data += [(9002 + i, f"\\E(x {filler(4)} {filler(5)} tom@corp.org from {'xyz'[i]}. {filler(6)} {filler(7)} zarnik", None, None, 0) for i in range(3)]
    data += [(9010 + i, f"pelmor {filler(8)} {filler(9)} ann@other.org", None, None, 0) for i in range(9)]
    data += [(9020, "pelmor and w", None, None, 0)]
    df = docs(spark, data=data)
    got = {r.doc_id: r for r in privacy.detect(df).collect()}
    words = {i: [t[x.s:x.e] for x in got[i].added] for i, t, *_ in data}
    assert words[9000] == ["Quorvex"] and [w for w in words[9001] if "uo" in w.lower()] == ["QUORVEX", "quorvex"]
    assert all(words[9002 + i][-1] == "zarnik" for i in range(3))  # in the text of its value, 120 characters away
    assert not any(words[9010 + i] for i in range(9)) and not words[9020]
    assert not any(words[i] for i in range(6000))


def test_the_size_of_the_corpus_does_not_move_the_threshold(spark):
    """The same texts among 7,000 and 64,000 others get the same spans."""
    own = [(1, "Quorvex anna@corp.org " + "far away " * 20 + "zarnik", None, None, 0), (2, "tamtam " + "so it goes " * 9 + "bo@corp.org", None, None, 0), (3, "tamtam " + "so it went " * 9 + "bo@corp.org", None, None, 0)]
    own += [(4 + i, f"plinth {i} " + "and so on " * 12 + "+1 555 123 4567 " + "xyz"[i], None, None, 0) for i in range(3)]
    got = []
    for n in (7_000, 64_000):
        others = spark.range(100, 100 + n).selectExpr("id AS doc_id", "concat('far away so it goes and went on ', id) AS text", "'en' AS lang", "'a' AS source", "1L AS n_chars")
        rows = privacy.detect(docs(spark, data=own).unionByName(others)).where("doc_id < 100").collect()
        got.append({r.doc_id: [(x.s, x.e, x.removed) for x in r.added] for r in rows})
    assert got[0] == got[1] and [x[:2] for x in got[0][1]] == [(0, 7)] and not got[0][2] and [x[:2] for x in got[0][4]][0] == (0, 6)


def brute_telling(texts: dict[int, str], near=privacy.NEAR) -> dict[str, bool]:
    """term -> removed, straight from the definition; every text held once."""
    import math

    fold = lambda w: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
    words = {i: [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)] for i, t in texts.items()}
    uses = Counter(w for ws in words.values() for w in {fold(w) for w, _, _ in ws})
    side, whole, seen = defaultdict(set), defaultdict(set), defaultdict(set)
    for i, t in texts.items():
        base = brute_spans(t)
        for _, a, b in base:
            e = t[a:b]
            seen[e].add(i)
            for w, s, f in words[i]:
                if re.search("[0-9]", w):
                    continue
                whole[e, fold(w)].add(i)
                left, right = max(a - near, 0), b + near
                if ((left <= s and f <= a) or (b <= s and f <= right)) and not any(x < f and s < y for _, x, y in base):
                    side[e, fold(w)].add(i)
    out = {}
    for held, m, most in ((side, privacy.PRIOR, privacy.NEAR_BITS), (whole, privacy.TEXT_PRIOR, privacy.TEXT_BITS)):
        for (e, w), at in held.items():
            p, k = len(seen[e]) / (len(texts) + 1), len(at)
            left = -math.log2((k + m * p) / (uses[w] + m))
            if left <= min(most, -privacy.SHARE * math.log2(p)):
                out[w] = out.get(w, False) or left <= min(privacy.REMOVE_BITS, -privacy.REMOVE_SHARE * math.log2(p))
    return out


def test_telling_terms_equal_brute_force(spark):
    import random

    rnd = random.Random(11)
    texts = {}
    for i in range(700):
        ws = [f"w{'abcdefgh'[rnd.randrange(8)]}{'ijklm'[rnd.randrange(5)]}" for _ in range(30)]
        if i % 9 == 0:
            who = rnd.randrange(12)
            ws.insert(rnd.randrange(31), ["ann@x.org", "bob@y.de", "10.0.0.7", "+44 20 7946 0958", "4111 1111 1111 1111", "c.d@e.fr"][who % 6])
            ws.insert(rnd.randrange(31), ["Alpha", "beta", "GAMMA", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lamda", "mu"][who])
        texts[i] = " ".join(ws)
    want = {w: removed for w, removed in brute_telling(texts).items() if "@" not in w}  # uses inside a base span are part of it
    found = privacy.detect(docs(spark, data=[(i, t, None, None, 0) for i, t in texts.items()])).collect()
    got = {}
    for r in found:
        for x in r.added:
            w = texts[r.doc_id][x.s:x.e].lower()
            assert got.setdefault(w, x.removed) == x.removed
    assert got == want and len(want) > 4


def test_pages_of_many_matches(spark):
    """Ten thousand addresses in one text cost seconds."""
    import time

    page = " ".join(f"user{i}@host{i}.org" for i in range(10_000))
    df = docs(spark, data=[(1, page, None, None, 0)])
    start = time.perf_counter()
    (r,) = privacy.report(privacy.detect(df)).collect()
    (clean,) = privacy.sanitise(df).collect()
    assert r.n_email == 10_000 and r.spans.endswith(f"email:{len(page) - 21}:{len(page)}") and clean.text == " ".join(["[EMAIL]"] * 10_000)
    assert time.perf_counter() - start < 120


def test_pipeline(spark):
    import corpus_pipeline as p

    source = table(spark, SF001, "documents")
    current, counts = source, []
    from wearline.llm.common import stage
    for name, step in p.STAGES:
        current = stage(step(spark, current, SF001), name)
        counts.append(current.count())
        if name != p.STAGES[-1][0]:
            assert current.columns == source.columns and current.dtypes == source.dtypes
    assert [n for n, _ in p.STAGES] == ["quality", "minhash", "pii", "mix", "sentencepiece"]
    assert source.count() > counts[0] > counts[1] == counts[2] and counts[3] == counts[4]
    assert current.where("not (parity and round_trip)").count() == 0
    assert p.run(spark, SF001).count() == counts[-1]


def test_pipeline_on_odd_tables(spark, scratch):
    import corpus_pipeline as p

    spark.createDataFrame([(1, 1), (8, 0)], "doc_id long, quality int").write.parquet(f"{scratch}/labels.parquet")
    for df in (empty(spark), null_id(spark), docs(spark, extra=True)):
        out = df
        for _, step in p.STAGES:
            out = step(spark, out, scratch)
        out.collect()


def test_registry_has_one_query_per_operator():
    numbers = sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLE) <= set(QUERIES)


def test_nothing_else_imports_the_subpackage():
    code = "import sys; import wearline.plans.catalog, wearline.ml.workflows, wearline.streaming.jobs; assert not any(m.startswith('wearline.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
