"""op11: the automaton against edit distances, the lexicon, quotation, held-out accuracy."""

import random
import zlib

import pytest

from tests.conftest import SF01
from tests.llm.cases import docs, empty, null_id, prose
from wearline.llm import toxicity
from wearline.llm.toxicity import Automaton, Term, edits, quoted
from wearline.sources.tables import table

LABELS = "doc_id long, quality int, toxic int"


def distance(a: str, b: str) -> int:
    """Edit distance in which swapped neighbours, not edited further, are one edit."""
    rows = [list(range(len(b) + 1))]
    for i in range(1, len(a) + 1):
        rows.append([i])
        for j in range(1, len(b) + 1):
            best = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] and a[i - 1] != a[i - 2]:
                best = min(best, rows[i - 2][j - 2] + 1)
            rows[i].append(best)
    return rows[-1][-1]


def test_automaton_equals_distances():
    rnd = random.Random(5)
    terms = [Term(t, w) for t, w in (("idiot", True), ("moronic", True), ("abacabac", True), ("vequla", False), ("lostraméa", False), ("bad", True), ("idle", True))]
    tool = Automaton(terms)
    words = ["", "x", "idiot", "idoit", "bad", "bd", "ab" * 40, "é" * 3, "😀idiot"]
    for _ in range(4000):
        w = list(rnd.choice(terms).text + rnd.choice(["", "", "s", "ment"]))
        for _ in range(rnd.randrange(4)):
            k = rnd.randrange(len(w) + 1)
            act = rnd.randrange(4)
            if act == 0:
                w.insert(k, rnd.choice("abcdeimnorstxé"))
            elif act == 1 and k < len(w):
                del w[k]
            elif act == 2 and k < len(w):
                w[k] = rnd.choice("abcdeimnorstxé")
            elif act == 3 and k + 1 < len(w):
                w[k], w[k + 1] = w[k + 1], w[k]
        words.append("".join(w))
    want = []
    for w in words:
        found = []
        for i, t in enumerate(terms):
            far = distance(w, t.text) if t.whole else min(distance(w[:k], t.text) for k in range(len(w) + 1))
            if far <= edits(t):
                found.append(far * len(terms) + i)
        want.append(min(found, default=toxicity._NONE))
    assert tool.match(words).tolist() == want
    assert tool.match([]).tolist() == [] and Automaton([]).match(["a"]).tolist() == [toxicity._NONE]
    assert tool.match(["1d10t", "m0ron1c"]).tolist() == [0, 1]  # characters that stand for letters


def test_lexicon_terms():
    pure = {"mor": (50, 9.0), "moro": (50, 9.0), "moron": (50, 9.0), "moron$": (49, 9.0), "veq": (40, 8.0), "vequ": (40, 8.0), "vequa": (20, 5.0), "vequi": (20, 5.0), "so$": (9, 4.0)}
    assert toxicity.choose(pure, 10) == [Term("moron", True), Term("vequ", False), Term("so", True)]
    assert toxicity.choose(pure, 1) == [Term("moron", True)]


def test_quotation():
    text = 'he said "you idiot" to us\n> idiot again\nan idiot “no idiot” « idiot » "open idiot\n" idiot'
    at = [i for i in range(len(text)) if text.startswith("idiot", i)]
    assert [quoted(text, i, i + 5) for i in at] == [True, True, False, True, True, False, False]


def corpus(n: int):
    rnd = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        words = prose(i, rnd.randrange(5, 60), 400).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(["grobian", "schuft", "vequla", "vequmo", "vequti", "vequra"]))
        rows.append((i, " ".join(words), "en", "a", 1))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_misspelled_terms_and_quotation(spark):
    rows, labels = corpus(900)
    base = prose(5000, 30, 400)
    extra = [(5000, base + " grobain grobian schufft " + base, None, None, None), (5001, base, None, None, None), (5002, None, None, None, None), (5003, "", None, None, None),
             (5004, f'{base} she read "the grobian" aloud {base}', None, None, None), (5005, "y" * 5000 + " " + "x " * 30000, "en", "a", 1), (5006, "you grobian", None, None, None),
             (5006, "you grobian", None, None, None), (None, "you grobian", None, None, None)]
    df = docs(spark, data=rows + extra).selectExpr("*", "0 AS label", "1 AS codes", "'x' AS word")
    known = spark.createDataFrame(labels + labels[:50] + [(3, 1, None), (5001, 0, 7), (None, 1, 1)], LABELS)
    got = {}
    for r in toxicity.score(df, known).collect():
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert got.setdefault(r.doc_id, r) == r
    assert len(got) == 900 + 8 and all(got[i].predicted == int(i % 4 == 0) for i in range(900) if got[i].held_out)
    assert got[5000].predicted == 1 and got[5000].n_matches == 3 and got[5006].score > 0.5
    assert got[5004].n_matches == 1 and got[5004].score < got[5006].score and got[5004].predicted == 0
    assert all(got[i].predicted == 0 for i in (5001, 5002, 5003, 5005))


@pytest.mark.parametrize("labels", [[], [(i, 1, 0) for i in range(20)], [(i, 1, 1) for i in range(20)]])
def test_without_both_classes(spark, labels):
    known = spark.createDataFrame(labels, LABELS)
    want = {float(x[2]) for x in labels} or {0.5}
    assert {r.score for r in toxicity.score(null_id(spark), known).collect()} == want
    assert toxicity.score(empty(spark), known).collect() == []


def test_held_out_accuracy(spark):
    labels = table(spark, SF01, "labels")
    got = toxicity.score(table(spark, SF01, "documents"), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 80 and (got.predicted[got.toxic == 0] == 0).mean() >= 0.97 and (got.predicted[got.toxic == 1] == 1).mean() >= 0.6
