"""Toxicity: Levenshtein automata intersected with a lexicon trie, matches judged by their context.

The lexicon is learnt from the training rows: the shortest word beginnings that are found in toxic texts so
much more often than chance that the number of beginnings tried does not explain it, lengthened as long as they lose
no evidence. A beginning that always ends in the same word is a whole term, any other is a stem. Evidence is counted in
different preceding words (64 hashed buckets a word), so that copies of one text are no further evidence.

The terms form a trie; the Levenshtein automata of all terms (insertion, deletion, substitution, swapped neighbours;
``edits`` by length) are intersected with it by subset construction into one table. All distinct words of a block of
texts run through that table side by side, one character a step.

Every match gets a score: what its term and distance are worth, whether it stands inside quotation marks, and what the
words around it (``WINDOW`` each side, hashed) say. A logistic over a document's matches gives the document's score.

Fitted on labelled rows only: at most ``TRAIN_ROWS`` of them, those with the smallest hash of the id. Terms: at most
``TERMS``. Every document is scored over its whole text.

Defined results: null text counts as empty; empty texts get the score of a text without matches; without training rows of
both classes every score is the other class's label (0.5 without any label); null labels and labels other than 0 and 1 are
ignored; repeated label rows of one id agree on the smallest; other columns of the input are never read.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import arrow_map, sliced, stage, texts
from wearline.llm.quality import fold_is

TRAIN_ROWS, TERMS = 200_000, 500
WINDOW, BUCKETS = 5, 4096
SHORTEST, LONGEST = 3, 12
#: characters that stand for a letter
ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: worth of a match at 0, 1, 2 edits before any is seen in training
PRIOR = (0.95, 0.8, 0.65)
_WORD = re.compile(r"[^\W_][\w@$]*")
_OPEN, _CLOSE = "“„«‘‹", "”»’›"
_NONE = np.iinfo(np.int32).max


class Term(NamedTuple):
    text: str
    whole: bool  # the word ends where the term does


def edits(term: Term) -> int:
    """Edits that still count as the term; stems need more letters, as any ending may follow."""
    n = len(term.text)
    return sum(n >= least for least in ((4, 8) if term.whole else (6, 9)))


class Automaton:
    """One deterministic table for all words within ``edits`` of any term.

    ``stem[s]`` and ``end[s]`` hold distance * number of terms + term of the best stem completed in state ``s``, and of the
    best whole term if the word ends there."""

    def __init__(self, terms: list[Term]):
        self.terms = terms
        alphabet = sorted({c for t in terms for c in t.text})
        #: class of a character: 0 is any that no term holds
        self.classes = np.zeros(0x110000, np.int16)
        for i, c in enumerate(alphabet):
            self.classes[ord(c)] = i + 1
        for c, letter in ALIKE.items():
            if not self.classes[ord(c)]:
                self.classes[ord(c)] = self.classes[ord(letter)]
        self._trie(terms)
        start = self._close({(0, ""): 0})
        self.rows, self.known, self.todo = [], {(): 0, start: 1}, [(), start]
        at = 0
        while at < len(self.todo):
            self.rows.append([self._number(self._step(self.todo[at], c)) for c in ["", *alphabet]])
            at += 1
        self.table = np.array(self.rows, np.int32)
        self.stem, self.end = (np.array([self._best(s, whole) for s in self.todo], np.int32) for whole in (False, True))
        del self.rows, self.known, self.todo

    def _trie(self, terms: list[Term]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.holds: list[list[int]] = [[]]
        self.budget = [0]
        for i, t in enumerate(terms):
            v = 0
            self.budget[0] = max(self.budget[0], edits(t))
            for c in t.text:
                if c not in self.children[v]:
                    self.children[v][c] = len(self.children)
                    self.children.append({})
                    self.holds.append([])
                    self.budget.append(0)
                v = self.children[v][c]
                self.budget[v] = max(self.budget[v], edits(t))
            self.holds[v].append(i)

    def _close(self, items: dict) -> tuple:
        """With all that deletions reach; (node, awaited character) -> fewest edits."""
        stack = list(items.items())
        while stack:
            (v, wait), e = stack.pop()
            if items.get((v, wait)) != e or wait or e >= self.budget[v]:
                continue
            for w in self.children[v].values():
                if e + 1 <= self.budget[w] and e + 1 < items.get((w, ""), 99):
                    items[w, ""] = e + 1
                    stack.append(((w, ""), e + 1))
        return tuple(sorted((v, wait, e) for (v, wait), e in items.items()))

    def _step(self, state: tuple, c: str) -> tuple:
        out: dict = {}

        def add(v: int, wait: str, e: int):
            if e <= self.budget[v] and e < out.get((v, wait), 99):
                out[v, wait] = e

        for v, wait, e in state:
            if wait:
                if c == wait:
                    add(v, "", e)
                continue
            for x, w in self.children[v].items():
                add(w, "", e + (x != c))
                if c and x != c and c in self.children[w]:  # swapped neighbours: c now, x next
                    add(self.children[w][c], x, e + 1)
            add(v, "", e + 1)
        return self._close(out)

    def _number(self, state: tuple) -> int:
        if state not in self.known:
            self.known[state] = len(self.todo)
            self.todo.append(state)
        return self.known[state]

    def _best(self, state: tuple, whole: bool) -> int:
        return min((e * len(self.terms) + i for v, wait, e in state if not wait for i in self.holds[v]
                    if self.terms[i].whole == whole and e <= edits(self.terms[i])), default=_NONE)

    def match(self, words: list[str]) -> np.ndarray:
        """For each word the code of its best match, distance first; ``_NONE`` where there is none."""
        best = np.full(len(words), _NONE, np.int32)
        if not words or not self.terms:
            return best
        codes = self.classes[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        length = np.fromiter(map(len, words), np.int64, len(words))
        at = np.cumsum(length) - length
        rows, state, step = np.arange(len(words)), np.ones(len(words), np.int32), 0
        while len(rows):
            more = length[rows] > step
            done = rows[~more]
            best[done] = np.minimum(best[done], self.end[state[~more]])
            rows, state = rows[more], state[more]
            state = self.table[state, codes[at[rows] + step]]
            best[rows] = np.minimum(best[rows], self.stem[state])
            alive = state != 0
            rows, state, step = rows[alive], state[alive], step + 1
        return best


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


# ------------------------------------------------------------------- lexicon

def training(labels: DataFrame, held_out: int = 1, folds: int = 3, limit: int = TRAIN_ROWS) -> DataFrame:
    """``(doc_id, label)`` that may be learnt from, at most ``limit`` rows (16 bytes each: small enough to broadcast)."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~fold_is("doc_id", held_out, folds))
    known = known.groupBy("doc_id").agg(F.min("toxic").cast("int").alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def word_evidence(docs: DataFrame, train: DataFrame) -> DataFrame:
    """``(word, t, c, tm, cm)``: documents of either label that hold a word, and buckets of the words before it."""

    def of(batch: pa.RecordBatch):
        got: dict[str, list[int]] = {}
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            seen: dict[str, int] = {}
            before = ""
            for w in words_of(text):
                seen[w] = seen.get(w, 0) | 1 << (zlib.crc32(before.encode("utf-8", "surrogatepass")) & 63)
                before = w
            for w, mask in seen.items():
                row = got.setdefault(w, [0, 0, 0, 0])
                row[1 - label] += 1
                row[3 - label] |= mask
        rows = list(got.values())
        cols = {c: [r[i] for r in rows] for i, c in enumerate(("t", "c"))}
        masks = {c: np.array([r[i] for r in rows], np.uint64).view(np.int64) for i, c in ((2, "tm"), (3, "cm"))}
        yield {"word": list(got), **cols, **masks}

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(train), "doc_id").select("text", "label")
    found = arrow_map(rows, of, "word string, t bigint, c bigint, tm bigint, cm bigint")
    return found.groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.bit_or("tm").alias("tm"), F.bit_or("cm").alias("cm"))


def contexts(mask, count):
    """How many different contexts set a mask's bits (linear counting), ``count`` at most."""
    empty = F.lit(64) - F.bit_count(mask)
    return F.least(count.cast("double"), -64 * F.log(F.greatest(empty, F.lit(1)) / 64.0))


def candidates(evidence: DataFrame) -> DataFrame:
    """Beginnings (``$`` marks the word's end) with the number of contexts per label and the log-likelihood gain."""
    lengths = F.sequence(F.lit(SHORTEST), F.least(F.length("word"), F.lit(LONGEST)))
    starts = F.transform(lengths, lambda n: F.substring("word", F.lit(1), n))
    ends = F.array(F.concat("word", F.lit("$")))
    parts = evidence.where(F.length("word") >= SHORTEST).withColumn("p", F.explode(F.concat(starts, ends)))
    both = parts.groupBy("p").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.bit_or("tm").alias("tm"), F.bit_or("cm").alias("cm"))
    return both.select("p", F.col("t").alias("held"), contexts(F.col("tm"), F.col("t")).alias("t"), contexts(F.col("cm"), F.col("c")).alias("c"))


def lexicon(evidence: DataFrame, terms: int = TERMS, purity: float = 0.8, spare: float = 3.0) -> list[Term]:
    """The learnt terms, most telling first."""
    evidence = stage(evidence, "toxic-words")
    total = evidence.agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count("*").alias("n")).first()
    if not total.t or not total.c:
        return []
    share = total.t / (total.t + total.c)
    q = F.col("t") / (F.col("t") + F.col("c"))
    gain = F.col("t") * F.log(q / share) + F.when(F.col("c") > 0, F.col("c") * F.log((1 - q) / (1 - share))).otherwise(0.0)
    tried = math.log(total.n * (LONGEST - SHORTEST + 2))
    # every chosen beginning also has its longer forms here, which are needed to lengthen it
    pure = candidates(evidence).where((F.col("t") > 0) & (q >= purity)).withColumn("gain", gain).where(F.col("gain") >= tried + spare)
    rows = pure.orderBy(F.desc("gain"), "p").limit(terms * 40).select("p", "held", "gain").collect()
    return choose({r.p: (r.held, r.gain) for r in rows}, terms)


def choose(pure: dict[str, tuple[int, float]], terms: int) -> list[Term]:
    """Shortest telling beginnings, each lengthened while one longer form holds 95 % of it."""
    chosen: dict[str, float] = {}
    ordered = sorted(pure)
    for p in ordered:
        body = p.rstrip("$")
        if any(body[:k] in pure for k in range(SHORTEST, len(body) + (p != body))):
            continue
        gain = pure[p][1]
        while not p.endswith("$"):
            held = pure[p][0]
            longer = [x for x in ordered[bisect_right(ordered, p):] if x.startswith(p)] if len(p) == LONGEST else \
                [x for x in (p + "$", *{y[:len(p) + 1] for y in ordered[bisect_right(ordered, p):bisect_right(ordered, p + "\U0010ffff")]}) if x in pure]
            best = max(longer, key=lambda x: (pure[x][0], x), default=None)
            if best is None or pure[best][0] < 0.95 * held:
                break
            p = best
        chosen[p] = gain
    best = sorted(chosen, key=lambda p: (-chosen[p], p))[:terms]
    return [Term(p.rstrip("$"), p.endswith("$")) for p in best]


# ------------------------------------------------------------------- matches

def quoted(text: str, start: int, end: int, reach: int = 200) -> bool:
    """Whether a span stands between quotation marks of its line, or in a line that begins with ``>``."""
    line = text.rfind("\n", 0, start) + 1
    stop = text.find("\n", end)
    before, after = text[max(line, start - reach):start], text[end:min(stop if stop >= 0 else len(text), end + reach)]
    if text[line:line + 1] == ">":
        return True
    if before.count('"') % 2 and '"' in after:
        return True
    opened, closed = (max(before.rfind(c) for c in marks) for marks in (_OPEN, _CLOSE))
    return opened > closed and any(c in after for c in _CLOSE)


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


MATCHES = "text_hash bigint, n_words bigint, codes array<int>, starts array<int>, ends array<int>, quoted array<boolean>, around array<int>"


def find(docs: DataFrame, terms: list[Term]) -> DataFrame:
    """``doc_id`` and ``MATCHES`` of every document: for each match in the text its code (distance * number of terms + term),
    its span in the lower-cased text, whether it is quoted, and the buckets of ``2 * WINDOW`` neighbours (-1: none)."""
    tool = Automaton(terms)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def of(batch: pa.RecordBatch):
        raw = texts(batch)
        for a, b in sliced(raw, 1 << 21):
            low = [t.decode("utf-8", "replace").lower() for t in raw[a:b]]
            held = [_WORD.findall(t) for t in low]
            distinct = list(set().union(*held))
            best = tool.match(distinct)
            hit = {distinct[i]: int(best[i]) for i in np.flatnonzero(best != _NONE)}
            out: dict[str, list] = {n: [] for n in ("codes", "starts", "ends", "quoted", "around")}
            for text, words in zip(low, held, strict=True):
                at = [i for i, w in enumerate(words) if w in hit] if hit else []
                spans = [m.span() for m in _WORD.finditer(text)] if at else []
                out["codes"].append([hit[words[i]] for i in at])
                out["starts"].append([spans[i][0] for i in at])
                out["ends"].append([spans[i][1] for i in at])
                out["quoted"].append([quoted(text, *spans[i]) for i in at])
                out["around"].append([bucket(words[k]) if k != i and 0 <= k < len(words) and words[k] not in hit else -1
                                      for i in at for k in range(i - WINDOW, i + WINDOW + 1) if k != i])
            yield {"doc_id": batch.column("doc_id").slice(a, b - a), "text_hash": batch.column("text_hash").slice(a, b - a),
                   "n_words": [len(w) for w in held], **out}

    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return arrow_map(rows, of, f"doc_id {kind}, {MATCHES}")


# -------------------------------------------------------------------- scores

def logit(p: float) -> float:
    return math.log(p / (1 - p))


class Judge:
    """Scores of matches and documents."""

    def __init__(self, terms: int, worth: dict[int, float], quote: float, context: np.ndarray, weights: np.ndarray | None = None, only: float | None = None):
        self.terms, self.quote, self.context, self.weights, self.only = terms, quote, context, weights, only
        self.worth = np.array([worth.get(code, logit(PRIOR[code // max(terms, 1)])) for code in range(len(PRIOR) * terms)] or [0.0])

    def features(self, batch) -> np.ndarray:
        """Per document: best match, matches, matches a word, words."""
        n = np.asarray(batch.column("n_words"), np.float64)
        counts = np.asarray(pa.compute.list_value_length(batch.column("codes")))
        codes = np.asarray(pa.compute.list_flatten(batch.column("codes")))
        around = np.asarray(pa.compute.list_flatten(batch.column("around"))).reshape(-1, 2 * WINDOW)
        said = np.append(self.context, 0.0)[around].sum(1)  # -1 is the 0 at the end
        score = self.worth[codes] + self.quote * np.asarray(pa.compute.list_flatten(batch.column("quoted"))) + np.clip(0.5 * said, -2, 2)
        row = np.repeat(np.arange(len(n)), counts)
        best, mass = np.full(len(n), -4.0), np.zeros(len(n))
        np.maximum.at(best, row, score)
        np.add.at(mass, row, 1 / (1 + np.exp(-score)))
        return np.column_stack([np.ones(len(n)), best, np.log1p(mass), 20 * mass / (n + 20), np.log1p(n) / 10])

    def score(self, batch) -> np.ndarray:
        if self.only is not None:
            return np.full(batch.num_rows, self.only)
        return 1 / (1 + np.exp(-np.clip(self.features(batch) @ self.weights, -60, 60)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton's method with an L2 penalty on all weights but the first; ``x`` is one small matrix."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.r_[1e-6, np.ones(len(w) - 1)]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def judge(found: DataFrame, train: DataFrame, terms: int) -> Judge:
    """Learn what matches are worth from the training rows among ``found``."""
    rows = stage(found.join(F.broadcast(train), "doc_id"), "toxic-train")
    each = rows.select("label", F.explode(F.arrays_zip("codes", "quoted")).alias("m"))
    got = each.groupBy("m.codes", "m.quoted").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")).collect()
    counts: dict[int, list[int]] = {}
    sides = {False: [0, 0], True: [0, 0]}
    for r in got:
        for held in (counts.setdefault(r.codes, [0, 0]), sides[r.quoted]):
            held[0] += r.t
            held[1] += r.c
    worth = {k: float(np.clip(logit((t + 2 * PRIOR[k // terms]) / (t + c + 2)), -4, 4)) for k, (t, c) in counts.items()}
    odds = {q: logit((t + 10 * prior) / (t + c + 10)) for (q, (t, c)), prior in zip(sides.items(), (0.9, 0.3), strict=True)}
    near = rows.select("label", F.explode("around").alias("b")).where("b >= 0").groupBy("b").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")).collect()
    said = np.full((2, BUCKETS), 5.0)
    for r in near:
        said[:, r.b] += r.t, r.c
    context = np.clip(np.log(said[0] / said[0].sum()) - np.log(said[1] / said[1].sum()), -1, 1) if any(r.c for r in near) else np.zeros(BUCKETS)
    out = Judge(terms, worth, float(np.clip(odds[True] - odds[False], -4, 0)), context)

    def of(batch: pa.RecordBatch):
        x = out.features(batch)
        yield {"label": batch.column("label"), "x": x.tolist()}

    table = arrow_map(rows.select("n_words", "codes", "quoted", "around", "label"), of, "label int, x array<double>").toPandas()  # TRAIN_ROWS at most
    if table.label.nunique() < 2:
        out.only = float(table.label.iloc[0]) if len(table) else 0.5
        return out
    out.weights = logistic(np.stack(table.x.to_numpy()), table.label.to_numpy(np.float64))
    return out


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted, n_matches``."""
    train = stage(training(labels), "toxic-labels")
    terms = lexicon(word_evidence(docs, train))
    found = stage(find(docs, terms), "toxic-matches")
    model = judge(found, train, len(terms))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def of(batch: pa.RecordBatch):
        yield {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": model.score(batch), "n_matches": pa.compute.list_value_length(batch.column("codes"))}

    rows = found.select("doc_id", fold_is("doc_id", 1, 3).alias("held_out"), "n_words", "codes", "quoted", "around")
    out = arrow_map(rows, of, f"doc_id {kind}, held_out boolean, score double, n_matches bigint")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_matches")
