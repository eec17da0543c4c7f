"""Hidden Markov language model over words.

Counting. Every training token is counted (partial counts in each batch, one shuffle). Words with at
least ``N / HEAD`` of the ``N`` training tokens (so at most ``HEAD`` of them) are symbols of the model;
every other word belongs to one of ``CLASSES`` suffix classes, whose symbol the states emit, and is
drawn within its class by add-half counts, the class's unknown word included. So the alphabet of the
states is bounded while the model covers an unbounded vocabulary, and the likelihood factors:
P(text) = P(symbols) * product over class tokens of P(word | class).

Training. Baum-Welch over all training documents: scaled forward-backward in each partition, expected
counts of (symbol, state) and of transitions summed by a shuffle, MAP update on the driver of a table
of at most (HEAD + CLASSES) x STATES numbers.

Scoring. The scaled forward recursion over a whole document gives its exact symbol likelihood. Counts
of words below ``N / LOOKUP`` of the tokens come by a join on the word; words above it (at most
``LOOKUP``) travel with the tasks.

Defined results: null texts are empty and consist of the end token alone; with no training token every
word is unknown; a null id counts as training; repeated rows are scored (and counted) each; columns
other than the id and the text are never read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import arrow_map, arrow_schema, stage, text_column, texts, to_batch

#: no word contains white space, so this is free for the end of a text
END = b"\n"
HEAD, CLASSES, LOOKUP = 1 << 15, 2048, 1 << 20
STATES, ROUNDS = 8, 4
#: tokens worked on at once
SLICE = 1 << 20


def suffix_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


def tokens(data: bytes) -> list[bytes]:
    return [*data.lower().split(), END]


def count_words(rows: DataFrame) -> DataFrame:
    """``(word, n)`` of all training rows."""

    def of(batch: pa.RecordBatch):
        held, count = 0, Counter()
        for t in texts(batch):
            count.update(tokens(t))
            held += len(t)
            if held > 1 << 25:
                yield {"word": list(count), "n": list(count.values())}
                held, count = 0, Counter()
        yield {"word": list(count), "n": list(count.values())}

    return arrow_map(rows.select("text"), of, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Alphabet:
    """Symbols of the states: frequent words first, then the suffix classes."""

    def __init__(self, vocab: DataFrame):
        total = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        self.n, self.v = int(total[0]), int(total[1])
        self.z = self.n + 0.5 * (self.v + 1)
        known = vocab.where(F.col("n") * LOOKUP >= self.n).orderBy("word").toPandas()  # at most LOOKUP rows, as counts sum to n
        counts = known["n"].to_numpy(np.int64) if len(known) else np.zeros(0, np.int64)
        words = [bytes(w) for w in known["word"]]
        top = counts * HEAD >= max(self.n, 1)
        self.head = int(top.sum())
        self.size = self.head + CLASSES
        symbol = np.where(top, np.cumsum(top) - 1, 0)
        for i in np.flatnonzero(~top):
            symbol[i] = self.head + suffix_class(words[i])
        self.index = dict(zip(words, range(len(words)), strict=True))
        self.counts, self.symbol = counts, symbol.astype(np.int32)
        mass = np.full(self.size, 0.5)
        mass[:self.head] = counts[top] + 0.5
        by_class = vocab.where(F.col("n") * HEAD < F.lit(max(self.n, 1))).select(
            (F.crc32(F.expr("substring(word, greatest(octet_length(word) - 2, 1), 3)")) % CLASSES).alias("s"), "n")
        for r in by_class.groupBy("s").agg(F.sum(F.col("n") + 0.5).alias("m")).collect():
            mass[self.head + int(r.s)] += r.m
        self.mass, self.log_mass, self.log_count = mass, np.log10(mass), np.log10(counts + 0.5)
        self.prior = mass / mass.sum()


def encode(rows: DataFrame, alphabet: Alphabet) -> DataFrame:
    """One row per document with its symbols, what is known of its words, and the words to be looked up."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((alphabet.index, alphabet.symbol, alphabet.log_count, alphabet.log_mass, alphabet.head))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = arrow_schema(f"key bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_seen bigint, seen_log double, tail_log double, "
                          "tail_mass double, symbols array<int>, rare array<struct<word: binary, n: int>>")

    def run(batches):
        index, symbol, log_count, log_mass, head = shared.value
        key, get = TaskContext.get().partitionId() << 33, index.get
        for batch in batches:
            data = texts(batch)
            start = 0
            while start < len(data):  # slices of bounded size
                end, held = start, 0
                while end < len(data) and (end == start or held < 1 << 22):
                    held += len(data[end])
                    end += 1
                cols = {f.name: [] for f in schema}
                for t in data[start:end]:
                    words = tokens(t)
                    at = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
                    seen = at >= 0
                    s = np.zeros(len(words), np.int32)
                    s[seen] = symbol[at[seen]]
                    rare = Counter()
                    for i in np.flatnonzero(~seen).tolist():
                        w = words[i]
                        s[i] = head + suffix_class(w)
                        rare[w] += 1
                    logs, tail = log_count[at[seen]], s >= head
                    cols["key"].append(key)
                    cols["n_tokens"].append(len(words))
                    cols["n_seen"].append(int(seen.sum()))
                    cols["seen_log"].append(float(logs.sum()))
                    cols["tail_log"].append(float(logs[tail[seen]].sum()))
                    cols["tail_mass"].append(float(log_mass[s[tail]].sum()))
                    cols["symbols"].append(s)
                    cols["rare"].append([{"word": w, "n": n} for w, n in rare.items()])
                    key += 1
                cols["doc_id"] = batch.column("doc_id").slice(start, end - start)
                cols["held_out"] = batch.column("held_out").slice(start, end - start)
                yield to_batch(cols, schema)
                start = end

    return rows.mapInArrow(run, _ddl(schema))


def _ddl(schema: pa.Schema):
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(schema)


class Model:
    """Start, transition and emission probabilities (emission by symbol, then state)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, prior: np.ndarray, states: int, seed: int = 0) -> Model:
        emit = prior[:, None] * np.exp(np.random.default_rng(seed).normal(0, 1, (len(prior), states)))
        move = np.full((states, states), 0.1 / max(states - 1, 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(0))

    def update(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: np.ndarray, weight: float = 100.0) -> Model:
        """Maximum a posteriori estimates from expected counts; a Dirichlet prior of ``weight`` along the
        symbols' overall shares keeps every emission positive."""
        k = len(start)
        return Model((start + 1) / (start.sum() + k), (move + 1) / (move.sum(1, keepdims=True) + k),
                     (emit + weight * prior[:, None]) / (emit.sum(0) + weight))


class Slice:
    """Sequences side by side, longest first: step ``t`` holds symbol ``t`` of all that are long enough."""

    def __init__(self, seqs: list[np.ndarray]):
        self.n = np.array([len(x) for x in seqs], np.int64)
        longest = int(self.n[0])
        self.alive = len(seqs) - np.searchsorted(self.n[::-1], np.arange(longest), side="right")
        self.offset = np.concatenate([[0], np.cumsum(self.alive)])
        flat, t = np.concatenate(seqs), np.arange(int(self.n.sum())) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        self.symbols = np.empty(len(flat), np.int32)
        self.symbols[self.offset[t] + np.repeat(np.arange(len(seqs)), self.n)] = flat

    def forward(self, m: Model):
        """Log10 likelihood of each sequence; filtered state probabilities, scales and emissions of each step."""
        off, k = self.offset.tolist(), len(m.start)
        one, move = np.ones(k, np.float32), m.move.astype(np.float32)
        # emissions relative to the symbol's overall share keep single precision safe; the shares' logs are added in double
        level = m.emit.max(1)
        emit = (m.emit / level[:, None]).astype(np.float32)[self.symbols]
        alpha, scale = np.empty_like(emit), np.empty(len(emit), np.float32)
        v = alpha[:off[1]]
        v[:] = m.start
        for t in range(len(off) - 1):
            lo, hi = off[t], off[t + 1]
            if t:
                v = np.matmul(v[:hi - lo], move, out=alpha[lo:hi])
            v *= emit[lo:hi]
            c = np.matmul(v, one, out=scale[lo:hi])
            v /= c[:, None]
        rank = np.arange(len(scale)) - np.repeat(self.offset[:-1], self.alive)
        logs = np.log10(scale.astype(np.float64)) + np.log10(level)[self.symbols]
        return np.bincount(rank, logs, len(self.n)), alpha, scale, emit

    def expected(self, m: Model, emit_sum: np.ndarray, move_sum: np.ndarray, start_sum: np.ndarray) -> float:
        """Add this slice's expected counts; its log10 likelihood."""
        loglik, alpha, scale, back = self.forward(m)
        off, alive, k = self.offset.tolist(), self.alive.tolist(), len(m.start)
        move = np.ascontiguousarray(m.move.T, np.float32)
        back /= scale[:, None]  # becomes emission * beta / scale
        beta = np.ones_like(back)
        for t in range(len(off) - 3, -1, -1):
            lo, n = off[t], alive[t + 1]
            later = back[off[t + 1]:off[t + 2]]
            later *= beta[off[t + 1]:off[t + 2]]
            np.matmul(later, move, out=beta[lo:lo + n])
        before = np.arange(off[1], off[-1]) - np.repeat(self.alive[:-1], self.alive[1:])
        move_sum += m.move * (alpha[before].T @ back[off[1]:])
        alpha *= beta  # now the posterior of the states
        start_sum += alpha[:off[1]].sum(0)
        for j in range(k):
            emit_sum[:, j] += np.bincount(self.symbols, alpha[:, j], len(emit_sum))
        return float(loglik.sum())


def slices_of(seqs: list[np.ndarray]):
    """Row numbers and slices of about SLICE tokens of sequences of like length."""
    order = np.argsort([-len(x) for x in seqs], kind="stable")
    start, held = 0, 0
    for i, r in enumerate(order):
        held += len(seqs[r])
        if held >= SLICE or i == len(order) - 1:
            rows = order[start:i + 1]
            yield rows, Slice([seqs[j] for j in rows])
            start, held = i + 1, 0


def sequences(batch: pa.RecordBatch) -> list[np.ndarray]:
    column = batch.column("symbols")
    flat, off = np.asarray(column.flatten()), np.asarray(column.offsets)
    return np.split(flat, (off[1:-1] - off[0])) if len(off) > 1 else []


def train(encoded: DataFrame, alphabet: Alphabet, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """Baum-Welch; the model and the log10 likelihood before each round."""
    spark, size, prior = encoded.sparkSession, alphabet.size, alphabet.prior
    model, history = Model.first(prior, states), []
    schema = arrow_schema("symbol int, e array<double>")
    rows = encoded.where("not held_out").select("symbols")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((model.start, model.move, model.emit))

        def run(batches, shared=shared):
            m = Model(*shared.value)
            k = len(m.start)
            emit, move, start, loglik = np.zeros((size, k)), np.zeros((k, k)), np.zeros(k), 0.0
            for batch in batches:
                for _, part in slices_of(sequences(batch)):
                    loglik += part.expected(m, emit, move, start)
            used = np.flatnonzero(emit.any(1))
            extra = np.vstack([move, start, np.full(k, loglik)])  # under symbols below 0
            yield to_batch({"symbol": [*used.tolist(), *range(-len(extra), 0)], "e": [*emit[used], *extra]}, schema)

        sums = rows.mapInArrow(run, _ddl(schema)).groupBy("symbol").agg(F.array(*[F.sum(F.col("e")[j]) for j in range(states)]).alias("e"))
        got = sums.toArrow()  # at most HEAD + CLASSES + states + 2 rows
        at, e = np.asarray(got.column("symbol")), np.array(got.column("e").to_pylist(), float).reshape(-1, states)
        emit, extra = np.zeros((size, states)), np.zeros((states + 2, states))
        emit[at[at >= 0]] = e[at >= 0]
        extra[at[at < 0]] = e[at < 0]
        history.append(float(extra[-1, 0]))
        model = model.update(extra[-2], extra[:states], emit, prior)
        shared.unpersist()
    return model, history


def score(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    from wearline.llm.quality import fold_is

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), text_column(docs, text_col).alias("text"))
    rows = rows.withColumn("held_out", fold_is("doc_id", 1, 5))
    vocab = stage(count_words(rows.where("not held_out")), "vocabulary")
    alphabet = Alphabet(vocab)
    encoded = stage(encode(rows, alphabet), "symbols")
    model, _ = train(encoded, alphabet, states, rounds)
    shared = spark.sparkContext.broadcast((model.start, model.move, model.emit))
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def of(batch: pa.RecordBatch):
        m, out = Model(*shared.value), np.zeros(batch.num_rows)
        for rows_, part in slices_of(sequences(batch)):
            out[rows_] = part.forward(m)[0]
        return {n: batch.column(n) for n in batch.schema.names if n != "symbols"} | {"loglik": out}

    plain = f"key bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_seen bigint, seen_log double, tail_log double, tail_mass double"
    scored = arrow_map(encoded.drop("rare"), of, f"{plain}, loglik double")
    posts = encoded.select("key", F.explode("rare").alias("r")).select("key", F.col("r.word").alias("word"), F.col("r.n").alias("k"))
    seldom = vocab.where(F.col("n") * LOOKUP < F.lit(alphabet.n))
    looked = posts.join(seldom, "word", "left").groupBy("key").agg(
        F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_log"), F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("rare_known"))
    rare = F.coalesce("rare_log", F.lit(0.0))
    return scored.join(looked, "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_seen") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(alphabet.n).cast("long").alias("train_tokens"),
        (F.col("seen_log") + rare - F.col("n_tokens") * F.lit(float(np.log10(alphabet.z)))).alias("base_score"),
        (F.col("loglik") + F.col("tail_log") + rare - F.col("tail_mass")).alias("score"))
