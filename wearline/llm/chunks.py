"""Chunks of documents and exact questions about what they share.

Documents are packed once into chunks (compressed, a few MB) and written as a table bucketed by chunk, so
that answers join the texts without shuffling them again. A chunk asks by sending each bucket of a key space
one blob of its distinct keys; the bucket's task sees all chunks' blobs and answers each with one blob of
its own. Keys are distinct within a chunk, so a key that a third of all documents hold reaches a bucket once
per chunk at most.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from wearline.llm.common import arrow_schema, partitions, stage, text_column, to_batch
from wearline.session import ensure_checkpoint_dir

LEAST, MOST = 1 << 20, 1 << 23
_LAST = np.iinfo(np.int64).max


def pack(docs: DataFrame, label: str, chunk_bytes: int | None = None) -> DataFrame:
    """``(chunk, ids, blob)``: ids in ascending order (null last), the texts' lengths and bytes in the blob."""
    spark = docs.sparkSession
    parts = partitions(spark)
    if chunk_bytes is None:
        total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        chunk_bytes = int(min(MOST, max(LEAST, total // (8 * parts))))
    schema = arrow_schema("chunk bigint, ids array<bigint>, blob binary")

    def run(batches):
        chunk, held, rows = TaskContext.get().partitionId() << 33, 0, []

        def packed():
            rows.sort(key=lambda r: (_LAST if r[0] is None else r[0], r[1]))
            body = pickle.dumps(([len(t) for _, t in rows], b"".join(t for _, t in rows)))
            return to_batch({"chunk": [chunk], "ids": [[i for i, _ in rows]], "blob": [zstandard.compress(body, 3)]}, schema)

        for batch in batches:
            for row in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                rows.append(row)
                held += len(row[1])
                if held >= chunk_bytes:
                    yield packed()
                    chunk, held, rows = chunk + 1, 0, []
        if rows:
            yield packed()

    made = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_column(docs).alias("text")).mapInArrow(run, from_arrow_schema(schema))
    name = f"llm_{label}_{uuid.uuid4().hex}"
    made.write.bucketBy(parts, "chunk").option("path", f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}").saveAsTable(name)
    return spark.table(name)


def unpack(blob: bytes) -> list[bytes]:
    lengths, body = pickle.loads(zstandard.decompress(blob))
    at = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).tolist()
    return [body[a:b] for a, b in zip(at, at[1:], strict=False)]


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin and end in sorted 64-bit keys; buckets are equal ranges of the key space."""
    step = (1 << 64) // buckets + 1
    return np.concatenate([np.searchsorted(keys, np.array([b * step for b in range(buckets)], np.uint64)), [len(keys)]])


def bucket_count(chunks: DataFrame) -> int:
    return partitions(chunks.sparkSession)


def ask(chunks: DataFrame, buckets: int, send: Callable[[dict], Iterable[tuple[int, int, object]]]) -> DataFrame:
    """``(bucket, kind, chunk, payload)``: what ``send(row)`` yields as (bucket, kind, object) for every chunk."""
    schema = arrow_schema("bucket int, kind int, chunk bigint, payload binary")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                got = list(send(row))
                if got:
                    yield to_batch({"bucket": [g[0] for g in got], "kind": [g[1] for g in got], "chunk": [row["chunk"]] * len(got),
                                    "payload": [pickle.dumps(g[2], 5) for g in got]}, schema)

    return chunks.mapInArrow(run, from_arrow_schema(schema))


def answer(asked: DataFrame, reply: Callable[[int, list[int], list], Iterator[object]]) -> DataFrame:
    """One row per chunk: ``(chunk, answers array<struct<kind, bucket, reply>>)``. ``reply(kind, chunks, payloads)``
    sees all that was sent to one bucket under one kind, and gives an object back for each payload."""
    spark = asked.sparkSession
    parts = partitions(spark)
    schema = arrow_schema("chunk bigint, kind int, bucket int, reply binary")

    def run(batches):
        key, chunks, payloads = None, [], []

        def replies():
            got = [pickle.dumps(x, 5) for x in reply(key[1], chunks, payloads)]
            return to_batch({"chunk": chunks, "kind": [key[1]] * len(got), "bucket": [key[0]] * len(got), "reply": got}, schema)

        for batch in batches:
            for b, k, c, p in zip(*(batch.column(n).to_pylist() for n in ("bucket", "kind", "chunk", "payload")), strict=True):
                if (b, k) != key:
                    if chunks:
                        yield replies()
                    key, chunks, payloads = (b, k), [], []
                chunks.append(c)
                payloads.append(pickle.loads(p))
        if chunks:
            yield replies()

    dealt = asked.repartitionById(parts, F.pmod(F.col("bucket"), F.lit(parts)).cast("int")).sortWithinPartitions("bucket", "kind", "chunk")
    got = stage(dealt.mapInArrow(run, from_arrow_schema(schema)), "answers")
    return got.groupBy("chunk").agg(F.collect_list(F.struct("kind", "bucket", "reply")).alias("answers"))


def told(chunks: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """Chunks with their answers as column ``name``; the texts stay where they are bucketed."""
    return chunks.join(answers.withColumnRenamed("answers", name), "chunk", "left")


def read_answers(answers: list[dict] | None, kind: int = 0) -> dict[int, object]:
    """bucket -> reply of one kind."""
    return {a["bucket"]: pickle.loads(a["reply"]) for a in answers or () if a["kind"] == kind}


def packed_answers(answers: list[dict] | None, edges: np.ndarray, dtype, kind: int = 0) -> np.ndarray:
    """The replies to the bucket-wise slices of a chunk's sorted keys, put together again."""
    got = read_answers(answers, kind)
    out = np.zeros(int(edges[-1]), dtype)
    for b, v in got.items():
        out[edges[b]:edges[b + 1]] = np.frombuffer(zstandard.decompress(v), dtype)
    return out


def small(codes: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(codes).tobytes(), 1)


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    have, out = 1, a
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[:len(a) - width + 1], out[width - have:][:len(a) - width + 1])


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in any of the ranges."""
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, start, 1)
    np.add.at(mark, end, -1)
    return np.cumsum(mark[:n]) > 0
