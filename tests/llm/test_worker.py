"""What a Python worker keeps: one object, not one of every kind that its program has used."""

import sys
import tracemalloc

import pyarrow as pa

from wearline.llm import minhash
from wearline.llm.common import per_worker, text_slices


def test_a_worker_keeps_one_object(monkeypatch):
    monkeypatch.delitem(sys.modules, "_wearline_worker", raising=False)
    made = []

    def make(name):
        return lambda: made.append(name) or name

    assert [per_worker("a", 1, make("a")), per_worker("a", 1, make("a")), per_worker("b", 1, make("b"))] == ["a", "a", "b"]
    held = vars(sys.modules["_wearline_worker"])
    assert "a" not in held and held["held"] == (("b", 1), "b")  # the first kind has gone
    assert per_worker("a", 1, make("a")) == "a" and made == ["a", "b", "a"]
    sys.modules.pop("_wearline_worker")


def test_hashing_many_texts_holds_little_beside_them():
    """A worker's memory does not grow with the batch: texts are hashed a small range at a time, and read so."""
    words = [b" ".join(b"w%d" % (i * 37 + j) for j in range(300)) for i in range(4000)]  # some 8 MB
    tracemalloc.start()
    try:
        n = sum(1 for _ in map(len, minhash.shingle_sets(words, 2)))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == len(words) and most < 40e6  # 10 MB of it are the sets
    batch = pa.RecordBatch.from_pydict({"text": pa.array([b"abc", None, b"", b"defg", b"h"], pa.binary())})
    assert list(text_slices(batch, 4)) == [(0, 4, [b"abc", None, b"", b"defg"]), (4, 5, [b"h"])]
