"""What a worker process keeps: of one operator at a time, and the codec's memory of stretches in two halves."""

import gc
import weakref
from types import SimpleNamespace

import pyarrow as pa
import pytest

from quillspan.llm import common, decontaminate, minhash, pieces, toxicity

MODEL = {"pieces": [(p, -float(i), i) for i, p in enumerate(["▁", "▁often", "a", "b", "c", "d"])], "bytes": {}, "unknown": 9}


def without_toxic():
    """The function that the workers get."""
    context = SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))
    docs = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context), columns=["doc_id", "text"], schema=None, mapInArrow=lambda f, _: f)
    return toxicity.without_toxic(docs, toxicity.Model())


TASKS = {
    "toxicity": without_toxic,
    "signatures": lambda: minhash._sign(5),
    "comparisons": lambda: minhash._compare(5, 80),
    "decontamination": lambda: decontaminate._search(SimpleNamespace(value=("a block", [(1, 1, [b"a"] * 9)])), 13),
}


@pytest.mark.parametrize("name", TASKS)
def test_other_operators_release_the_codec(name):
    codec = pieces.codec(MODEL)
    assert pieces.codec(MODEL) is codec  # tasks of one operator share it
    codec.encode("a b c d")
    held = weakref.ref(codec)
    del codec
    list(TASKS[name]()(iter([pa.RecordBatch.from_pylist([], schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))] * (name != "comparisons"))))
    gc.collect()
    assert held() is None
    common.release()


def test_memory_of_stretches():
    codec, whole, searched = pieces.PieceCodec(MODEL), pieces.PieceCodec(MODEL), []
    codec.LIMIT, inner = 20, codec.search
    codec.search = lambda s: searched.append(s) or inner(s)
    words = [f"{x}{y}{z}" for x in "abcd" for y in "abcd" for z in "abcd"]
    for w in words * 2:
        text = f"often {w}"
        assert codec.encode(text).tolist() == whole.encode_plain(text, True).tolist()
        assert len(codec.memo) <= codec.LIMIT + 2 and len(codec.memo.before) <= codec.LIMIT + 2
        assert not getattr(codec.memo.before, "before", {})
    assert searched.count("▁often") == 1  # frequent stretches outlive a full memory
    assert len(searched) > len(words)  # others are forgotten


def test_tasks_give_memory_back(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(True))
    for make in TASKS.values():
        list(make()(iter([])))
    assert len(given) == len(TASKS)
