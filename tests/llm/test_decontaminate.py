"""Overlaps with benchmark items against every stretch of every diagonal."""

import random

import numpy as np
import pytest

from quillspan.llm import decontaminate


def most_equal(equal):
    """The most equal words of any stretch with four of five equal, by trying all."""
    c = np.concatenate([[0], np.cumsum(equal)])
    return max((int(c[e] - c[s]) for s in range(len(equal)) for e in range(s + 1, len(equal) + 1) if 5 * (c[e] - c[s]) >= 4 * (e - s)), default=0)


@pytest.mark.parametrize(("words", "rate"), [(8, 0.1), (10, 0.2), (15, 0.2), (16, 0.2), (48, 0.2), (48, 0.25), (59, 0.2), (59, 0.25)])
def test_any_qualifying_stretch_is_found(words, rate):
    r = random.Random(words)
    item = [f"w{i}" for i in range(words)]
    block = decontaminate.Block([(1, 1, [w.encode() for w in item])])
    seen = 0
    for _ in range(300):
        ws = [w if r.random() > rate else "other" for w in item]
        equal = np.array([a == b for a, b in zip(ws, item)])
        most = most_equal(equal)
        want = most if most >= min(13, -(-4 * words // 5)) else 0
        doc = [f"n{i}".encode() for i in range(r.randrange(20))]
        got = block.overlaps(block.number({}, [*doc, *(w.encode() for w in ws)]), 13)
        assert [g[3] for g in got] == [want] * bool(want)
        for _, s, e, n in got:
            part = equal[s - len(doc) : e - len(doc)]
            assert part[0] and part[-1] and part.sum() == n and 5 * n >= 4 * len(part)
        seen += bool(want)
    assert seen > 50


def test_exact_run_beside_weaker_words():
    """13 equal words are enough, whatever follows."""
    equal = np.array([True] * 13 + ([False] * 2 + [True] * 5) * 5)
    s, e = decontaminate.best_stretch(equal)
    assert equal[s:e].sum() >= 13 and 5 * equal[s:e].sum() >= 4 * (e - s)


def test_same_ids_and_other_texts(spark):
    """A second benchmark in the same session is searched as itself."""
    texts = [" ".join(f"{c}{i}" for i in range(20)) for c in "ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for k, t in enumerate(texts):
        bench = spark.createDataFrame([(0, t)], "item_id long, text string")
        assert [r["doc_id"] for r in decontaminate.contaminated(docs, bench).collect()] == [k]
