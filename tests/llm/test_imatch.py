"""I-Match fingerprints of short texts, and against plain Python."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspan.llm import imatch

DOC = "doc_id long, text string"


def test_imatch_tells_short_texts_apart(spark):
    """Each term of the lexicon enters a signature, and texts without one aren't all alike."""
    words = [f"t{i}" for i in range(100)]
    rows = [(i, f"{words[i % 100]} only{i}") for i in range(300)] + [(300 + i, f"{words[i]} {words[(7 * i + 1) % 100]}") for i in range(100)]
    rows += [(400 + i, f"rare{i}") for i in range(20)] + [(430, None), (431, ""), (432, " "), (433, " \t"), (434, "rare1")]
    df = spark.createDataFrame(rows, DOC)
    lex = imatch.lexicon(df, (0.001, 0.02))
    assert lex.count() == 101
    got = {x["doc_id"]: x for x in imatch.compared(df).collect()}
    signed = {}
    for i, t in rows:
        known = tuple(sorted({w for w in (t or "").split() if w in words or w == "rare1"}))
        signed.setdefault(got[i]["fingerprint"], set()).add(known or t or "")
    assert all(len(ts) == 1 for ts in signed.values())
    assert len(signed) == len({k for ts in signed.values() for k in ts})
    blank = [i for i, x in got.items() if not x["fingerprint"].strip("-")]
    assert sorted(blank) == [430, 431]
    assert [got[i]["near_next"] for i in (400, 405, 430, 431, 432, 433)] == [0.0, 0.0, 1.0, 0.0, 0.0, 0.0]


def by_hand(spark, rows, band):
    """Fingerprints, edited texts and likenesses of (doc_id, text) in plain Python; Spark lends its hash alone."""
    cut = lambda t: {w for w in re.split(r"[\x20\x09-\x0D]+", t.lower()) if w}
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: r[0])
    texts = [t for _, t in rows]
    after = texts[1:] + texts[:1]
    half = [len(t) // 2 for t in texts]
    edited = [t[: len(t) - k] + n[:k] for t, n, k in zip(texts, after, half)]
    known = sorted(set().union(*map(cut, texts + edited)) | set(texts) | set(edited))
    hashes = {r["w"]: (r["t"], r["h"]) for r in spark.createDataFrame([(w,) for w in known], "w string").withColumn("t", F.xxhash64("w")).withColumn("h", F.xxhash64("t", F.lit(7))).collect()}
    df = Counter(hashes[w][0] for t in texts for w in cut(t))
    lex = {t for t, n in df.items() if max(2, band[0] * len(rows)) <= n <= max(2, band[1] * len(rows))}

    def fingerprint(text):
        slots, whole, found = [None] * (imatch.SUBSETS + 1), None, False
        for w in cut(text) or ({text} if text else ()):
            t, h = hashes[w]
            whole = h if whole is None else whole ^ h
            if t in lex:
                found = True
                for j in {t % 32, (t >> 5) % 64} | ({32 + (t >> 11) % 512} if (t >> 11) % 512 < 32 else set()):
                    if j < 32 or j == 32 + (t >> 11) % 512:
                        slots[j] = h if slots[j] is None else slots[j] ^ h
        told = ["-" * 4 if s is None else f"{s & (1 << 64) - 1:016x}"[:4] for s in slots[:-1]]
        return "".join(told) + ("-" * 16 if found or whole is None else f"{whole & (1 << 64) - 1:016x}")

    def like(a, b):
        parts = [(a[4 * j : 4 * j + 4], b[4 * j : 4 * j + 4]) for j in range(imatch.SUBSETS)] + [(a[4 * imatch.SUBSETS :], b[4 * imatch.SUBSETS :])]
        filled = [(x, y) for x, y in parts if set(x) != {"-"} or set(y) != {"-"}]
        return 1.0 if a == b else sum(x == y for x, y in filled) / max(1, len(filled))

    own = [fingerprint(t) for t in texts]
    other = [fingerprint(t) for t in edited]
    return [(i, len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, like(f, g), like(f, n)) for (i, t), e, f, g, n in zip(rows, edited, own, other, own[1:] + own[:1])]


@pytest.mark.parametrize("per_chunk", [7, 2000])
def test_fingerprints_equal_those_by_hand(spark, monkeypatch, per_chunk):
    r = random.Random(21)
    words = [f"w{i}" for i in range(400)]
    rows = [(3 * i, " ".join(r.choice(words[: r.choice([20, 400])]) for _ in range(r.randrange(0, 60)))) for i in range(80)]
    rows += [(1, None), (2, ""), (4, " \t\n"), (5, rows[7][1]), (250, "É é ÀB " + rows[9][1])]
    real = imatch.with_next
    monkeypatch.setattr(imatch, "with_next", lambda docs: real(docs, per_chunk))
    got = imatch.compared(spark.createDataFrame(rows, "doc_id long, text string"), (0.02, 0.2)).collect()
    want = by_hand(spark, rows, (0.02, 0.2))
    assert sorted(map(tuple, got)) == want


def test_frequent_ids_are_dealt_out(spark):
    """A third of all rows without an id, a third with one id: every row once, next texts in one circle."""
    rows = [(i, f"text {i}") for i in range(60)] + [(30, f"same {i}") for i in range(60)] + [(None, f"none {i}") for i in range(60)]
    out = imatch.with_next(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    after = {r["text"]: r["next"] for r in out}
    assert len(out) == len(after) == len(rows)
    assert max(Counter(r["chunk"] for r in out).values()) < 25
    at, seen = "text 0", []
    for _ in rows:
        seen.append(at)
        at = after[at]
    assert at == "text 0" and len(set(seen)) == len(rows)
    ids = {t: i for i, t in rows}
    order = [ids[t] for t in seen]
    assert order == sorted(order, key=lambda i: (i is None, i or 0))
