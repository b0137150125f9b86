"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words; words under its zeros don't enter the hash, so a substituted word spoils
only the windows that look at it. Test hashes and training hashes are joined, and around every hit the two texts are laid
side by side on the hit's diagonal: of all stretches with four of five words equal (a sum of at least 0 at +1 for an equal
word and -4 for a substituted one) the one with the most equal words has to hold at least ``min_match`` of them, or all but
a fifth of a shorter item. Any such stretch has a hit: four words running are equal in it, or a spaced mask meets it.

Test items are hashed in blocks of at most ``block_words`` words. A block is what a task holds, so its size is bounded
whatever the benchmark's size, and each block meets all documents in one pass without a shuffle: the hash join runs where
the document is, and both word sequences are at hand to verify. Items of equal words are one class.

Words are compared in lower case without punctuation around them. Items of fewer than ``min_words`` words are passed
over: so short a run of words says nothing. Null texts on either side match nothing; rows that repeat a doc_id are each
reported.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

MASKS = ("11010011", "10111001", "11100101", "11001011", "1111")
RESULT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_copies", pa.int64()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("n_equal", pa.int64()), ("item_words", pa.int64())])
EDGE = re.compile(r"^\W+|\W+$")


def plain(word: bytes) -> bytes:
    return EDGE.sub("", word.decode("utf-8", "replace").lower()).encode()


def item_words(text: str | None) -> list[bytes]:
    return [w for w in (plain(x) for x in (text or "").encode("utf-8", "surrogatepass").split()) if w]


def best_stretch(equal: np.ndarray) -> tuple[int, int]:
    """Start and end of the stretch with the most equal words of all that have four of five equal, from the first to the last equal one."""
    count = np.concatenate([[0], np.cumsum(equal)])
    total = 5 * count - 4 * np.arange(len(count))
    # for each end, the first start that leaves a sum of at least 0 holds the most equal words
    first = np.searchsorted(-np.minimum.accumulate(total), -total, "left")
    end = int(np.argmax(count - count[first]))
    inside = np.flatnonzero(equal[first[end] : end]) + first[end]
    return (int(inside[0]), int(inside[-1]) + 1) if len(inside) else (0, 0)


class Block:
    """Test items of one block: word numbers, seed hashes and where they come from."""

    def __init__(self, items: list[tuple[int, int, list[bytes]]]):
        self.vocab: dict[bytes, int] = {}
        self.items = [(i, n, np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws], np.int64)) for i, n, ws in items]
        hs, owners = [], []
        for k, (_, _, ids) in enumerate(self.items):
            for h in self.seeds(ids):
                hs.append(h)
                owners.append(np.stack([np.full(len(h), k), np.arange(len(h))], axis=1))
        self.hash = np.concatenate(hs) if hs else np.empty(0, C.U64)
        self.owner = np.concatenate(owners) if owners else np.empty((0, 2), np.int64)
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.owner = self.hash[order], self.owner[order]
        # a bit per residue: most training hashes need no search
        self.may = np.zeros(1 << 22, bool)
        self.may[(self.hash >> C.U64(42)).astype(np.int64)] = True

    @staticmethod
    def seeds(ids: np.ndarray):
        mult = C.odd(99, max(map(len, MASKS)))
        x = C.mix(ids.astype(C.U64))
        for m, mask in enumerate(MASKS):
            n = len(ids) - len(mask) + 1
            if n <= 0:
                yield np.empty(0, C.U64)
                continue
            h = np.full(n, C.U64(m + 1))
            for j in (j for j, c in enumerate(mask) if c == "1"):
                h = h + x[j : j + n] * mult[j]
            yield C.mix(h)

    def number(self, memo: dict[bytes, int], words: list[bytes]) -> np.ndarray:
        """0 stands for a word that no item has, -1 for one without a letter or digit, which takes no place."""
        for w in set(words).difference(memo):
            p = plain(w)
            memo[w] = self.vocab.get(p, 0) if p else -1
        return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))

    def overlaps(self, numbers: np.ndarray, min_match: int):
        """(item, start, end, equal) of each item's best verified overlap, in word coordinates of the document."""
        place = np.flatnonzero(numbers >= 0)
        ids = numbers[place]
        if np.count_nonzero(ids) < 4:
            return []
        found: set[tuple[int, int]] = set()
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for h, mask in zip(self.seeds(ids), MASKS, strict=True):
            if not len(h):
                continue
            at = np.flatnonzero(self.may[(h >> C.U64(42)).astype(np.int64)] & (known[len(mask) :] - known[: -len(mask)] >= mask.count("1")))
            if not len(at):
                continue
            lo, hi = np.searchsorted(self.hash, h[at], "left"), np.searchsorted(self.hash, h[at], "right")
            for p, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                found.update((int(k), p - int(j)) for k, j in self.owner[a:b])
        best: dict[int, tuple[int, int, int]] = {}
        for k, diagonal in sorted(found):
            item = self.items[k][2]
            lo, hi = max(0, -diagonal), min(len(item), len(ids) - diagonal)
            equal = item[lo:hi] == ids[lo + diagonal : hi + diagonal]
            need = max(min(min_match, -(-4 * len(item) // 5)), best.get(k, (0, 0, 0))[2] + 1)
            if np.count_nonzero(equal) < need:
                continue
            s, e = best_stretch(equal)
            n = int(equal[s:e].sum())
            if n >= need:
                best[k] = (int(place[s + lo + diagonal]), int(place[e - 1 + lo + diagonal]) + 1, n)
        return [(k, *v) for k, v in best.items()]


#: by a name of each block and call: other items may have the same ids
_BLOCKS: dict[str, tuple[Block, dict[bytes, int]]] = {}


def _search(shared, min_match: int):
    @C.tidy
    def search(batches):
        C.release()
        key = shared.value[0]
        if key not in _BLOCKS:
            _BLOCKS.clear()
            _BLOCKS[key] = (Block(shared.value[1]), {})
        block, memo = _BLOCKS[key]
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if len(memo) > 1_000_000:
                    memo.clear()
                numbers = block.number(memo, (text.as_py() or "").encode("utf-8", "surrogatepass").split())
                out += [(doc_id, block.items[k][0], block.items[k][1], s, e, n, len(block.items[k][2])) for k, s, e, n in block.overlaps(numbers, min_match)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), RESULT, strict=True)], schema=RESULT) if out else pa.RecordBatch.from_pylist([], schema=RESULT)

    return search


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = 13, min_words: int = 8, block_words: int = 2_000_000) -> DataFrame:
    """A row for each document and each test item that it holds: where, and how many words are equal.

    item_id is the smallest id of all items with the same words; n_copies says how many they are.
    """
    spark = docs.sparkSession
    docs = C.texts(docs)

    def split(batches):
        for b in batches:
            got = [(i, b" ".join(ws), len(ws)) for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) if len(ws := item_words(t.as_py())) >= min_words and i is not None]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.binary()), pa.array([g[2] for g in got], pa.int64())], names=["item_id", "words", "n"])

    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(split, "item_id long, words binary, n long")
    items = C.written(items.groupBy("words", "n").agg(F.min("item_id").alias("item_id"), F.count("*").alias("copies")), "items")
    blocks = max(1, -(-(items.agg(F.sum("n")).first()[0] or 0) // block_words))
    out = None
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id").select("item_id", "copies", "words").toLocalIterator()
        block = [(r.item_id, r.copies, bytes(r.words).split(b" ")) for r in rows]
        if not block and blocks > 1:
            continue
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, block))
        found = docs.mapInArrow(_search(shared, min_match), C.schema(RESULT))
        out = found if out is None else out.unionByName(found)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that hold no test item, all columns as they were, whatever their names.

    Rows that share a doc_id with one that holds an item go with it; rows with a null doc_id are taken as one document.
    """
    (bad,) = C.free(docs.columns, "bad_id")
    found = contaminated(docs, benchmark, **how).select(F.col("doc_id").alias(bad)).distinct()
    return docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(bad)), "left_anti")
