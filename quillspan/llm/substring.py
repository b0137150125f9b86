"""Substring dedup over the de Bruijn graph of token k-mers.

Each run of k words is an edge from its first k-1 words to its last k-1. Documents are dealt in ranges of ascending
doc_id ("chunks"). A chunk sends each of its distinct edges once, as sorted 64-bit hashes packed by hash bucket; a
bucket joins the edges of all chunks and answers with one bit each: whether an earlier chunk has it. So what is moved is
8 bytes an edge and a bit back, a passage in a third of all documents counts once a chunk, and no group grows with the
number of its copies. Back in its chunk, consecutive repeated edges compact into one path, and its word coordinates give
the span to remove.

Nulls: a null text has no words; rows with a null doc_id count as later than all others and remove nothing from each
other. Rows that share a doc_id never remove from each other, in whichever chunks they are. Empty texts and texts of fewer
than k words stay whole. Columns other than doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("n_spans", pa.int64()), ("span_starts", pa.list_(pa.int64())), ("span_ends", pa.list_(pa.int64()))])
LATEST = np.iinfo(np.int64).max


class Chunk:
    """Edges of one chunk: words, owner of each edge and its smallest doc_id here."""

    def __init__(self, table: pa.Table, k: int, buckets: int):
        ids = table.column("doc_id").combine_chunks()
        self.ids = ids.to_pylist()
        self.rank = np.asarray(ids.fill_null(LATEST), dtype=np.int64)
        mult, memo = C.odd(211, k), C.WordHash()
        self.words, edges = [], []
        for t in table.column("text"):
            words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
            self.words.append(words)
            edges.append(C.windows(C.hashes(words, memo), k, mult))
        self.counts = np.array([len(e) for e in edges], dtype=np.int64)
        flat = np.concatenate(edges) if edges else np.empty(0, C.U64)
        self.distinct, self.edge = np.unique(flat, return_inverse=True)
        owner = np.repeat(self.rank, self.counts)
        first = np.full(len(self.distinct), LATEST, np.int64)
        np.minimum.at(first, self.edge, owner)
        self.here = first[self.edge] < owner
        # sorted hashes are cut into equal ranges of hash space, so buckets are slices
        cuts = [(i << 64) // buckets for i in range(1, buckets)]
        self.cut = np.concatenate([[0], np.searchsorted(self.distinct, np.array(cuts, dtype=C.U64)), [len(self.distinct)]]).astype(np.int64)


def _ask(k: int, buckets: int):
    def ask(table: pa.Table) -> pa.Table:
        c, chunk = Chunk(table, k, buckets), table.column("chunk")[0].as_py()
        rows = [(b, c.distinct[c.cut[b] : c.cut[b + 1]].tobytes()) for b in range(buckets) if c.cut[b + 1] > c.cut[b]]
        return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int32()), "chunk": pa.array([chunk] * len(rows), pa.int32()), "edges": pa.array([e for _, e in rows], pa.binary())})

    return ask


def _answer(cut: C.Ranges):
    def answer(table: pa.Table) -> pa.Table:
        """Which edges of each chunk an earlier chunk has, those of the same doc_id (or of none) left aside."""
        order = np.argsort(np.asarray(table.column("chunk")), kind="stable")
        chunks = np.asarray(table.column("chunk"))[order]
        edges = table.column("edges").combine_chunks()
        lists = [np.frombuffer(edges[int(i)].as_py(), dtype=C.U64) for i in order]
        flat = np.concatenate(lists)
        group = np.repeat(cut.groups(chunks.astype(np.int64)), [len(x) for x in lists])
        by = np.argsort(flat, kind="stable")
        new = np.concatenate([[True], flat[by[1:]] != flat[by[:-1]]])
        # the chunk that has the edge first
        first = group[by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]]
        again = np.zeros(len(flat), bool)
        again[by] = group[by] != first
        ends = np.cumsum([len(x) for x in lists])
        bits = [again[e - len(x) : e] for x, e in zip(lists, ends, strict=True)]
        keep = [i for i, b in enumerate(bits) if b.any()]
        bucket = table.column("bucket")[0].as_py()
        return pa.table({"chunk": pa.array([int(chunks[i]) for i in keep], pa.int32()), "bucket": pa.array([bucket] * len(keep), pa.int32()), "again": pa.array([np.packbits(bits[i]).tobytes() for i in keep], pa.binary())})

    return answer


def _cut(k: int, buckets: int):
    def cut(docs: pa.Table, answers: pa.Table) -> pa.Table:
        c = Chunk(docs, k, buckets)
        earlier = np.zeros(len(c.distinct), bool)
        for b, bits in zip(answers.column("bucket").to_pylist(), answers.column("again").to_pylist(), strict=True):
            lo, hi = int(c.cut[b]), int(c.cut[b + 1])
            earlier[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)
        gone = c.here | earlier[c.edge]
        out, at = [], 0
        for doc_id, words, n in zip(c.ids, c.words, c.counts.tolist(), strict=True):
            mine, at = gone[at : at + n], at + n
            starts, ends, kept = [], [], words
            if mine.any():
                step = np.diff(np.concatenate([[0], mine.astype(np.int8), [0]]))
                firsts, lasts = np.flatnonzero(step == 1), np.flatnonzero(step == -1) + k - 1
                # paths whose spans touch or overlap are one span
                new = np.concatenate([[True], firsts[1:] > lasts[:-1]])
                starts = firsts[new].tolist()
                ends = lasts[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(lasts) - 1]])].tolist()
                kept, last = [], 0
                for s, e in zip(starts, ends, strict=True):
                    kept += words[last:s]
                    last = e
                kept += words[last:]
            out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), len(starts), starts, ends))
        return pa.Table.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out, strict=True), RESULT, strict=True)], schema=RESULT) if out else RESULT.empty_table()

    return cut


def remove_repeats(docs: DataFrame, k: int = 13, chunk_docs: int = 1000) -> DataFrame:
    """Per document: words, words removed, digest of the rest, and the removed spans in word coordinates."""
    docs = C.texts(docs)
    cut = C.ranges(docs, chunk_docs)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = int(min(65536, max(4, chars // 12_000_000)))
    n = max(C.parts(docs.sparkSession), cut.chunks // 64 + 1)
    dealt = C.chunked(docs, cut).repartition(n, "chunk")
    asked = dealt.groupBy("chunk").applyInArrow(_ask(k, buckets), "bucket int, chunk int, edges binary")
    answered = asked.groupBy("bucket").applyInArrow(_answer(cut), "chunk int, bucket int, again binary")
    return dealt.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(_cut(k, buckets), C.schema(RESULT))
