"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

At each position the automaton reports, through its output links, every piece that ends there; each relaxes the best
score of that position from the best score where it starts. A character that no piece covers takes one fallback edge,
ten below the lowest score, and is written as its UTF-8 bytes in byte pieces. Ties go to the longer last piece.

White space marks begin pieces and never stand inside one (checked when a model is loaded; a model where they do is
searched text by text), so the best path of a text is that of its space-marked stretches, and each distinct stretch is
searched once while a worker remembers it.

Decoding is exact for every text: a literal U+2581 is written as bytes, so that it isn't read back as a space. Null texts
encode like empty ones, to no piece.
"""

from __future__ import annotations

import math
import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SPACE = "▁"
HOLE = "￾"  # stands for a literal U+2581 while a text is searched; a literal U+FFFE falls back to bytes like it
RESULT = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])


def read_model(path: str) -> dict:
    """Pieces and scores of a SentencePiece model file, in plain containers that can be broadcast (tens of thousands)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [(sp.id_to_piece(i), sp.get_score(i), i) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return {"pieces": pieces, "bytes": {int(sp.id_to_piece(i)[3:-1], 16): i for i in range(n) if sp.is_byte(i)}, "unknown": sp.unk_id()}


class _Memo(dict):
    """Stretch -> ids, as the bytes of 32-bit integers. Stretches that the full memory before this one knows come over."""

    def __init__(self, codec: "PieceCodec", before: dict[str, bytes]):
        self.codec, self.before = codec, before

    def __missing__(self, w: str) -> bytes:
        got = self.before.get(w)
        if got is None:
            got = np.array(self.codec.search(w), np.int32).tobytes()
        self[w] = got
        return got


class PieceCodec:
    #: stretches in a memory; there are two, this one and the one before
    LIMIT = 300_000

    def __init__(self, model: dict):
        self.bytes, self.unknown = model["bytes"], model["unknown"]
        self.text_of = {i: p for p, _, i in model["pieces"]}
        # what each id stands for in UTF-8, by id and as an array over all ids
        self.raw = {i: p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for i, p in self.text_of.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        self.table = pa.array(map(self.raw.get, range(max(self.raw, default=-1) + 1)), pa.large_binary())
        self.scores = {p: (s, i) for p, s, i in model["pieces"]}
        self.worst = min((s for _, s, _ in model["pieces"]), default=0.0) - 10
        self.auto = ahocorasick.Automaton()
        for p, s, i in model["pieces"]:
            self.auto.add_word(p, (len(p), s, i))
        self.auto.make_automaton()
        self.apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.text_of.values())
        self.memo = _Memo(self, {})

    def search(self, s: str) -> list[int]:
        """Ids of the best path through s, whose spaces are marked already."""
        n, worst = len(s), self.worst
        best, size, piece = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        at = 0  # positions up to here have taken their fallback edge and are final
        for end, (length, score, i) in self.auto.iter(s):
            while at < end:
                at += 1
                fallen = best[at - 1] + worst
                if fallen > best[at]:
                    best[at], size[at], piece[at] = fallen, 1, -1
            end += 1
            got = best[end - length] + score
            if got > best[end] or (got == best[end] and length > size[end]):
                best[end], size[end], piece[end] = got, length, i
        while at < n:
            at += 1
            fallen = best[at - 1] + worst
            if fallen > best[at]:
                best[at], size[at], piece[at] = fallen, 1, -1
        out, at = [], n
        while at:
            i = piece[at]
            if i >= 0:
                out.append(i)
            else:
                ch = SPACE if s[at - 1] == HOLE else s[at - 1]
                out += [self.bytes.get(b, self.unknown) for b in reversed(ch.encode("utf-8", "surrogatepass"))]
            at -= size[at]
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        if HOLE not in text:
            return self.encode_plain(text, True)
        out = []
        for k, x in enumerate(text.split(HOLE)):
            out += [self._raw(HOLE)] * (k > 0) + [self.encode_plain(x, k == 0)]
        return np.concatenate(out)

    def _raw(self, ch: str) -> np.ndarray:
        return np.array([self.bytes.get(b, self.unknown) for b in ch.encode("utf-8", "surrogatepass")], np.int32)

    def encode_plain(self, text: str, first: bool) -> np.ndarray:
        s = (SPACE if first else "") + text.replace(SPACE, HOLE).replace(" ", SPACE)
        if not s:
            return np.empty(0, np.int32)
        if not self.apart:
            return np.array(self.search(s), np.int32)
        if len(self.memo) > self.LIMIT:
            self.memo.before = {}
            self.memo = _Memo(self, self.memo)
        # cut where a mark follows another character: no piece stands across
        return np.frombuffer(b"".join(map(self.memo.__getitem__, STRETCH.findall(s))), np.int32)

    def decode(self, ids) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]

    def decode_all(self, ids: pa.Array) -> pa.Array:
        """The texts of lists of ids, a null list being empty."""
        flat = ids.flatten()
        if not len(flat):
            return pa.array([""] * len(ids), pa.string())
        taken = self.table.take(flat)
        if taken.null_count:
            raise KeyError("an id that stands for nothing")
        # the ids' bytes stand one after another: a text is what lies between its first and its last
        _, at, data = taken.buffers()
        lists = np.cumsum([0, *pc.list_value_length(ids).fill_null(0).to_numpy()])
        cuts = np.frombuffer(at, np.int64, len(taken) + 1)[lists]
        whole = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(cuts), data])
        return pc.utf8_slice_codeunits(whole.cast(pa.large_string()), 1).cast(pa.string())


STRETCH = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def codec(model: dict) -> PieceCodec:
    """One a worker process: its stretches stay known from task to task, until a task of another operator begins."""
    return C.kept(("pieces", hash(tuple(model["pieces"][:50])) ^ len(model["pieces"])), lambda: PieceCodec(model))


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, CRC-32 of the ids as little-endian 32-bit integers, and the ids."""
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    @C.tidy
    def run(batches):
        c = codec(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids = [c.encode(t.as_py() or "") for t in part.column(1)]
                lens = np.fromiter(map(len, ids), np.int64, len(ids))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lens]), pa.int32()), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lens), pa.array([zlib.crc32(np.ascontiguousarray(x, "<i4")) for x in ids], pa.int64()), lists], schema=RESULT)

    return C.texts(docs).mapInArrow(run, C.schema(RESULT))


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """The columns of ``encode`` and the text that the ids stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_model(model_path))

    @C.tidy
    def run(batches):
        c = codec(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, c.decode_all(part.column("ids"))], names=[*part.schema.names, "text"])

    names = C.schema(RESULT)
    return encoded.select(*RESULT.names).mapInArrow(run, f"{names}, text string")
