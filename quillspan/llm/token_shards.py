"""Token-ID output: documents -> wavelet shards -> per-document digests.

Documents are dealt in ranges of ascending doc_id, a shard each; every shard is encoded, packed and written in the task
that holds it. Only shard totals are summed in order (one row a shard).

Null texts count as empty (the end id alone). Rows with a null doc_id come last and fill shards of their own; rows that
repeat a doc_id stand next to each other, in the order of their texts within a shard. An empty table has no shards. Long
texts are encoded whole. Columns other than doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from itertools import compress, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .wavelet import dumps, loads

SHARD = pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("data", pa.binary())])
RESULT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
END_ID = 2
BATCH = 8_000_000


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for U+0100 onwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """The tokenizers library, asked once for each distinct word.

    Where the normaliser and splitter are the ones of the word-level BPE file, white space always separates, so a text's
    ids are those of its words. Distinct normalised pieces go to the library's BPE model in one call a batch, without the
    per-text cost of its alignment. Any other tokenizer file is used as it is, text by text.
    """

    LIMIT = 800_000
    NORMALIZER = ["NFC", "Replace", "Lowercase"]

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        got = json.loads(spec)
        self.whole = Tokenizer.from_str(spec)
        # ids as the bytes of 32-bit (16-bit where the vocabulary allows) integers, by word and by normalised piece
        self.words: dict[bytes, bytes] = {}
        # when there are too many, frequent words come back from the generation before without being learnt again
        self.before: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {"\n": b""}
        steps = [x["type"] for x in (got.get("normalizer") or {}).get("normalizers", [])]
        split = (got.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = steps == self.NORMALIZER and [x["type"] for x in split] == ["Split", "ByteLevel"] and split[0]["behavior"] == "Removed" and split[0]["invert"] and not split[1]["use_regex"] and not split[1]["add_prefix_space"] and got["model"]["type"] == "BPE"
        self.kind = np.dtype("<u2" if self.whole.get_vocab_size() <= 65536 else "<u4")
        if self.by_word:
            self.special = [x["content"].encode() for x in got["added_tokens"]]
            self.cut = regex.compile(r"\n|" + split[0]["pattern"]["Regex"]).findall
            self.letters = _byte_letters() | {10: "\n"}
            self.model = Tokenizer.from_str(json.dumps(got | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}))
            suffix, vocab = got["model"].get("end_of_word_suffix") or "", got["model"]["vocab"]
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True

    def _normal(self, words: list[bytes]) -> list[str]:
        text = b"\n".join(words).decode()
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # the library lowers letter by letter; Python does but for a final sigma
        return ("".join(map(str.lower, text)) if "\u03a3" in text else text.lower()).split("\n")

    def _ids(self, new: list[str]) -> list[bytes]:
        """The ids of each of the pieces."""
        spelt = "\n".join(new).encode().decode("latin-1").translate(self.letters).split("\n")
        # without alignment the call is quicker, and a piece's last id shows by the end mark of its token
        ids = np.array(self.model.encode_batch_fast([spelt], is_pretokenized=True, add_special_tokens=False)[0].ids, self.kind)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(new) or ends[-1] != len(ids):
            got = self.model.encode(spelt, is_pretokenized=True, add_special_tokens=False)
            ids, ends = np.array(got.ids, self.kind), np.searchsorted(np.array(got.word_ids), np.arange(len(new)), "right")
        raw, cuts = ids.tobytes(), (ends * self.kind.itemsize).tolist()
        return [raw[i:j] for i, j in zip([0, *cuts], cuts, strict=False)]

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """The ids of words not known yet, which are remembered."""
        known, norm = self.pieces, self._normal(words)
        # a word of letters alone is one piece; the others are cut, with a line end after each
        whole = list(map(str.isalpha, norm))
        plain, odd = list(compress(norm, whole)), [w for w, x in zip(norm, whole, strict=True) if not x]
        cut = self.cut("\n".join([*odd, ""])) if odd else []
        if new := list(set(plain).union(cut).difference(known)):
            known.update(zip(new, self._ids(new), strict=True))
        parts = list(map(known.__getitem__, cut))
        raw, ends = b"".join(parts), np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        at = ends[np.fromiter(map("\n".__eq__, cut), bool, len(cut))].tolist()
        ones, others = map(known.__getitem__, plain), (raw[i:j] for i, j in pairwise([0, *at]))
        out = [next(ones if x else others) for x in whole]
        self.words.update(zip(words, out, strict=True))
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.encode_raw([t.encode() for t in texts])

    def encode_raw(self, raw: list[bytes]) -> list[np.ndarray]:
        """The ids of texts in UTF-8."""
        if not self.by_word:
            return [np.array(e.ids, np.uint32) for e in self.whole.encode_batch_fast([r.decode() for r in raw], add_special_tokens=False)]
        # a special token's own string in a text is matched by the library before anything else
        odd = {i for i, r in enumerate(raw) if any(s in r for s in self.special)}
        texts = pa.array([b"" if i in odd else r for i, r in enumerate(raw)], pa.large_binary())
        # words are told apart, and their ids laid out, by Arrow: Python sees each distinct one once a call
        cut = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        words = cut.flatten().dictionary_encode()
        ids = pa.array(self._known(words.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(words.indices)
        _, at, data = ids.buffers()
        ends = np.frombuffer(at, np.int64, len(ids) + 1)[cut.offsets.to_numpy()] // self.kind.itemsize
        flat, ends = np.frombuffer(data or b"", self.kind, ends[-1]), ends.tolist()
        return [np.array(self.whole.encode(raw[i].decode(), add_special_tokens=False).ids, np.uint32) if i in odd else flat[a:b] for i, (a, b) in enumerate(pairwise(ends))]

    def _known(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words."""
        if len(self.words) > self.LIMIT:
            self.before, self.words = self.words, {}
        if len(self.pieces) > self.LIMIT:
            self.pieces = {"\n": b""}
        got = list(map(self.words.get, words))
        if miss := [i for i, x in enumerate(got) if x is None]:
            if self.before:
                for i in miss:
                    if (x := self.before.get(words[i])) is not None:
                        got[i] = self.words[words[i]] = x
                miss = [i for i in miss if got[i] is None]
            for i, x in zip(miss, self._learn(list(map(words.__getitem__, miss))) if miss else [], strict=True):
                got[i] = x
        return got


_ENCODERS: dict[int, WordEncoder] = {}


def encoder(spec: str) -> WordEncoder:
    """One a worker process: its words stay known from task to task."""
    key = hash(spec)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(spec)
    return _ENCODERS[key]


def tokenizer_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _pack(spec_of):
    def pack(table: pa.Table) -> pa.Table:
        enc = encoder(spec_of.value)
        ids = table.column("doc_id").combine_chunks()
        key, texts = np.asarray(ids.fill_null(0)), table.column("text").combine_chunks().cast(pa.binary())
        order = np.argsort(key, kind="stable")
        if len(np.unique(key)) < len(key):
            order = np.array(sorted(order.tolist(), key=lambda i: (key[i], texts[i].as_py() or b"")), np.int64)
        each, lens, batch, size = [], [], [], 0
        # a call for about BATCH bytes: more of a text's words are known to it, and long texts stay few
        for k, i in enumerate(order.tolist(), 1):
            batch.append(texts[i].as_py() or b"")
            size += len(batch[-1])
            if size >= BATCH or k == len(order):
                for got in enc.encode_raw(batch):
                    each += [got, np.array([END_ID], np.uint16)]
                    lens.append(len(got) + 1)
                batch, size = [], 0
        flat = np.concatenate(each).astype(np.uint32)
        return pa.Table.from_pylist([{"shard": table.column("chunk")[0].as_py(), "n_docs": len(order), "n_tokens": len(flat), "doc_ids": ids.take(pa.array(order)).to_pylist(), "data": dumps(flat, np.array(lens))}], schema=SHARD)

    return pack


def write_shards(docs: DataFrame, path: str, tokenizer: str, shard_docs: int = 2000) -> DataFrame:
    """Encode and write the shards under path; returns the written table: a row a shard, data being its file."""
    spark = docs.sparkSession
    docs = C.texts(docs)
    cut = C.ranges(docs, shard_docs)
    spec = spark.sparkContext.broadcast(tokenizer_spec(tokenizer))
    dealt = C.chunked(docs, cut).repartition(max(C.parts(spark), cut.chunks // 32 + 1), "chunk")
    dealt.groupBy("chunk").applyInArrow(_pack(spec), C.schema(SHARD)).write.parquet(path)
    return spark.read.schema(C.schema(SHARD)).parquet(path)


def _read(batches):
    for b in batches:
        for row in b.to_pylist():
            matrix, lengths = loads(row["data"])
            flat = np.ascontiguousarray(matrix.ids(), "<u4")
            ends = np.cumsum(lengths)
            out = [(d, row["start"] + int(e - n), int(n), zlib.crc32(memoryview(flat[e - n : e]).cast("B"))) for d, n, e in zip(row["doc_ids"], lengths.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out, strict=True), RESULT, strict=True)], schema=RESULT)


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document, read back from the shard files: position in the stream, tokens, CRC of its ids."""
    totals = shards.select("shard", "n_tokens").withColumn("start", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # a number for each shard, of which write_shards makes a million at most: the files themselves stay where they are
    return shards.drop("n_tokens").join(F.broadcast(totals.select("shard", "start")), "shard").select("start", "doc_ids", "data").mapInArrow(_read, C.schema(RESULT))
