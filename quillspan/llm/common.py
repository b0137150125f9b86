"""Helpers shared by the training-data operators.

Words everywhere are maximal runs of ``[^\\x20\\x09-\\x0D]`` - exactly what ``bytes.split()`` cuts.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Hashable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_OWN: list[str] = []
#: what a worker process keeps from task to task, of one operator
_KEPT: dict[Hashable, object] = {}
#: glibc alone has it
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one on a local master where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isEmpty():
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = own.get()
    if not found:
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="quillspan-"))
        found = _OWN[0]
    return found.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder as Parquet and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspan/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a table made by ``written`` that no plan reads any more."""
    spark = df.sparkSession
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/quillspan/" in f:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores before it as keep it apart from the given columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone: other columns, clashing names included, don't matter."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def kept(key: Hashable, make: Callable[[], object]):
    """What the tasks of one operator share in a worker process, made by the first of them. Another key takes its place."""
    if key not in _KEPT:
        release()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Drop what another operator keeps in this worker process: it would stand beside the memories of the task that begins."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()  # a codec and its memory hold each other


def give_back() -> None:
    """Free memory that Arrow and the C library hold goes to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def tidy(run):
    """run over batches; at the end its worker, which may idle for stages, gives back what is free."""

    def task(batches):
        yield from run(batches)
        give_back()

    return task


class WordHash(dict):
    """bytes -> 64-bit hash, remembered for the most recent words."""

    LIMIT = 1_000_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def hashes(words: list[bytes], memo: WordHash) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), dtype=U64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: each output bit depends on each input bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def odd(seed: int, n: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


def windows(h: np.ndarray, k: int, mult: np.ndarray) -> np.ndarray:
    """Hashes of all runs of k values; empty where there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = h[:n] * mult[0]
    for j in range(1, k):
        out += h[j : j + n] * mult[j]
    return mix(out)


def schema(arrow: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", pa.float64(): "double", pa.bool_(): "boolean", pa.list_(pa.int32()): "array<int>", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in arrow)


@dataclass(frozen=True)
class Ranges:
    """Ranges of doc_id in ascending order, about equal in rows: chunks 0, 1, 2, ...

    An id that fills more than a range by itself has ``splits`` chunks of its own after the other ids of its range, and
    rows without an id have ``nulls`` chunks at the end; within these a row's text decides. So no chunk grows with the
    rows of one id.
    """

    bounds: np.ndarray
    splits: np.ndarray
    nulls: int

    @property
    def offsets(self) -> np.ndarray:
        """The first chunk of each range; the last entry is the first chunk of rows without an id."""
        return np.concatenate([[0], np.cumsum(1 + self.splits), [len(self.bounds) + int(self.splits.sum()) + 1]]).astype(np.int64)

    @property
    def chunks(self) -> int:
        return int(self.offsets[-1]) + self.nulls

    def groups(self, chunks: np.ndarray) -> np.ndarray:
        """The first of the chunks that share their doc_id, or have none; any other chunk stands for itself."""
        offsets = self.offsets
        at = np.searchsorted(offsets, chunks, "right") - 1
        return np.where(at == len(offsets) - 1, offsets[-1], offsets[at] + np.minimum(chunks - offsets[at], 1))


def _constant(values: np.ndarray) -> Column:
    """An array that the optimiser folds into one literal, however long."""
    return F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast("array<bigint>")


def text_part(text: Column) -> Column:
    """31 bits of a text's hash: rows of one doc_id are dealt out, and follow each other, by these."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 33)


def ranges(docs: DataFrame, per_chunk: int, most: int = 1 << 20) -> Ranges:
    """Ranges of about per_chunk rows. At most ``most`` numbers reach the driver, however many rows there are."""
    n, known = docs.agg(F.count("*"), F.count("doc_id")).first()
    k, nulls = min(most, max(1, -(-known // per_chunk))), -(-(n - known) // per_chunk)
    if k == 1:
        return Ranges(np.empty(0, np.int64), np.empty(0, np.int64), nulls)
    at = [i / k for i in range(1, k)]
    got = docs.select(F.percentile_approx("doc_id", at, min(1_000_000, 100 * k)).alias("b")).first()["b"] or []
    bounds, times = np.unique(np.array(got, dtype=np.int64), return_counts=True)
    # an id that stands at several of the cuts holds about so many ranges of rows
    return Ranges(bounds, np.where(times > 1, times, 0), nulls)


def chunked(rows: DataFrame, cut: Ranges) -> DataFrame:
    """rows (with doc_id and text) and the chunk of each."""
    part = text_part(F.col("text"))
    none = F.lit(int(cut.offsets[-1])) + F.shiftright(part * max(1, cut.nulls), 31)
    if not len(cut.bounds):
        return rows.withColumn("chunk", F.when(F.col("doc_id").isNull(), none).otherwise(0).cast("int"))
    (at_name,) = free(rows.columns, "range")
    bounds, splits, offsets = map(_constant, (cut.bounds, cut.splits, cut.offsets))
    # how many bounds are below the id, by halving steps
    steps = [1 << i for i in reversed(range(len(cut.bounds).bit_length()))]
    below = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) < F.col("doc_id"), at + step).otherwise(at))
    at = F.col(at_name)
    pieces = F.get(splits, at)
    own = (F.get(bounds, at) == F.col("doc_id")) & (pieces > 0)
    chunk = F.when(F.col("doc_id").isNull(), none).when(own, F.get(offsets, at) + 1 + F.shiftright(part * pieces, 31)).otherwise(F.get(offsets, at))
    return rows.withColumn(at_name, below).withColumn("chunk", chunk.cast("int")).drop(at_name)
