"""Chat formatting over reply trees.

Messages point to the message they answer. Ancestors are found by pointer doubling: each self-join doubles the distance
known, so a tree of depth d takes log2(d) joins, and the same tables list the nodes of the chosen branches. Branches are
ranked by the sum of their messages' scores, ties by leaf id, and the best ``top`` of each conversation are formatted.

A formatted turn is ``### role:\\n`` text ``\\n</turn>\\n``. Inside roles and texts a backslash escapes backslashes, ``#`` and
the slash of ``</turn>`` (and line ends within roles), so no text can end or begin a turn and reading back is exact. The
loss mask covers the assistants' texts. Output comes in parts of at most ``part_chars`` (more only for one longer turn), in
order, so a conversation of any length streams through its task.

Nulls: a null text or role is empty; a null conv_id is a conversation of its own; a message whose parent doesn't exist is
a root; messages on a cycle, or below one, belong to no branch and are left out. Rows that tie on their order keep the
order of role and text; repeated rows are turns of their own.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

END = "\n</turn>\n"
PART = pa.schema([("conv_id", pa.int64()), ("leaf", pa.int64()), ("part", pa.int64()), ("text", pa.string()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64()))])
DIGEST = pa.schema([("conv_id", pa.int64()), ("leaf", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
_ESCAPE = re.compile(r"\\|#|</turn>|\n")
_UNESCAPE = re.compile(r"\\([\\#/n])")


def escape(s: str, line: bool = False) -> str:
    def put(m: re.Match) -> str:
        got = m.group()
        return "<\\/turn>" if len(got) > 1 else ("\\n" if line else got) if got == "\n" else "\\" + got

    return _ESCAPE.sub(put, s)


def unescape(s: str) -> str:
    return _UNESCAPE.sub(lambda m: "\n" if m.group(1) == "n" else m.group(1), s)


def chained(rows: DataFrame) -> DataFrame:
    """Conversations whose turns are in order, as reply chains: conv_id, id, parent, role, text, score."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select(F.col("conv_id").cast("long"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("id", F.row_number().over(w).cast("long")).select("conv_id", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def branches(messages: DataFrame, top: int = 1) -> DataFrame:
    """The messages of each conversation's best branches: conv_id, leaf, depth, role, text."""
    # no conversation has the number that stands for none: it is beyond 64 bits
    key = F.coalesce(F.col("conv_id").cast("decimal(20,0)"), F.lit(str(2**63)).cast("decimal(20,0)"))
    m = C.written(messages.select(key.alias("c"), "conv_id", F.col("id").cast("long"), F.col("parent").cast("long"), "role", "text", F.coalesce("score", F.lit(0.0)).alias("score")), "messages")
    known = m.select("c", F.col("id").alias("parent"), F.lit(True).alias("there"))
    start = m.select("c", "id", "parent", "score").join(known, ["c", "parent"], "left").select("c", "id", F.when(F.col("there"), F.col("parent")).alias("up"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("steps"), F.col("score").alias("total"))
    start = C.written(start, "jump-0")
    # nodes that have reached their root take no part in further joins
    jumps, ended = [start.where("up IS NOT NULL")], [start.where("up IS NULL")]
    limit = max(1, m.count()).bit_length() + 1
    while len(jumps) <= limit and jumps[-1].limit(1).count():
        b = reduce(DataFrame.unionByName, [jumps[-1], *ended]).select(F.col("c").alias("bc"), F.col("id").alias("bid"), F.col("up").alias("bup"), F.col("steps").alias("bsteps"), F.col("total").alias("btotal"))
        nxt = jumps[-1].join(b, (F.col("c") == F.col("bc")) & (F.col("up") == F.col("bid"))).select("c", "id", F.col("bup").alias("up"), (F.col("steps") + F.col("bsteps")).alias("steps"), (F.col("total") + F.col("btotal")).alias("total"))
        nxt = C.written(nxt, f"jump-{len(jumps)}")
        jumps.append(nxt.where("up IS NOT NULL"))
        ended.append(nxt.where("up IS NULL"))
    done = reduce(DataFrame.unionByName, ended).select("c", "id", "steps", "total")
    leaves = done.join(m.select("c", F.col("parent").alias("id")).where("id IS NOT NULL").distinct(), ["c", "id"], "left_anti")
    best = Window.partitionBy("c").orderBy(F.desc("total"), F.asc("id"))
    marked = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("c", F.col("id").alias("leaf"), "id")
    marked = C.written(marked, "leaves")
    for j in jumps:
        over = marked.join(j.select("c", "id", "up"), ["c", "id"]).select("c", "leaf", F.col("up").alias("id"))
        marked = C.written(marked.unionByName(over), "marked")
    return marked.join(done.select("c", "id", "steps"), ["c", "id"]).join(m, ["c", "id"]).select("conv_id", "leaf", F.col("steps").alias("depth"), "role", "text")


def formatted(path: DataFrame, part_chars: int = 1_000_000) -> DataFrame:
    """One conversation for each (conv_id, leaf), in parts of whole turns, with the loss spans of each part in code points."""

    def run(batches):
        key, part, text, size, starts, ends = None, 0, [], 0, [], []
        for b in batches:
            out = []
            for conv, leaf, role, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4), strict=True):
                head, body = f"### {escape(role or '', True)}:\n", escape(words.as_py() or "")
                if text and ((conv, leaf) != key or size + len(head) + len(body) + len(END) > part_chars):
                    out.append((*key, part, "".join(text), starts, ends))
                    part, text, size, starts, ends = part + 1, [], 0, [], []
                if (conv, leaf) != key:
                    key, part = (conv, leaf), 0
                if role == "assistant":
                    starts.append(size + len(head))
                    ends.append(size + len(head) + len(body))
                text += [head, body, END]
                size += len(head) + len(body) + len(END)
            yield _batch(out, PART)
        if text:
            yield _batch([(*key, part, "".join(text), starts, ends)], PART)

    rows = path.select("conv_id", "leaf", "depth", "role", "text").repartition(C.parts(path.sparkSession), "conv_id", "leaf").sortWithinPartitions("conv_id", "leaf", "depth")
    return rows.mapInArrow(run, C.schema(PART))


def turns(part: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted part."""
    out = []
    for t in part.split(END)[:-1]:
        head, body = t.split("\n", 1)
        out.append((unescape(head[4:-1]), unescape(body)))
    return out


def digests(parts: DataFrame) -> DataFrame:
    """A row a conversation, read from its parts in order."""

    def run(batches):
        key = None
        for b in batches:
            out = []
            for conv, leaf, text, starts, ends in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                if (conv, leaf) != key:
                    if key:
                        out.append((*key, n, said.hexdigest(), chars, loss.hexdigest(), total))
                    key, n, said, loss, chars, total = (conv, leaf), 0, hashlib.sha256(), hashlib.sha256(), 0, 0
                text = text.as_py()
                for role, words in turns(text):
                    n += 1
                    said.update(f"{role}\n{words}\n".encode("utf-8", "surrogatepass"))
                for s, e in zip(starts, ends, strict=True):
                    words = unescape(text[s:e])
                    chars += len(words)
                    loss.update(words.encode("utf-8", "surrogatepass"))
                total += len(text)
            yield _batch(out, DIGEST)
        if key:
            yield _batch([(*key, n, said.hexdigest(), chars, loss.hexdigest(), total)], DIGEST)

    rows = parts.select(*PART.names).repartition(C.parts(parts.sparkSession), "conv_id", "leaf").sortWithinPartitions("conv_id", "leaf", "part")
    return rows.mapInArrow(run, C.schema(DIGEST))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema=schema)
