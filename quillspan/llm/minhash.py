"""Near-duplicate groups by min-max hashing.

Under each permutation both the smallest and the largest value of a document's shingle set are kept, so P permutations
give 2P unbiased agreements for P hash evaluations a shingle. A band is a fixed random choice of ``ROWS`` of these lanes.
With 64 bands of six of 128 lanes a pair at a similarity of 0.8 shares no band with a chance of about 4e-6; one at 0.3
shares one with a chance of 5 in 100, so common passages seldom bring documents together.

Equal sets are one class, whatever their number. In each band bucket every class is compared, on full sets, with the one
that meets most others (the hub): about one comparison a class, not one a pair. For a while the classes left over get a
further hub of their own each round. What is still apart then is settled exactly, without pairing all: of each class only
its difference from the hub is looked at. Two sets A and B are linked if their differences DA and DB share enough,

    |DA and DB| >= (|DA| - q|A| + |DB| - q|B|) / 2        with q = (100 - percent) / (100 + percent),

and a class that isn't linked with its hub has |DA| - q|A| > q|hub|, so there is always something to share: what differs
from the hub in an order of its own (words that the hub hasn't first), cut to the prefix that a link can't do without,
is joined, and a bit map bounds the overlap within the join. Any two classes that share a bucket and are not connected
have been compared in this way: no link between components is lost. Where very many classes lie close under the
threshold of each other, the join still weighs many of them, but emits links alone.

Nulls: null and empty texts have no shingles and are linked with nothing. A text of fewer words than a shingle is one
shingle. Rows with a null doc_id take no part in links and are kept. Rows that repeat a doc_id are one document, linked
where any of its texts is. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import connected_components

PERMS, BANDS, ROWS = 64, 64, 6
#: rounds of further hubs before what is left is settled by differences
HUB_ROUNDS = 3
#: 64-bit words of the map of a difference
MAP = 8
SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])
COMPARED = pa.schema([("hub", pa.int64()), ("rep", pa.int64()), ("linked", pa.bool_()), ("n", pa.int64()), ("size", pa.int64()), ("delta", pa.list_(pa.int64())), ("map", pa.list_(pa.int64()))])


def shingle_set(text: str | None, n: int, memo: C.WordHash, mult: np.ndarray) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles, A-Z in lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, C.U64)
    h = C.hashes(words, memo)
    if len(h) < n:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], C.U64)
    return np.unique(C.windows(h, n, mult))


def band_lanes() -> list[np.ndarray]:
    """The lanes of each band: the same choice in every run."""
    return [np.argsort(C.mix(np.arange(2 * PERMS, dtype=C.U64) + C.U64(1 + k * 2 * PERMS)))[:ROWS] for k in range(BANDS)]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Smallest and largest value of each set (none empty) under each permutation: a row a lane."""
    a, b = C.odd(31, PERMS), C.mix(np.arange(PERMS, dtype=C.U64) + C.U64(77))
    sig = np.zeros((2 * PERMS, len(sets)), C.U64)
    if sets:
        flat = np.concatenate(sets)
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
        for p in range(PERMS):
            x = flat * a[p] + b[p]
            x ^= x >> C.U64(32)
            x *= a[-1 - p]
            sig[2 * p] = np.minimum.reduceat(x, at)
            sig[2 * p + 1] = np.maximum.reduceat(x, at)
    return sig


def _sign(n: int):
    salt, chosen = C.mix(np.arange(1, BANDS + 1, dtype=C.U64)), band_lanes()

    @C.tidy
    def sign(batches):
        C.release()
        memo, mult = C.WordHash(), C.odd(5, n)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [shingle_set(t.as_py(), n, memo, mult) for t in part.column(1)]
                full = [i for i, s in enumerate(sets) if len(s)]
                sig = signatures([sets[i] for i in full])
                keys = np.zeros((BANDS, len(full)), C.U64)
                for k, lanes in enumerate(chosen):
                    for lane in lanes:
                        keys[k] = C.mix(keys[k] * C.U64(0x9E3779B97F4A7C15) + sig[lane])
                    keys[k] = C.mix(keys[k] + salt[k])
                bands = [[] for _ in sets]
                for j, i in enumerate(full):
                    bands[i] = keys[:, j].view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=SIGNED)

    return sign


def _compare(n: int, percent: int):
    """Whether hub and class are linked, and what they differ in: first what the hub hasn't, then what it alone has."""

    @C.tidy
    def compare(batches):
        C.release()
        memo, mult = C.WordHash(), C.odd(5, n)
        last, centre = object(), np.empty(0, C.U64)
        for batch in batches:
            out = []
            for hub, rep, th, tr in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if hub != last:
                    last, centre = hub, shingle_set(th.as_py(), n, memo, mult)
                mine = shingle_set(tr.as_py(), n, memo, mult)
                delta = np.concatenate([np.setdiff1d(mine, centre, True), np.setdiff1d(centre, mine, True)])
                either = (len(mine) + len(centre) + len(delta)) // 2
                linked = 100 * (either - len(delta)) >= percent * either
                bits = np.zeros(64 * MAP, np.uint8)
                bits[(delta % C.U64(64 * MAP)).astype(np.int64)] = 1
                out.append((hub, rep, linked, len(mine), len(delta), delta.view(np.int64), np.packbits(bits).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), COMPARED, strict=True)] if out else [pa.array([], f.type) for f in COMPARED], schema=COMPARED)

    return compare


def _joined(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """rep, comp with the components that edges (a, b) tie made one: only components are walked, not their members."""
    a, b = (comps.select(F.col("rep").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
    between = edges.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where("ca <> cb").select("ca", "cb").distinct()
    merged = connected_components(between, "ca", "cb")
    return C.written(comps.join(merged.hint("merge"), comps.comp == merged.node, "left").select("rep", F.coalesce("component", "comp").alias("comp")), "components")


def _settled(compared: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes of one hub that are in different components, found by what differs from the hub."""
    own, hubs = comps.select("rep", "comp"), comps.select(F.col("rep").alias("hub"), F.col("comp").alias("main"))
    scale, slack = 100 + percent, 100 - percent
    placed = compared.join(own.hint("merge"), "rep").join(hubs.hint("merge"), "hub").select("hub", "rep", "comp", (F.col("comp") != F.col("main")).alias("odd"), "n", "size", "delta", "map", (scale * F.col("size") - slack * F.col("n")).alias("w"))
    placed = C.written(placed, "placed")
    low = placed.groupBy("hub").agg(F.min("w").alias("low"), F.min(F.when(F.col("odd"), F.col("w"))).alias("low_odd")).where("low_odd IS NOT NULL")
    low = C.written(low, "low")
    sides = C.written(placed.join(low.hint("merge"), "hub"), "sides")

    def prefixes(rows: DataFrame, low: str, names: str) -> DataFrame:
        need = F.ceil((F.col("w") + F.col(low)) / F.lit(2.0 * scale) - 1e-9)
        cut = (F.col("size") - F.greatest(need, F.lit(1)) + 1).cast("int")
        return rows.where(cut > 0).select("hub", *(F.col(c).alias(c + names) for c in ("rep", "comp", "odd", "n", "size", "map", "w")), F.explode(F.slice("delta", F.lit(1), cut)).alias("e"))

    def lacking(x: str, y: str) -> Column:
        return sum((F.bit_count(F.get(x, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(y, F.lit(i))))) for i in range(1, MAP)), F.bit_count(F.get(x, F.lit(0)).bitwiseAND(F.bitwise_not(F.get(y, F.lit(0))))))

    left, right = prefixes(sides, "low_odd", "1"), prefixes(sides.where("odd"), "low", "2")
    most = F.least(F.col("size1") - lacking("map1", "map2"), F.col("size2") - lacking("map2", "map1"))
    possible = F.expr(f"comp1 <> comp2 AND (NOT odd1 OR rep1 < rep2) AND 100 * least(n1, n2) >= {percent} * greatest(n1, n2)") & (2 * scale * most >= F.col("w1") + F.col("w2"))
    met = left.join(right.hint("merge"), (left.hub == right.hub) & (left.e == right.e) & possible).select(left.hub, "rep1", "rep2").distinct()
    a, b = (sides.select("hub", F.col("rep").alias(f"rep{k}"), F.col("delta").alias(f"delta{k}"), F.col("w").alias(f"w{k}")) for k in (1, 2))
    both = C.written(met, "met").join(a.hint("merge"), ["hub", "rep1"]).join(b.hint("merge"), ["hub", "rep2"])
    return both.where(2 * scale * F.size(F.array_intersect("delta1", "delta2")) >= F.col("w1") + F.col("w2")).select(F.col("rep1").alias("a"), F.col("rep2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked doc_id, itself included), kept."""
    docs = C.texts(docs)
    signed = C.written(docs.mapInArrow(_sign(words), C.schema(SIGNED)), "signed")
    classes = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    classes = C.written(classes, "classes")
    members = signed.join(classes, "digest").select("doc_id", "rep").distinct()
    spread = signed.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"]).select(F.col("doc_id").alias("rep"), F.explode("bands").alias("key"))
    spread = C.written(spread, "bands")
    shared = C.written(spread.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    bucketed = C.written(spread.join(shared.hint("merge"), "key"), "bucketed")
    C.dropped(spread)
    # of a group of copies the original meets most others: it makes the best hub
    drawn = C.written(bucketed.groupBy("rep").agg(F.sum("size").alias("drawn")), "drawn")
    bucketed = C.written(bucketed.join(drawn.hint("merge"), "rep").select("key", "rep", "drawn"), "bucketed")
    first = F.max_by("rep", F.struct("drawn", -F.col("rep")))
    hubs = C.written(bucketed.groupBy("key").agg(first.alias("hub")), "hubs")
    # texts move once, whatever the rounds; the hint keeps the plan the same at every size
    texts = C.written(docs.join(drawn.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi"), "texts")

    def compared(pairs: DataFrame) -> DataFrame:
        th, tr = (texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"t{x}")) for x in ("hub", "rep"))
        full = tr.join(pairs.hint("merge"), "rep").join(th.hint("merge"), "hub").select("hub", "rep", "thub", "trep")
        return C.written(full.mapInArrow(_compare(words, percent), C.schema(COMPARED)), "compared")

    first_hubs = compared(bucketed.join(hubs.hint("merge"), "key").where("rep <> hub").select("hub", "rep").distinct())
    links = lambda found: found.where("linked").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    comps = _joined(drawn.select("rep", F.col("rep").alias("comp")), links(first_hubs))
    left = bucketed.join(hubs.hint("merge"), "key").select("key", "rep", "drawn", "hub")
    for _ in range(HUB_ROUNDS):
        # what its bucket's hubs have not drawn in gets a hub of its own
        main = comps.select(F.col("rep").alias("hub"), F.col("comp").alias("main"))
        left = C.written(left.join(comps.hint("merge"), "rep").join(main.hint("merge"), "hub").where("comp <> main").select("key", "rep", "drawn", "comp"), "left")
        hubs = C.written(left.groupBy("key").agg(first.alias("hub"), F.max_by("comp", F.struct("drawn", -F.col("rep"))).alias("main")), "hubs")
        left = left.join(hubs.hint("merge"), "key")
        pairs = C.written(left.where("comp <> main").select("hub", "rep").distinct(), "pairs")
        left = left.select("key", "rep", "drawn", "hub")
        if pairs.isEmpty():
            break
        found = links(compared(pairs))
        if found.isEmpty():
            break
        comps = _joined(comps, found)
    comps = _joined(comps, _settled(first_hubs, comps, percent))
    # a doc_id whose rows are in several classes ties these together
    several = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("hi")).where("a <> hi").select("doc_id", "a")
    tied = C.written(members.join(several, "doc_id").where("a <> rep").select("a", F.col("rep").alias("b")), "tied")
    if not tied.isEmpty():
        lone = classes.select("rep").join(comps, "rep", "left_anti").select("rep", F.col("rep").alias("comp"))
        comps = _joined(comps.unionByName(lone), tied)
    named = members.join(comps, "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("comp", "rep")).alias("component"))
    out = signed.select("doc_id", "n_shingles").join(named, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"))
