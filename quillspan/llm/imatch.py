"""I-Match fingerprints with DataFrame functions alone.

Terms are the distinct words of a text in lower case, as 64-bit hashes. The lexicon holds the terms whose document
frequency lies in a band of inverse document frequency, counted over all documents. A term of at least a share f of the
documents is one of at most (mean distinct terms / f) terms, so the lexicon is bounded whatever the input; it is broadcast
below ``BROADCAST`` terms and joined by shuffle beyond. Random subsets of the lexicon overlap, and together they hold all
of it: each term is dealt to one of the dense subsets, every other term to one more of them, and a sixteenth of all terms
to a sparse subset besides. A subset's signature hashes the document's distinct terms in it. Sorting serves to make that
hash independent of order; here the terms' mixed hashes are combined by exclusive or, which has no order, so that Spark
can aggregate them partially and no list is built. A text without a term of the lexicon fills no signature; the hash of all
its terms stands behind the signatures instead, or the hash of the text itself if it is nothing but white space.
The fingerprint is the list of signatures and that hash. Likeness is the share that agrees among those that either fills.

The next document in ascending doc_id is found within ranges of doc_id; the first row of a range also stands, as a
guest, at the end of the range before it, so no sort of all rows in one task is needed.

Null texts count as empty. Only an empty text has a blank fingerprint; equal fingerprints have the likeness 1. Rows with a
null doc_id come last; rows that repeat a doc_id, or have none, follow in the order of a hash of their texts, so ranges
can part them too. Long texts are taken whole. An empty table gives an empty result. Columns other than doc_id and text,
whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: subsets of three 64ths of the lexicon for common texts, and of a 512th for long ones
DENSE, SPARSE = 32, 32
SUBSETS, DIGITS, WHOLE = DENSE + SPARSE, 4, 16
BAND = (0.001, 0.02)
BROADCAST = 1_000_000
BLANK = "-" * DIGITS
SEPARATOR = "[\\x20\\x09-\\x0D]+"
LATEST = 2**63 - 1


def terms(text: Column) -> Column:
    """Distinct hashes of a text's words."""
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(text), SEPARATOR), lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """The hashed terms whose document frequency is in the band (and at least 2)."""
    n = docs.count()
    counts = docs.select(F.explode(terms(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return C.written(counts.where((F.col("df") >= max(2.0, band[0] * n)) & (F.col("df") <= max(2.0, band[1] * n))).select("term"), "lexicon")


def signatures(rows: DataFrame, keys: list[str], text: str, lex: DataFrame) -> DataFrame:
    """keys and the fingerprint of the text column; rows with equal keys are taken as one text."""
    small = lex.count() <= BROADCAST
    has_word = F.col(text).rlike("[^\\x20\\x09-\\x0D]")
    spread = rows.select(*keys, F.explode_outer(F.when(has_word, terms(F.col(text))).when(F.col(text) != "", F.array(F.xxhash64(text)))).alias("term"))
    known = lex.select("term", F.lit(True).alias("in_band"))
    hit = spread.join(F.broadcast(known) if small else known, "term", "left").withColumn("h", F.when(F.col("term").isNotNull(), F.xxhash64("term", F.lit(7))))
    # bits of the term's hash deal it out; what isn't in the lexicon is dealt nowhere
    known_term = F.when(F.col("in_band"), F.col("term"))
    hit = hit.withColumn("one", F.pmod(known_term, F.lit(DENSE))).withColumn("two", F.pmod(F.shiftright(known_term, 5), F.lit(2 * DENSE))).withColumn("far", F.pmod(F.shiftright(known_term, 11), F.lit(512)))
    dense = [F.bit_xor(F.when((F.col("one") == j) | (F.col("two") == j), F.col("h"))).alias(f"_{j}") for j in range(DENSE)]
    sparse = [F.bit_xor(F.when(F.col("far") == j, F.col("h"))).alias(f"_{DENSE + j}") for j in range(SPARSE)]
    whole = [F.bit_xor("h").alias("_whole"), F.max("in_band").alias("_known")]
    shown = [F.when(F.col(f"_{j}").isNull(), BLANK).otherwise(F.lower(F.substring(F.lpad(F.hex(F.col(f"_{j}")), 16, "0"), 1, DIGITS))) for j in range(SUBSETS)]
    shown.append(F.when(F.col("_known").isNull() & F.col("_whole").isNotNull(), F.lower(F.lpad(F.hex("_whole"), WHOLE, "0"))).otherwise("-" * WHOLE))
    return hit.groupBy(*keys).agg(*dense, *sparse, *whole).select(*keys, F.concat(*shown).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing signatures among those that either fills; 1 for equal fingerprints."""
    slots = [(DIGITS * j + 1, DIGITS) for j in range(SUBSETS)] + [(DIGITS * SUBSETS + 1, WHOLE)]
    at = [(F.substring(a, p, n), F.substring(b, p, n), "-" * n) for p, n in slots]
    filled = sum((F.when((x != blank) | (y != blank), 1).otherwise(0) for x, y, blank in at), F.lit(0))
    same = sum((F.when((x == y) & (x != blank), 1).otherwise(0) for x, y, blank in at), F.lit(0))
    return F.when(a == b, 1.0).otherwise(same / F.greatest(filled, F.lit(1)))


def _dealt(docs: DataFrame, per_chunk: int) -> DataFrame:
    """doc_id, text, k, h and chunk: chunks ascend with (k, h), and none holds all rows of a frequent doc_id."""
    rows = C.texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    cut = C.ranges(C.texts(docs).select("doc_id"), per_chunk, most=1 << 17)
    rows = rows.withColumn("k", F.coalesce("doc_id", F.lit(LATEST))).withColumn("h", C.text_part(F.col("text")))
    return C.chunked(rows, cut)


def with_next(docs: DataFrame, per_chunk: int = 2000) -> DataFrame:
    """Each row with the text after it: doc_id, text, next, and the places (chunk, at) and (next_chunk, next_at)."""
    rows = _dealt(docs, per_chunk)
    firsts = sorted((r["chunk"], r["k"], r["h"]) for r in rows.groupBy("chunk").agg(F.min(F.struct("k", "h")).alias("f")).select("chunk", "f.*").collect())
    host = {c: firsts[i - 1][0] for i, (c, *_) in enumerate(firsts)}
    cols = ["doc_id", "text", "k", "h", "chunk"]
    if firsts:
        spark = docs.sparkSession
        # a row a chunk, of which there are 2^17 and some at most
        table = F.broadcast(spark.createDataFrame([(c, k, h, host[c]) for c, k, h in firsts], "chunk long, k long, h long, host long"))
        guests = rows.join(table, ["chunk", "k", "h"]).withColumn("r", F.row_number().over(Window.partitionBy("chunk").orderBy("text"))).where("r = 1")
        guests = guests.select("doc_id", "text", "k", "h", F.col("host").alias("chunk"), F.lit(1).alias("guest"), F.col("chunk").alias("own"))
        rows = rows.select(*cols, F.lit(0).alias("guest"), F.col("chunk").alias("own")).unionByName(guests)
    else:
        rows = rows.select(*cols, F.lit(0).alias("guest"), F.col("chunk").alias("own"))
    w = Window.partitionBy("chunk").orderBy("guest", "k", "h", "text")
    rows = rows.withColumn("at", F.row_number().over(w)).withColumn("next", F.lead("text").over(w)).withColumn("next_guest", F.lead("guest").over(w)).withColumn("next_chunk", F.lead("own").over(w))
    rows = rows.where("guest = 0")
    return rows.select("doc_id", "text", "next", "chunk", "at", "next_chunk", F.when(F.col("next_guest") == 1, 1).otherwise(F.col("at") + 1).alias("next_at"))


def compared(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """Fingerprints of each text and of its edited form, half of which is the next document's beginning."""
    lex = lexicon(docs, band)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = with_next(docs).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half)))
    both = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "chunk", "at", "next_chunk", "next_at", F.explode(F.array(F.struct(F.lit(0).alias("w"), F.col("text").alias("t")), F.struct(F.lit(1).alias("w"), F.col("edited").alias("t")))).alias("x"))
    keys = ["doc_id", "n_chars", "edited_sha256", "chunk", "at", "next_chunk", "next_at", "w"]
    signed = C.written(signatures(both.select(*keys[:-1], "x.w", "x.t"), keys, "t", lex), "fingerprints")
    own = signed.where("w = 0").drop("w")
    edited = signed.where("w = 1").select("chunk", "at", F.col("fingerprint").alias("edited_fingerprint"))
    after = own.select(F.col("chunk").alias("next_chunk"), F.col("at").alias("next_at"), F.col("fingerprint").alias("next_fingerprint"))
    out = own.join(edited, ["chunk", "at"]).join(after, ["next_chunk", "next_at"])
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
