"""Secret scans with DataFrame functions alone: base patterns, and a battery of randomness tests.

Spans come from cutting a text at a pattern's matches: the lengths of what lies between and of the matches add up to
their places, in code points.

Candidates of the battery are runs of 20 or more of ``A-Za-z0-9+/_=-`` with a digit or capital beside other letters. Each
run's encoding is inferred from its letters (hexadecimal, base 32, base 62, base 64) and three tests compare it with what
running text does in that alphabet: chi-squared uniformity (text is uneven: its non-centrality grows with the length),
the number of runs of upper case, lower case and digits (text changes class rarely) and the serial correlation of
neighbouring letters (text has some). Their z scores combine by Stouffer's rule into the chance that text looks so random.
Discoveries are controlled over the whole table by the Benjamini-Hochberg rule with weights in proportion to the length
and a mean of one over all candidates, on chances rounded up to tenths of a power of ten, so that a histogram of fixed
size is all the driver sees. A run must also pass the chi-squared test of uniformity itself.

Null texts count as empty and have no spans. Each row is scanned by itself, whole, so repeated rows and ids are no matter;
only the rate is judged over all rows. Columns may have any names: those that the scan adds keep apart from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RANDOM = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
BINS = 300
#: the length at which a chance counts for what it is before the mean of the table is known
USUAL = 30
#: alphabet size and the sum of squared letter shares that text has in it
ENCODINGS = {"hex": (16, 0.25), "base32": (32, 0.08), "base62": (62, 0.066), "base64": (64, 0.066)}
CHANGES, SERIAL = 0.15, 0.25


def _spans(text: Column, pattern: str, hint: Column) -> Column:
    """Array of (s, e, m) of all matches, leftmost and not overlapping."""
    cut = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["c"])
        return F.struct((s + F.length(x["m"])).alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), (s + F.length(x["m"])).alias("e"), x["m"].alias("m")))).alias("out"))

    pairs = F.zip_with(F.slice(cut, 1, F.size(hits)), hits, lambda c, m: F.struct(c.alias("c"), m.alias("m")))
    return F.when(hint, F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(none)


def _battery(span: Column) -> Column:
    """(s, e, bin) of one candidate; bin is tenths of -log10 of its weighted chance, -1 where uniformity fails."""
    m = span["m"]
    n = F.length(m).cast("double")
    kind = F.when(m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex").when(m.rlike("^[A-Z2-7]+=*$"), "base32").when(m.rlike("^[A-Za-z0-9]+$"), "base62").otherwise("base64")
    size, share = (F.create_map(*(F.lit(x) for k, v in ENCODINGS.items() for x in (k, float(v[i]))))[kind] for i in (0, 1))
    letters = F.split(m, "")
    squares = F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda a, c: a + F.pow((F.length(m) - F.length(F.replace(m, c, F.lit("")))).cast("double"), F.lit(2.0)))
    chi = size / n * squares - n
    skew = n * (size * share - 1)
    z1 = (chi - (size - 1) - skew) / F.sqrt(2 * (size - 1) + 4 * skew)
    classes = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(m, "[A-Z]", "A"), "[a-z]", "a"), "[0-9]", "0"), "+/_=-", "-----")
    # the first of each run of a class stays
    runs = F.length(F.regexp_replace(classes, r"(.)\1+", "$1")).cast("double")
    z2 = ((n - 1) * CHANGES - (runs - 1)) / F.sqrt((n - 1) * CHANGES * (1 - CHANGES))
    codes = F.transform(letters, lambda c: F.ascii(c).cast("double"))
    mean = F.aggregate(codes, F.lit(0.0), lambda a, x: a + x) / n
    power = F.aggregate(codes, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    lag = F.aggregate(F.zip_with(F.slice(codes, 1, F.length(m) - 1), F.slice(codes, 2, F.length(m) - 1), lambda x, y: (x - mean) * (y - mean)), F.lit(0.0), lambda a, x: a + x)
    z3 = (F.abs(F.when(power > 0, lag / power).otherwise(1.0)) - SERIAL) * F.sqrt(n)
    z = (z1 + z2 + z3) / 3**0.5
    # Page's approximation of the normal distribution
    chance = 1 / (1 + F.exp(F.least(1.5976 * -z + 0.070566 * F.pow(-z, F.lit(3.0)), F.lit(600.0))))
    passes = (chi - (size - 1)) / F.sqrt(2 * (size - 1)) < 4
    level = F.floor(-10 * F.log10(F.least(chance * USUAL / n, F.lit(1.0)))).cast("int")
    return F.struct(span["s"].alias("s"), span["e"].alias("e"), F.when(passes, F.least(level, F.lit(BINS))).otherwise(-1).alias("bin"))


def _of_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e")))


def _count(base: str, kind: int) -> Column:
    return F.size(F.filter(base, lambda x: x["k"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")


def scanned(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with two columns more, and their names: base spans (s, kind number, e), and candidates (s, e, bin)."""
    base_name, maybe_name, runs_name = C.free(docs.columns, "base", "maybe", "runs")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    assign = _spans(text, ASSIGN, text.rlike("(?i:passw|secret|token|api_?key)"))
    assign = F.filter(assign, lambda x: F.length(F.regexp_extract(x["m"], f"^{ASSIGN}$", 1)) >= 6)
    access = _spans(text, ACCESS, F.contains(text, F.lit("AKIA")))
    hexes = _spans(text, HEX, text.rlike(HEX))
    base = F.concat(*(_of_kind(c, k) for k, c in enumerate((assign, access, hexes))))
    mixed = F.filter(_spans(text, RANDOM, text.rlike(RANDOM)), lambda x: x["m"].rlike("[0-9A-Z].*[a-z]|[a-z].*[0-9A-Z]|[0-9].*[A-Z]|[A-Z].*[0-9]"))
    out = docs.withColumn(base_name, F.array_sort(base)).withColumn(runs_name, mixed)
    fresh = F.filter(runs_name, lambda x: ~F.exists(base_name, lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"])))
    return out.withColumn(maybe_name, F.transform(fresh, _battery)).drop(runs_name), base_name, maybe_name


def smallest_bin(histogram: dict[int, tuple[int, int]], rate: float) -> int:
    """The smallest bin that is a discovery, from each bin's number of candidates and their letters."""
    total, letters, above = sum(n for n, _ in histogram.values()), sum(m for _, m in histogram.values()), 0
    # bins hold chance * USUAL / length: in proportion to the mean length, weights have a mean of one
    scale, best = letters / max(1, total) / USUAL, BINS + 1
    for b in range(BINS, -1, -1):
        above += histogram.get(b, (0, 0))[0]
        if above and 10 ** (-b / 10) * scale * total <= rate * above:
            best = b
    return best


def discovery_bin(rows: DataFrame, maybe: str, rate: float = 0.01) -> int:
    """Smallest bin that is a discovery: the histogram has at most BINS + 2 rows."""
    counts = rows.select(F.explode(maybe).alias("x")).groupBy(F.col("x.bin").alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col("x.e") - F.col("x.s")).alias("m"))
    return smallest_bin({r["bin"]: (r["n"], r["m"]) for r in counts.collect()}, rate)


def all_spans(base: str, maybe: str, limit: int) -> Column:
    """Base and discovered spans (s, kind number, e), in order."""
    return F.array_sort(F.concat(base, _of_kind(F.filter(maybe, lambda x: x["bin"] >= limit), 3)))


def told(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def secrets(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """doc_id, counts of base kinds, digest of base spans, all spans. The text is read once."""
    found, base, maybe = scanned(docs.select("doc_id", "text"))
    rows = C.written(found.select("doc_id", base, maybe), "secret-spans")
    limit = discovery_bin(rows, maybe, rate)
    return rows.select("doc_id", *(_count(base, k) for k in range(3)), F.sha2(told(F.col(base)), 256).alias("base_sha256"), told(all_spans(base, maybe, limit)).alias("spans"))


def masked(docs: DataFrame, mark: str = "[SECRET]", rate: float = 0.01) -> DataFrame:
    """docs with each secret replaced by a mark: all columns as they were, texts without secrets untouched. One scan."""
    found, base, maybe = scanned(docs)
    found = C.written(found, "secret-spans")
    (every,) = C.free(found.columns, "every")
    rows = found.withColumn(every, all_spans(base, maybe, discovery_bin(found, maybe, rate)))
    # spans that touch or overlap become one
    empty = F.expr("cast(array() as array<struct<s:int,e:int>>)")

    def join(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        own = F.array(F.struct(x["s"].alias("s"), x["e"].alias("e")))
        return F.when(F.size(acc) == 0, own).when(x["s"] <= last["e"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))).otherwise(F.concat(acc, own))

    rows = rows.withColumn(every, F.aggregate(every, empty, join))
    before = F.concat(F.array(F.lit(0)), F.transform(every, lambda x: x["e"]))
    after = F.concat(F.transform(every, lambda x: x["s"]), F.array(F.length("text")))
    kept = F.zip_with(before, after, lambda b, a: F.substring(F.col("text"), b + 1, a - b))
    return rows.withColumn("text", F.when(F.size(every) > 0, F.array_join(kept, mark)).otherwise(F.col("text"))).select(*docs.columns)
