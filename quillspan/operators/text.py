"""Full-text search over derived postings: BM25, prefixes, typos, phrases, synonyms.

Where postings were made, a query's words are expanded on the field's dictionary; elsewhere one pass over the texts finds
all that a request asks (``evidence``). From there a row for each document, field and word combine as the request asks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import RequestError
from ..functions.analysis import Chain
from ..plans.clauses import Words

K1 = 1.2
LENGTH = {"none": 0.0, "moderate": 0.75, "strong": 1.0}
ONE_TYPO, TWO_TYPOS = 5, 9
SYNONYM_BOOST, EXACT_BOOST = 0.8, 2.0


@dataclass(frozen=True)
class TextField:
    """A searched field with what its usage says."""

    name: str
    weight: float
    usage: dict
    chain: Chain
    autocomplete_only: bool
    has_both: bool

    @property
    def b(self) -> float:
        return LENGTH[self.usage.get("lengthNormalization", "moderate")]


def bm25(tf: Column, df: Column, n: float, length: Column, average: float, b: float) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf / (tf + K1 * (1 - b + b * length / (average or 1.0)))


def edits_allowed(word: str, usage: dict, words: Words, excluded: frozenset[str], while_typing: bool) -> int:
    conf = usage.get("typoTolerance")
    if conf is None or words.typos == "off" or word in excluded or (word.isdigit() and not conf.get("numbers")):
        return 0
    most = 1 if while_typing and "minLengthTwoTypos" not in conf else 2
    if most == 2 and len(word) >= conf.get("minLengthTwoTypos", TWO_TYPOS):
        return 2
    return 1 if len(word) >= conf.get("minLengthOneTypo", ONE_TYPO) else 0


def ways(f: TextField, word: str, words: Words, as_prefix: bool, excluded: frozenset[str]) -> list[tuple[tuple, float, str]]:
    """(need, boost, kind): the ways in which a document holds one word that count the same however often it does."""
    edits = edits_allowed(word, f.usage, words, excluded, f.autocomplete_only)
    starts = as_prefix or f.autocomplete_only
    out = [(("starts", word), 1.0, "exact")] if starts else []
    if edits:
        out.append((("near", word, 1, starts), float(edits), "typo"))
        if edits == 2:
            out.append((("near", word, 2, starts), 1.0, "typo"))
    return out


def needs_of(index, fields: list[TextField], words: Words) -> list[tuple[TextField, tuple]]:
    """What a text clause may ask of the texts, relaxed readings of it as well, so that one pass finds it all."""
    out = []
    parts = read_typed(words.text) if words.match == "user" else []
    phrases = [words.text] if words.match == "phrase" else [p.text for p in parts if p.phrase]
    loose = [] if words.match == "phrase" else [" ".join(p.text for p in parts if not p.phrase and not p.exclude)] if parts else [words.text]
    loose += [p.text for p in parts if p.exclude and not p.phrase]
    for f in fields:
        excluded, sets = index.typo_exclusions(f), index.synonyms(f)
        for text in loose:
            read = f.chain.analyze(text)
            for slot, (_, word) in enumerate(read):
                last = slot == len(read) - 1 and words.prefix == "last_token" and not f.autocomplete_only
                out += [] if f.autocomplete_only else [(f, ("is", word))]
                at, typed = completed(index, f, text, len(read), word, last)
                out += [(at, need) for need, _, _ in ways(at, typed, words, last, excluded)]
                if last and len(read) > 1 and words.relax != "off":
                    out += [(f, need) for need, _, _ in ways(f, word, words, False, excluded)]
                for alternative in sets.get(word, []):
                    out += [(f, ("is", alternative[0]))] if len(alternative) == 1 else [(at, ("at", t)) for t in alternative]
        for text in phrases if not f.autocomplete_only else []:
            read = f.chain.analyze(text)
            out += [(f, ("at" if len(read) > 1 else "is", t)) for _, t in read]
    return out


def term_hits(index, f: TextField, wanted: list[tuple[int, str, float]], keys: list[str]) -> DataFrame:
    """Keys, slot, kind and BM25 score of (slot, term, boost)."""
    found = index.evidence(f.name, {("is", term) for _, term, _ in wanted})
    # a row for each word of the query
    slots = [F.struct(F.lit(slot).alias("slot"), F.lit(float(boost)).alias("boost"), F.col(found.columns["is", term]).alias("tf"), F.lit(found.held["is", term]).alias("df")) for slot, term, boost in wanted]
    rows = found.frame.select(*keys, "len", F.explode(F.filter(F.array(*slots), lambda x: x["tf"] > 0)).alias("x"))
    score = F.col("x.boost") * bm25(F.col("x.tf"), F.col("x.df"), found.n, F.col("len"), found.average, f.b)
    return rows.select(*keys, F.col("x.slot").alias("slot"), F.lit("exact").alias("kind"), score.alias("s"))


def word_hits(index, f: TextField, word: str, slot: int, keys: list[str], words: Words, as_prefix: bool, excluded: frozenset[str], synonyms: list[tuple[str, ...]]) -> list[DataFrame]:
    """Frames of keys, slot, kind and score: the ways in which documents hold one word, but for its very term."""
    out = []
    held = ways(f, word, words, as_prefix, excluded)
    if held:
        found = index.evidence(f.name, {need for need, _, _ in held})
    for need, boost, kind in held:
        rows = found.frame.where(F.col(found.columns[need]) > 0)
        out.append(rows.select(*keys, F.lit(slot).alias("slot"), F.lit(kind).alias("kind"), F.lit(float(boost)).alias("s")))
    for alternatives in synonyms:
        if len(alternatives) > 1:
            out.append(phrase_hits(index, f, list(enumerate(alternatives)), 0, keys).select(*keys, F.lit(slot).alias("slot"), F.lit("exact").alias("kind"), (F.col("s") * SYNONYM_BOOST).alias("s")))
    return out


def phrase_hits(index, f: TextField, tokens: list[tuple[int, str]], slop: int, keys: list[str]) -> DataFrame:
    """Documents that hold the words in order, adjacent but for holes and so many words between: keys and score."""
    if f.autocomplete_only:
        raise RequestError("search:usage_unsupported", f"{f.name} has no positions", f.name)
    base = tokens[0][0]
    offsets = [(p - base, t) for p, t in tokens]
    distinct = sorted({t for _, t in tokens})
    found = index.evidence(f.name, {("at", t) for t in distinct})
    spots = {t: F.col(found.columns["at", t]) for t in distinct}
    rows = found.frame.where(reduce(Column.__and__, [F.size(c) > 0 for c in spots.values()]))
    if slop == 0:
        # a phrase starts where every word stands at its own distance from the start
        starts = [_moved(spots[t], -o) for o, t in offsets]
        tf = F.size(reduce(F.array_intersect, starts) if len(starts) > 1 else F.array_distinct(starts[0])).cast("double")
    else:

        def end(start: Column) -> Column:
            at = start
            for i in range(1, len(offsets)):
                step = offsets[i][0] - offsets[i - 1][0]
                at = F.array_min(_after(spots[offsets[i][1]], at, step))
            return at

        width = offsets[-1][0]
        extra = F.transform(F.array_sort(spots[offsets[0][1]]), lambda p: end(p) - p - width)
        close = F.filter(extra, lambda x: (x.isNotNull()) & (x <= slop))
        tf = F.aggregate(close, F.lit(0.0), lambda a, x: a + 1.0 / (1.0 + x))
    n, dfs = found.n, [float(found.held["at", t]) for t in distinct]
    idf = reduce(Column.__add__, [F.log(F.lit(1 + (n - df + 0.5) / (df + 0.5))) for df in dfs])
    score = idf * F.col("tf") / (F.col("tf") + K1 * (1 - f.b + f.b * F.col("len") / (found.average or 1.0)))
    return rows.select(*keys, "len", tf.alias("tf")).where("tf > 0").select(*keys, score.alias("s"))


def _moved(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p + by)


def _after(positions: Column, at: Column, step: int) -> Column:
    return F.filter(positions, lambda x: x >= at + step)


def exact_value_boost(index, fields: list[TextField], text: str, keys: list[str]) -> DataFrame | None:
    """Documents whose whole value reads as the text: the best field's boost, once."""
    out = []
    for f in fields:
        if "exact" in f.usage:
            want = " ".join(t for _, t in f.chain.analyze(text))
            boost = float((f.usage["exact"] or {}).get("boost", EXACT_BOOST))
            out.append(index.whole_values(f.name).where(F.col("whole") == want).select(*keys, F.lit(boost).alias("x")))
    return reduce(DataFrame.unionByName, out).groupBy(*keys).agg(F.max("x").alias("x")) if out else None


def completed(index, f: TextField, text: str, size: int, word: str, last: bool) -> tuple[TextField, str]:
    """The last of several words is looked up among the words for autocomplete, where the field has both usages and both
    read as many words: what is half typed has no stem yet."""
    if last and size > 1 and f.has_both:
        other = f"{f.name}@autocomplete"
        chain = index.chain(other)
        if len(read := chain.analyze(text)) == size:
            return TextField(other, f.weight, f.usage, chain, False, False), read[-1][1]
    return f, word


def loose_hits(index, fields: list[TextField], text: str, words: Words, keys: list[str]) -> DataFrame | None:
    """Keys and score for loose words; None where analysis leaves no word, which matches nothing."""
    read = {f.name: f.chain.analyze(text) for f in fields}
    groups: dict[int, list[TextField]] = {}
    for f in fields:
        if read[f.name]:
            groups.setdefault(len(read[f.name]), []).append(f)
    out = []
    for size, group in groups.items():
        frames = []
        for f in group:
            excluded, sets, exact = index.typo_exclusions(f), index.synonyms(f), []
            for slot, (_, word) in enumerate(read[f.name]):
                last = slot == size - 1 and words.prefix == "last_token" and not f.autocomplete_only
                exact += [(slot, a[0], SYNONYM_BOOST) for a in sets.get(word, []) if len(a) == 1]
                if not last and not f.autocomplete_only:
                    exact.append((slot, word, 1.0))
                hits = word_hits(index, *completed(index, f, text, size, word, last), slot, keys, words, last, excluded, sets.get(word, []))
                frames += [h.withColumn("f", F.lit(f.name)).withColumn("s", F.col("s") * f.weight) for h in hits]
            if exact:
                frames.append(term_hits(index, f, exact, keys).withColumn("f", F.lit(f.name)).withColumn("s", F.col("s") * f.weight))
        rows = reduce(DataFrame.unionByName, frames)
        # of the readings of one kind the best counts; a typo's adds to the exact word's
        rows = rows.groupBy(*keys, "f", "slot", "kind").agg(F.max("s").alias("s")).groupBy(*keys, "f", "slot").agg(F.sum("s").alias("s"))
        full = size if words.match != "any" else 1
        if words.combine == "field":
            got = rows.groupBy(*keys, "f").agg(F.sum("s").alias("s"), F.count("*").alias("n")).where(F.col("n") >= full).groupBy(*keys).agg(F.max("s").alias("s"))
        else:
            got = rows.groupBy(*keys, "slot").agg(F.max("s").alias("s")).groupBy(*keys).agg(F.sum("s").alias("s"), F.count("*").alias("n")).where(F.col("n") >= full).drop("n")
        out.append(got)
    if not out:
        return None
    return out[0] if len(out) == 1 else reduce(DataFrame.unionByName, out).groupBy(*keys).agg(F.max("s").alias("s"))


def phrase_of(index, fields: list[TextField], text: str, slop: int, keys: list[str]) -> DataFrame | None:
    out = []
    for f in fields:
        if f.autocomplete_only:
            continue
        if tokens := f.chain.analyze(text):
            hits = phrase_hits(index, f, tokens, slop, keys) if len(tokens) > 1 else term_hits(index, f, [(0, tokens[0][1], 1.0)], keys).select(*keys, "s")
            out.append(hits.withColumn("s", F.col("s") * f.weight))
    return reduce(DataFrame.unionByName, out).groupBy(*keys).agg(F.max("s").alias("s")) if out else None


@dataclass(frozen=True)
class Part:
    text: str
    phrase: bool
    exclude: bool
    open: bool


def read_typed(text: str) -> list[Part]:
    """Search syntax: words, quoted phrases and leading hyphens. Anything reads as something; nothing fails."""
    parts, i, n = [], 0, len(text)
    while i < n:
        if text[i].isspace():
            i += 1
            continue
        exclude = text[i] == "-" and i + 1 < n and not text[i + 1].isspace()
        i += exclude
        if text[i] == '"':
            end = text.find('"', i + 1)
            got = text[i + 1 : end if end >= 0 else n]
            if got.strip():
                parts.append(Part(got, True, exclude, end < 0))
            i = end + 1 if end >= 0 else n
        else:
            start = i
            while i < n and not text[i].isspace():
                i += 1
            parts.append(Part(text[start:i], False, exclude, True))
    return parts


def text_hits(index, fields: list[TextField], words: Words, keys: list[str], everything: DataFrame) -> DataFrame | None:
    """Keys and score ``s`` of a text clause; None if it matches nothing. ``everything`` has all keys."""
    if words.match == "phrase":
        hits = phrase_of(index, fields, words.text, words.slop, keys)
    elif words.match != "user":
        hits = loose_hits(index, fields, words.text, words, keys)
    else:
        hits = _typed_hits(index, fields, words, keys, everything)
    if hits is None:
        return None
    if (boost := exact_value_boost(index, fields, words.text, keys)) is not None and words.match != "phrase":
        hits = hits.join(boost, keys, "left").select(*keys, (F.col("s") + F.coalesce("x", F.lit(0.0))).alias("s"))
    return hits


def _typed_hits(index, fields: list[TextField], words: Words, keys: list[str], everything: DataFrame) -> DataFrame | None:
    parts = read_typed(words.text)
    loose = [p.text for p in parts if not p.phrase and not p.exclude]
    plain = Words("", match="any" if words.join == "any" else "all", prefix=words.prefix, typos=words.typos, combine=words.combine)
    if parts and parts[-1].phrase and not parts[-1].open:
        plain = Words("", match=plain.match, prefix="off", typos=words.typos, combine=words.combine)
    found: list[DataFrame | None] = []
    if loose and any(f.chain.analyze(" ".join(loose)) for f in fields):
        found.append(loose_hits(index, fields, " ".join(loose), plain, keys))
    for p in parts:
        if p.phrase and not p.exclude:
            if all(f.autocomplete_only for f in fields):
                found.append(loose_hits(index, fields, p.text, plain, keys))
            else:
                found.append(phrase_of(index, fields, p.text, words.slop, keys))
    excluded = [p for p in parts if p.exclude]
    if found:
        if any(x is None for x in found) and words.join == "all":
            return None
        frames = [x for x in found if x is not None]
        if not frames:
            return None
        hits = reduce(DataFrame.unionByName, frames).groupBy(*keys).agg(F.sum("s").alias("s"), F.count("*").alias("n"))
        hits = hits.where(F.col("n") >= (len(found) if words.join == "all" else 1)).drop("n")
    elif excluded:
        hits = everything.select(*keys, F.lit(0.0).alias("s"))
    else:
        return None
    strict = Words("", prefix="off", typos="off")
    for p in excluded:
        gone = phrase_of(index, fields, p.text, 0, keys) if p.phrase else loose_hits(index, fields, p.text, strict, keys)
        if gone is not None:
            hits = hits.join(gone.select(*keys), keys, "left_anti")
    return hits
