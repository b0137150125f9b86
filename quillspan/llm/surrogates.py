"""PII surrogates with DataFrame functions alone.

Mail addresses, telephone and card numbers, IP addresses, social security numbers and titled names are found by one
pattern. Each distinct entity gets a keyed surrogate of its own type and format: digits stand for digits, letters for
letters of the same case and script, a mail address keeps its shape and top-level domain, an IP address stays one, a
number keeps its country code and punctuation, a name gets a name of the title's gender and the same script. One entity
has one surrogate in every document (coreference); surrogates are checked against each other and against all real
entities, and the later of two that collide is drawn again until all are distinct. With each draw a name gains a syllable
and a mail address a letter before the @, and its host is drawn anew, so there are always enough of them. Numbers keep
their digits: where the real ones leave too few of a format, ``ROUNDS`` draws end with an error.

What is joined is spans, a row for each distinct entity, and only documents that hold any are put together again; others
pass untouched. Null texts stay null. Rows that repeat doc_id and text are rewritten alike. Other columns may have any
names and stay as they were, but for one called n_entities, which gives way to the operator's own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
PATTERNS = {
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![0-9])",
    "ip": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "name": r"(?<!\p{L})(?:Mrs?|Ms|Miss|Herr|Frau|Señora?|Madame|Monsieur|Mme|г-н|г-жа)\.? \p{Lu}\p{Ll}{1,30}(?: \p{Lu}\p{Ll}{1,30})?(?!\p{L})",
}
PII = "|".join(PATTERNS.values())
TITLE = r"^([^ ]+ )(.*)$"
SHE = r"^(?:Mrs|Ms|Miss|Frau|Señora|Madame|Mme|г-жа)\b"
SYLLABLES = {"latin": ("ba de fi ga ha jo ka li ma ne no pa ra ro sa ta ti va ve zo".split(), "a", "o"), "cyrillic": ("ба ве га до зи ка ле ли ма ми на но па ра ро са та ти ва зо".split(), "а", "н"), "greek": ("βα γε δι ζο θα κα λε λι μα μι να νο πα ρα ρο σα τα τι βα ξε".split(), "α", "ς")}

#: syllables a name can gain, letters a mail address can, and draws
LONGER_NAME, LONGER_MAIL, ROUNDS = 10, 32, 200


def kind_of(m: Column) -> Column:
    return reduce(lambda acc, k: acc.when(m.rlike(f"^(?:{PATTERNS[k]})$"), k), list(PATTERNS)[1:], F.when(m.rlike(f"^(?:{PATTERNS['mail']})$"), "mail")).otherwise("other")


def normal(kind: Column, m: Column) -> Column:
    """What makes two mentions one entity: case and spacing don't."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    return F.when(kind == "mail", F.lower(m)).when(kind.isin("card", "ssn", "phone"), digits).when(kind == "name", F.regexp_replace(m, TITLE, "$2")).otherwise(m)


def _stream(key: str, *parts: Column) -> Column:
    """128 keyed hexadecimal digits."""
    return F.sha2(F.concat_ws("\u0001", F.lit(key), *parts), 512)


def _refill(text: Column, seed: Column) -> Column:
    """Each digit and Latin letter replaced by a keyed one of its kind; everything else stays."""
    low = F.translate(seed, "0123456789abcdef", "kmnprstvxzbcdfgh")

    def put(c: Column, i: Column) -> Column:
        # sixteen bits a digit, so that all ten are as likely
        digit = (F.conv(F.substring(seed, i % 32 * 4 + 1, F.lit(4)), 16, 10).cast("int") % 10).cast("string")
        letter = F.substring(low, i % 128 + 1, F.lit(1))
        return F.when(c.rlike("[0-9]"), digit).when(c.rlike("[a-z]"), letter).when(c.rlike("[A-Z]"), F.upper(letter)).otherwise(c)

    each = F.transform(F.split(text, ""), put)
    return F.array_join(each, "")


def _number(seed: Column, at: int, below: int) -> Column:
    return F.conv(F.substring(seed, at, 4), 16, 10).cast("int") % below


def _name(m: Column, seed: Column, attempt: Column) -> Column:
    """Words of keyed syllables, the first ending by gender and longer by a syllable an attempt, in the script of the original."""

    def word(script: str, at: int, end: Column) -> Column:
        got = F.array(*map(F.lit, SYLLABLES[script][0]))
        return F.initcap(F.concat(*(F.get(got, _number(seed, at + 4 * j, 20)) for j in range(3)), end))

    def more(script: str) -> Column:
        got = F.array(*map(F.lit, SYLLABLES[script][0]))
        places = F.slice(F.array(*(F.lit(33 + 4 * j) for j in range(LONGER_NAME))), F.lit(1), F.least(attempt, F.lit(LONGER_NAME)))
        return F.array_join(F.transform(places, lambda at: F.get(got, F.conv(F.substring(seed, at, F.lit(4)), 16, 10).cast("int") % 20)), "")

    def whole(script: str) -> Column:
        _, she, he = SYLLABLES[script]
        first = word(script, 1, F.concat(more(script), F.when(m.rlike(SHE), she).otherwise(he)))
        return F.when(m.rlike(r"^[^ ]+ [^ ]+ "), F.concat_ws(" ", first, word(script, 17, F.lit("")))).otherwise(first)

    return F.when(m.rlike(r"\p{IsCyrillic}"), whole("cyrillic")).when(m.rlike(r"\p{IsGreek}"), whole("greek")).otherwise(whole("latin"))


def surrogate(key: str, kind: Column, norm: Column, sample: Column, attempt: Column) -> Column:
    """The keyed replacement for an entity, as its normal form; ``sample`` is its first mention, with title or sign."""
    seed = _stream(key, kind, norm, attempt.cast("string"))
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    tld = F.substring_index(domain, ".", -1)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(tld) - 1)
    longer = _refill(F.repeat(F.lit("x"), F.least(attempt, F.lit(LONGER_MAIL))), F.reverse(seed))
    site = _refill(host, _stream(key, F.lit("host"), domain, F.when(attempt > 0, attempt.cast("string"))))
    mail = F.concat(_refill(local, seed), longer, F.lit("@"), site, F.lit("."), tld)
    ip = F.concat_ws(".", *(F.when(F.lit(j > 0), _number(seed, 4 * j + 1, 256)).otherwise(_number(seed, 1, 223) + 1).cast("string") for j in range(4)))
    return F.when(kind == "mail", mail).when(kind == "ip", ip).when(kind == "name", _name(sample, seed, attempt)).otherwise(_refill(norm, seed))


def placed(kind: Column, m: Column, drawn: Column) -> Column:
    """The surrogate in the format of a mention: its punctuation, country code, title and capitals."""
    lead = F.when(kind == "phone", F.length(F.regexp_extract(m, r"^\+([0-9]{1,3})", 1))).otherwise(0)

    # walk the mention, taking the next drawn digit wherever it has one, after the country code
    def step(acc: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        new = F.when(digit & (acc["n"] >= lead), F.substring(drawn, acc["n"] + 1, F.lit(1))).otherwise(c)
        return F.struct((acc["n"] + F.when(digit, 1).otherwise(0)).alias("n"), F.concat(acc["s"], new).alias("s"))

    number = F.aggregate(F.split(m, ""), F.struct(F.lit(0).alias("n"), F.lit("").alias("s")), step, lambda a: a["s"])
    mail = F.when(F.upper(m) == m, F.upper(drawn)).otherwise(drawn)
    return F.when(kind == "mail", mail).when(kind == "name", F.concat(F.regexp_extract(m, TITLE, 1), drawn)).when(kind.isin("card", "ssn", "phone"), number).otherwise(drawn)


def dictionary(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, drawn) of distinct entities, with collisions drawn again until none is left."""
    # a telephone number's country code is no part of what is drawn, so codes keep apart what they keep apart
    drawn = surrogate(key, F.col("kind"), F.col("norm"), F.col("sample"), F.col("attempt"))
    code = F.when(F.col("kind") == "phone", F.regexp_extract("sample", r"^\+([0-9]{1,3})", 1)).otherwise("")
    shown = F.concat(code, F.substring(F.col("drawn"), F.length(code) + 1, F.lit(1 << 20)))
    table = C.written(entities.withColumn("attempt", F.lit(0)).withColumn("drawn", drawn).withColumn("shown", shown), "surrogates")
    w = Window.partitionBy("kind", "shown").orderBy("attempt", "norm")
    for _ in range(ROUNDS):
        real = table.select("kind", F.col("norm").alias("shown"), F.lit(True).alias("real"))
        clash = table.withColumn("n", F.row_number().over(w)).join(real, ["kind", "shown"], "left").where("n > 1 OR real").select("kind", "norm")
        clash = C.written(clash, "clashes")
        if not clash.limit(1).count():
            return table.select("kind", "norm", "drawn")
        again = table.join(clash.withColumn("hit", F.lit(1)), ["kind", "norm"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("hit", F.lit(0)))
        table = C.written(again.select("kind", "norm", "sample", "attempt").withColumn("drawn", drawn).withColumn("shown", shown), "surrogates")
    raise RuntimeError(f"no distinct surrogates after {ROUNDS} draws: too few are left of some format")


def replaced(docs: DataFrame, key: str) -> DataFrame:
    """docs with surrogates in their texts, all columns kept, and n_entities beside them."""
    own = [c for c in docs.columns if c.lower() != "n_entities"]
    docs = docs.select(*own)
    id_name, hash_name, text_name, n_name = C.free(own, "new_id", "new_hash", "new_text", "new_n")
    text = F.col("text").cast("string")
    hit = F.coalesce(text.rlike(PII), F.lit(False))
    parts = docs.where(hit).select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("th"), F.split(text, PII, -1).alias("cut"), F.regexp_extract_all(text, F.lit(PII), F.lit(0)).alias("hits"))
    parts = C.written(parts.dropDuplicates(["id", "th"]), "mentions")
    spread = parts.select("id", "th", F.posexplode("hits").alias("at", "m")).withColumn("kind", kind_of(F.col("m"))).withColumn("norm", normal(F.col("kind"), F.col("m")))
    spread = C.written(spread, "spans")
    known = dictionary(spread.groupBy("kind", "norm").agg(F.min("m").alias("sample")), key)
    put = spread.join(known, ["kind", "norm"]).select("id", "th", F.struct("at", placed(F.col("kind"), F.col("m"), F.col("drawn")).alias("s")).alias("x"))
    lists = put.groupBy("id", "th").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    same = parts.alias("p").join(lists.alias("l"), F.col("p.id").eqNullSafe(F.col("l.id")) & (F.col("p.th") == F.col("l.th")))
    # between the pieces stand the surrogates
    woven = F.concat(F.array_join(F.flatten(F.zip_with("xs", F.slice("cut", F.lit(1), F.size("xs")), lambda x, c: F.array(c, x["s"]))), ""), F.element_at("cut", -1))
    new = C.written(same.select(F.col("p.id").alias(id_name), F.col("p.th").alias(hash_name), woven.alias(text_name), F.size("xs").cast("long").alias(n_name)), "rewritten")
    joined = docs.where(hit).join(new, F.col("doc_id").cast("long").eqNullSafe(F.col(id_name)) & (F.xxhash64(text) == F.col(hash_name)))
    changed = joined.withColumn("text", F.col(text_name)).withColumn("n_entities", F.col(n_name)).select(*own, "n_entities")
    return changed.unionByName(docs.where(~hit).withColumn("n_entities", F.lit(0).cast("long")))
