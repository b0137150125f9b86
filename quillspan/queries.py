"""The engine's operators over the driver's tables, each beside SQL that says the same.

Each query takes (spark, sf_dir) and works on whole tables; a limit is there only where it is the feature (a page, a top k).
Text queries use the plain chain, whose tokens SQL can cut too: lower case, split at everything but letters and digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.analysis import Chain
from .plans.search import Index
from .sources import documents as docs
from .sources import patch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NOW = "1998-12-01T00:00:00Z"
S = {"type": "string"}
F_ = {"filter": {}}
FS = {"filter": {}, "sort": {}}
FFS = {"filter": {}, "facet": {}, "sort": {}}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# indexes over the tables ------------------------------------------------------------------------------------------------

DOCUMENTS = {"fields": {"doc_id": {"type": "int64", "primaryKey": True}, "text": S | {"matching": {"weight": 1, "highlight": {}, "typoTolerance": {}}}, "lang": S | FFS, "source": S | FFS, "n_chars": {"type": "int64"} | FFS}}
PARTS = {
    "fields": {
        "p_partkey": {"type": "int64", "primaryKey": True}, "p_name": S | {"matching": {"exact": {}}} | FS, "p_brand": S | FFS, "p_type": S | FFS,
        "p_size": {"type": "int64"} | FFS, "p_retailprice": {"type": "double", "unit": "USD"} | FFS, "tree": S | {"filter": {}, "facet": {}, "hierarchy": {}},
    }
}
ORDERS = {
    "fields": {
        "o_orderkey": {"type": "int64", "primaryKey": True}, "o_custkey": {"type": "int64"} | FS, "o_orderstatus": S | FFS, "o_totalprice": {"type": "double"} | FFS,
        "o_orderdate": {"type": "timestamp"} | FFS, "o_orderpriority": S | FFS,
        "lines": {"type": "object", "multiple": True, "mode": "nested", "key": "n", "fields": {"n": {"type": "int64"} | FS, "qty": {"type": "double"} | FFS, "price": {"type": "double"} | FFS, "flag": S | FFS, "mode": S | FFS}},
    }
}
EVENTS = {"fields": {"event_id": {"type": "int64", "primaryKey": True}, "ts": {"type": "timestamp"} | FFS, "user_id": {"type": "int64"} | FFS, "event_type": S | FFS, "value": {"type": "double"} | FFS}}
VECTORS = {"fields": {"vec_id": {"type": "int64", "primaryKey": True}, "embedding": {"type": "vector", "dimensions": 64, "similarity": "cosine"}, "label": S | FFS}}
CHATS = {"fields": {"conv_id": {"type": "int64", "primaryKey": True}, "turns": {"type": "object", "multiple": True, "mode": "nested", "fields": {"role": S | FFS, "text": S | {"matching": {}}, "turn": {"type": "int64"} | FS}}}}
PLACES = {"fields": {"c_custkey": {"type": "int64", "primaryKey": True}, "c_name": S | FS, "location": {"type": "geo_point", "filter": {}, "sort": {}}}}


#: indexes made once by ``prepare``; queries search them instead of deriving postings again
BUILT: dict[tuple[str, str], Index] = {}


def _index(name: str, d: str, default: dict, rows: Callable[[], DataFrame], settings=None, definition=None, **how) -> Index:
    built = BUILT.get((name, d)) if definition is None else None
    if built is None:
        return Index(definition or default, rows(), settings, **how)
    out = Index(built.definition, built.frame, settings, tables=built._tables, **how)
    out._stats = built._stats
    return out


def documents(spark, d, *a, **how) -> Index:
    return _index("documents", d, DOCUMENTS, lambda: table(spark, d, "documents"), *a, **how)


def parts(spark, d, *a, **how) -> Index:
    return _index("parts", d, PARTS, lambda: table(spark, d, "part").withColumn("tree", F.concat_ws("/", "p_brand", F.replace("p_type", F.lit(" "), F.lit("/")))), *a, **how)


def orders(spark, d, *a, **how) -> Index:
    return _index("orders", d, ORDERS, lambda: table(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")), *a, **how)


def with_lines(spark, d, **how) -> Index:
    """Orders with their lines as a nested list: lines are gathered by key once, in line order."""

    def rows() -> DataFrame:
        line = F.struct(F.col("l_linenumber").cast("long").alias("n"), F.col("l_quantity").cast("double").alias("qty"), F.col("l_extendedprice").cast("double").alias("price"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("mode"))
        lists = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
        return table(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")).join(lists, "o_orderkey", "left")

    return _index("with_lines", d, ORDERS, rows, **how)


def events(spark, d, **how) -> Index:
    return _index("events", d, EVENTS, lambda: table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), **how)


def vectors(spark, d, **how) -> Index:
    return _index("vectors", d, VECTORS, lambda: table(spark, d, "embeddings").withColumn("label", F.col("label").cast("string")), **how)


def chats(spark, d, **how) -> Index:
    def rows() -> DataFrame:
        turn = F.struct(F.col("turn").alias("o"), F.col("role"), F.col("text"), F.col("turn"))
        lists = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
        return lists.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"), x["turn"].alias("turn"))).alias("turns"))

    return _index("chats", d, CHATS, rows, **how)


def places(spark, d, **how) -> Index:
    def rows() -> DataFrame:
        k = F.col("c_custkey")
        point = F.struct(((k * 7919) % 18000 / 100.0 - 90).cast("double").alias("lat"), ((k * 104729) % 36000 / 100.0 - 180).cast("double").alias("lon"))
        return table(spark, d, "customer").withColumn("location", F.when(k % 10 != 0, point))

    return _index("places", d, PLACES, rows, **how)


def prepare(spark: SparkSession, d: str) -> None:
    """Build the indexes as an engine does before it is searched: documents held in memory, postings derived once."""
    for build in (documents, parts, orders, with_lines, events, vectors, chats, places):
        index = build(spark, d)
        index.frame = index.frame.cache()
        index.frame.count()
        index = index.prepared()
        for t in index._tables.values():
            t.count()
        for n in index.definition.names():
            if index.definition.place(n).field.textual:
                index.text_stats(n)
        BUILT[(build.__name__, d)] = index


def match(field: str, **m) -> dict:
    return {"field": field, "match": m}


def ids(index: Index, request: dict) -> DataFrame:
    """Keys of all matches."""
    return index.search(request | {"limit": 0}).matches.select(index.pk)


def pages(index: Index, request: dict, *more: str, score: bool = True) -> DataFrame:
    hits = index.search(request).hits
    return hits.select(F.col("_position").cast("int").alias("position"), index.pk, *([F.round("_score", 6).alias("score")] if score else []), *more)


# filters ----------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE lower(o_orderstatus) = 'f'")
def filter_equals(spark, d):
    return ids(orders(spark, d).folded(), {"query": [match("o_orderstatus", value="F")]})


@query("SELECT doc_id FROM documents WHERE lang IN ('fr', 'de')")
def filter_in(spark, d):
    return ids(documents(spark, d), {"filters": [match("lang", type="in", values=["fr", "de"])]})


@query("SELECT doc_id FROM documents WHERE false")
def filter_in_empty(spark, d):
    return ids(documents(spark, d), {"filters": [match("lang", type="in", values=[])]})


@query("SELECT event_id FROM events WHERE value IS NOT NULL")
def filter_any(spark, d):
    return ids(events(spark, d), {"query": [match("value", type="any")]})


@query("SELECT p_partkey FROM part WHERE starts_with(lower(p_type), 'economy')")
def filter_prefix(spark, d):
    return ids(parts(spark, d), {"query": [match("p_type", type="prefix", value="Economy")]})


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 50000 AND o_totalprice < 150000 AND o_orderdate >= TIMESTAMP '1995-01-01'")
def filter_range(spark, d):
    return ids(orders(spark, d), {"query": [match("o_totalprice", type="range", gte=50000, lt=150000), match("o_orderdate", type="range", gte="1995-01-01T00:00:00Z")]})


@query("SELECT p_partkey FROM part WHERE p_size < 5 OR (p_size >= 20 AND p_size <= 22) OR p_size > 45")
def filter_ranges(spark, d):
    return ids(parts(spark, d), {"query": [match("p_size", type="ranges", values=[{"lt": 5}, {"gte": 20, "lte": 22}, {"gt": 45}])]})


@query("SELECT p_partkey FROM part WHERE lower(concat_ws('/', p_brand, replace(p_type, ' ', '/'))) LIKE 'brand#11/%' OR lower(p_brand) = 'brand#11' AND p_type IS NULL")
def filter_under(spark, d):
    return ids(parts(spark, d), {"query": [match("tree", type="under", path="Brand#11")]})


@query("SELECT p_partkey FROM part WHERE NOT (coalesce(p_size > 25, false)) AND (coalesce(starts_with(lower(p_brand), 'brand#1'), false) OR coalesce(p_retailprice < 920, false))")
def bool_or_not(spark, d):
    q = [{"type": "not", "clauses": [match("p_size", type="range", gt=25)]}, {"type": "or", "clauses": [match("p_brand", type="prefix", value="brand#1"), match("p_retailprice", type="range", lt=920)]}]
    return ids(parts(spark, d), {"query": q})


@query("SELECT p_partkey FROM part WHERE (p_size <= 10 AND starts_with(lower(p_brand), 'brand#2')) OR (NOT coalesce(p_size <= 10, false) AND p_retailprice > 960)")
def bool_nested_and(spark, d):
    a = {"type": "and", "clauses": [match("p_size", type="range", lte=10), match("p_brand", type="prefix", value="Brand#2")]}
    b = {"type": "and", "clauses": [{"type": "not", "clauses": [match("p_size", type="range", lte=10)]}, match("p_retailprice", type="range", gt=960)]}
    return ids(parts(spark, d), {"query": [{"type": "or", "clauses": [a, b]}]})


# sorts and pages --------------------------------------------------------------------------------------------------------


@query("SELECT row_number() OVER (ORDER BY v DESC NULLS FIRST, event_id)::INT AS position, event_id FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events) ORDER BY v DESC NULLS FIRST, event_id LIMIT 200")
def sort_field_missing(spark, d):
    index = events(spark, d)
    index.frame = index.frame.withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return pages(index, {"sort": [{"field": "value", "order": "desc"}], "limit": 200}, score=False)


@query("SELECT row_number() OVER (ORDER BY p_size, p_retailprice DESC, p_partkey)::INT AS position, p_partkey FROM part ORDER BY p_size, p_retailprice DESC, p_partkey LIMIT 100")
def sort_tiebreak(spark, d):
    return pages(parts(spark, d, {"ranking": {"tieBreakers": [{"field": "p_retailprice"}]}}), {"sort": [{"field": "p_size"}], "limit": 100}, score=False)


@query("SELECT (row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey))::INT AS position, o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 150")
def page_offset(spark, d):
    return pages(orders(spark, d), {"sort": [{"field": "o_totalprice", "order": "desc"}], "limit": 50, "offset": 150}, score=False)


@query("SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey)::INT AS position, o_orderkey FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS r FROM orders) WHERE r > 40 AND r <= 80")
def page_keyset(spark, d):
    index, q = orders(spark, d), {"sort": [{"field": "o_totalprice"}], "limit": 40}
    return pages(index, q | {"after": index.search(q).cursors()["next"]}, score=False)


@query("SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey)::INT AS position, o_orderkey FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS r FROM orders) WHERE r <= 40")
def page_before(spark, d):
    index, q = orders(spark, d), {"sort": [{"field": "o_totalprice"}], "limit": 40}
    second = index.search(q | {"after": index.search(q).cursors()["next"]})
    return pages(index, q | {"before": second.cursors()["previous"]}, score=False)


# facets -----------------------------------------------------------------------------------------------------------------


def counted(facet: DataFrame, *cols: str) -> DataFrame:
    return facet.select("position", *(cols or ("value", "count", "total_values")))


@query("SELECT row_number() OVER (ORDER BY count(*) DESC, source)::INT AS position, source AS value, count(*) AS count, (SELECT count(DISTINCT source) FROM documents WHERE lang = 'en') AS total_values FROM documents WHERE lang = 'en' GROUP BY source ORDER BY count(*) DESC, source LIMIT 10")
def facet_value(spark, d):
    return counted(documents(spark, d).search({"query": [match("lang", value="en")], "facets": [{"field": "source"}], "limit": 0}).facets["source"])


@query("SELECT row_number() OVER (ORDER BY p_size)::INT AS position, p_size AS value, count(*) AS count, (SELECT count(DISTINCT p_size) FROM part) AS total_values FROM part GROUP BY p_size ORDER BY p_size LIMIT 25")
def facet_value_order(spark, d):
    return counted(parts(spark, d).search({"facets": [{"field": "p_size", "order": "value", "limit": 25}], "limit": 0}).facets["p_size"])


@query("SELECT i AS position, lo AS \"from\", hi AS \"to\", (SELECT count(*) FROM orders WHERE (lo IS NULL OR o_totalprice >= lo) AND (hi IS NULL OR o_totalprice < hi)) AS count FROM (VALUES (0, NULL::DOUBLE, 50000.0::DOUBLE), (1, 50000.0::DOUBLE, 150000.0::DOUBLE), (2, 150000.0::DOUBLE, NULL::DOUBLE)) t(i, lo, hi)")
def facet_range(spark, d):
    ranges = [{"to": 50000}, {"from": 50000, "to": 150000}, {"from": 150000}]
    return orders(spark, d).search({"facets": [{"field": "o_totalprice", "ranges": ranges}], "limit": 0}).facets["o_totalprice"]


TREE = "concat_ws('/', p_brand, replace(p_type, ' ', '/'))"


@query(f"""
    WITH t AS (SELECT p_partkey, string_split({TREE}, '/') AS s FROM part),
    l AS (SELECT p_partkey, s, unnest([1, 2]) AS level FROM t), p AS (SELECT DISTINCT p_partkey, array_to_string(s[1:level], '/') AS path, level, CASE WHEN level = 1 THEN '' ELSE s[1] END AS parent, s[level] AS value FROM l WHERE len(s) >= level),
    c AS (SELECT level, parent, path, value, count(*) AS count FROM p GROUP BY ALL),
    r AS (SELECT *, count(*) OVER (PARTITION BY parent) AS total_values, row_number() OVER (PARTITION BY parent ORDER BY count DESC, value) AS position FROM c)
    SELECT level::INT AS level, parent, path, value, count, total_values, position::INT AS position FROM r WHERE position <= 10""")
def facet_hierarchy(spark, d):
    return parts(spark, d).search({"facets": [{"field": "tree", "depth": 2}], "limit": 0}).facets["tree"]


@query("""
    SELECT 'lang' AS facet, row_number() OVER (ORDER BY count(*) DESC, lang)::INT AS position, lang AS value, count(*) AS count FROM documents WHERE source IN ('src0', 'src1', 'src2') GROUP BY lang
    UNION ALL SELECT 'source', position, value, count FROM (SELECT row_number() OVER (ORDER BY count(*) DESC, source)::INT AS position, source AS value, count(*) AS count FROM documents WHERE lang = 'en' GROUP BY source ORDER BY 1 LIMIT 10)""")
def facet_sideways(spark, d):
    got = documents(spark, d).search({"filters": [match("lang", value="en"), match("source", type="in", values=["src0", "src1", "src2"])], "facets": [{"field": "lang"}, {"field": "source"}], "limit": 0}).facets
    one = lambda n: got[n].select(F.lit(n).alias("facet"), "position", "value", "count")
    return one("lang").unionByName(one("source"))


@query("SELECT row_number() OVER (ORDER BY CASE lang WHEN 'fr' THEN 0 WHEN 'en' THEN 1 END NULLS LAST, count(*) DESC, lang)::INT AS position, lang AS value, count(*) AS count, CASE lang WHEN 'fr' THEN 'French' WHEN 'en' THEN 'English' END AS label FROM documents GROUP BY lang")
def facet_declared(spark, d):
    settings = {"fields": {"lang": {"values": [{"value": "fr", "label": "French"}, {"value": "en", "label": "English"}]}}}
    return counted(documents(spark, d, settings).search({"facets": [{"field": "lang", "order": "declared"}], "limit": 0}).facets["lang"], "value", "count", "label")


@query("SELECT row_number() OVER (ORDER BY count(DISTINCT l_orderkey) DESC, l_linestatus)::INT AS position, l_linestatus AS value, count(DISTINCT l_orderkey) AS count FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_quantity > 30 GROUP BY l_linestatus")
def facet_nested(spark, d):
    q = [{"type": "nested", "path": "lines", "clauses": [match("lines.flag", value="R"), match("lines.qty", type="range", gt=30)]}]
    return counted(with_lines(spark, d).search({"query": q, "facets": [{"field": "lines.mode"}], "limit": 0}).facets["lines.mode"], "value", "count")


# text -------------------------------------------------------------------------------------------------------------------

TOKENS = r"""
    tok AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM documents),
    len AS (SELECT doc_id, count(*) AS len FROM tok GROUP BY doc_id), st AS (SELECT count(*)::DOUBLE AS n, avg(len) AS a FROM len),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    bm AS (SELECT doc_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * len / a)) AS s FROM tf JOIN df USING (term) JOIN len USING (doc_id), st)"""
POSITIONS = r"""
    w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ts FROM documents),
    pos AS (SELECT doc_id, unnest(ts) AS term, unnest(range(0, len(ts))) AS p FROM w),
    len AS (SELECT doc_id, len(ts) AS len FROM w WHERE len(ts) > 0), st AS (SELECT count(*)::DOUBLE AS n, avg(len) AS a FROM len),
    df AS (SELECT term, count(DISTINCT doc_id) AS df FROM pos GROUP BY term)"""


def top(inner: str, limit: int = 50) -> str:
    return f"SELECT row_number() OVER (ORDER BY round(s, 9) DESC, doc_id)::INT AS position, doc_id, round(s, 6) AS score FROM ({inner}) ORDER BY round(s, 9) DESC, doc_id LIMIT {limit}"


def text(words: str, **more) -> dict:
    return {"query": [{"type": "text", "text": words, "fields": {"text": None}, "prefix": "off", "typos": "off", "relax": "off"} | more], "limit": 50}


@query(f"WITH {TOKENS} " + top("SELECT doc_id, sum(s) AS s FROM bm WHERE term IN ('the', 'hesh', 'with') GROUP BY doc_id HAVING count(*) = 3"))
def text_all(spark, d):
    return pages(documents(spark, d), text("The hesh, with"))


@query(f"WITH {TOKENS} " + top("SELECT doc_id, sum(s) AS s FROM bm WHERE term IN ('pathetic', 'moron', 'clown') GROUP BY doc_id"))
def text_any(spark, d):
    return pages(documents(spark, d), text("pathetic moron clown", match="any"))


@query(r"""
    WITH f AS (SELECT p_partkey, 'p_name' AS f, 2.0 AS w, p_name AS v FROM part UNION ALL SELECT p_partkey, 'p_type', 1.0, p_type FROM part),
    tok AS (SELECT p_partkey, f, w, unnest(list_filter(regexp_split_to_array(lower(v), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM f),
    len AS (SELECT p_partkey, f, count(*) AS len FROM tok GROUP BY ALL), st AS (SELECT f, count(*)::DOUBLE AS n, avg(len) AS a FROM len GROUP BY f),
    tf AS (SELECT p_partkey, f, w, term, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT f, term, count(*) AS df FROM tf GROUP BY ALL),
    bm AS (SELECT p_partkey, f, term, w * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * len / a)) AS s FROM tf JOIN df USING (f, term) JOIN len USING (p_partkey, f) JOIN st USING (f)),
    g AS (SELECT p_partkey, f, sum(s) AS s FROM bm WHERE term IN ('small', 'ring') GROUP BY ALL HAVING count(*) = 2), m AS (SELECT p_partkey, max(s) AS s FROM g GROUP BY p_partkey)
    SELECT row_number() OVER (ORDER BY s DESC, p_partkey)::INT AS position, p_partkey, round(s, 6) AS score FROM m ORDER BY s DESC, p_partkey LIMIT 50""")
def text_combine_field(spark, d):
    definition = {"fields": PARTS["fields"] | {"p_type": S | FFS | {"matching": {}}, "p_name": S | {"matching": {"weight": 2}} | FS}}
    q = {"type": "text", "text": "small ring", "fields": {"p_name": None, "p_type": None}, "combine": "field", "prefix": "off", "relax": "off"}
    return pages(parts(spark, d, definition=definition), {"query": [q], "limit": 50})


@query(f"WITH {TOKENS} " + top("SELECT doc_id, a.s + 1.0 AS s FROM (SELECT doc_id, s FROM bm WHERE term = 'the') a SEMI JOIN (SELECT doc_id FROM tok WHERE starts_with(term, 'wort')) b USING (doc_id)"))
def text_prefix(spark, d):
    return pages(documents(spark, d), text("the wort", prefix="last_token"))


@query(f"""WITH {POSITIONS},
    hit AS (SELECT a.doc_id, count(*)::DOUBLE AS tf FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND b.p = a.p + 1 AND b.term = 'the' WHERE a.term = 'of' GROUP BY a.doc_id),
    i AS (SELECT sum(ln(1 + (n - df + 0.5) / (df + 0.5))) AS idf FROM df, st WHERE term IN ('of', 'the')) """ + top("SELECT doc_id, idf * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * len / a)) AS s FROM hit JOIN len USING (doc_id), st, i"))
def text_phrase(spark, d):
    return pages(documents(spark, d), text("of the", match="phrase"))


@query(f"""WITH {POSITIONS},
    pair AS (SELECT a.doc_id, a.p, min(b.p) - a.p - 1 AS gap FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND b.p > a.p AND b.term = 'is' WHERE a.term = 'that' GROUP BY a.doc_id, a.p),
    hit AS (SELECT doc_id, sum(1.0 / (1.0 + gap)) AS tf FROM pair WHERE gap <= 2 GROUP BY doc_id),
    i AS (SELECT sum(ln(1 + (n - df + 0.5) / (df + 0.5))) AS idf FROM df, st WHERE term IN ('that', 'is')) """ + top("SELECT doc_id, idf * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * len / a)) AS s FROM hit JOIN len USING (doc_id), st, i"))
def text_slop(spark, d):
    return pages(documents(spark, d), text("that is", match="phrase", slop=2))


@query(f"""WITH {POSITIONS},
    tf AS (SELECT doc_id, term, count(*) AS tf FROM pos GROUP BY ALL),
    bm AS (SELECT doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * len / a)) AS s FROM tf JOIN df USING (term) JOIN len USING (doc_id), st WHERE term = 'hesh'),
    ph AS (SELECT a.doc_id, count(*)::DOUBLE AS tf FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND b.p = a.p + 1 AND b.term = 'the' WHERE a.term = 'is' GROUP BY a.doc_id),
    i AS (SELECT sum(ln(1 + (n - df + 0.5) / (df + 0.5))) AS idf FROM df, st WHERE term IN ('is', 'the')) """ + top("SELECT ph.doc_id, bm.s + idf * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * len / a)) AS s FROM ph JOIN bm USING (doc_id) JOIN len USING (doc_id), st, i WHERE ph.doc_id NOT IN (SELECT doc_id FROM pos WHERE term = 'idiot')"))
def text_user(spark, d):
    return pages(documents(spark, d), text('hesh "is the" -idiot', match="user", interpret="off"))


@query(r"""
    WITH tok AS (SELECT p_partkey, unnest(list_filter(regexp_split_to_array(lower(p_name), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM part),
    len AS (SELECT p_partkey, count(*) AS len FROM tok GROUP BY ALL), st AS (SELECT count(*)::DOUBLE AS n, avg(len) AS a FROM len),
    tf AS (SELECT p_partkey, term, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
    q AS (SELECT p_name AS t, list_filter(regexp_split_to_array(lower(p_name), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part)),
    bm AS (SELECT p_partkey, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * len / a))) AS s, count(*) AS c FROM tf JOIN df USING (term) JOIN len USING (p_partkey), st, q WHERE list_contains(ws, term) GROUP BY p_partkey)
    SELECT row_number() OVER (ORDER BY s + CASE WHEN lower(p_name) = lower(t) THEN 2 ELSE 0 END DESC, p_partkey)::INT AS position, p_partkey, round(s + CASE WHEN lower(p_name) = lower(t) THEN 2 ELSE 0 END, 6) AS score FROM bm JOIN part USING (p_partkey), q WHERE c = len(list_distinct(ws)) ORDER BY 3 DESC, 2 LIMIT 20""")
def text_exact(spark, d):
    first = table(spark, d, "part").orderBy("p_partkey").first()["p_name"]
    return pages(parts(spark, d), {"query": [{"type": "text", "text": first, "fields": {"p_name": None}, "prefix": "off", "relax": "off"}], "limit": 20})


@query(f"WITH {TOKENS}, v AS (SELECT DISTINCT term FROM tok WHERE starts_with(term, 'p') AND term <> 'pathetci'), k AS (SELECT term FROM v WHERE damerau_levenshtein(term, 'pathetci') <= 1) " + top("SELECT DISTINCT doc_id, 1.0::DOUBLE AS s FROM tok SEMI JOIN k USING (term)"))
def text_typo(spark, d):
    return pages(documents(spark, d), text("pathetci", typos="auto"))


@query(f"WITH {TOKENS} " + top("SELECT doc_id, max(CASE WHEN term = 'moron' THEN s ELSE 0.8 * s END) AS s FROM bm WHERE term IN ('moron', 'idiot', 'clown') GROUP BY doc_id"))
def text_synonym(spark, d):
    return pages(documents(spark, d, {"synonyms": {"text": [["moron", "idiot", "clown"]]}}), text("moron"))


@query(f"WITH {TOKENS} SELECT row_number() OVER (ORDER BY round(s, 9) DESC, doc_id)::INT AS position, doc_id, round(s, 6) AS score FROM (SELECT doc_id, sum(s) AS s FROM bm WHERE term IN ('the', 'with') GROUP BY doc_id HAVING count(*) = 2) JOIN documents USING (doc_id) WHERE lang IN ('en', 'fr') ORDER BY round(s, 9) DESC, doc_id LIMIT 10")
def text_search(spark, d):
    """The flagship: text in one field, a filter, ranked, first page."""
    return pages(documents(spark, d), {"query": [{"type": "text", "text": "the with", "fields": {"text": None}, "prefix": "off"}], "filters": [match("lang", type="in", values=["en", "fr"])], "facets": [{"field": "lang"}, {"field": "source"}], "limit": 10})


@query(f"WITH {TOKENS} " + top("SELECT doc_id, s FROM bm WHERE term = 'pathetic'"))
def text_relax(spark, d):
    """No document has the second word, so it is let go."""
    return pages(documents(spark, d), text("pathetic zzzznowhere", relax="unmatched"))


# ranking ----------------------------------------------------------------------------------------------------------------


@query("SELECT row_number() OVER (ORDER BY 1 + 2.0 * p_size / (p_size + 10.0) DESC, p_partkey)::INT AS position, p_partkey, round(1 + 2.0 * p_size / (p_size + 10.0), 6) AS score FROM part ORDER BY 1 + 2.0 * p_size / (p_size + 10.0) DESC, p_partkey LIMIT 100")
def signal_saturation(spark, d):
    return pages(parts(spark, d), {"signals": [{"field": "p_size", "saturation": {"pivot": 10}, "weight": 2}], "limit": 100})


@query("SELECT row_number() OVER (ORDER BY s DESC, o_orderkey)::INT AS position, o_orderkey, round(s, 6) AS score FROM (SELECT o_orderkey, 1 + pow(2.0, -greatest(epoch(TIMESTAMP '1998-12-01' - o_orderdate::TIMESTAMP), 0) / 31536000.0) AS s FROM orders) ORDER BY s DESC, o_orderkey LIMIT 100")
def signal_decay(spark, d):
    return pages(orders(spark, d, now=NOW), {"signals": [{"field": "o_orderdate", "decay": {"halfLife": 31536000}}], "limit": 100})


@query("SELECT row_number() OVER (ORDER BY s DESC, p_partkey)::INT AS position, p_partkey, round(s, 6) AS score FROM (SELECT p_partkey, 1 + 0.5 * least(1, greatest(0, p_retailprice / 980.0)) AS s FROM part) ORDER BY s DESC, p_partkey LIMIT 100")
def signal_linear(spark, d):
    return pages(parts(spark, d), {"signals": [{"field": "p_retailprice", "linear": {"ceiling": 980}, "weight": 0.5}], "limit": 100})


@query("WITH a AS (SELECT p_partkey, p_size, p_brand, 1 + p_size / (p_size + 10.0) AS s FROM part), w AS (SELECT * FROM a ORDER BY s DESC, p_partkey LIMIT 200), x AS (SELECT p_partkey, s + 0.5 * (1 + CASE WHEN lower(p_brand) = 'brand#2' THEN 1 ELSE 0 END) AS s FROM w) SELECT row_number() OVER (ORDER BY s DESC, p_partkey)::INT AS position, p_partkey, round(s, 6) AS score FROM x ORDER BY s DESC, p_partkey LIMIT 50")
def rescore_window(spark, d):
    return pages(parts(spark, d), {"signals": [{"field": "p_size", "saturation": {"pivot": 10}}], "rescore": {"window": 200, "boost": [match("p_brand", value="Brand#2")], "weight": 0.5}, "limit": 50})


@query("SELECT row_number() OVER (ORDER BY s DESC, p_partkey)::INT AS position, p_partkey, s AS score FROM (SELECT p_partkey, CASE WHEN p_size > 40 THEN 2.5 ELSE 0.0 END::DOUBLE AS s FROM part WHERE p_retailprice > 950) ORDER BY s DESC, p_partkey LIMIT 100")
def boost_score(spark, d):
    return pages(parts(spark, d), {"query": [match("p_retailprice", type="range", gt=950), {"type": "boost", "weight": 2.5, "clauses": [match("p_size", type="range", gt=40)]}], "limit": 100})


# vectors ----------------------------------------------------------------------------------------------------------------

PROBE = [round(((i * 37) % 64) / 32 - 1, 4) for i in range(64)]
COSINE = f"(1 + list_dot_product(embedding::DOUBLE[], {PROBE}::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product({PROBE}::DOUBLE[], {PROBE}::DOUBLE[])))) / 2"


@query(f"SELECT row_number() OVER (ORDER BY s DESC, vec_id)::INT AS position, vec_id, round(s, 6) AS score FROM (SELECT vec_id, {COSINE} AS s FROM embeddings) ORDER BY s DESC, vec_id LIMIT 25")
def knn_exact(spark, d):
    return pages(vectors(spark, d), {"query": [{"type": "knn", "field": "embedding", "vector": PROBE, "k": 25}], "limit": 25})


@query(f"SELECT row_number() OVER (ORDER BY s DESC, vec_id)::INT AS position, vec_id, round(s, 6) AS score FROM (SELECT vec_id, {COSINE} AS s FROM embeddings WHERE label::VARCHAR IN ('1', '2')) ORDER BY s DESC, vec_id LIMIT 25")
def knn_filtered(spark, d):
    return pages(vectors(spark, d), {"query": [{"type": "knn", "field": "embedding", "vector": PROBE, "k": 25, "filter": [match("label", type="in", values=["1", "2"])]}], "limit": 25})


@query(f"""WITH {TOKENS},
    a AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM (SELECT doc_id, s FROM bm WHERE term = 'the') JOIN documents USING (doc_id) WHERE lang = 'en' ORDER BY s DESC, doc_id LIMIT 100),
    b AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM (SELECT doc_id, s FROM bm WHERE term = 'is') JOIN documents USING (doc_id) WHERE lang = 'en' ORDER BY s DESC, doc_id LIMIT 100),
    u AS (SELECT doc_id, 1.0 / (60 + r) AS s FROM a UNION ALL SELECT doc_id, 0.5 / (60 + r) FROM b) """ + top("SELECT doc_id, sum(s) AS s FROM u GROUP BY doc_id"))
def fuse_rrf(spark, d):
    one = lambda w: {"type": "text", "text": w, "fields": {"text": None}, "prefix": "off"}
    return pages(documents(spark, d), {"query": [{"type": "fuse", "rankings": [{"clauses": [one("the")]}, {"clauses": [one("is")], "weight": 0.5}], "filter": [match("lang", value="en")]}], "limit": 50})


# nested lists -----------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)")
def nested_filter(spark, d):
    return ids(with_lines(spark, d), {"query": [{"type": "nested", "path": "lines", "clauses": [match("lines.flag", value="R"), match("lines.qty", type="range", gt=40)]}]})


@query("""
    WITH tok AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM conversations),
    len AS (SELECT conv_id, turn, count(*) AS len FROM tok GROUP BY ALL), st AS (SELECT count(*)::DOUBLE AS n, avg(len) AS a FROM len),
    tf AS (SELECT conv_id, turn, term, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    bm AS (SELECT conv_id, turn, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * len / a)) AS s FROM tf JOIN df USING (term) JOIN len USING (conv_id, turn), st WHERE term = 'the')
    SELECT conv_id, round(max(s), 6) AS max, round(min(s), 6) AS min, round(avg(s), 6) AS avg, round(sum(s), 6) AS total FROM bm GROUP BY conv_id""")
def nested_score_modes(spark, d):
    index, out = chats(spark, d), None
    for mode in ("max", "min", "avg", "total"):
        q = {"query": [{"type": "nested", "path": "turns", "score": mode, "clauses": [{"type": "text", "text": "the", "prefix": "off"}]}], "limit": 0}
        got = index.search(q).matches.select("conv_id", F.round("_score", 6).alias(mode))
        out = got if out is None else out.join(got, "conv_id")
    return out


@query("SELECT row_number() OVER (ORDER BY m DESC, o_orderkey)::INT AS position, o_orderkey FROM (SELECT l_orderkey AS o_orderkey, max(l_extendedprice) AS m FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL) SEMI JOIN orders USING (o_orderkey) ORDER BY m DESC, o_orderkey LIMIT 100")
def nested_sort(spark, d):
    return pages(with_lines(spark, d), {"query": [{"type": "nested", "path": "lines", "clauses": [match("lines.flag", value="A")]}], "sort": [{"field": "lines.price", "order": "desc"}], "limit": 100}, score=False)


CHAIN = "coalesce((SELECT min(l_extendedprice) FROM lineitem WHERE l_orderkey = o_orderkey AND lower(l_linestatus) = 'f'), (SELECT min(l_extendedprice) FROM lineitem WHERE l_orderkey = o_orderkey AND lower(l_linestatus) = 'o'))"
CHAINED = {"field": "lines.price", "when": [match("lines.mode", value="F")], "fallback": [{"field": "lines.price", "when": [match("lines.mode", value="O")]}]}


@query(f"WITH c AS (SELECT o_orderkey, {CHAIN} AS v FROM orders) SELECT row_number() OVER (ORDER BY v NULLS LAST, o_orderkey)::INT AS position, o_orderkey FROM c ORDER BY v NULLS LAST, o_orderkey LIMIT 100")
def chain_sort(spark, d):
    return pages(with_lines(spark, d), {"sort": [CHAINED], "limit": 100}, score=False)


@query("""
    WITH v AS (SELECT l_orderkey, l_linestatus, l_extendedprice AS x FROM lineitem SEMI JOIN orders ON l_orderkey = o_orderkey), a AS (SELECT DISTINCT l_orderkey FROM v WHERE lower(l_linestatus) = 'f'),
    c AS (SELECT l_orderkey, x FROM v WHERE lower(l_linestatus) = 'f' UNION ALL SELECT l_orderkey, x FROM v ANTI JOIN a USING (l_orderkey) WHERE lower(l_linestatus) = 'o')
    SELECT i AS position, lo AS "from", hi AS "to", (SELECT count(DISTINCT l_orderkey) FROM c WHERE (lo IS NULL OR x >= lo) AND (hi IS NULL OR x < hi)) AS count FROM (VALUES (0, NULL::DOUBLE, 10000.0::DOUBLE), (1, 10000.0::DOUBLE, 40000.0::DOUBLE), (2, 40000.0::DOUBLE, NULL::DOUBLE)) t(i, lo, hi)""")
def chain_range_facet(spark, d):
    facet = CHAINED | {"ranges": [{"to": 10000}, {"from": 10000, "to": 40000}, {"from": 40000}]}
    return with_lines(spark, d).search({"facets": [facet], "limit": 0}).facets["lines.price"]


@query("""
    WITH t AS (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100),
    m AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_linestatus) AS r, count(*) OVER (PARTITION BY l_orderkey) AS total FROM lineitem WHERE l_quantity > 25)
    SELECT o_orderkey, coalesce(max(total), 0)::INT AS total, coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) FILTER (r <= 2), '') AS lines FROM t JOIN m ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def matched_values(spark, d):
    index = with_lines(spark, d)
    q = {"query": [{"type": "boost", "weight": 0, "clauses": [{"type": "nested", "path": "lines", "clauses": [match("lines.qty", type="range", gt=25)]}]}], "sort": [{"field": "o_totalprice", "order": "desc"}], "limit": 100, "matched": {"fields": {"lines": {"limit": 2}}}}
    got = index.search(q).hits.select("o_orderkey", F.col("_matched_lines.totalValues").alias("total"), F.array_join(F.transform("_matched_lines.values", lambda v: v["value"]["n"].cast("string")), ",").alias("lines"))
    return got.where("total > 0")


@query("SELECT row_number() OVER (ORDER BY l_extendedprice DESC, o_orderkey, i)::INT AS position, o_orderkey, i::INT AS index, l_linenumber::VARCHAR AS key FROM (SELECT l_orderkey AS o_orderkey, l_linenumber, l_extendedprice, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_linestatus) - 1 AS i FROM lineitem SEMI JOIN orders ON l_orderkey = o_orderkey) WHERE l_quantity >= 45 ORDER BY l_extendedprice DESC, o_orderkey, i LIMIT 100")
def value_hits(spark, d):
    q = {"query": [{"type": "nested", "path": "lines", "clauses": [match("lines.qty", type="range", gte=45)]}], "hits": {"path": "lines"}, "sort": [{"field": "lines.price", "order": "desc"}], "limit": 100}
    return pages(with_lines(spark, d), q, F.col("_index").alias("index"), F.col("_key").alias("key"), score=False)


@query("""
    WITH l AS (SELECT l_orderkey AS o_orderkey, l_quantity, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_linestatus) - 1)::INT AS i FROM lineitem)
    SELECT o_orderkey, i AS index FROM l JOIN orders USING (o_orderkey) WHERE l_quantity >= 30 AND lower(o_orderstatus) = 'f' UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM l WHERE l_quantity >= 30) AND NOT coalesce(lower(o_orderstatus) = 'f', false)""")
def mixed_hits(spark, d):
    q = {"query": [{"type": "nested", "path": "lines", "clauses": [match("lines.qty", type="range", gte=30)]}], "hits": {"path": "lines", "when": [match("o_orderstatus", value="F")]}, "limit": 0}
    return with_lines(spark, d).search(q).matches.select("o_orderkey", F.col("_index").alias("index"))


# geo --------------------------------------------------------------------------------------------------------------------

POINTS = "(SELECT c_custkey, (c_custkey * 7919) % 18000 / 100.0 - 90 AS lat, (c_custkey * 104729) % 36000 / 100.0 - 180 AS lon FROM customer WHERE c_custkey % 10 <> 0)"
METRES = "2 * 6371008.7714 * asin(sqrt(least(1.0, pow(sin(radians(lat - 59.3) / 2), 2) + cos(radians(59.3)) * cos(radians(lat)) * pow(sin(radians(lon - 18.1) / 2), 2))))"


@query(f"SELECT c_custkey FROM {POINTS} WHERE {METRES} <= 3000000")
def geo_distance_filter(spark, d):
    return ids(places(spark, d), {"query": [match("location", type="distance", lat=59.3, lon=18.1, radius=3000000)]})


@query(f"SELECT row_number() OVER (ORDER BY {METRES}, c_custkey)::INT AS position, c_custkey FROM {POINTS} ORDER BY {METRES}, c_custkey LIMIT 100")
def geo_distance_sort(spark, d):
    return pages(places(spark, d), {"sort": [{"type": "distance", "field": "location", "lat": 59.3, "lon": 18.1}], "limit": 100}, score=False)


# suggestions ------------------------------------------------------------------------------------------------------------


@query("""
    WITH v AS (SELECT 'p_brand' AS field, p_brand AS value, count(*) AS count FROM part GROUP BY ALL UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY ALL)
    SELECT row_number() OVER (ORDER BY count DESC, field, value)::INT AS position, field, value, count FROM v WHERE starts_with(lower(value), 's') OR starts_with(lower(value), 'b') AND false ORDER BY count DESC, field, value LIMIT 20""")
def suggest_prefix(spark, d):
    settings = {"fields": {"p_brand": {"suggest": {}}, "p_type": {"suggest": {}}}}
    return parts(spark, d, settings).suggest({"text": "S", "limit": 20}).select("position", "field", "value", "count")


@query("SELECT row_number() OVER (ORDER BY count(*) DESC, p_type)::INT AS position, p_type AS value, count(*) AS count FROM part WHERE starts_with(lower(p_type), 'econ') GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT 20")
def suggest_typo(spark, d):
    """ecnoo is one swap away from econo."""
    return parts(spark, d, {"fields": {"p_type": {"suggest": {}}}}).suggest({"text": "ecnoo", "limit": 20}).select("position", "value", "count")


@query("SELECT row_number() OVER (ORDER BY p_type)::INT AS position, p_type AS value, count(*) AS count FROM part WHERE p_size > 10 AND starts_with(lower(p_type), 'promo') GROUP BY p_type ORDER BY p_type LIMIT 15")
def facet_values_prefix(spark, d):
    return counted(parts(spark, d).facet_values("p_type", {"prefix": "Promo", "order": "value", "limit": 15, "query": [match("p_size", type="range", gt=10)]}), "value", "count")


@query("SELECT row_number() OVER (ORDER BY CASE WHEN p_retailprice < 950 THEN 1 ELSE 0 END DESC, p_partkey)::INT AS position, p_partkey FROM part WHERE p_retailprice < 950 ORDER BY 1 LIMIT 100")
def interpret_quantity(spark, d):
    """No name has the words, so what is left is the range they say."""
    return pages(parts(spark, d), {"query": [{"type": "text", "match": "user", "text": "under 950 usd", "fields": {"p_name": None}}], "limit": 100}, score=False)


# documents --------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, o_custkey, 'X', o_totalprice + 1 FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT -o_orderkey - 1, o_custkey, 'N', o_totalprice FROM orders WHERE o_orderkey % 5 = 0")
def upsert(spark, d):
    old = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("double"))
    changed = old.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("X")).withColumn("o_totalprice", F.col("o_totalprice") + 1).withColumn("seq", F.lit(2))
    stale = old.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("S")).withColumn("seq", F.lit(1))
    new = old.where("o_orderkey % 5 = 0").withColumn("o_orderkey", -F.col("o_orderkey") - 1).withColumn("o_orderstatus", F.lit("N")).withColumn("seq", F.lit(1))
    return docs.upserted(old, changed.unionByName(stale).unionByName(new), "o_orderkey", "seq")


@query("SELECT p_partkey, p_name || '' AS p_name, CASE WHEN p_partkey BETWEEN 1 AND 100 THEN 7 ELSE p_size END AS p_size, CASE WHEN p_partkey BETWEEN 1 AND 100 THEN NULL ELSE p_brand END AS p_brand FROM part")
def patch_path(spark, d):
    index = parts(spark, d)
    rows = index.frame.select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice", "tree")
    return patch.updated(rows, index.definition, list(range(1, 101)), {"p_size": 7, "p_brand": None}, "skip").select("p_partkey", "p_name", "p_size", "p_brand")


@query("SELECT l_orderkey AS o_orderkey, count(*) AS n, round(sum(CASE WHEN l_linenumber = 1 THEN 99.5 ELSE l_extendedprice END), 2) AS price FROM lineitem SEMI JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey")
def patch_selector(spark, d):
    """The price of the line whose key reads as 1, in place."""
    index = with_lines(spark, d)
    got = patch.patched(index.frame.where("lines IS NOT NULL"), index.definition, {"lines[n=1].price": 99.5}, "skip")
    return got.select("o_orderkey", F.explode("lines").alias("x")).groupBy("o_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("x.price"), 2).alias("price"))


@query("SELECT o_orderkey FROM orders WHERE NOT coalesce(o_totalprice > 100000 AND lower(o_orderstatus) = 'o', false)")
def delete_by_query(spark, d):
    return docs.deleted_by_query(orders(spark, d), [match("o_totalprice", type="range", gt=100000), match("o_orderstatus", value="O")]).select("o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey > 100 ORDER BY c_custkey LIMIT 500")
def scan_after(spark, d):
    return docs.scanned(places(spark, d), 100, 500).select("c_custkey", "c_name")


@query("SELECT p_partkey, p_name FROM part")
def json_round_trip(spark, d):
    """Documents out as NDJSON and in again, typed and valid."""
    index = parts(spark, d)
    rows = index.frame.select(*index.definition.fields)
    return docs.from_json(docs.as_ndjson(rows), index.definition).select("p_partkey", "p_name")


@query(r"SELECT row_number() OVER (ORDER BY count(*) DESC, term)::INT AS position, term, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM documents) GROUP BY term ORDER BY count(*) DESC, term LIMIT 100")
def analysis_terms(spark, d):
    from pyspark.sql import Window

    words = table(spark, d, "documents").select(F.explode(Chain().tokens(F.col("text"))).alias("x")).groupBy(F.col("x.t").alias("term")).agg(F.count("*").alias("n"))
    order = [F.desc("n"), F.asc("term")]
    return words.orderBy(*order).limit(100).withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("int"))


@query()
def highlight_page(spark, d):
    q = text("pathetic the") | {"highlight": {"fields": {"text": {"fragments": 2, "length": 80}}}, "limit": 20}
    return documents(spark, d).search(q).hits.select("doc_id", F.col("_highlight_text").alias("fragments"))


@query()
def analysis_html(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(Chain({"charFilters": [{"type": "htmlStrip"}]}).tokens(F.col("html"))).alias("n_tokens"))
