"""Literal fixtures, ids expected: matchers, clauses, text, sorts, facets, nested lists, ranking."""

import pytest
from pyspark.sql import functions as F

from quillspan.errors import EngineError
from quillspan.plans.definition import IndexDefinition
from quillspan.plans.search import Index

S = {"type": "string"}
ALL = {"filter": {}, "facet": {}, "sort": {}}


def found(index, **request):
    got = index.search({"limit": 100, **request}).hits.orderBy("_position")
    return [r[index.pk] for r in got.select(index.pk).collect()]


def match(field, **m):
    return {"field": field, "match": m}


@pytest.fixture(scope="module")
def books(spark):
    d = {"fields": {"id": {"type": "int64", "primaryKey": True}, "name": S | {"matching": {"weight": 2, "typoTolerance": {}, "highlight": {}}}, "description": S | {"matching": {"language": "en"}}, "category": S | ALL, "code": S | ALL, "tags": S | {"multiple": True, "filter": {}, "facet": {}}, "published": {"type": "boolean", "filter": {}}}}
    rows = [(1, "Silent Spring", "A book about the silent spring of 1962", "non-fiction", "EX-100", ["nature"], True), (2, "Spring Cleaning", "Tidying up", "fiction", "EX-200", [], False), (3, "The Quiet Sea", "Silent waters run deep", "poetry", "AB-300", [], True)]
    return Index(d, spark.createDataFrame(rows, IndexDefinition.of(d).schema()))


@pytest.fixture(scope="module")
def products(spark):
    d = {"fields": {"id": {"type": "int64", "primaryKey": True}, "name": S | {"matching": {}}, "category": S | ALL, "tags": S | {"multiple": True, "filter": {}, "facet": {}}, "published": {"type": "boolean", "filter": {}, "facet": {}}, "price": {"type": "double", "unit": "SEK"} | ALL, "stock": {"type": "int32"} | ALL, "added": {"type": "timestamp"} | ALL, "brand": S | ALL}}
    rows = [(1, "Trail runner", "shoes", ["outdoor", "sale"], True, 120.0, 3, "2024-05-01T12:00:00Z"), (2, "City sneaker", "shoes", ["sale"], True, 80.0, 5, "2024-06-01T12:00:00Z"), (3, "Wool sweater", "clothes", [], False, 80.0, 3, "2024-06-01T12:00:00Z"), (4, "Rain jacket", "clothes", [], True, 200.0, 7, "2024-07-01T12:00:00+02:00")]
    frame = spark.createDataFrame(rows, "id long, name string, category string, tags array<string>, published boolean, price double, stock int, added string").withColumn("added", F.to_timestamp("added")).withColumn("brand", F.lit(None).cast("string"))
    return Index(d, frame, now="2024-07-01T10:00:00Z")


VARIANTS = {"type": "object", "multiple": True, "mode": "nested", "fields": {"color": S | ALL, "price": {"type": "double"} | ALL, "sizes": S | {"multiple": True, "filter": {}, "facet": {}}, "title": S | {"matching": {}}}}


@pytest.fixture(scope="module")
def nested(spark):
    d = {"fields": {"id": {"type": "int64", "primaryKey": True}, "name": S | {"matching": {}}, "variants": VARIANTS}}
    rows = [(1, "One", [("red", 15.0, ["S", "M"], "red cotton"), ("black", 25.0, ["XL"], "black wool")]), (2, "Two", [("red", 30.0, [], "red red silk"), ("blue", 10.0, [], "blue")]), (3, "Three", None)]
    return Index(d, spark.createDataFrame(rows, IndexDefinition.of(d).schema()))


def test_matchers(books):
    assert found(books, query=[match("category", value="FICTION")]) == [2]
    assert found(books, query=[match("category", type="in", values=["poetry", "fiction"])]) == [2, 3]
    assert found(books, query=[match("category", type="in", values=[])]) == []
    assert found(books, query=[match("tags", type="any")]) == [1]
    assert found(books, query=[match("tags", value="Nature")]) == [1]
    assert found(books, query=[match("code", type="prefix", value="ex-")]) == [1, 2]
    assert found(books, query=[match("code", type="range", gte="EX-100", lt="EX-200")]) == [1]
    assert found(books, query=[match("published", value=True)]) == [1, 3]
    assert found(books, query=[{"type": "not", "clauses": [match("tags", value="nature")]}]) == [2, 3]
    assert found(books, query=[{"type": "or", "clauses": []}]) == []
    assert found(books, query=[{"type": "not", "clauses": []}]) == [1, 2, 3]


def test_text(books):
    text = lambda t, **m: [{"type": "text", "text": t, "fields": {"name": None, "description": None}} | m]
    assert sorted(found(books, query=text("silent spring"))) == [1]
    assert sorted(found(books, query=text("silent", prefix="off"))) == [1, 3]
    assert sorted(found(books, query=text("silent tidying", match="any", prefix="off"))) == [1, 2, 3]
    assert found(books, query=[{"type": "text", "text": "spri", "fields": {"name": None}}]) == [1, 2]
    assert found(books, query=[{"type": "text", "text": "spring silent", "fields": {"name": None}, "match": "phrase"}]) == []
    assert found(books, query=[{"type": "text", "text": "silent spring", "fields": {"name": None}, "match": "phrase"}]) == [1]
    # removed stopwords leave their places empty
    assert found(books, query=[{"type": "text", "text": "spring of 1962", "fields": {"description": None}, "match": "phrase"}]) == [1]
    assert found(books, query=[{"type": "text", "text": "spring 1962", "fields": {"description": None}, "match": "phrase"}]) == []
    assert found(books, query=[{"type": "text", "text": "sprnig", "fields": {"name": None}, "prefix": "off"}]) == [1, 2]
    assert found(books, query=[{"type": "text", "text": "sprnig", "fields": {"name": None}, "prefix": "off", "typos": "off"}]) == []
    assert found(books, query=[{"type": "text", "text": "spring -cleaning", "fields": {"name": None}, "match": "user"}]) == [1]
    assert found(books, query=[{"type": "text", "text": '"quiet sea"', "fields": {"name": None}, "match": "user"}]) == [3]
    assert found(books, query=[{"type": "text", "text": "...", "fields": {"name": None}}]) == []


def test_slop(spark):
    d = {"fields": {"id": {"type": "int64", "primaryKey": True}, "name": S | {"matching": {}}}}
    index = Index(d, spark.createDataFrame([(1, "silent green spring"), (2, "silent spring"), (3, "spring silent")], "id long, name string"))
    q = lambda n: [{"type": "text", "text": "silent spring", "match": "phrase", "slop": n}]
    assert found(index, query=q(1)) == [2, 1]
    assert found(index, query=q(0)) == [2]


def test_relax(spark):
    d = {"fields": {"id": {"type": "int64", "primaryKey": True}, "name": S | {"matching": {}}, "category": S | ALL}}
    rows = [(1, "Mens Running Shoes", "shoes"), (2, "Womens Running Shoes", "shoes"), (3, "Mens Leather Boots", "boots"), (4, "Kids Leather Boots", "boots")]
    index = Index(d, spark.createDataFrame(rows, "id long, name string, category string"))
    got = index.search({"query": [{"type": "text", "text": "waterproof running shoes"}]})
    assert got.relaxed == {"dropped": [{"word": "waterproof", "reason": "unmatched"}], "text": "running shoes"}
    assert got.total == 2
    assert index.search({"query": [{"type": "text", "text": "mens kids boots", "relax": "off"}]}).total == 0
    got = index.search({"query": [{"type": "text", "text": "kids running boots", "relax": "words"}]})
    assert got.total and {d["reason"] for d in got.relaxed["dropped"]} == {"common"}


def values(facet):
    return [(r["value"], r["count"]) for r in facet.orderBy("position").collect()]


def test_facets(products):
    got = products.search({"facets": [{"field": "category"}, {"field": "tags"}, {"field": "price", "order": "value"}, {"field": "brand"}]}).facets
    assert values(got["category"]) == [("clothes", 2), ("shoes", 2)]
    assert values(got["tags"]) == [("sale", 2), ("outdoor", 1)]
    assert values(got["price"]) == [(80.0, 2), (120.0, 1), (200.0, 1)]
    assert values(got["brand"]) == []
    got = products.search({"filters": [match("category", value="shoes"), match("tags", value="outdoor")], "facets": [{"field": "category"}, {"name": "all", "field": "category", "excludeFilters": []}, {"field": "price", "ranges": [{"to": 100}, {"from": 100}]}]}).facets
    assert values(got["category"]) == [("shoes", 1)]
    assert values(got["all"]) == [("shoes", 1)]
    assert [r["count"] for r in got["price"].orderBy("position").collect()] == [0, 1]


def test_timestamps(products):
    # 12:00+02:00 is 10:00Z
    assert found(products, query=[match("added", type="range", gte="2024-07-01T10:00:00Z")]) == [4]
    assert found(products, query=[match("added", type="range", gt="2024-07-01T10:00:00Z")]) == []


def test_hierarchy(spark):
    d = {"fields": {"id": {"type": "int64", "primaryKey": True}, "category": S | {"multiple": True, "filter": {}, "facet": {}, "hierarchy": {}}}}
    rows = [(1, ["Men/Shoes/Running"]), (2, ["Men/Shoes/Casual"]), (3, ["Men/Outerwear"]), (4, ["Women/Knitwear"]), (5, ["Women/Shoes/Sandals", "Men/Shoes/Casual"])]
    index = Index(d, spark.createDataFrame(rows, "id long, category array<string>"))
    assert found(index, query=[match("category", type="under", path="men/shoes")]) == [1, 2, 5]
    assert found(index, query=[match("category", type="under", path="Men/Sho")]) == []
    got = index.search({"facets": [{"field": "category", "path": "Men", "depth": 2}]}).facets["category"]
    assert [(r["path"], r["count"]) for r in got.orderBy("level", "parent", "position").collect()] == [("Men/Shoes", 3), ("Men/Outerwear", 1), ("Men/Shoes/Casual", 2), ("Men/Shoes/Running", 1)]


def test_nested(nested):
    both = lambda color, lt: [{"type": "nested", "path": "variants", "clauses": [match("variants.color", value=color), match("variants.price", type="range", lt=lt)]}]
    assert found(nested, query=both("red", 20)) == [1]
    assert found(nested, query=both("blue", 20)) == [2]
    assert found(nested, query=[{"type": "nested", "path": "variants", "clauses": []}]) == [1, 2]
    assert found(nested, query=[{"type": "nested", "path": "variants", "clauses": [{"type": "text", "text": "red", "prefix": "off"}], "score": "total"}]) == [2, 1]
    red = [{"type": "nested", "path": "variants", "clauses": [match("variants.color", value="red")]}]
    assert found(nested, query=red, sort=[{"field": "variants.price"}]) == [1, 2]
    assert found(nested, sort=[{"field": "variants.price"}]) == [2, 1, 3]
    got = nested.search({"query": red, "facets": [{"field": "variants.color"}]}).facets["variants.color"]
    assert values(got) == [("red", 2)]
    hits = nested.search({"query": red, "hits": {"path": "variants"}}).hits.orderBy("_position").collect()
    assert [(r["id"], r["_index"], r["_element"]["color"]) for r in hits] == [(1, 0, "red"), (2, 0, "red")]
    got = nested.search({"query": red, "matched": {"fields": {"variants": {}}}}).hits.orderBy("id").collect()
    assert [r["_matched_variants"]["totalValues"] for r in got] == [1, 1]
    with pytest.raises(EngineError, match="path_not_nested"):
        nested.search({"query": [{"type": "nested", "path": "name", "clauses": []}]})
    with pytest.raises(EngineError, match="field_outside"):
        nested.search({"query": [match("variants.color", value="red")]})


def test_sort_missing(spark):
    d = {"fields": {"id": {"type": "int64", "primaryKey": True}, "n": {"type": "int32", "filter": {}, "sort": {}}, "m": {"type": "int32", "filter": {}, "sort": {"missing": "first"}}}}
    index = Index(d, spark.createDataFrame([(1, 5, 5), (2, None, None), (3, 1, 1)], "id long, n int, m int"))
    # the missing value's place turns with the direction
    assert found(index, sort=[{"field": "n"}]) == [3, 1, 2]
    assert found(index, sort=[{"field": "n", "order": "desc"}]) == [2, 1, 3]
    assert found(index, sort=[{"field": "m"}]) == [2, 3, 1]
    assert found(index, sort=[{"field": "m", "order": "desc"}]) == [1, 3, 2]
    walked, q = [], {"sort": [{"field": "n", "order": "desc"}], "limit": 1}
    page = index.search(q)
    while c := page.cursors():
        walked += [r["id"] for r in page.hits.collect()]
        page = index.search(q | {"after": c["next"]})
    assert walked == [2, 1, 3]
    with pytest.raises(EngineError, match="sort_mismatch"):
        index.search({"sort": [{"field": "m"}], "after": index.search(q).cursors()["next"]})


def test_signals(products):
    got = products.search({"signals": [{"field": "stock", "saturation": {"pivot": 5}}]}).hits.orderBy("_position").collect()
    assert [(r["id"], round(r["_score"], 4)) for r in got] == [(4, 1.5833), (2, 1.5), (1, 1.375), (3, 1.375)]
    got = products.search({"signals": [{"field": "added", "decay": {"halfLife": 30 * 86400 - 7200}}]}).hits.orderBy("_position").collect()
    assert got[0]["id"] == 4 and got[0]["_score"] == 2.0
    assert round(got[1]["_score"], 6) == 1.5
    with pytest.raises(EngineError, match="type_unsupported"):
        products.search({"signals": [{"field": "category", "linear": {"ceiling": 1}}]})


def test_interpret(products):
    got = products.search({"query": [{"type": "text", "match": "user", "text": "sneaker under 100 kr", "fields": {"name": None}}]})
    assert got.interpreted["filters"] == [{"field": "price", "match": {"type": "range", "lt": 100.0}, "words": ["under", "100", "kr"]}]
    assert got.interpreted["text"] == "sneaker" and [r["id"] for r in got.hits.collect()] == [2]
    got = products.search({"query": [{"type": "text", "match": "user", "text": "size 44", "fields": {"name": None}}]})
    assert got.interpreted is None


def test_read_values(spark):
    d = {"fields": {"id": {"type": "int64", "primaryKey": True}, "name": S | {"matching": {}}, "colour": S | ALL, "brand": S | ALL}}
    rows = [(1, "Running shoes", "Red", "Nike"), (2, "Running shoes", "Dark red", "Nike"), (3, "Running shoes", "Blue", "Puma")]
    settings = {"fields": {"colour": {"interpret": {}, "suggest": {}, "values": [{"value": "Red", "label": "Röd"}]}, "brand": {"interpret": {}, "suggest": {}}}}
    index = Index(d, spark.createDataFrame(rows, "id long, name string, colour string, brand string"), settings)
    got = index.search({"query": [{"type": "text", "match": "user", "text": "dark red nike shoes", "fields": {"name": None}}]})
    assert [(f["field"], f["match"]["value"]) for f in got.interpreted["filters"]] == [("colour", "Dark red"), ("brand", "Nike")]
    assert [r["id"] for r in got.hits.collect()] == [2]
    rows = index.suggest({"text": "rö"}).collect()
    assert [(r["text"], r["value"], r["typed"]) for r in rows] == [("Röd", "Red", 2)]
    assert [r["value"] for r in index.suggest({"text": "n"}).collect()] == ["Nike"]
    assert [r["value"] for r in index.facet_values("brand", {"prefix": "pu"}).collect()] == ["Puma"]


def test_vectors(spark):
    d = {"fields": {"id": {"type": "int64", "primaryKey": True}, "title": S | {"matching": {}}, "category": S | ALL, "v": {"type": "vector", "dimensions": 2}}}
    rows = [(1, "silent spring", "a", [1.0, 0.0]), (2, "quiet spring", "b", [0.0, 1.0]), (3, "sea", "a", [0.7, 0.7]), (4, "silent sea", "b", None)]
    index = Index(d, spark.createDataFrame(rows, "id long, title string, category string, v array<float>"))
    knn = {"type": "knn", "field": "v", "vector": [1.0, 0.1], "k": 2}
    assert found(index, query=[knn]) == [1, 3]
    assert found(index, query=[knn | {"filter": [match("category", value="b")]}]) == [2]
    fuse = {"type": "fuse", "rankings": [{"clauses": [{"type": "text", "text": "spring", "prefix": "off"}]}, {"clauses": [knn]}]}
    assert found(index, query=[fuse])[0] == 1
    assert found(index, query=[fuse | {"filter": [match("category", value="b")]}]) == [2]
    for bad, code in (({"vector": [1.0]}, "vector_dimensions"), ({"vector": [0.0, 0.0]}, "vector_zero"), ({"k": 0}, "k_out_of_range")):
        with pytest.raises(EngineError, match=code):
            index.search({"query": [knn | bad]})


def test_locales(spark):
    d = {"fields": {"id": {"type": "int64", "primaryKey": True}, "title": S | {"locales": ["en", "sv", "no"], "defaultLocale": "en", "filter": {}, "sort": {}, "matching": {}}}}
    rows = [(1, {"en": "red shoe", "sv": "röd sko"}), (2, {"en": "blue shoe"})]
    index = Index(d, spark.createDataFrame(rows, "id long, title map<string,string>"))
    q = [{"type": "text", "text": "sko", "prefix": "off"}]
    assert found(index, query=q, locale="sv-SE") == [1]
    assert found(index, query=q) == []
    got = index.search({"query": q, "locale": "sv", "fields": ["title"]}).hits.collect()
    assert got[0]["title"] == {"sv": "röd sko"}
    assert index.definition.locale_of(index.definition.fields["title"], "nb-NO") == "no"


def test_explain_and_highlight(books):
    q = {"query": [{"type": "text", "text": "silent spring", "fields": {"name": None}, "prefix": "off"}, {"type": "boost", "weight": 2, "clauses": [match("published", value=True)]}], "signals": []}
    tree = books.explain(q, 1)
    top = books.search(q).hits.collect()[0]
    assert tree["matched"] and tree["clauses"][1]["score"] == 2.0 and abs(tree["score"] - top["_score"]) < 1e-6
    assert not books.explain(q, 2)["matched"]
    got = books.search(q | {"highlight": {"fields": {"name": {}}}}).hits.collect()
    assert got[0]["_highlight_name"] == ["<em>Silent</em> <em>Spring</em>"]


def test_refusals(books):
    for request, code in (
        ({"query": [match("nothing", value=1)]}, "field_unknown"),
        ({"query": [match("name", value="x")]}, "usage_unsupported"),
        ({"filters": [{"type": "text", "text": "x"}]}, "filter:clause_unsupported"),
        ({"limit": 1001}, "limit_out_of_range"),
        ({"facets": [{"field": "category"}, {"field": "category"}]}, "name_duplicate"),
        ({"query": [{"type": "fuse", "rankings": [{"clauses": []}]}]}, "rankings_too_few"),
        ({"query": [{"type": "text", "text": "a b", "slop": 1}]}, "slop_unsupported"),
        ({"signalsMode": "add"}, "mode_without_signals"),
        ({"rescore": {"boost": []}}, "window_required"),
        ({"query": [match("published", type="prefix", value="x")]}, "type_unsupported"),
    ):
        with pytest.raises(EngineError, match=code):
            books.search(request)


def test_definition_refusals():
    for fields, code in (({"a": {"type": "decimal"}}, "type_unknown"), ({"a": {"type": "string", "signal": {}}}, "signal:type_unsupported"), ({"a": {"type": "double", "signal": {}, "filter": {}}}, "usage_conflicting"), ({"a": {"type": "vector"}}, "dimensions_out_of_range"), ({"a": {"type": "int32", "matching": {}}}, "usage_unsupported")):
        with pytest.raises(EngineError, match=code):
            IndexDefinition.of({"fields": fields})
    a = IndexDefinition.of({"fields": {"id": {"role": "id"}, "n": {"type": "int32"}}})
    b = IndexDefinition.of({"fields": {"id": {"role": "id"}, "n": {"type": "int32", "sort": {}}}})
    assert a.changes_needing_generation(b) == ["n"] and b.changes_needing_generation(a) == []


def test_wildcards_and_chains(spark):
    d = {"fields": {"id": {"type": "int64", "primaryKey": True}, "attr_*": {"type": "double", "filter": {}}, "prices": {"type": "object", "multiple": True, "mode": "nested", "fields": {"list": S | ALL, "amount": {"type": "double", "unit": "SEK"} | ALL}}}}
    rows = [(1, {"attr_w": 2.0}, [("cust", 149.0), ("store", 99.0)]), (2, {"attr_w": 5.0}, [("store", 90.0)]), (3, {}, [])]
    index = Index(d, spark.createDataFrame(rows, "id long, `attr_*` map<string,double>, prices array<struct<list:string,amount:double>>"))
    assert found(index, query=[match("attr_w", type="range", gt=3)]) == [2]
    when = lambda x: [match("prices.list", value=x)]
    chain = {"field": "prices.amount", "when": when("cust"), "fallback": [{"field": "prices.amount", "when": when("store")}]}
    assert found(index, sort=[chain]) == [2, 1, 3]
    got = index.search({"facets": [chain | {"ranges": [{"to": 100}, {"from": 100}]}]}).facets["prices.amount"]
    assert [r["count"] for r in got.orderBy("position").collect()] == [1, 1]


def test_completed_last_word(spark):
    """The stem of what is half typed isn't asked for: the other usage has the words as they stand."""
    d = {"fields": {"id": {"type": "int64", "primaryKey": True}, "name": S | {"matching": {"language": "en"}, "autocomplete": {}}}}
    index = Index(d, spark.createDataFrame([(1, "trail running shoes"), (2, "trail rug")], "id long, name string"))
    assert found(index, query=[{"type": "text", "text": "trail runni"}]) == [1]
    assert sorted(found(index, query=[{"type": "text", "text": "trail ru"}])) == [1, 2]


def test_analysis_chains(spark):
    from quillspan.functions.analysis import Chain

    text = "Don't <b>STOP</b> the ﬁne cats running café"
    for spec in ({}, {"language": "en"}, {"charFilters": [{"type": "htmlStrip"}]}, {"tokenizer": "whitespace", "filters": ["asciiFolding"]}, {"filters": [{"type": "normalize", "form": "nfkc"}]}, {"tokenizer": "letter"}, {"tokenizer": "keyword"}, {"filters": ["normalize", {"type": "edgeNgram", "min": 2, "max": 3}]}, {"filters": ["normalize", {"type": "ngram", "min": 3, "max": 3}]}, {"filters": ["normalize", {"type": "synonyms", "map": {"cats": ["felines"]}}]}, {"charFilters": [{"type": "mapping", "map": {"STOP": "halt"}}, {"type": "patternReplace", "pattern": "c(a)", "replacement": "k$1"}]}, {"filters": ["normalize", {"type": "decompound", "words": ["run", "ning"]}]}):
        chain = Chain(spec)
        got = spark.range(1).select(chain.tokens(F.lit(text)).alias("t")).first()["t"]
        assert [tuple(x) for x in got] == chain.analyze(text, query_side=False), spec
    with pytest.raises(EngineError, match="language_unsupported"):
        Chain({"language": "xx"})


def test_deadline(spark, tmp_path):
    import time

    from quillspan.plans.deadline import collected_within

    assert len(collected_within(spark.range(3).toDF("x"), 60)) == 3
    # about a millisecond a row, read from a file as a search's rows are
    spark.range(0, 400_000, 1, 4).write.parquet(str(tmp_path / "rows"))
    costly = F.aggregate(F.sequence(F.lit(1), F.lit(20_000)), F.col("id"), lambda a, x: (a * 31 + x) % 1_000_003)
    slow = spark.read.parquet(str(tmp_path / "rows")).agg(F.max(costly))
    with pytest.raises(EngineError, match="timeout"):
        collected_within(slow, 2)
    # the cores are free again
    began = time.monotonic()
    assert spark.range(0, 1000, 1, 4).agg(F.sum("id")).first()[0] == 499_500
    assert time.monotonic() - began < 60
