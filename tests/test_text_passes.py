"""A search reads the texts of its documents once, however many words, readings and relaxations it has."""

import pytest
from pyspark.sql import functions as F

from quillspan.plans.search import Index

TEXT = {"type": "string", "matching": {"typoTolerance": {}}}
DEFINITION = {"fields": {"id": {"type": "int64", "primaryKey": True}, "text": TEXT, "lang": {"type": "string", "filter": {}}}}
DOCS = ["the hesh is the best", "a pathetic wort of the clown", "that moron is with the hesh", "is the hesh the idiot", "that old man is with wortel", None, "", "is the is the hesh is the"]


def one(words, **more):
    return {"type": "text", "text": words, "fields": {"text": None}, "prefix": "off", "typos": "off", "relax": "off"} | more


#: by the query of the finding, with the ids found in order of their keys
REQUESTS = {
    "text_relax": ([one("pathetic zzzznowhere", relax="unmatched")], [1]),
    "text_user": ([one('hesh "is the" -idiot', match="user", interpret="off")], [0, 7]),
    "text_prefix": ([one("the wort", prefix="last_token")], [1]),
    "text_search": ([one("the with", relax="unmatched")], [2]),
    "fuse_rrf": ([{"type": "fuse", "rankings": [{"clauses": [one("the")]}, {"clauses": [one("is")], "weight": 0.5}], "filter": [{"field": "lang", "match": {"value": "en"}}]}], [0, 2, 4]),
    "text_typo": ([one("pathetci", typos="auto")], [1]),
    "text_phrase": ([one("is the is", match="phrase")], [7]),
    "text_slop": ([one("that is", match="phrase", slop=2)], [2, 4]),
    "text_all": ([one("the hesh, with")], [2]),
    "text_any": ([one("pathetic moron clown", match="any")], [1, 2]),
}


@pytest.mark.parametrize("name", REQUESTS)
def test_texts_are_read_once(spark, name):
    query, ids = REQUESTS[name]
    read = spark.sparkContext.accumulator(0)

    def seen(x):
        read.add(1)
        return x

    rows = spark.createDataFrame([(i, t, "fr" if i % 2 else "en") for i, t in enumerate(DOCS)], "id long, raw string, lang string")
    # a value that isn't worked out again within one pass
    index = Index(DEFINITION, rows.withColumn("text", F.udf(seen, "string").asNondeterministic()("raw")).drop("raw"))
    got = index.search({"query": query, "limit": 50}).hits.select("id").collect()
    assert sorted(r["id"] for r in got) == ids
    assert read.value == len(DOCS)


def test_prepared_postings_say_the_same(spark):
    index = Index(DEFINITION, spark.createDataFrame([(i, t, "en") for i, t in enumerate(DOCS)], "id long, text string, lang string"))
    ready = index.prepared()
    for query, _ in REQUESTS.values():
        rows = lambda x: [tuple(r) for r in x.search({"query": query, "limit": 50}).hits.orderBy("_position").select("id", F.round("_score", 6)).collect()]  # noqa: B023, E731
        assert rows(index) == rows(ready)
