"""Documents in and out, patches, generations, streams."""

import json

import pytest
from pyspark.sql import functions as F

from quillspan.errors import EngineError
from quillspan.plans.definition import IndexDefinition
from quillspan.plans.search import Index
from quillspan.sources import documents as docs
from quillspan.sources import patch
from quillspan.sources.store import Store
from quillspan.streaming.ingest import ingest

S = {"type": "string"}
SPEC = {"fields": {"id": {"type": "int64", "primaryKey": True, "required": True}, "name": S | {"matching": {}}, "price": {"type": "double", "validation": {"min": 0}}, "n": {"type": "int32"}, "at": {"type": "timestamp"}, "title": S | {"locales": ["en", "sv"]}, "tags": S | {"multiple": True}, "variants": {"type": "object", "multiple": True, "mode": "nested", "key": "sku", "fields": {"sku": S, "price": {"type": "double"}}}, "dim": {"type": "object", "fields": {"w": {"type": "double"}}}}}
DEF = IndexDefinition.of(SPEC)


def raw(spark, *rows):
    return spark.createDataFrame([(json.dumps(r) if isinstance(r, dict) else r,) for r in rows], "value string")


def test_json(spark):
    good = {"id": 1, "name": "a", "price": -0.0, "at": "2024-05-01T12:00:00.123456+02:00", "tags": ["x"], "variants": [{"sku": "a", "price": 1}]}
    bad = [{"id": 2, "price": -1}, {"name": "no key"}, "not json", {"id": 3, "nothing": 1}, {"id": 4, "variants": [{"sku": "a"}, {"sku": "a"}]}]
    rows = docs.from_json(raw(spark, good, *bad), DEF, "skip").collect()
    assert [r["id"] for r in rows] == [1]
    assert str(rows[0]["price"]) == "0.0" and rows[0]["at"].microsecond == 123000
    with pytest.raises(Exception, match="value_too_small"):
        docs.from_json(raw(spark, bad[0]), DEF).collect()
    assert docs.from_json(raw(spark), DEF).count() == 0


def test_round_trip(spark, tmp_path):
    rows = docs.from_json(raw(spark, {"id": 1, "name": "a", "title": {"en": "x"}}, {"id": 2, "dim": {"w": 2}}), DEF)
    docs.as_ndjson(rows).write.text(str(tmp_path / "out"))
    again = docs.read_json(spark, str(tmp_path / "out"), DEF)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))


def test_fallback_locales(spark):
    d = IndexDefinition.of(SPEC | {"localeFallback": {"sv": "en"}})
    rows = docs.with_fallbacks(docs.from_json(raw(spark, {"id": 1, "title": {"en": "x"}}, {"id": 2, "title": {"sv": "y"}}), d), d)
    assert {r["id"]: r["title"] for r in rows.collect()} == {1: {"en": "x", "sv": "x"}, 2: {"sv": "y"}}


def test_patches(spark):
    rows = docs.from_json(raw(spark, {"id": 1, "price": 1, "tags": ["x"], "title": {"en": "a"}, "variants": [{"sku": "V-1", "price": 1}, {"sku": "V-2", "price": 2}]}), DEF)

    def one(changes, missing="fail"):
        return patch.patched(rows, DEF, changes, missing).collect()[0]

    assert one({"price": 5})["price"] == 5.0 and one({"price": None})["price"] is None
    assert one({"tags[]": "y"})["tags"] == ["x", "y"]
    assert one({"title[sv]": "b"})["title"] == {"en": "a", "sv": "b"}
    assert one({"title[en]": None})["title"] == {}
    assert [v["price"] for v in one({"variants[sku=V-2].price": 9})["variants"]] == [1.0, 9.0]
    assert [v["sku"] for v in one({"variants[V-1]": None})["variants"]] == ["V-2"]
    assert one({"dim.w": 3})["dim"]["w"] == 3.0
    assert one({"variants[sku=none].price": 9}, "skip")["variants"][0]["price"] == 1.0
    with pytest.raises(Exception, match="no_match"):
        one({"variants[sku=none].price": 9})
    with pytest.raises(EngineError, match="key_fixed"):
        one({"id": 2})
    assert patch.parse(r"fields.variants\.colour[a\]b]")[1] == patch.Step("variants.colour", "word", "a]b")


def test_upsert_and_delete(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id long, name string, seq int")
    got = docs.upserted(old, new, "id", "seq")
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "d"), (3, "e")]
    index = Index({"fields": {"id": {"type": "int64", "primaryKey": True}, "name": S | {"filter": {}}}}, old)
    assert docs.deleted_by_query(index, []).count() == 0
    with pytest.raises(EngineError, match="matches_everything"):
        docs.deleted_by_query(index, [{"type": "not", "clauses": []}])
    assert [r["id"] for r in docs.deleted_by_query(index, [{"field": "name", "match": {"value": "A"}}]).collect()] == [2]
    assert [r["id"] for r in docs.scanned(index, 1, 10).collect()] == [2]


def test_generations(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/ix")
    store.create({"fields": {"id": {"type": "int64", "primaryKey": True}, "name": S | {"filter": {}}}})
    assert store.frame().count() == 0
    before = store.token()
    store.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string"))
    assert store.fresh(before) and store.frame().count() == 2
    job = store.start_reindex(lambda r: r.withColumn("name", F.upper("name")))
    store.upsert(spark.createDataFrame([(3, "c")], "id long, name string"))
    store.delete([1])
    store.replay(lambda r: r.withColumn("name", F.upper("name")))
    store.promote(expected_live=0)
    assert store.live()["generation"] == job["to"]
    assert sorted(map(tuple, store.frame().collect())) == [(2, "B"), (3, "C")]
    store.put_settings({"synonyms": {}})
    assert store.patch_settings({"fields.name.suggest": {}})["fields"] == {"name": {"suggest": {}}}
    with pytest.raises(EngineError, match="index:exists"):
        store.create({"fields": {"id": {"role": "id"}}})


def test_stream(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/ix")
    store.create({"fields": {"id": {"type": "int64", "primaryKey": True}, "name": S}})
    source = tmp_path / "in"
    for i, rows in enumerate(([(1, "a", 1), (2, "b", 2)], [(1, "z", 3)])):
        spark.createDataFrame(rows, "id long, name string, seq int").coalesce(1).write.mode("append").parquet(str(source))
        q = ingest(store, spark.readStream.schema("id long, name string, seq int").parquet(str(source)), "seq", str(tmp_path / "cp"), once=True)
        q.awaitTermination(60)
    assert sorted((r["id"], r["name"]) for r in store.frame().collect()) == [(1, "z"), (2, "b")]


def test_signals_side_table(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, 0.1)], "id long, pop double")
    side = spark.createDataFrame([(1, 0.9)], "id long, pop double")
    assert {r["id"]: r["pop"] for r in docs.signals_laid(rows, side, "id", ["pop"]).collect()} == {1: 0.9, 2: 0.1}
