"""The registered NDJSON round trip takes every part."""

from quillspan import queries
from quillspan.sources import documents as docs

DATA = "/root/testdata/sf0.001"


def test_every_part_makes_the_round_trip(spark, monkeypatch):
    out, seen = docs.as_ndjson, []
    monkeypatch.setattr(docs, "as_ndjson", lambda rows: seen.append(rows) or out(rows))
    got = queries.QUERIES["json_round_trip"](spark, DATA)
    part = spark.read.parquet(f"{DATA}/part.parquet")
    assert len(got.collect()) == part.count()
    rows, definition = seen[0], queries.parts(spark, DATA).definition
    back = docs.from_json(out(rows), definition).select("p_partkey", "p_name", "p_brand", "p_size")
    assert back.count() == part.count()
    assert back.exceptAll(part.select("p_partkey", "p_name", "p_brand", "p_size")).count() == 0
