"""Suggestions: prefix facets over opted-in fields, then values one mistake away if too few start with the text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import RequestError
from ..functions.analysis import folded
from ..plans.clauses import Facet, read_request
from . import facets as fc
from .evidence import near_start

MIN_FOR_TYPOS = 5


def suggested(index, q: dict) -> DataFrame:
    """position, text, typed, field, value, label, count, corrected."""
    limit = q.get("limit", 5)
    if not 1 <= limit <= index.limits.suggest:
        raise RequestError("search:suggest:limit_out_of_range", str(limit))
    text = folded((q.get("text") or "").strip())
    names = sorted(n for n, s in index.settings.get("fields", {}).items() if "suggest" in s)
    r = read_request({"filters": q.get("filters", []), "locale": q.get("locale")}, index.limits)
    frames = []
    for n in names:
        f = Facet(n, n)
        scope, at, _ = index.matched_rows(r, filters=fc.kept(r.filters, f))
        values = fc.values_of(at, fc.kept(r.filters, f), f, None)
        got = scope.select(F.explode(F.array_distinct(values)).alias("value")).select(F.col("value").cast("string").alias("value")).groupBy("value").agg(F.count("*").alias("count"))
        rows = [(str(v["value"]), (v.get("labels") or {}).get(r.locale or "", v.get("label"))) for v in index.field_settings(n).get("values", [])]
        if rows:
            got = got.join(F.broadcast(got.sparkSession.createDataFrame(rows, "value string, label string")), "value", "left")
        else:
            got = got.withColumn("label", F.lit(None).cast("string"))
        frames.append(got.withColumn("field", F.lit(n)))
    if not frames:
        return index.frame.sparkSession.createDataFrame([], "position int, text string, typed int, field string, value string, label string, count long, corrected boolean")
    all_ = reduce(DataFrame.unionByName, frames)
    by_label, by_value = F.coalesce(F.lower("label").startswith(text), F.lit(False)), F.lower("value").startswith(text)
    exact = all_.where(by_label | by_value).withColumn("corrected", F.lit(False)).withColumn("text", F.when(by_label, F.col("label")).when(by_value & F.col("label").isNotNull(), F.col("value")).otherwise(F.coalesce("label", "value"))).withColumn("typed", F.lit(len(text)))
    order = [F.asc("corrected"), F.desc("count"), F.asc("field"), F.asc("value")]
    out = exact
    if q.get("typos", "auto") == "auto" and len(text) >= MIN_FOR_TYPOS and exact.limit(limit).count() < limit:
        # one edit anywhere in the start of the value; the first letter is held to
        close = near_start(F.lower("value"), text, 1) & F.lower("value").startswith(text[:1])
        more = all_.where(close & ~(by_label | by_value)).withColumn("corrected", F.lit(True)).withColumn("text", F.coalesce("label", "value")).withColumn("typed", F.lit(0))
        out = exact.unionByName(more)
    top = out.dropDuplicates(["field", "value"]).orderBy(*order).limit(limit)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("int")).select("position", "text", "typed", "field", "value", "label", "count", "corrected")
