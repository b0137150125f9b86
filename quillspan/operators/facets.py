"""Facets: documents counted by value, range or tree level, each under the filters it keeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import RequestError
from ..functions.analysis import folded
from ..plans.clauses import Facet, FieldClause, Nested, walk
from ..plans.definition import NUMBERS
from .compiler import Compiler
from .matchers import SEPARATOR, literal


def filter_path(c) -> str:
    """The most specific path that covers a filter entry."""
    names = [x.field.split(".") for x in walk([c]) if isinstance(x, FieldClause)]
    if not names:
        return c.path if isinstance(c, Nested) else ""
    out = names[0]
    for n in names[1:]:
        out = [a for a, b in zip(out, n, strict=False) if a == b]
    return ".".join(out)


def kept(filters, facet: Facet) -> tuple:
    """Filters that narrow a facet: all but those on its own field, or on or below the paths it excludes."""
    dropped = (facet.field,) if facet.exclude is None else facet.exclude
    return tuple(c for c in filters if not any(filter_path(c) == p or filter_path(c).startswith(p + ".") for p in dropped))


def values_of(compiler: Compiler, query, facet: Facet, hit_path: str | None) -> Column:
    """The list of a document's (or value hit's) values."""
    place = compiler.index.definition.place(facet.field).need("facet")
    if place.nested and place.nested == hit_path:
        return Compiler(compiler.index, compiler.locale, hit_path, F.col("_elem")).all_values(place)
    if place.nested:
        inner = compiler.narrowed_list(query, place.nested)
        return F.flatten(F.transform(inner, lambda x: Compiler(compiler.index, compiler.locale, place.nested, x).all_values(place)))
    return compiler.all_values(place)


def value_facet(scope: DataFrame, values: Column, facet: Facet, declared: dict, locale: str | None) -> DataFrame:
    """value, count, label and total_values, ordered and cut as asked."""
    got = scope.select(F.explode(F.array_distinct(values)).alias("value")).groupBy("value").agg(F.count("*").alias("count"))
    spark = scope.sparkSession
    rows = [(str(v["value"]), i, (v.get("labels") or {}).get(locale or "", v.get("label"))) for i, v in enumerate(declared.get("values", []))]
    if rows:
        # as many rows as the settings declare
        table = F.broadcast(spark.createDataFrame(rows, "dv string, declared int, label string"))
        got = got.join(table, F.col("value").cast("string") == F.col("dv"), "left").drop("dv")
    else:
        got = got.withColumn("declared", F.lit(None).cast("int")).withColumn("label", F.lit(None).cast("string"))
    if facet.prefix is not None and (want := folded(facet.prefix)):
        got = got.where(F.lower(F.col("value").cast("string")).startswith(want) | F.coalesce(F.lower("label").startswith(want), F.lit(False)))
    order = {"count": [F.desc("count"), F.asc("value")], "value": [F.asc("value")], "declared": [F.asc_nulls_last("declared"), F.desc("count"), F.asc("value")]}[facet.order]
    total = got.agg(F.count("*").alias("total_values"))
    top = got.orderBy(*order).limit(facet.limit)
    # at most limit rows: numbering them takes one small task
    top = top.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("int"))
    return top.crossJoin(F.broadcast(total)).select("position", "value", "count", "label", "total_values")


def range_facet(scope: DataFrame, values: Column, facet: Facet, field) -> DataFrame:
    """from, to, count of each bucket, all in one pass."""
    if field.type not in NUMBERS | {"timestamp"}:
        raise RequestError("search:matcher:type_unsupported", f"ranges on {field.type}", facet.field)

    def inside(lo, hi):
        tests = lambda v: ([v >= literal(field, lo)] if lo is not None else []) + ([v < literal(field, hi)] if hi is not None else [])
        return F.exists(F.col("_v"), lambda v: reduce(Column.__and__, tests(v)))

    row = scope.select(values.alias("_v")).agg(*(F.count_if(F.coalesce(inside(lo, hi), F.lit(False))).alias(f"n{i}") for i, (lo, hi) in enumerate(facet.ranges)))
    kind = "string" if field.type == "timestamp" else "double"
    cells = [F.struct(F.lit(i).alias("position"), F.lit(lo).cast(kind).alias("from"), F.lit(hi).cast(kind).alias("to"), F.col(f"n{i}").alias("count")) for i, (lo, hi) in enumerate(facet.ranges)]
    return row.select(F.inline(F.array(*cells)))


def hierarchy_facet(scope: DataFrame, values: Column, facet: Facet) -> DataFrame:
    """path, parent, value, level, count and the parent's total of children; limit and order hold for each level."""
    base = facet.path.strip(SEPARATOR) if facet.path else ""
    start = len(base.split(SEPARATOR)) if base else 0
    steps = lambda p: F.split(p, SEPARATOR)
    paths = F.flatten(F.transform(values, lambda p: F.transform(F.sequence(F.lit(1), F.size(steps(p))), lambda i: F.array_join(F.slice(steps(p), 1, i), SEPARATOR))))
    rows = scope.select(F.explode(F.array_distinct(paths)).alias("path")).withColumn("level", F.size(steps(F.col("path"))) - start)
    rows = rows.where((F.col("level") >= 1) & (F.col("level") <= facet.depth))
    if base:
        rows = rows.where(F.lower("path").startswith(base.lower() + SEPARATOR))
    got = rows.groupBy("path", "level").agg(F.count("*").alias("count"))
    got = got.withColumn("value", F.substring_index("path", SEPARATOR, -1)).withColumn("parent", F.when(F.size(steps(F.col("path"))) > 1, F.expr(f"substring(path, 1, length(path) - length(value) - {len(SEPARATOR)})")).otherwise(""))
    order = [F.asc("value")] if facet.order == "value" else [F.desc("count"), F.asc("value")]
    w = Window.partitionBy("parent")
    got = got.withColumn("total_values", F.count("*").over(w)).withColumn("position", F.row_number().over(w.orderBy(*order)))
    return got.where(F.col("position") <= facet.limit).select("level", "parent", "path", "value", "count", "total_values", "position")
