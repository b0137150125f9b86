"""Documents in and out: JSON and NDJSON, typed by the definition, validated before they are taken in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DocumentError
from ..plans.definition import Field, IndexDefinition

INT32 = (-(2**31), 2**31 - 1)


def _wire(t: T.DataType) -> T.DataType:
    """How a type travels: timestamps as text, since their offset is mandatory, and whole numbers wide, to be checked."""
    if isinstance(t, T.TimestampType):
        return T.StringType()
    if isinstance(t, (T.IntegerType, T.LongType)):
        return T.DecimalType(38, 0)
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_wire(t.elementType))
    if isinstance(t, T.MapType):
        return T.MapType(t.keyType, _wire(t.valueType))
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _wire(f.dataType)) for f in t.fields])
    return t


def wire_schema(definition: IndexDefinition) -> T.StructType:
    return T.StructType([*_wire(definition.schema()).fields, T.StructField("_corrupt_record", T.StringType())])


def read_json(spark: SparkSession, path: str, definition: IndexDefinition, lines: bool = True, on_error: str = "fail") -> DataFrame:
    """Documents of files: one a line, or a body {"documents": [...]}. ``on_error`` skip leaves out what can't be taken."""
    if lines:
        raw = spark.read.text(path).where(F.trim("value") != "").select("value")
    else:
        whole = spark.read.text(path, wholetext=True)
        raw = whole.select(F.explode(F.from_json("value", "struct<documents: array<string>>").getField("documents")).alias("value"))
    return from_json(raw, definition, on_error)


def from_json(raw: DataFrame, definition: IndexDefinition, on_error: str = "fail") -> DataFrame:
    """A ``value`` column of JSON texts as typed, valid documents."""
    got = raw.select("value", F.from_json("value", wire_schema(definition), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("d"))
    known = F.array(*map(F.lit, [n for n in definition.fields if "*" not in n]))
    unknown = F.filter(F.json_object_keys("value"), lambda k: ~F.array_contains(known, k)) if all("*" not in n for n in definition.fields) else F.expr("cast(array() as array<string>)")
    problem = F.when(F.col("d").isNull() | F.col("d._corrupt_record").isNotNull(), F.lit("document:json_invalid")).when(F.size(unknown) > 0, F.concat(F.lit("document:field_unknown: "), F.get(unknown, F.lit(0))))
    rows = got.withColumn("_problem", problem)
    cols = [_typed(F.col(f"d.`{n}`"), f.spark_type()).alias(n) for n, f in definition.fields.items()]
    return valid(rows.select(*cols, F.col("_problem")), definition, on_error)


def _typed(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.TimestampType):
        # an offset has to be there; milliseconds are kept
        ok = c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$")
        return F.when(ok, F.timestamp_millis(F.unix_millis(F.try_to_timestamp(c))))
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _typed(x, t.elementType))
    if isinstance(t, T.MapType):
        return F.transform_values(c, lambda _, v: _typed(v, t.valueType))
    if isinstance(t, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(_typed(c[f.name], f.dataType).alias(f.name) for f in t.fields)))
    if isinstance(t, (T.IntegerType, T.LongType)):
        return F.try_cast(c, t.simpleString()) if hasattr(F, "try_cast") else c.try_cast(t.simpleString())
    if isinstance(t, (T.DoubleType, T.FloatType)):
        # no negative zero
        return F.when(c == 0, F.lit(0.0).cast(t)).otherwise(c)
    return c


def problems(definition: IndexDefinition) -> Column:
    """The first thing wrong with a typed document, or null."""
    out = []

    def check(name: str, f: Field, c: Column) -> None:
        each = (lambda test: F.exists(c, test)) if f.multiple and not f.locales else (lambda test: test(c))
        if f.required:
            out.append(F.when(c.isNull(), f"document:field_required: {name}"))
        if f.type in {"float", "double"} and not f.locales:
            out.append(F.when(each(lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), f"document:value_not_finite: {name}"))
        if f.minimum is not None:
            out.append(F.when(each(lambda x: x < f.minimum), f"document:value_too_small: {name}"))
        if f.maximum is not None:
            out.append(F.when(each(lambda x: x > f.maximum), f"document:value_too_large: {name}"))
        if f.type == "geo_point":
            out.append(F.when(each(lambda x: (F.abs(x["lat"]) > 90) | (F.abs(x["lon"]) > 180)), f"document:geo_invalid: {name}"))
        if f.type == "vector" and not f.multiple:
            out.append(F.when(F.size(c) != f.dimensions, f"document:vector_dimensions: {name}"))
            if f.similarity == "cosine":
                out.append(F.when(~F.exists(c, lambda x: x != 0), f"document:vector_zero: {name}"))
        if f.type == "object" and f.multiple and f.key:
            keys = F.transform(c, lambda x: x[f.key])
            out.append(F.when(F.size(F.array_distinct(keys)) < F.size(keys), f"document:key_duplicate: {name}"))
        if f.type == "object" and not f.multiple:
            for n, g in f.fields.items():
                check(f"{name}.{n}", g, c[n])

    for n, f in definition.fields.items():
        if "*" not in n:
            check(n, f, F.col(f"`{n}`"))
    return F.coalesce(*out, F.lit(None).cast("string"))


def valid(rows: DataFrame, definition: IndexDefinition, on_error: str = "fail") -> DataFrame:
    """Rows without problems. ``fail`` raises inside the job at the first bad one, ``skip`` leaves bad ones out."""
    if on_error not in {"fail", "skip"}:
        raise DocumentError("document:on_error_unknown", on_error)
    have = F.col("_problem") if "_problem" in rows.columns else F.lit(None).cast("string")
    rows = rows.withColumn("_problem", F.coalesce(have, problems(definition)))
    if on_error == "skip":
        return rows.where("_problem IS NULL").drop("_problem")
    first = next(iter(definition.fields))
    # the check hangs on the key column, so no plan prunes it
    rows = rows.withColumn(first, F.when(F.col("_problem").isNotNull(), F.raise_error(F.col("_problem")).cast(rows.schema[first].dataType)).otherwise(F.col(first)))
    return rows.drop("_problem")


def with_fallbacks(rows: DataFrame, definition: IndexDefinition) -> DataFrame:
    """Missing locale variants filled along the fallback chain, as the index stores them."""
    for n, f in definition.fields.items():
        for tag in f.locales:
            chain, at = [], tag
            while (at := definition.fallback_locales.get(at)) and at not in chain:
                chain.append(at)
            if chain:
                fill = F.coalesce(*(F.col(n)[t] for t in chain))
                have = F.map_contains_key(n, F.lit(tag))
                rows = rows.withColumn(n, F.when(have | fill.isNull(), F.col(n)).otherwise(F.map_concat(F.col(n), F.create_map(F.lit(tag), fill))))
    return rows


def upserted(old: DataFrame, new: DataFrame, pk: str, order: str | None = None) -> DataFrame:
    """Replace on the same key; of several new rows of one key the last by ``order`` stays."""
    if order:
        last = new.groupBy(pk).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in new.columns]), order).alias("r"))
        new = last.select("r.*")
    new = new.select(*old.columns) if set(old.columns) <= set(new.columns) else new
    return old.join(new.select(pk), pk, "left_anti").unionByName(new)


def deleted(old: DataFrame, keys: DataFrame | list, pk: str) -> DataFrame:
    if isinstance(keys, list):
        return old.where(~F.col(pk).isin(keys)) if keys else old
    return old.join(keys.select(pk), pk, "left_anti")


def deleted_by_query(index, clauses: list[dict]) -> DataFrame:
    """What stays. An empty list empties the index; a list that matches everything by its structure is refused."""
    from ..operators.compiler import Compiler, sure
    from ..plans.clauses import reach

    parsed = index.clauses(clauses)
    if not parsed:
        return index.frame.where(F.lit(False))
    if reach(parsed) == "all":
        raise DocumentError("document:delete:matches_everything", "say so with an empty list")
    df, part = Compiler(index).all(index.frame, parsed)
    return df.where(~sure(part.match)).select(*index.frame.columns)


def got(index, key) -> DataFrame:
    return index.frame.where(F.col(index.pk) == F.lit(key))


def scanned(index, after=None, limit: int = 1000) -> DataFrame:
    """Documents in key order after a key: numbers by value, strings by their UTF-8 bytes."""
    if not 1 <= limit <= 10_000:
        raise DocumentError("document:scan:limit_out_of_range", str(limit))
    rows = index.frame if after is None else index.frame.where(F.col(index.pk) > F.lit(after))
    return rows.orderBy(index.pk).limit(limit)


def as_ndjson(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def signals_laid(rows: DataFrame, side: DataFrame, pk: str, names: list[str]) -> DataFrame:
    """Signal values from a narrow side table over the documents' own; rows are not rewritten."""
    fresh = side.select(F.col(pk), *(F.col(n).alias(f"_new_{n}") for n in names), F.lit(True).alias("_has"))
    out = rows.join(fresh, pk, "left")
    for n in names:
        out = out.withColumn(n, F.when(F.col("_has"), F.col(f"_new_{n}")).otherwise(F.col(n)))
    return out.drop("_has", *(f"_new_{n}" for n in names))


def matched_keys(index, clauses: list[dict]) -> DataFrame:
    from ..operators.compiler import Compiler

    df, part = Compiler(index).all(index.frame, index.clauses(clauses))
    return df.where(part.match).select(index.pk)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
