"""Partial updates: paths like ``variants[sku=V-2].price`` compiled to Column expressions over one row."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DocumentError
from ..plans.definition import Field, IndexDefinition


@dataclass(frozen=True)
class Step:
    name: str
    kind: str = "name"  # name, add, word, pair
    word: str = ""
    key: str = ""


def parse(path: str) -> tuple[Step, ...]:
    """Names joined by dots, each with a selector in brackets at most; a backslash takes the next character as it is."""
    out, i, n = [], 0, len(path)
    while i <= n:
        name = []
        while i < n and path[i] not in ".[":
            if path[i] == "\\" and i + 1 < n:
                i += 1
            name.append(path[i])
            i += 1
        if not name:
            raise DocumentError("document:patch:path_invalid", path)
        step = Step("".join(name))
        if i < n and path[i] == "[":
            i += 1
            word, key, pair = [], "", False
            while i < n and path[i] != "]":
                if path[i] == "\\" and i + 1 < n:
                    i += 1
                elif path[i] == "=" and not pair:
                    key, word, pair = "".join(word), [], True
                    i += 1
                    continue
                word.append(path[i])
                i += 1
            if i >= n:
                raise DocumentError("document:patch:path_invalid", path)
            i += 1
            step = Step(step.name, "pair" if pair else "word" if word else "add", "".join(word), key)
        out.append(step)
        if i >= n:
            break
        if path[i] != ".":
            raise DocumentError("document:patch:path_invalid", path)
        i += 1
    return tuple(out)


def _literal(value, f: Field, one: bool = False) -> Column:
    t = f.spark_type().elementType if one and f.multiple and not f.locales else f.spark_type()
    if value is None:
        return F.lit(None).cast(t)
    return F.from_json(F.lit(json.dumps({"v": value})), f"struct<v: {t.simpleString()}>").getField("v")


def _changed(col: Column, f: Field, steps: tuple[Step, ...], value, fields: dict[str, Field]) -> tuple[Column, Column]:
    """The new value of a place, and whether every selector found what it names."""
    step, rest = steps[0], steps[1:]
    yes = F.lit(True)
    if step.kind == "name":
        if not rest:
            return _literal(value, f), yes
        if f.type != "object" or f.multiple:
            raise DocumentError("document:patch:path_unsupported", step.name)
        return _struct(col, f, rest, value)
    if step.kind == "word" and f.locales:
        tag = step.word
        if tag not in f.locales:
            raise DocumentError("document:patch:locale_undeclared", tag)
        others = F.map_filter(F.coalesce(col, F.create_map().cast(f.spark_type())), lambda k, _: k != tag)
        if value is None:
            return others, yes
        inner = f.spark_type().valueType
        return F.map_concat(others, F.create_map(F.lit(tag), F.from_json(F.lit(json.dumps({"v": value})), f"struct<v: {inner.simpleString()}>").getField("v"))), yes
    if not f.multiple:
        raise DocumentError("document:patch:not_a_list", step.name)
    if step.kind == "add":
        if rest:
            raise DocumentError("document:patch:path_unsupported", step.name)
        empty = F.from_json(F.lit('{"v": []}'), f"struct<v: {f.spark_type().simpleString()}>").getField("v")
        return F.concat(F.coalesce(col, empty), F.array(_literal(value, f, True))), yes
    key = step.key or f.key
    if f.type == "object":
        if not key or key not in f.fields:
            raise DocumentError("document:patch:key_required", step.name)
        test = lambda x: F.coalesce(x[key].cast("string") == step.word, F.lit(False))
    else:
        test = lambda x: F.coalesce(x.cast("string") == step.word, F.lit(False))
    found = F.coalesce(F.exists(col, test), F.lit(False))
    if rest:
        return F.transform(col, lambda x: F.when(test(x), _struct(x, f, rest, value)[0]).otherwise(x)), found
    if value is None:
        return F.filter(col, lambda x: ~test(x)), found
    return F.transform(col, lambda x: F.when(test(x), _literal(value, f, True)).otherwise(x)), found


def _struct(col: Column, f: Field, steps: tuple[Step, ...], value) -> tuple[Column, Column]:
    """A struct with one name changed; it comes to be if it wasn't there."""
    name = steps[0].name
    if name not in f.fields:
        raise DocumentError("document:field_unknown", name)
    g = f.fields[name]
    new, found = _changed(col[name], g, steps, value, f.fields)
    return F.struct(*((new if n == name else col[n]).cast(h.spark_type()).alias(n) for n, h in f.fields.items())), found


def patched(rows: DataFrame, definition: IndexDefinition, changes: dict, missing: str = "fail") -> DataFrame:
    """Every row with the changes {path: value} applied in order; null clears.

    A selector that matches nothing is an error inside the job with ``missing`` fail, and leaves the row alone with skip.
    """
    for path, value in changes.items():
        steps = parse(path)
        f = definition.fields.get(steps[0].name)
        if f is None:
            raise DocumentError("document:field_unknown", steps[0].name)
        if f.primary_key:
            raise DocumentError("document:patch:key_fixed", path)
        if f.required and value is None and len(steps) == 1 and steps[0].kind == "name":
            raise DocumentError("document:field_required", path)
        new, found = _changed(F.col(f"`{f.name}`"), f, steps, value, definition.fields)
        other = F.raise_error(F.lit(f"document:patch:no_match: {path}")).cast(f.spark_type()) if missing == "fail" else F.col(f"`{f.name}`")
        rows = rows.withColumn(f.name, F.when(found, new).otherwise(other))
    return rows


def updated(rows: DataFrame, definition: IndexDefinition, keys: list, changes: dict, missing: str = "fail") -> DataFrame:
    """Rows of the given keys changed, all others as they are. Absent keys are refused or passed over."""
    pk = definition.pk
    want = F.col(pk).isin(keys)
    if missing == "fail":
        there = rows.where(want).select(pk).distinct().count()
        if there < len(set(keys)):
            raise DocumentError("document:not_found", f"{len(set(keys)) - there} keys")
    return rows.where(~want | F.col(pk).isNull()).unionByName(patched(rows.where(want), definition, changes, missing))
