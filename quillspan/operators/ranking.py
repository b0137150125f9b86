"""Signals, sort keys and cursors."""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import RequestError
from ..functions.geometry import haversine
from ..plans.clauses import DistanceSort, FieldSort, Request, ScoreSort, Signal, Target, read_signal
from ..plans.definition import NUMBERS


def factor(shape: str, value: float, v: Column, now: Column) -> Column:
    """A signal's shape: saturation, decay by half-life in seconds, or a clamped line."""
    if shape == "saturation":
        up = F.greatest(v.cast("double"), F.lit(0.0))
        return up / (up + value)
    if shape == "linear":
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v.cast("double") / value))
    age = (F.unix_millis(now) - F.unix_millis(v.cast("timestamp"))) / 1000.0
    return F.pow(F.lit(2.0), -F.greatest(age, F.lit(0.0)) / value)


def signals_of(index, request: Request) -> list[Signal]:
    """The index's signals with the request's laid over them, or the request's alone."""
    own = [read_signal(s) for s in index.ranking.get("signals", [])]
    if request.signals is None:
        return own
    if request.signals_mode == "replace":
        return list(request.signals)
    named = {s.field for s in request.signals}
    return [s for s in own if s.field not in named] + list(request.signals)


def ranked(compiler, score: Column, signals: list[Signal] | tuple[Signal, ...], now: Column) -> Column:
    """score times the product of 1 + weight * shape; a document without a value keeps its score."""
    for s in signals:
        place = compiler.index.definition.place(s.field).need("sort")
        if place.field.type not in (NUMBERS if s.shape != "decay" else {"timestamp"}):
            raise RequestError("search:matcher:type_unsupported", f"{s.shape} on {place.field.type}", s.field)
        v, many = compiler.values(place)
        if many:
            v = F.array_max(v)
        score = score * F.coalesce(1 + s.weight * factor(s.shape, s.value, v, now), F.lit(1.0))
    return score


@dataclass(frozen=True)
class Key:
    """One sort key: a named column, its direction, and where nulls go."""

    name: str
    column: Column
    descending: bool
    nulls_first: bool

    def order(self) -> Column:
        c = F.col(self.name)
        if self.descending:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()

    def after(self, value) -> Column:
        """Rows that come after a value; null compares by its place."""
        c = F.col(self.name)
        if value is None:
            return c.isNotNull() if self.nulls_first else F.lit(False)
        past = c < F.lit(value) if self.descending else c > F.lit(value)
        return past if self.nulls_first else past | c.isNull()

    def same(self, value) -> Column:
        return F.col(self.name).isNull() if value is None else F.col(self.name) == F.lit(value)

    def reversed(self) -> "Key":
        return Key(self.name, self.column, not self.descending, not self.nulls_first)


def collation(f, locale: str | None) -> str | None:
    """String sorts use the locale's collation where one is named; binary order otherwise."""
    spec = f.sort or {}
    tag = spec.get("locale") or locale
    if f.type != "string" or spec.get("collation") == "binary" or not tag:
        return None
    return tag.split("-")[0]


def sort_keys(compiler, request: Request, value_path: str | None = None) -> list[Key]:
    """The request's sorts, or the score, then the tie breakers, then the primary key."""
    index, keys = compiler.index, []
    for i, s in enumerate(request.sort or (ScoreSort(),)):
        name = f"_sort{i}"
        if isinstance(s, ScoreSort):
            keys.append(Key("_score", F.col("_score"), s.descending, False))
            continue
        place = index.definition.place(s.field)
        if isinstance(s, DistanceSort):
            if place.nested:
                raise RequestError("search:sort:nested_unsupported", s.field, s.field)
            p, _ = compiler.values(place.need("sort"))
            keys.append(Key(name, haversine(p["lat"], p["lon"], s.lat, s.lon), False, False))
            continue
        keys.append(field_key(compiler, request, s, name, value_path))
    sorted_already = {s.field for s in request.sort if isinstance(s, FieldSort) and not s.chained}
    for j, t in enumerate(index.ranking.get("tieBreakers", [])):
        if t["field"] not in sorted_already:
            keys.append(field_key(compiler, request, FieldSort(t["field"], t.get("direction", "descending") == "descending"), f"_tie{j}", None))
    return keys


def field_key(compiler, request: Request, s: FieldSort, name: str, value_path: str | None) -> Key:
    place = compiler.index.definition.place(s.field).need("sort")
    f = place.field
    if f.type in {"geo_point", "vector"}:
        raise RequestError("search:sort:type_unsupported", f"{s.field} is a {f.type}", s.field)
    pick = F.array_max if s.descending else F.array_min
    if s.chained:
        if value_path:
            raise RequestError("search:hits:sort_fallback_unsupported", s.field, s.field)
        if f.type not in NUMBERS | {"timestamp"}:
            raise RequestError("search:sort:type_unsupported", s.field, s.field)
        chain = (Target(s.field, s.when), *s.fallback)
        for t in chain:
            if compiler.index.definition.place(t.field).need("sort").field.type != f.type:
                raise RequestError("search:sort:fallback_type_mismatch", t.field, t.field)
        col = pick(compiler.chain_values(chain))
    elif place.nested and place.nested == value_path:
        col = type(compiler)(compiler.index, compiler.locale, value_path, F.col("_elem")).values(place)[0]
    elif place.nested:
        inner = compiler.narrowed_list(request.query, place.nested)
        col = pick(F.transform(inner, lambda x: type(compiler)(compiler.index, compiler.locale, place.nested, x).values(place)[0]))
    else:
        col, many = compiler.values(place)
        col = pick(col) if many else col
    if tag := collation(f, request.locale):
        col = F.collate(col, tag)
    # declared for ascending order; the other direction turns the list, and the missing with it
    first = (f.sort or {}).get("missing", "last") == "first"
    return Key(name, col, s.descending, first != s.descending)


def fingerprint(keys: list[Key]) -> str:
    said = json.dumps([[k.name, k.descending, k.nulls_first, str(k.column._jc.toString()) if hasattr(k.column, "_jc") else str(k.column)] for k in keys])
    return hashlib.sha256(said.encode()).hexdigest()[:12]


def cursor(keys: list[Key], values: list) -> str:
    return base64.urlsafe_b64encode(json.dumps([fingerprint(keys), values], default=str).encode()).decode()


def read_cursor(keys: list[Key], text: str) -> list:
    try:
        print_, values = json.loads(base64.urlsafe_b64decode(text.encode()))
    except ValueError as e:
        raise RequestError("search:cursor:invalid", "can't be read") from e
    if print_ != fingerprint(keys):
        raise RequestError("search:cursor:sort_mismatch", "the cursor is of another sort")
    return values


def beyond(keys: list[Key], values: list) -> Column:
    """Rows after a position, key by key."""
    out, same = [], F.lit(True)
    for k, v in zip(keys, values, strict=True):
        out.append(same & k.after(v))
        same = same & k.same(v)
    return reduce(Column.__or__, out)
