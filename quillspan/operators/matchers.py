"""Field matchers as predicates. NULL is no match; ``not`` and conditional scores put that right where it matters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import RequestError
from ..functions.geometry import within
from ..plans.clauses import Any, Distance, Equals, In, Prefix, Range, Ranges, Under
from ..plans.definition import NUMBERS, Field



def no() -> Column:
    return F.lit(False)


SEPARATOR = "/"


def levels(path: Column) -> Column:
    """Folded ancestor paths of a tree value, itself included: a/b/c -> [a, a/b, a/b/c]."""
    steps = F.split(F.lower(path), SEPARATOR)
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), SEPARATOR))


def literal(f: Field, value: object) -> Column:
    """A request's value in the type of the field."""
    if f.type == "timestamp":
        # bounds have milliseconds, as stored values do
        return F.expr(f"timestamp_millis(unix_millis(timestamp'{value}'))")
    if f.type == "boolean":
        if not isinstance(value, bool):
            raise RequestError("search:matcher:value_invalid", f"{value!r} is no boolean", f.name)
        return F.lit(value)
    if f.type in NUMBERS:
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise RequestError("search:matcher:value_invalid", f"{value!r} is no number", f.name)
        return F.lit(value)
    return F.lit(str(value).lower() if folds(f) else str(value))


def folds(f: Field) -> bool:
    return f.type == "string" and not (f.filter or {}).get("caseSensitive")


def one(f: Field, v: Column, m) -> Column:
    """The predicate on a single value, which is folded already."""
    if isinstance(m, Any):
        return v.isNotNull()
    if f.type == "geo_point":
        if isinstance(m, Distance):
            return within(v, m.lat, m.lon, m.radius)
    elif isinstance(m, Equals):
        return v == literal(f, m.value)
    elif isinstance(m, In):
        return v.isin([literal(f, x) for x in m.values]) if m.values else no()
    elif isinstance(m, Prefix) and f.type == "string":
        return v.startswith(literal(f, m.value))
    elif isinstance(m, Under) and f.hierarchy is not None:
        path = m.path.lower().strip(SEPARATOR)
        return (v == path) | v.startswith(path + SEPARATOR)
    elif isinstance(m, Range) and f.type != "boolean":
        bounds = [op(v, literal(f, x)) for x, op in ((m.gt, Column.__gt__), (m.gte, Column.__ge__), (m.lt, Column.__lt__), (m.lte, Column.__le__)) if x is not None]
        return reduce(Column.__and__, bounds)
    elif isinstance(m, Ranges) and f.type != "boolean":
        return reduce(Column.__or__, [one(f, v, r) for r in m.values]) if m.values else no()
    raise RequestError("search:matcher:type_unsupported", f"{type(m).__name__} can't read {f.type}", f.name)


def matches(f: Field, values: Column, multiple: bool, m, shadow: Column | None = None) -> Column:
    """The predicate on a field's value or list of values. ``shadow`` is the folded column, where one is stored."""
    if isinstance(m, (In, Ranges)) and not m.values:
        return no()
    fold = (lambda x: F.lower(x)) if folds(f) and not isinstance(m, Any) else lambda x: x
    if not multiple:
        return one(f, shadow if shadow is not None and folds(f) else fold(values), m)
    if isinstance(m, Any):
        return F.coalesce(F.exists(values, lambda x: x.isNotNull()), no())
    return F.coalesce(F.exists(values, lambda x: F.coalesce(one(f, fold(x), m), no())), no())
