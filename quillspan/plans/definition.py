"""Index definitions: declared, typed fields with opt-in usages, validated up front and turned into a Spark schema."""

from __future__ import annotations

import fnmatch
import json
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from ..errors import DefinitionError, RequestError

TYPES = {"string", "boolean", "int32", "int64", "float", "double", "timestamp", "geo_point", "vector", "object"}
NUMBERS = {"int32", "int64", "float", "double"}
SPARK = {"string": T.StringType(), "boolean": T.BooleanType(), "int32": T.IntegerType(), "int64": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "timestamp": T.TimestampType(), "geo_point": T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]), "vector": T.ArrayType(T.FloatType())}
#: what a role stands for, before the field's own settings
ROLES = {
    "id": {"type": "string", "primaryKey": True, "required": True},
    "title": {"type": "string", "matching": {"weight": 3.0, "highlight": {}, "typoTolerance": {}}, "sort": {}},
    "description": {"type": "string", "matching": {"weight": 1.0, "highlight": {}}},
    "tag": {"type": "string", "multiple": True, "filter": {}, "facet": {}},
    "path": {"type": "string", "filter": {}, "facet": {}, "hierarchy": {}},
    "code": {"type": "string", "filter": {}, "sort": {}},
    "timestamp": {"type": "timestamp", "filter": {}, "sort": {}},
    "geo": {"type": "geo_point", "filter": {}, "sort": {}},
}
MAX_DEPTH, MAX_DIMENSIONS = 20, 4096
#: tags that stand for a broader one
BROADER = {"nb": "no", "nn": "no", "yue": "zh", "arb": "ar", "ekk": "et", "zsm": "ms"}


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    primary_key: bool = False
    required: bool = False
    multiple: bool = False
    stored: bool = True
    locales: tuple[str, ...] = ()
    default_locale: str | None = None
    filter: dict | None = None
    sort: dict | None = None
    facet: dict | None = None
    matching: dict | None = None
    autocomplete: dict | None = None
    hierarchy: dict | None = None
    signal: dict | None = None
    unit: str | None = None
    minimum: float | None = None
    maximum: float | None = None
    mode: str = "flattened"
    key: str | None = None
    fields: dict[str, "Field"] = field(default_factory=dict)
    dimensions: int = 0
    similarity: str = "cosine"

    @property
    def nested(self) -> bool:
        return self.type == "object" and self.multiple and self.mode == "nested"

    @property
    def textual(self) -> bool:
        return self.type == "string" and (self.matching is not None or self.autocomplete is not None)

    @property
    def weight(self) -> float:
        return float((self.matching or self.autocomplete or {}).get("weight", 1.0))

    @property
    def text_usage(self) -> dict:
        return self.matching if self.matching is not None else self.autocomplete or {}

    def spark_type(self) -> T.DataType:
        base = T.StructType([T.StructField(f.name, f.spark_type()) for f in self.fields.values()]) if self.type == "object" else SPARK[self.type]
        if self.locales:
            base = T.ArrayType(base) if self.multiple else base
            return T.MapType(T.StringType(), base)
        if "*" in self.name:
            return T.MapType(T.StringType(), T.ArrayType(base) if self.multiple else base)
        return T.ArrayType(base) if self.multiple else base


def _refuse(code: str, name: str, why: str = "") -> None:
    raise DefinitionError(f"index:field:{code}", why or f"field {name}", name)


def _field(name: str, spec: dict, depth: int = 0, inside: bool = False) -> Field:
    if depth > MAX_DEPTH:
        _refuse("object:too_deep", name)
    spec = {**ROLES[spec["role"]], **{k: v for k, v in spec.items() if k != "role"}} if spec.get("role") else dict(spec)
    kind = spec.get("type")
    if kind not in TYPES:
        _refuse("type_unknown", name, f"field {name} has the unknown type {kind!r}")
    get = spec.get
    out = Field(
        name, kind, bool(get("primaryKey")), bool(get("required")), bool(get("multiple")), get("stored", True) is not False, tuple(get("locales", ())), get("defaultLocale"),
        get("filter"), get("sort"), get("facet"), get("matching"), get("autocomplete"), get("hierarchy"), get("signal"), get("unit"),
        (get("validation") or {}).get("min"), (get("validation") or {}).get("max"), get("mode", "flattened"), get("key"),
        {k: _field(k, v, depth + 1, True) for k, v in get("fields", {}).items()}, int(get("dimensions", 0)), get("similarity", "cosine"),
    )
    if out.primary_key and (kind not in {"string", "int32", "int64"} or out.multiple or out.locales or inside):
        _refuse("primary_key_unsupported", name)
    if kind != "string" and (out.matching is not None or out.autocomplete is not None or out.hierarchy is not None or out.locales):
        _refuse("usage_unsupported", name, f"{name} is no string field")
    if out.signal is not None:
        if kind not in NUMBERS:
            _refuse("signal:type_unsupported", name)
        if any(x is not None for x in (out.filter, out.facet)) or get("stored") or out.locales or out.primary_key:
            _refuse("signal:usage_conflicting", name)
        if "*" in name:
            _refuse("signal:wildcard_unsupported", name)
        if out.multiple:
            _refuse("sort:multiple_unsupported", name)
        if inside:
            _refuse("object:inner_usage_unsupported", name)
    if out.sort is not None and kind == "vector":
        _refuse("sort:type_unsupported", name)
    if out.unit is not None and kind not in NUMBERS:
        _refuse("unit:type_unsupported", name)
    if kind == "vector":
        if not 1 <= out.dimensions <= MAX_DIMENSIONS:
            _refuse("vector:dimensions_out_of_range", name)
        if out.similarity not in {"cosine", "dot_product", "euclidean"}:
            _refuse("vector:similarity_unknown", name)
    if kind == "object":
        if not out.fields:
            _refuse("object:fields_required", name)
        if out.mode not in {"flattened", "nested"}:
            _refuse("object:mode_unknown", name)
        if out.nested and any(f.nested for f in _walk(out)):
            _refuse("object:nested_in_nested", name)
        if out.key is not None and out.key not in out.fields:
            _refuse("object:key_unknown", name)
    if out.filter is not None and out.type == "object":
        _refuse("usage_unsupported", name)
    return out


def _walk(f: Field):
    for x in f.fields.values():
        yield x
        yield from _walk(x)


@dataclass(frozen=True)
class Place:
    """A resolved name: its field, the nested list it stands in, and the steps from there."""

    name: str
    field: Field
    nested: str | None
    steps: tuple[str, ...]
    wildcard: str | None = None

    def need(self, usage: str) -> "Place":
        f = self.field
        has = {"filter": f.filter is not None, "sort": f.sort is not None or f.signal is not None, "facet": f.facet is not None, "hierarchy": f.hierarchy is not None, "text": f.textual}[usage]
        if not has:
            raise RequestError("search:usage_unsupported", f"{self.name} isn't declared for {usage}", self.name)
        return self


@dataclass(frozen=True)
class IndexDefinition:
    fields: dict[str, Field]
    ranking: dict = field(default_factory=dict)
    fallback_locales: dict[str, str] = field(default_factory=dict)
    synonyms: dict[str, list] = field(default_factory=dict)

    @classmethod
    def of(cls, spec: dict | str) -> "IndexDefinition":
        spec = json.loads(spec) if isinstance(spec, str) else spec
        fields = {n: _field(n, f) for n, f in spec.get("fields", {}).items()}
        if sum(f.primary_key for f in fields.values()) > 1:
            raise DefinitionError("index:primary_key_multiple", "more than one primary key")
        out = cls(fields, spec.get("ranking", {}), spec.get("localeFallback", {}), spec.get("synonyms", {}))
        for t in out.ranking.get("tieBreakers", []):
            out.place(t["field"]).need("sort")
        for s in out.ranking.get("signals", []):
            out.place(s["field"]).need("sort")
        return out

    @property
    def pk(self) -> str:
        for n, f in self.fields.items():
            if f.primary_key:
                return n
        raise RequestError("index:primary_key_required", "the index declares no primary key")

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, f.spark_type(), metadata={"type": f.type}) for n, f in self.fields.items()])

    def _named(self, fields: dict[str, Field], name: str) -> tuple[Field, str | None] | None:
        """An exact name first, then the pattern with the longest literal start, then the shorter pattern."""
        if name in fields:
            return fields[name], None
        found = sorted((p for p in fields if "*" in p and fnmatch.fnmatchcase(name, p) and "." not in name), key=lambda p: (-p.index("*"), len(p)))
        return (fields[found[0]], name) if found else None

    def place(self, name: str) -> Place:
        fields, nested, steps, rest = self.fields, None, [], name.split(".")
        if got := self._named(fields, name):
            return Place(name, got[0], None, (got[0].name,), got[1])
        while rest:
            got = self._named(fields, rest[0])
            if not got:
                break
            f, wild = got
            steps.append(f.name)
            if len(rest) == 1:
                return Place(name, f, nested, tuple(steps), wild)
            if f.type != "object":
                break
            if f.nested:
                nested, steps = ".".join([*steps]), []
            fields, rest = f.fields, rest[1:]
        raise RequestError("search:field_unknown", f"no field {name}", name)

    def names(self, inside: str | None = None):
        """All dotted names; those of one nested list if ``inside`` is given, else those outside all of them."""

        def walk(fields: dict[str, Field], at: str, nested: str | None):
            for f in fields.values():
                name = f"{at}{f.name}"
                if f.type == "object":
                    yield from walk(f.fields, f"{name}.", name if f.nested else nested)
                elif "*" not in name and nested == inside:
                    yield name

        return list(walk(self.fields, "", None))

    def locale_of(self, f: Field, asked: str | None) -> str | None:
        """The declared variant nearest to the tag: subtags go one by one, then broader tags are tried."""
        if not f.locales:
            return None
        tag = asked
        while tag:
            if tag in f.locales:
                return tag
            broader = BROADER.get(tag)
            if broader in f.locales:
                return broader
            tag = tag.rpartition("-")[0]
        return f.default_locale if f.default_locale in f.locales else "en" if "en" in f.locales else f.locales[0]

    def changes_needing_generation(self, new: "IndexDefinition") -> list[str]:
        """Names whose change can't be served from what is already indexed."""
        out = []
        for n, f in self.fields.items():
            g = new.fields.get(n)
            if g is None:
                continue
            kept = ("type", "multiple", "locales", "mode", "key", "dimensions", "similarity", "primary_key")
            if any(getattr(f, k) != getattr(g, k) for k in kept) or (f.signal is None) != (g.signal is None):
                out.append(n)
            elif any(getattr(f, u) is None and getattr(g, u) is not None for u in ("filter", "sort", "facet", "matching", "autocomplete", "hierarchy")):
                out.append(n)
            elif f.fields != g.fields:
                out.append(n)
        return out + [n for n, g in new.fields.items() if n not in self.fields and g.required]


def with_signals(f: Field, **kw) -> Field:
    return replace(f, **kw)
