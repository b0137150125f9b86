"""The query model: clauses and matchers as a closed family of records, read from JSON with limits checked on the way."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from ..errors import RequestError


@dataclass(frozen=True)
class Limits:
    clauses: int = 1024
    depth: int = 20
    limit: int = 1000
    page_depth: int = 10_000
    window: int = 1000
    k: int = 1000
    fuse_depth: int = 1000
    facet_values: int = 1000
    suggest: int = 100


@dataclass(frozen=True)
class Equals:
    value: object


@dataclass(frozen=True)
class In:
    values: tuple


@dataclass(frozen=True)
class Any:
    pass


@dataclass(frozen=True)
class Prefix:
    value: str


@dataclass(frozen=True)
class Under:
    path: str


@dataclass(frozen=True)
class Range:
    gt: object = None
    gte: object = None
    lt: object = None
    lte: object = None


@dataclass(frozen=True)
class Ranges:
    values: tuple[Range, ...]


@dataclass(frozen=True)
class Distance:
    lat: float
    lon: float
    radius: float


@dataclass(frozen=True)
class Words:
    """What is typed and how it is read: the body of text clauses and text matchers."""

    text: str
    match: str = "all"
    join: str = "all"
    prefix: str = "last_token"
    typos: str = "auto"
    slop: int = 0
    relax: str = "unmatched"
    interpret: object = "auto"
    combine: str = "term"


@dataclass(frozen=True)
class FieldClause:
    field: str
    match: object


@dataclass(frozen=True)
class Text:
    words: Words
    fields: tuple[tuple[str, float | None], ...] | None = None


@dataclass(frozen=True)
class Knn:
    field: str
    vector: tuple[float, ...]
    k: int
    filter: tuple = ()


@dataclass(frozen=True)
class Ranking:
    clauses: tuple
    weight: float = 1.0


@dataclass(frozen=True)
class Fuse:
    rankings: tuple[Ranking, ...]
    depth: int = 100
    constant: float = 60.0
    filter: tuple = ()


@dataclass(frozen=True)
class Nested:
    path: str
    clauses: tuple
    score: str = "max"


@dataclass(frozen=True)
class And:
    clauses: tuple


@dataclass(frozen=True)
class Or:
    clauses: tuple


@dataclass(frozen=True)
class Not:
    clauses: tuple


@dataclass(frozen=True)
class Boost:
    clauses: tuple
    weight: float


def scores(c) -> bool:
    """Whether a clause adds to the score of what it matches."""
    if isinstance(c, (And, Or, Nested)):
        return any(map(scores, c.clauses))
    if isinstance(c, FieldClause):
        return isinstance(c.match, Words)
    return isinstance(c, (Text, Knn, Fuse, Boost))


def _number(x: object, code: str, low: float = -math.inf, strict: bool = False) -> float:
    if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) or x < low or (strict and x == low):
        raise RequestError(code, f"{x!r} is out of range")
    return float(x)


def read_range(m: dict) -> Range:
    got = {k: m[k] for k in ("gt", "gte", "lt", "lte") if m.get(k) is not None}
    if not got:
        raise RequestError("search:matcher:range_empty", "a range needs a bound")
    return Range(**got)


def read_words(m: dict, limits: Limits) -> Words:
    get = m.get
    w = Words(get("text") or "", get("match", "all"), get("join", "all"), get("prefix", "last_token"), get("typos", "auto"), int(get("slop", 0)), get("relax", "unmatched"), get("interpret", "auto"), get("combine", "term"))
    for name, got, known in (("match", w.match, {"all", "any", "phrase", "user"}), ("join", w.join, {"all", "any"}), ("prefix", w.prefix, {"last_token", "off"}), ("typos", w.typos, {"auto", "off"}), ("relax", w.relax, {"unmatched", "words", "off"}), ("combine", w.combine, {"term", "field"})):
        if got not in known:
            raise RequestError(f"search:clause:{name}_unknown", f"{got!r}")
    if w.slop and w.match in {"all", "any"}:
        raise RequestError("search:clause:slop_unsupported", "slop goes with phrases")
    if "join" in m and w.match != "user":
        raise RequestError("search:clause:join_unsupported", "join goes with user syntax")
    if isinstance(w.interpret, dict) and not w.interpret.get("fields"):
        raise RequestError("search:clause:interpret_fields_required", "no target")
    return w


def read_matcher(m: dict, limits: Limits = Limits()):
    kind = m.get("type", "equals")
    if kind == "equals":
        if m.get("value") is None:
            raise RequestError("search:matcher:value_required", "equals needs a value")
        return Equals(m["value"])
    if kind == "in":
        return In(tuple(m.get("values", ())))
    if kind == "any":
        return Any()
    if kind == "prefix":
        return Prefix(m["value"])
    if kind == "under":
        return Under(m["path"])
    if kind == "range":
        return read_range(m)
    if kind == "ranges":
        return Ranges(tuple(map(read_range, m.get("values", ()))))
    if kind == "distance":
        lat, lon = _number(m.get("lat"), "search:matcher:origin_invalid", -90), _number(m.get("lon"), "search:matcher:origin_invalid", -180)
        if lat > 90 or lon > 180:
            raise RequestError("search:matcher:origin_invalid", "the origin isn't on earth")
        return Distance(lat, lon, _number(m.get("radius"), "search:matcher:radius_invalid", 0, True))
    if kind == "text":
        return read_words(m, limits)
    raise RequestError("search:matcher:type_unknown", repr(kind))


class Reader:
    """Counts clauses and depth over one request."""

    def __init__(self, limits: Limits = Limits()):
        self.limits, self.seen = limits, 0

    def all(self, clauses, depth: int = 1) -> tuple:
        return tuple(self.one(c, depth) for c in clauses or ())

    def one(self, c: dict, depth: int = 1):
        self.seen += 1
        if self.seen > self.limits.clauses:
            raise RequestError("search:clauses_too_many", f"more than {self.limits.clauses} clauses")
        if depth > self.limits.depth:
            raise RequestError("search:clauses_too_deep", f"more than {self.limits.depth} levels")
        kind = c.get("type", "field")
        below = lambda k="clauses": self.all(c.get(k), depth + 1)
        if kind == "field":
            if "field" not in c or "match" not in c:
                raise RequestError("search:clause:field_required", "a field clause needs field and match")
            return FieldClause(c["field"], read_matcher(c["match"], self.limits))
        if kind == "text":
            fields = c.get("fields")
            for w in (fields or {}).values():
                if w is not None:
                    _number(w, "search:clause:weight_out_of_range", 0)
            return Text(read_words(c, self.limits), tuple(fields.items()) if fields else None)
        if kind == "knn":
            vector = tuple(_number(x, "search:clause:vector_invalid") for x in c.get("vector", ()))
            if not 1 <= c.get("k", 0) <= self.limits.k:
                raise RequestError("search:clause:k_out_of_range", str(c.get("k")))
            return Knn(c["field"], vector, int(c["k"]), below("filter"))
        if kind == "fuse":
            rankings = tuple(Ranking(self.all(r.get("clauses"), depth + 1), _number(r.get("weight", 1), "search:clause:weight_out_of_range", 0)) for r in c.get("rankings", ()))
            if len(rankings) < 2:
                raise RequestError("search:clause:rankings_too_few", "fuse needs two rankings")
            if not all(r.clauses for r in rankings):
                raise RequestError("search:clause:ranking_empty", "a ranking has no clause")
            d = c.get("depth", 100)
            if not 1 <= d <= self.limits.fuse_depth:
                raise RequestError("search:clause:depth_out_of_range", str(d))
            return Fuse(rankings, int(d), _number(c.get("rankConstant", 60), "search:clause:rank_constant_out_of_range", 0, True), below("filter"))
        if kind == "nested":
            if c.get("score", "max") not in {"max", "min", "avg", "total"}:
                raise RequestError("search:clause:score_unknown", str(c.get("score")))
            inner = below()
            if any(isinstance(x, (Nested, Fuse)) for x in walk(inner)):
                raise RequestError("search:nested:clause_unsupported", "nested and fuse can't stand inside nested")
            return Nested(c["path"], inner, c.get("score", "max"))
        if kind in {"and", "or", "not"}:
            return {"and": And, "or": Or, "not": Not}[kind](below())
        if kind == "boost":
            return Boost(below(), _number(c.get("weight"), "search:clause:weight_out_of_range", 0))
        raise RequestError("search:clause:type_unknown", repr(kind))


def walk(clauses):
    for c in clauses:
        yield c
        if isinstance(c, (And, Or, Not, Boost, Nested)):
            yield from walk(c.clauses)
        elif isinstance(c, Fuse):
            for r in c.rankings:
                yield from walk(r.clauses)


def reach(clauses, any_of: bool = False) -> str:
    """all, none or some: what a clause list matches by its structure alone. Guards deletes against matching everything."""

    def one(c) -> str:
        if isinstance(c, And):
            return reach(c.clauses)
        if isinstance(c, Or):
            return reach(c.clauses, True)
        if isinstance(c, Not):
            got = reach(c.clauses, True) if c.clauses else "none"
            return {"all": "none", "none": "all"}.get(got, "some")
        if isinstance(c, Boost):
            return "all"
        if isinstance(c, FieldClause) and isinstance(c.match, (In, Ranges)) and not c.match.values:
            return "none"
        return "some"

    got = [one(c) for c in clauses]
    if any_of:
        return "all" if "all" in got else "none" if all(g == "none" for g in got) else "some"
    return "none" if "none" in got else "all" if all(g == "all" for g in got) else "some"


@dataclass(frozen=True)
class FieldSort:
    field: str
    descending: bool = False
    when: tuple = ()
    fallback: tuple = ()
    chained: bool = False


@dataclass(frozen=True)
class Target:
    """A field with its condition; a chain is a list of them."""

    field: str
    when: tuple = ()


@dataclass(frozen=True)
class ScoreSort:
    descending: bool = True


@dataclass(frozen=True)
class DistanceSort:
    field: str
    lat: float
    lon: float


@dataclass(frozen=True)
class Signal:
    field: str
    shape: str
    value: float
    weight: float = 1.0


@dataclass(frozen=True)
class Facet:
    name: str
    field: str
    limit: int = 10
    order: str = "count"
    ranges: tuple = ()
    path: str | None = None
    depth: int = 1
    exclude: tuple[str, ...] | None = None
    chain: tuple[Target, ...] = ()
    prefix: str | None = None


@dataclass(frozen=True)
class Rescore:
    window: int
    boost: tuple = ()
    signals: tuple[Signal, ...] = ()
    weight: float = 1.0


@dataclass(frozen=True)
class Request:
    query: tuple = ()
    filters: tuple = ()
    facets: tuple[Facet, ...] = ()
    sort: tuple = ()
    signals: tuple[Signal, ...] | None = None
    signals_mode: str = "add"
    rescore: Rescore | None = None
    locale: str | None = None
    fields: tuple[str, ...] | None = None
    highlight: dict | None = None
    matched: dict | None = None
    hits_path: str | None = None
    hits_when: tuple | None = None
    limit: int = 10
    offset: int = 0
    after: str | None = None
    before: str | None = None
    pages: int | None = None
    extra: dict = field(default_factory=dict)


def read_chain(t: dict, r: Reader, depth: int = 1) -> tuple[Target, ...]:
    """A target and its fallbacks, depth first: the order in which they are read."""
    out = [Target(t["field"], r.all(t.get("when"), depth + 1))]
    for f in t.get("fallback", ()):
        out += read_chain(f, r, depth + 1)
    return tuple(out)


def read_signal(s: dict) -> Signal:
    shapes = [k for k in ("saturation", "decay", "linear") if k in s]
    if len(shapes) != 1:
        raise RequestError("search:signal:shape_required", "a signal names exactly one shape")
    key = {"saturation": "pivot", "decay": "halfLife", "linear": "ceiling"}[shapes[0]]
    return Signal(s["field"], shapes[0], _number(s[shapes[0]].get(key), f"search:signal:{key}_out_of_range", 0, True), _number(s.get("weight", 1), "search:signal:weight_out_of_range", 0))


def read_sort(s: dict, r: Reader):
    kind = s.get("type", "field")
    if kind == "score":
        return ScoreSort(s.get("order", "desc") == "desc")
    if kind == "distance":
        if "order" in s:
            raise RequestError("search:sort:order_unsupported", "a distance sort has no order")
        return DistanceSort(s["field"], float(s["lat"]), float(s["lon"]))
    chain = read_chain(s, r)
    return FieldSort(s["field"], s.get("order", "asc") == "desc", chain[0].when, chain[1:], "when" in s or "fallback" in s)


def read_facet(f: dict, r: Reader) -> Facet:
    limits = r.limits
    ranges = f.get("ranges")
    if ranges is not None:
        if "limit" in f or "order" in f or "path" in f or "depth" in f:
            raise RequestError("search:facet:ranges_conflicting", "ranges go without limit, order, path and depth")
        if len(ranges) > 1000:
            raise RequestError("search:facet:ranges_too_many", str(len(ranges)))
        for x in ranges:
            if x.get("from") is None and x.get("to") is None:
                raise RequestError("search:facet:range_empty", "a bucket needs an end")
            if x.get("from") is not None and x.get("to") is not None and not x["from"] < x["to"]:
                raise RequestError("search:facet:range_invalid", "to isn't above from")
    elif "when" in f or "fallback" in f:
        raise RequestError("search:facet:fallback_unsupported", "when and fallback go with ranges")
    limit, depth = f.get("limit", 10), f.get("depth", 1)
    if not 1 <= limit <= limits.facet_values:
        raise RequestError("search:facet:limit_out_of_range", str(limit))
    if not 1 <= depth <= 10:
        raise RequestError("search:facet:depth_out_of_range", str(depth))
    if f.get("order", "count") not in {"count", "value", "declared"}:
        raise RequestError("search:facet:order_unknown", str(f["order"]))
    ex = f.get("excludeFilters")
    return Facet(f.get("name", f["field"]), f["field"], limit, f.get("order", "count"), tuple((x.get("from"), x.get("to")) for x in ranges or ()), f.get("path"), depth, None if ex is None else tuple(ex), read_chain(f, r) if "when" in f or "fallback" in f else ())


def read_request(q: dict, limits: Limits = Limits()) -> Request:
    r = Reader(limits)
    query, filters = r.all(q.get("query")), r.all(q.get("filters"))
    for c in filters:
        if not isinstance(c, (FieldClause, Nested)):
            raise RequestError("search:filter:clause_unsupported", type(c).__name__)
        if scores(c):
            raise RequestError("search:filter:scoring_unsupported", "filters don't score")
    facets = tuple(read_facet(f, r) for f in q.get("facets", ()))
    if len({f.name for f in facets}) < len(facets):
        raise RequestError("search:facet:name_duplicate", "two facets of one name")
    limit, offset = q.get("limit", 10), q.get("offset", 0)
    if not 0 <= limit <= limits.limit:
        raise RequestError("search:limit_out_of_range", str(limit))
    if offset < 0 or offset + limit > limits.page_depth:
        raise RequestError("search:paging_too_deep", str(offset + limit))
    if sum(1 for k in ("offset", "after", "before") if q.get(k)) > 1:
        raise RequestError("search:paging_conflicting", "one of offset, after and before")
    if "signalsMode" in q and "signals" not in q:
        raise RequestError("search:signal:mode_without_signals", "")
    rescore = None
    if s := q.get("rescore"):
        if "window" not in s:
            raise RequestError("search:rescore:window_required", "")
        if not 1 <= s["window"] <= limits.window:
            raise RequestError("search:rescore:window_out_of_range", str(s["window"]))
        if not s.get("boost") and not s.get("signals"):
            raise RequestError("search:rescore:empty", "")
        if q.get("hits"):
            raise RequestError("search:rescore:hits_unsupported", "")
        if offset + limit > s["window"]:
            raise RequestError("search:rescore:window_too_small", "")
        rescore = Rescore(s["window"], r.all(s.get("boost")), tuple(map(read_signal, s.get("signals", ()))), _number(s.get("weight", 1), "search:rescore:weight_out_of_range", 0))
    hits = q.get("hits") or {}
    if hits and any(isinstance(c, Knn) for f in walk(query) if isinstance(f, Fuse) for x in f.rankings for c in walk(x.clauses)):
        raise RequestError("search:hits:knn_unsupported", "")
    pages = q.get("pages")
    return Request(query, filters, facets, tuple(read_sort(s, r) for s in q.get("sort", ())), tuple(map(read_signal, q["signals"])) if "signals" in q else None, q.get("signalsMode", "add"), rescore, q.get("locale"), tuple(q["fields"]) if q.get("fields") else None, q.get("highlight"), q.get("matched"), hits.get("path"), r.all(hits["when"]) if "when" in hits else None, limit, offset, q.get("after"), q.get("before"), None if pages is None else pages.get("max", 9))
