"""Pages of hits: ordering, paging, rescoring, value hits, projections, matched values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import RequestError
from ..plans.clauses import And, Nested, Request, scores, walk
from . import ranking as rk
from .compiler import Compiler, sure


def page(index, at: Compiler, r: Request, rows: DataFrame, keys: list[rk.Key], scored: bool) -> DataFrame:
    """The asked slice: keys and sort values are ranked, then the page alone meets the wide columns."""
    extra = ["_index", "_key", "_element"] if r.hits_path else []
    names = dict.fromkeys([index.pk, "_score", *extra, *(k.name for k in keys)])
    have = rows
    for k in keys:
        if k.name not in rows.columns:
            have = have.withColumn(k.name, k.column)
    ranked = have.select(*names)
    back = bool(r.before)
    order = [k.reversed() for k in keys] if back else keys
    if r.after or r.before:
        ranked = ranked.where(rk.beyond(order, rk.read_cursor(keys, r.after or r.before)))
    # one top-k: each task keeps offset + limit rows
    top = ranked.orderBy(*(k.order() for k in order)).offset(r.offset).limit(r.limit) if r.offset else ranked.orderBy(*(k.order() for k in order)).limit(r.limit)
    out = top.withColumn("_position", F.row_number().over(Window.orderBy(*(k.order() for k in keys))) + r.offset)
    return _completed(index, at, r, out, scored)


def rescored(index, at: Compiler, r: Request, rows: DataFrame, keys: list[rk.Key]) -> DataFrame:
    """The best ``window`` rows scored a second time: first + weight * (1 + boosts) * signals."""
    s = r.rescore
    have = rows
    for k in keys:
        if k.name not in rows.columns:
            have = have.withColumn(k.name, k.column)
    window = have.orderBy(*(k.order() for k in keys)).limit(s.window)
    df, boosts = window, F.lit(1.0)
    for c in s.boost:
        df, p = at.one(df, c)
        boosts = boosts + F.when(sure(p.match), p.score if p.score is not None else F.lit(1.0)).otherwise(0.0)
    second = rk.ranked(at, boosts, s.signals, index.now)
    df = df.withColumn("_first", F.col("_score")).withColumn("_score", F.col("_score") + s.weight * second)
    names = dict.fromkeys([index.pk, "_score", "_first", *(k.name for k in keys)])
    top = df.select(*names).orderBy(*(k.order() for k in keys)).offset(r.offset).limit(r.limit)
    return _completed(index, at, r, top.withColumn("_position", F.row_number().over(Window.orderBy(*(k.order() for k in keys))) + r.offset), True)


def _completed(index, at: Compiler, r: Request, top: DataFrame, scored: bool) -> DataFrame:
    """The page's rows with the fields asked for, matched values and highlights."""
    if not (r.fields or r.matched or r.highlight):
        return top
    cols = projected(at, r.fields or ()) if r.fields else []
    wide = index.frame.select(F.col(index.pk).alias("_wide"), *cols, *(c.alias(f"_matched_{p}") for p, c in matched(at, r).items()), *(F.col(n.split(".")[0]).alias(f"_src_{n}") for n in (r.highlight or {}).get("fields", {})))
    # a page has at most limit rows, so it is the side to send
    out = wide.join(F.broadcast(top.withColumnRenamed(index.pk, "_pk")), F.col("_wide") == F.col("_pk")).drop("_wide").withColumnRenamed("_pk", index.pk)
    if r.highlight:
        from .highlight import highlighted

        out = highlighted(index, r, out)
    return out


def projected(at: Compiler, names: tuple[str, ...]) -> list[Column]:
    """Named fields, one locale variant each; fields inside objects keep their nesting."""
    tree: dict = {}
    for n in names:
        node = tree
        for step in n.split("."):
            node = node.setdefault(step, {})

    def build(fields: dict, node: dict, col) -> list[Column]:
        out = []
        for name, below in node.items():
            f = fields.get(name)
            if f is None:
                raise RequestError("search:field_unknown", name, name)
            if not f.stored:
                raise RequestError("search:field_not_retrievable", name, name)
            c = F.col(f"`{name}`") if col is None else col[name]
            if (tag := at.index.definition.locale_of(f, at.locale)) is not None:
                c = F.map_filter(c, lambda k, _: k == tag)
            elif below and f.multiple:
                c = _rebuilt(c, f, below, build)
            elif below:
                c = F.when(c.isNotNull(), F.struct(*build(f.fields, below, c)))
            out.append(c.alias(name))
        return out

    return build(at.index.definition.fields, tree, None)


def _rebuilt(c: Column, f, below: dict, build) -> Column:
    return F.transform(c, lambda x: F.struct(*build(f.fields, below, x)))


def element_test(at: Compiler, clauses, path: str):
    """Whether an element satisfies the query's nested clauses on a path; all do if there are none."""
    found = [c for c in walk(clauses) if isinstance(c, Nested) and c.path == path]

    def test(x: Column) -> Column:
        inner = Compiler(at.index, at.locale, path, x)
        each = [reduce(Column.__and__, [sure(inner.predicate(k)) for k in c.clauses if inner.simple(k)], F.lit(True)) for c in found]
        return reduce(Column.__or__, each) if each else F.lit(True)

    return test


def matched(at: Compiler, r: Request) -> dict[str, Column]:
    """For each path a struct of ``values`` (index and value, in list order, cut to the limit) and ``totalValues``."""
    out = {}
    for path, spec in ((r.matched or {}).get("fields", r.matched or {})).items():
        limit = int((spec or {}).get("limit", 3))
        if not 1 <= limit <= 100:
            raise RequestError("search:matched:limit_out_of_range", str(limit), path)
        all_ = F.transform(at.list_of(path), lambda x, i: F.struct(i.alias("index"), x.alias("value")))
        test = element_test(at, tuple(r.query) + tuple(r.filters), path)
        kept = F.filter(all_, lambda p: test(p["value"]))
        out[path] = F.struct(F.slice(kept, 1, limit).alias("values"), F.size(kept).alias("totalValues"))
    return out


def expanded(index, at: Compiler, r: Request, rows: DataFrame, filters=None) -> DataFrame:
    """A row for each matched element of hits.path; with hits.when only of documents it holds for, others staying whole."""
    path = r.hits_path
    f = index.definition.place(path).field
    if f.type != "object" or not f.multiple:
        raise RequestError("search:hits:path_unsupported", path, path)
    query = tuple(r.query) + tuple(r.filters if filters is None else filters)
    test = element_test(at, query, path)
    all_ = F.transform(at.list_of(path), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    cond = None
    if r.hits_when is not None:
        if r.sort and any(not isinstance(s, rk.ScoreSort) for s in r.sort):
            raise RequestError("search:hits:when_sort_unsupported", path, path)
        rows, p = at.all(rows, r.hits_when)
        cond = sure(p.match)
    source = rows if cond is None else rows.where(cond)
    out = source.select("*", F.explode(F.filter(all_, lambda p: test(p["x"]))).alias("_x"))
    key = F.col("_x.x")[f.key].cast("string") if f.key else F.lit(None).cast("string")
    out = out.select(*rows.columns, F.col("_x.i").alias("_index"), key.alias("_key"), F.col("_x.x").alias("_element"), F.col("_x.x").alias("_elem"))
    scoring = [c for c in _top_nested(query) if c.path == path and any(map(scores, c.clauses))]
    if scoring and cond is None:
        out = _child_scores(index, at, out, scoring[0], path)
    if cond is not None:
        plain = rows.where(~cond).select("*", F.lit(None).cast("int").alias("_index"), F.lit(None).cast("string").alias("_key"), F.lit(None).cast(out.schema["_element"].dataType).alias("_element"), F.lit(None).cast(out.schema["_element"].dataType).alias("_elem"))
        out = out.unionByName(plain)
    return out


def _top_nested(clauses):
    for c in clauses:
        if isinstance(c, Nested):
            yield c
        elif isinstance(c, And):
            yield from _top_nested(c.clauses)


def _child_scores(index, at: Compiler, out: DataFrame, c: Nested, path: str) -> DataFrame:
    """Parent score plus the element's own; elements that a scored clause doesn't match go."""
    inner = Compiler(index, at.locale, path, F.col("_elem"))
    rows, p = inner.all(index.elements(path), c.clauses)
    own = rows.where(p.match).select(F.col(index.pk), F.col("_ord").alias("_index"), (p.score if p.score is not None else F.lit(0.0)).alias("_own"))
    return out.join(own, [index.pk, "_index"]).withColumn("_score", F.col("_score") + F.col("_own")).drop("_own")

