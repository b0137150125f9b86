"""Clauses to DataFrames: for each clause a match and a score over the documents, or over the elements of one list.

Field clauses are plain predicates, so Catalyst pushes, prunes and folds them. Text, vector and fused clauses become a
frame of (key, score) that is joined to the documents once.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import RequestError
from ..functions.geometry import similarity
from ..plans.clauses import And, Boost, FieldClause, Fuse, Knn, Nested, Not, Or, Text, Words, scores
from ..plans.definition import Place
from .matchers import matches, no
from .text import text_hits



def yes() -> Column:
    return F.lit(True)


@dataclass
class Part:
    """What one clause says: whether it holds, and what it adds (None if it never scores)."""

    match: Column
    score: Column | None = None


def sure(c: Column) -> Column:
    return F.coalesce(c, no())


class Compiler:
    def __init__(self, index, locale: str | None = None, path: str | None = None, element: Column | None = None):
        self.index, self.locale, self.path, self.element = index, locale, path, element
        self.keys = [index.pk] + (["_ord"] if path else [])

    # values -----------------------------------------------------------------------------------------------------------

    def values(self, place: Place) -> tuple[Column, bool]:
        """The column of a place and whether it is a list. Inside flattened lists all objects' values count."""
        if place.nested and place.nested != self.path:
            raise RequestError("search:nested:field_outside", f"{place.name} stands inside {place.nested}", place.name)
        if self.path and place.nested != self.path:
            raise RequestError("search:nested:field_not_inside", f"{place.name} doesn't stand inside {self.path}", place.name)
        fields = self.index.definition.fields
        if place.nested:
            for step in place.nested.split("."):
                fields = fields[step].fields
        col, many = None, False
        for step in place.steps:
            f = fields[step]
            base = self.element if col is None and place.nested else None
            if col is None:
                col = base[step] if base is not None else F.col(f"`{step}`")
            elif many:
                col = _inside(col, step)
            else:
                col = col[step]
            if place.wildcard and f is place.field:
                col = col[place.wildcard]
            if (tag := self.index.definition.locale_of(f, self.locale)) is not None:
                col = col[tag]
            if f.multiple:
                col = F.flatten(col) if many else col
                many = True
            fields = f.fields
        return col, many

    def all_values(self, place: Place) -> Column:
        """Always a list, without nulls."""
        col, many = self.values(place)
        return F.filter(col if many else F.array(col), lambda x: x.isNotNull())

    # clauses ----------------------------------------------------------------------------------------------------------

    def field(self, c: FieldClause) -> Column:
        place = self.index.definition.place(c.field).need("filter")
        col, many = self.values(place)
        shadow = F.col(f"_fold_{c.field}") if not many and self.element is None and f"_fold_{c.field}" in self.index.frame.columns else None
        return matches(place.field, col, many, c.match, shadow)

    def joined(self, df: DataFrame, hits: DataFrame | None) -> tuple[DataFrame, Part]:
        if hits is None:
            return df, Part(no(), F.lit(0.0))
        name = self.index.fresh("s")
        df = df.join(hits.select(*self.keys, F.col("s").alias(name)), self.keys, "left")
        return df, Part(F.col(name).isNotNull(), F.coalesce(F.col(name), F.lit(0.0)))

    def everything(self) -> DataFrame:
        return self.index.elements(self.path) if self.path else self.index.frame

    def text(self, words: Words, fields) -> DataFrame | None:
        return text_hits(self.index, self.index.text_fields(fields, self.path, self.locale), words, self.keys, self.everything())

    def knn(self, c: Knn, extra: tuple = ()) -> DataFrame:
        """The k nearest of what the filters leave; ties by key."""
        place = self.index.definition.place(c.field)
        f = place.field
        if f.type != "vector":
            raise RequestError("search:matcher:type_unsupported", f"{c.field} is no vector", c.field)
        if len(c.vector) != f.dimensions:
            raise RequestError("search:clause:vector_dimensions", f"{len(c.vector)} for {f.dimensions}", c.field)
        if f.similarity == "cosine" and not any(c.vector):
            raise RequestError("search:clause:vector_zero", "cosine has no direction for zero", c.field)
        col, _ = self.values(place)
        df, kept = self.narrowed(self.everything(), tuple(c.filter) + extra)
        got = kept.where(col.isNotNull()).select(*self.keys, similarity(col, c.vector, f.similarity).alias("s"))
        return got.orderBy(F.desc("s"), *self.keys).limit(c.k)

    def narrowed(self, df: DataFrame, clauses: tuple) -> tuple[DataFrame, DataFrame]:
        df, part = self.all(df, clauses)
        return df, df.where(part.match)

    def fuse(self, c: Fuse) -> DataFrame:
        """Reciprocal rank fusion: each ranking is cut to its depth, then weights over ranks add up."""
        lists = []
        for r in c.rankings:
            clauses = tuple(self.pushed(x, c.filter) for x in r.clauses)
            df, part = self.all(self.everything(), clauses + tuple(c.filter))
            top = df.where(part.match).select(*self.keys, (part.score if part.score is not None else F.lit(0.0)).alias("s")).orderBy(F.desc("s"), *self.keys).limit(c.depth)
            # at most depth rows: their rank needs no more than one task
            ranked = top.withColumn("r", F.row_number().over(Window.orderBy(F.desc("s"), *self.keys)))
            lists.append(ranked.select(*self.keys, (F.lit(r.weight) / (c.constant + F.col("r"))).alias("s")))
        return reduce(DataFrame.unionByName, lists).groupBy(*self.keys).agg(F.sum("s").alias("s"))

    def pushed(self, c, extra: tuple):
        """A fuse filter goes into every knn it can reach, so that k are found among what the filter leaves."""
        if isinstance(c, Knn):
            return replace(c, filter=tuple(c.filter) + tuple(extra))
        if isinstance(c, (And, Or, Boost)):
            return replace(c, clauses=tuple(self.pushed(x, extra) for x in c.clauses))
        return c

    def nested_predicate(self, c: Nested) -> Column:
        place = self.list_of(c.path)

        def holds(x: Column) -> Column:
            at = Compiler(self.index, self.locale, c.path, x)
            return sure(reduce(Column.__and__, [sure(at.predicate(k)) for k in c.clauses], x.isNotNull()))

        return sure(F.exists(place, holds))

    def list_of(self, path: str) -> Column:
        f = self.index.definition.place(path).field
        if f.type != "object" or not f.nested:
            raise RequestError("search:nested:path_not_nested", path, path)
        return reduce(lambda c, s: c[s], path.split(".")[1:], F.col(f"`{path.split('.')[0]}`"))

    def predicate(self, c) -> Column:
        """A clause that needs no join, as a Column alone."""
        if isinstance(c, FieldClause) and not isinstance(c.match, Words):
            return self.field(c)
        if isinstance(c, And):
            return reduce(Column.__and__, [self.predicate(x) for x in c.clauses], yes())
        if isinstance(c, Or):
            return reduce(Column.__or__, [sure(self.predicate(x)) for x in c.clauses], no())
        if isinstance(c, Not):
            return reduce(Column.__and__, [~sure(self.predicate(x)) for x in c.clauses], yes())
        if isinstance(c, Boost):
            return yes()
        if isinstance(c, Nested) and not self.path:
            return self.nested_predicate(c)
        raise RequestError("search:clause:unsupported_here", type(c).__name__)

    def simple(self, c) -> bool:
        if isinstance(c, FieldClause):
            return not isinstance(c.match, Words)
        return isinstance(c, (And, Or, Not, Nested)) and all(map(self.simple, c.clauses))

    def one(self, df: DataFrame, c) -> tuple[DataFrame, Part]:
        if self.simple(c):
            return df, Part(self.predicate(c))
        if isinstance(c, FieldClause):
            return self.joined(df, self.text(c.match, ((c.field, None),)))
        if isinstance(c, Text):
            return self.joined(df, self.text(c.words, c.fields))
        if isinstance(c, Knn):
            return self.joined(df, self.knn(c))
        if isinstance(c, Fuse):
            return self.joined(df, self.fuse(c))
        if isinstance(c, And):
            return self.all(df, c.clauses)
        if isinstance(c, Or):
            parts = []
            for x in c.clauses:
                df, p = self.one(df, x)
                parts.append(p)
            match = reduce(Column.__or__, [sure(p.match) for p in parts], no())
            if not any(map(scores, c.clauses)):
                return df, Part(match)
            # beside a scoring alternative, each that holds counts, a field clause with a constant
            each = [F.when(sure(p.match), p.score if p.score is not None else F.lit(1.0)).otherwise(0.0) for p in parts]
            return df, Part(match, reduce(Column.__add__, each))
        if isinstance(c, Not):
            match = yes()
            for x in c.clauses:
                df, p = self.one(df, x)
                match = match & ~sure(p.match)
            return df, Part(match)
        if isinstance(c, Boost):
            df, p = self.all(df, c.clauses)
            # one clause keeps its own score, a field clause's being 1; several field clauses only filter, and lift nothing
            inner = p.score if p.score is not None else F.lit(1.0 if len(c.clauses) == 1 else 0.0)
            return df, Part(yes(), F.when(sure(p.match), c.weight * inner).otherwise(0.0))
        if isinstance(c, Nested):
            self.list_of(c.path)
            at = Compiler(self.index, self.locale, c.path, F.col("_elem"))
            rows, p = at.all(self.index.elements(c.path), c.clauses)
            how = {"max": F.max, "min": F.min, "avg": F.avg, "total": F.sum}[c.score]
            hits = rows.where(p.match).groupBy(self.index.pk).agg(how(p.score if p.score is not None else F.lit(0.0)).alias("s"))
            return self.joined(df, hits)
        raise RequestError("search:clause:type_unknown", type(c).__name__)

    def all(self, df: DataFrame, clauses) -> tuple[DataFrame, Part]:
        """An implicit AND; boosts add and never narrow."""
        match, score = None, None
        for c in clauses:
            df, p = self.one(df, c)
            match = p.match if match is None else match & p.match
            if p.score is not None:
                score = p.score if score is None else score + p.score
        return df, Part(yes() if match is None else match, score)

    # lists narrowed by the query ----------------------------------------------------------------------------------------

    def required(self, clauses, path: str) -> list[Nested]:
        """Nested clauses on a path that must hold: at the top or inside and."""
        out = []
        for c in clauses:
            if isinstance(c, Nested) and c.path == path:
                out.append(c)
            elif isinstance(c, And):
                out += self.required(c.clauses, path)
        return out

    def narrowed_list(self, clauses, path: str) -> Column:
        """The elements that the query's required nested clauses leave."""
        kept = self.list_of(path)
        for c in self.required(clauses, path):
            kept = F.filter(kept, self._holds(c))
        return kept

    def _holds(self, c: Nested):
        def holds(x: Column) -> Column:
            at = Compiler(self.index, self.locale, c.path, x)
            return reduce(Column.__and__, [sure(at.predicate(k)) for k in c.clauses if at.simple(k)], yes())

        return holds

    def chain_values(self, chain) -> Column:
        """Values of the first target that has any where its conditions hold."""
        each = []
        for t in chain:
            place = self.index.definition.place(t.field)
            if place.nested:
                def value(x, place=place):
                    return Compiler(self.index, self.locale, place.nested, x).values(place)[0]

                kept = F.filter(self.list_of(place.nested), self._holds(Nested(place.nested, t.when)))
                vals = F.filter(F.transform(kept, _one_arg(value)), lambda v: v.isNotNull())
            else:
                vals = self.all_values(place)
                if t.when:
                    cond = reduce(Column.__and__, [sure(self.predicate(k)) for k in t.when], yes())
                    vals = F.when(cond, vals)
            each.append(F.when(F.size(vals) > 0, vals))
        return F.coalesce(*each)


def _one_arg(f):
    return lambda x: f(x)


def _inside(col: Column, step: str) -> Column:
    return F.transform(col, lambda x: x[step])
