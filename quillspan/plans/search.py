"""An index over a DataFrame, and searches of it.

``Index.search`` compiles a request into one DataFrame plan for the hits and one for each facet. Ranking reads keys and
sort values alone; the page's documents are joined to it afterwards, so wide columns are read for a page only.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import RequestError
from ..functions.analysis import Chain
from ..operators import facets as fc
from ..operators import ranking as rk
from ..operators import evidence as ev
from ..operators.compiler import Compiler
from ..operators.text import TextField, needs_of
from .clauses import Facet, FieldClause, Fuse, Knn, Limits, Nested, Reader, Request, Text, Words, read_request, scores, walk
from .definition import IndexDefinition

#: the text column whose keys have a locale are cached by (field, locale)
DEFAULT_NOW = "2000-01-01T00:00:00Z"


@dataclass
class SearchResult:
    """What a search found. Frames are lazy; ``total`` runs a count when asked."""

    hits: DataFrame
    facets: dict[str, DataFrame]
    matches: DataFrame
    request: Request
    keys: list = field(default_factory=list)
    relaxed: dict | None = None
    interpreted: dict | None = None

    @cached_property
    def total(self) -> int:
        return self.matches.count()

    def cursors(self) -> dict:
        """``next`` and ``previous`` of the page."""
        rows = self.hits.orderBy("_position").select(*(k.name for k in self.keys)).collect()
        if not rows:
            return {}
        return {"next": rk.cursor(self.keys, list(rows[-1])), "previous": rk.cursor(self.keys, list(rows[0]))}

    def pages(self) -> dict:
        """Numbered pages around the current one."""
        r = self.request
        size = max(1, r.limit)
        count = -(-self.total // size)
        at, most = r.offset // size, r.pages or 9
        lo = max(0, min(at - most // 2, count - most))
        middle = list(range(lo, min(count, lo + most)))
        entry = lambda i: {"page": i + 1, "offset": i * size, "current": i == at}
        return {"count": count, "start": [] if 0 in middle or not count else [entry(0)], "middle": [entry(i) for i in middle], "end": [] if not count or count - 1 in middle else [entry(count - 1)]}


class Index:
    """One generation of documents under a definition, with the settings searches read."""

    def __init__(self, definition: IndexDefinition | dict | str, frame: DataFrame, settings: dict | None = None, now: str = DEFAULT_NOW, limits: Limits = Limits(), tables: dict[str, DataFrame] | None = None):
        self.definition = definition if isinstance(definition, IndexDefinition) else IndexDefinition.of(definition)
        self.frame, self.settings, self.limits = frame, settings or {}, limits
        self.pk = self.definition.pk
        self.now = F.lit(now).cast("timestamp")
        self._names = itertools.count()
        self._tables: dict[str, DataFrame] = dict(tables or {})
        self._stats: dict[str, tuple[float, float]] = {}
        self._evidence: dict[str, ev.Evidence] = {}
        self._needs: dict[str, set[tuple]] = {}

    @property
    def ranking(self) -> dict:
        """Settings' ranking takes the place of the definition's as a whole."""
        return self.settings.get("ranking", self.definition.ranking)

    def fresh(self, what: str) -> str:
        return f"_{what}{next(self._names)}"

    # derived tables -----------------------------------------------------------------------------------------------------

    def elements(self, path: str) -> DataFrame:
        """A row for each element of a nested list: the document's columns, _ord and _elem."""
        values = Compiler(self).list_of(path)
        return self.frame.select("*", F.posexplode(values).alias("_ord", "_elem"))

    def _place(self, name: str):
        """A text field's place; ``name@autocomplete`` is its other usage."""
        return self.definition.place(name.partition("@")[0])

    def _text_of(self, name: str) -> tuple[DataFrame, list[str], Column]:
        place = self._place(name)
        source = self.elements(place.nested) if place.nested else self.frame
        at = Compiler(self, self._locale.get(place.name), place.nested, F.col("_elem") if place.nested else None)
        return source, at.keys, at.all_values(place)

    @property
    def _locale(self) -> dict:
        return self.__dict__.setdefault("_locales", {})

    def chain(self, name: str) -> Chain:
        place = self._place(name)
        usage = (place.field.autocomplete if name.endswith("@autocomplete") else place.field.text_usage) or {}
        tag = self._locale.get(place.name)
        return Chain(usage.get("analyzer") or {k: v for k, v in usage.items() if k in {"language", "preset", "filters", "tokenizer", "charFilters"}}, tag.split("-")[0] if tag else None)

    def _table(self, kind: str, name: str, make) -> DataFrame:
        key = f"{kind}:{name}:{self._locale.get(name.partition('@')[0]) or ''}"
        if key not in self._tables:
            self._tables[key] = make()
        return self._tables[key]

    def _tokens(self, name: str) -> Column:
        values, chain = self._text_of(name)[2], self.chain(name)
        return F.flatten(F.transform(values, lambda v, i: F.transform(chain.tokens(v), lambda x: F.struct((x["p"] + i * 100_000).alias("p"), x["t"].alias("t")))))

    def postings(self, name: str) -> DataFrame:
        """keys, pos, term of a text field; several values follow each other with a gap, so that no phrase spans two."""

        def make():
            source, keys, _ = self._text_of(name)
            return source.select(*keys, F.explode(self._tokens(name)).alias("x")).select(*keys, F.col("x.p").alias("pos"), F.col("x.t").alias("term"))

        return self._table("postings", name, make)

    def lengths(self, name: str) -> DataFrame:
        """keys and len: a field's tokens in a document."""
        place = self._place(name)
        keys = [self.pk] + (["_ord"] if place.nested else [])
        return self._table("lengths", name, lambda: self.postings(name).groupBy(*keys).agg(F.count("*").alias("len")))

    def terms(self, name: str) -> DataFrame:
        """The field's dictionary: distinct terms."""
        return self._table("terms", name, lambda: self.postings(name).select("term").distinct())

    def whole_values(self, name: str) -> DataFrame:
        """keys and the whole value in its analysed form."""

        def make():
            source, keys, values = self._text_of(name)
            chain = self.chain(name)
            return source.select(*keys, F.explode(values).alias("v")).select(*keys, F.array_join(F.transform(chain.tokens(F.col("v")), lambda x: x["t"]), " ").alias("whole"))

        return self._table("whole", name, make)

    def text_stats(self, name: str) -> tuple[float, float]:
        """Documents that have the field, and their average length: one small job a field."""
        key = f"{name}:{self._locale.get(name) or ''}"
        if key not in self._stats:
            r = self.lengths(name).agg(F.count("*").alias("n"), F.avg("len").alias("a")).first()
            self._stats[key] = (float(r["n"]), float(r["a"] or 0.0))
        return self._stats[key]

    def _plain_words(self, name: str) -> Column | None:
        """The terms alone of a single value whose chain leaves each at its own index."""
        place = self._place(name)
        at = Compiler(self, self._locale.get(place.name), place.nested, F.col("_elem") if place.nested else None)
        value, many = at.values(place)
        return None if many else self.chain(name).words(value)

    def evidence(self, name: str, needs: set[tuple]) -> ev.Evidence:
        """What meets the needs in a text field. The last is kept: an index is one generation of documents."""
        key = f"{name}:{self._locale.get(name.partition('@')[0]) or ''}"
        if key in self._evidence and self._evidence[key].covers(needs):
            return self._evidence[key]
        wanted = sorted(needs | self._needs.get(key, set()), key=repr)
        columns = {x: f"_n{i}" for i, x in enumerate(wanted)}
        if ready := f"postings:{key}" in self._tables:
            keys = [self.pk] + (["_ord"] if self._place(name).nested else [])
            frame = ev.kept(ev.of_postings(self.postings(name), self.terms(name), self.lengths(name), keys, wanted, list(columns.values())))
        else:
            source, keys, _ = self._text_of(name)
            frame = ev.kept(ev.of_texts(source, keys, self._plain_words(name), self._tokens(name), wanted, list(columns.values())))
        r = frame.agg(F.count("*").alias("n"), F.avg("len").alias("a"), *(F.count_if(ev.held_by(x, c)).alias(c) for x, c in columns.items())).first()
        n, average = self.text_stats(name) if ready else (float(r["n"]), float(r["a"] or 0.0))
        self._evidence[key] = found = ev.Evidence(frame, columns, n, average, {x: r[c] for x, c in columns.items()})
        return found

    def gather(self, r: Request) -> None:
        """Note what all text clauses of a request may ask, so that one pass over a field serves them."""
        self._needs = {}

        def visit(clauses, path: str | None) -> None:
            for c in clauses:
                words, fields = (c.words, c.fields) if isinstance(c, Text) else (c.match, ((c.field, None),)) if isinstance(c, FieldClause) and isinstance(c.match, Words) else (None, None)
                if words is not None:
                    for f, need in needs_of(self, self.text_fields(fields, path, r.locale), words):
                        self._needs.setdefault(f"{f.name}:{self._locale.get(f.name.partition('@')[0]) or ''}", set()).add(need)
                elif isinstance(c, Fuse):
                    for x in c.rankings:
                        visit(x.clauses, path)
                    visit(c.filter, path)
                elif isinstance(c, Knn):
                    visit(c.filter, path)
                elif hasattr(c, "clauses"):
                    visit(c.clauses, c.path if isinstance(c, Nested) else path)

        visit((*r.query, *r.filters, *(r.rescore.boost if r.rescore else ())), None)

    def prepared(self, *names: str, write_to: str | None = None) -> "Index":
        """The same index with postings, lengths and dictionaries of text fields made once: written, or cached."""
        tables = dict(self._tables)
        for n in names or [x for x in self.definition.names() if self.definition.place(x).field.textual]:
            for kind in ("postings", "lengths", "terms"):
                t = getattr(self, kind)(n)
                key = f"{kind}:{n}:{self._locale.get(n) or ''}"
                if write_to:
                    path = f"{write_to}/{kind}-{n}"
                    # by term, so that a word's postings lie together and row groups prune
                    (t.repartitionByRange("term").sortWithinPartitions("term") if kind != "lengths" else t).write.mode("overwrite").parquet(path)
                    t = t.sparkSession.read.parquet(path)
                else:
                    t = t.coalesce(t.sparkSession.sparkContext.defaultParallelism).cache()
                tables[key] = self._tables[key] = t
        return Index(self.definition, self.frame, self.settings, DEFAULT_NOW, self.limits, tables)._with_now(self.now)

    def _with_now(self, now: Column) -> "Index":
        self.now = now
        return self

    def folded(self) -> "Index":
        """The same index with a stored folded column for every filterable string outside lists, so filters reach the scan."""
        frame = self.frame
        for n, f in self.definition.fields.items():
            if f.type == "string" and f.filter is not None and not f.multiple and not f.locales and f"_fold_{n}" not in frame.columns:
                frame = frame.withColumn(f"_fold_{n}", F.lower(n))
        return Index(self.definition, frame, self.settings, DEFAULT_NOW, self.limits, self._tables)._with_now(self.now)

    # settings -----------------------------------------------------------------------------------------------------------

    def text_fields(self, fields, path: str | None, locale: str | None) -> list[TextField]:
        """Fields a text clause searches, with their weights: all searchable ones of the place if none is named."""
        named = fields is not None
        pairs = fields or tuple((n, None) for n in self.definition.names(path) if self.definition.place(n).field.textual)
        out = []
        for name, weight in pairs:
            place = self.definition.place(name).need("text")
            if place.nested != path:
                raise RequestError("search:nested:field_outside" if place.nested else "search:nested:field_not_inside", name, name)
            f = place.field
            if f.locales:
                self._locale[name] = self.definition.locale_of(f, locale)
            out.append(TextField(name, f.weight if weight is None else float(weight), f.text_usage, self.chain(name), f.matching is None, f.matching is not None and f.autocomplete is not None))
        if not out and not named:
            raise RequestError("search:usage_unsupported", "no field is searchable")
        return out

    def synonyms(self, f: TextField) -> dict[str, list[tuple[str, ...]]]:
        """word -> alternatives, each a tuple of words."""
        out: dict[str, list[tuple[str, ...]]] = {}
        for group in self.settings.get("synonyms", {}).get(f.name, self.settings.get("synonyms", {}).get("*", [])):
            words = [tuple(t for _, t in f.chain.analyze(w)) for w in group]
            for w in words:
                if len(w) == 1:
                    out.setdefault(w[0], []).extend(x for x in words if x and x != w)
        return out

    def typo_exclusions(self, f: TextField) -> frozenset[str]:
        return frozenset(t for w in self.settings.get("typoExclusions", []) for _, t in f.chain.analyze(w))

    def field_settings(self, name: str) -> dict:
        return self.settings.get("fields", {}).get(name, {})

    # searches -----------------------------------------------------------------------------------------------------------

    def request(self, q: dict | Request) -> Request:
        return q if isinstance(q, Request) else read_request(q, self.limits)

    def matched_rows(self, r: Request, query=None, filters=None) -> tuple[DataFrame, Compiler, bool]:
        """Documents that satisfy query and filters, with _score: the scope of hits and facets."""
        at = Compiler(self, r.locale)
        query = r.query if query is None else query
        filters = r.filters if filters is None else filters
        df, part = at.all(self.frame, tuple(query) + tuple(filters))
        scored = part.score is not None
        # sums come in any order: to nine digits equal scores are equal
        df = df.where(part.match).withColumn("_score", F.round((part.score if scored else F.lit(1.0)).cast("double"), 9))
        return df, at, scored

    def search(self, q: dict | Request) -> SearchResult:
        from ..operators.interpret import interpreted
        from ..operators.relax import relaxed

        r = self.request(q)
        r, reading = interpreted(self, r)
        self.gather(r)
        out = self._search(r)
        out.interpreted = reading
        if self._relaxable(r) and out.matches.limit(1).count() == 0 and (change := relaxed(self, r)):
            r2, said = change
            out = self._search(r2)
            out.relaxed, out.interpreted = said, reading
        return out

    def _relaxable(self, r: Request) -> bool:
        texts = [c for c in walk(r.query) if isinstance(c, Text)]
        w = texts[0].words if len(texts) == 1 else None
        return w is not None and w.relax != "off" and (w.match == "all" or (w.match == "user" and w.join == "all")) and len(w.text.split()) > 1

    def _search(self, r: Request) -> SearchResult:
        from ..operators.hits import expanded, page, rescored

        rows, at, scored = self.matched_rows(r)
        if not r.sort:
            rows = rows.withColumn("_score", rk.ranked(at, F.col("_score"), rk.signals_of(self, r), self.now))
        if r.hits_path:
            rows = expanded(self, at, r, rows)
        keys = rk.sort_keys(at, r, r.hits_path)
        pk = [rk.Key(self.pk, F.col(self.pk), False, False)] + ([rk.Key("_index", F.col("_index"), False, True)] if r.hits_path else [])
        keys = keys + pk
        if r.rescore and not r.sort and not r.after and not r.before:
            hits = rescored(self, at, r, rows, keys)
        else:
            hits = page(self, at, r, rows, keys, scored)
        result = SearchResult(hits, {}, rows, r, keys)
        for f in r.facets:
            result.facets[f.name] = self.facet(r, f)
        return result

    def facet(self, r: Request, f: Facet) -> DataFrame:
        from ..operators.hits import expanded

        keep = fc.kept(r.filters, f)
        scope, at, _ = self.matched_rows(r, filters=keep)
        place = self.definition.place(f.field).need("facet")
        if r.hits_path:
            scope = expanded(self, at, r, scope, keep)
        if place.field.hierarchy is None and (f.path is not None or f.depth != 1):
            raise RequestError("search:usage_unsupported", f"{f.field} has no levels", f.field)
        if f.chain:
            for t in f.chain:
                if self.definition.place(t.field).field.type != place.field.type:
                    raise RequestError("search:facet:fallback_type_mismatch", t.field, t.field)
            return fc.range_facet(scope, at.chain_values(f.chain), f, place.field)
        values = fc.values_of(at, tuple(r.query) + keep, f, r.hits_path)
        if f.ranges:
            return fc.range_facet(scope, values, f, place.field)
        if place.field.hierarchy is not None and f.prefix is None:
            return fc.hierarchy_facet(scope, values, f)
        return fc.value_facet(scope, values, f, self.field_settings(f.field), r.locale)

    def facet_values(self, name: str, q: dict) -> DataFrame:
        """Values of one facet by prefix, of the value or of its label."""
        if self.definition.place(name).field.hierarchy is not None and q.get("prefix"):
            raise RequestError("search:facet:prefix_unsupported", name, name)
        base = read_request({k: v for k, v in q.items() if k in {"query", "filters", "locale"}} | {"facets": [{"field": name, **{k: q[k] for k in ("limit", "order") if k in q}}]}, self.limits)
        return self.facet(base, replace(base.facets[0], prefix=(q.get("prefix") or "").strip() or None))

    def suggest(self, q: dict) -> DataFrame:
        from ..operators.suggest import suggested

        return suggested(self, q)

    def explain(self, q: dict | Request, key) -> dict:
        from ..operators.explain import explained

        return explained(self, self.request(q), key)

    def clauses(self, specs: list[dict]) -> tuple:
        return Reader(self.limits).all(specs)

    def scoring(self, r: Request) -> bool:
        return any(map(scores, r.query))
