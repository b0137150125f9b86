"""Highlights, for the page alone: fragments around the words that scored."""

from __future__ import annotations

import html
import re

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import RequestError
from ..plans.clauses import FieldClause, Not, Request, Text, Words, walk
from .text import read_typed

FIRST_CHARS = 10_000


def _typed(r: Request):
    """Texts of the scoring clauses and the fields they name; nothing under a ``not`` marks."""
    gone = {id(x) for c in walk(r.query) if isinstance(c, Not) for x in walk(c.clauses)}
    for c in walk(r.query):
        if id(c) in gone:
            continue
        if isinstance(c, Text):
            yield c.words, None if c.fields is None else {n for n, _ in c.fields}
        elif isinstance(c, FieldClause) and isinstance(c.match, Words):
            yield c.match, {c.field}


def marks(chain, words: Words) -> tuple[set[str], list[list[str]], str | None]:
    """Terms to mark, phrases that must stand whole, and the last word where it may be a beginning."""
    if words.match == "phrase":
        return set(), [[t for _, t in chain.analyze(words.text)]], None
    if words.match == "user":
        parts = [p for p in read_typed(words.text) if not p.exclude]
        loose = " ".join(p.text for p in parts if not p.phrase)
        phrases = [[t for _, t in chain.analyze(p.text)] for p in parts if p.phrase]
    else:
        loose, phrases = words.text, []
    terms = [t for _, t in chain.analyze(loose)]
    return set(terms), [p for p in phrases if p], terms[-1] if terms and words.prefix == "last_token" else None


def fragments(text: str, chain, said: list[tuple[set[str], list[list[str]], str | None]], count: int, length: int, pre: str, post: str) -> list[str]:
    text = text[:FIRST_CHARS]
    tokens = [(m.start(), m.end(), [t for _, t in chain.analyze(m.group())]) for m in regex.finditer(r"[\p{L}\p{N}]+", text)]
    flat = [t[0] if t else "" for _, _, t in tokens]
    hit: set[int] = set()
    for terms, phrases, last in said:
        hit |= {i for i, t in enumerate(flat) if t and (t in terms or (last and t.startswith(last)))}
        for p in phrases:
            for i in range(len(flat) - len(p) + 1):
                if flat[i : i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
    if not hit:
        return []
    pieces, at = [], 0
    for m in re.finditer(r"(?<=[.!?])\s+|\n+", text):
        pieces.append((at, m.start()))
        at = m.end()
    pieces.append((at, len(text)))
    cut = []
    for s, e in pieces:
        while e - s > length:
            stop = text.rfind(" ", s, s + length)
            stop = stop if stop > s else s + length
            cut.append((s, stop))
            s = stop + 1 if text[stop : stop + 1] == " " else stop
        if e > s:
            cut.append((s, e))
    scored = sorted(((-sum(s <= tokens[i][0] < e for i in hit), s, e) for s, e in cut))
    best = sorted((s, e) for n, s, e in scored[:count] if n)
    out = []
    for s, e in best:
        got, at = [], s
        for i in sorted(hit):
            a, b, _ = tokens[i]
            if s <= a and b <= e:
                got += [html.escape(text[at:a], quote=False), pre, html.escape(text[a:b], quote=False), post]
                at = b
        out.append("".join([*got, html.escape(text[at:e], quote=False)]))
    return out


def highlighted(index, r: Request, page: DataFrame) -> DataFrame:
    """A column _highlight_<field> of fragments for each field asked for."""
    for name, spec in r.highlight.get("fields", {}).items():
        spec = spec or {}
        f = index.definition.place(name).need("text").field
        if "highlight" not in f.text_usage:
            raise RequestError("search:usage_unsupported", f"{name} isn't declared for highlighting", name)
        count, length = int(spec.get("fragments", 3)), int(spec.get("length", 150))
        if not 1 <= length <= FIRST_CHARS or count < 1:
            raise RequestError("search:highlight:length_out_of_range", str(length), name)
        chain = index.chain(name)
        said = [marks(chain, w) for w, fields in _typed(r) if fields is None or name in fields]
        pre, post = spec.get("pre", "<em>"), spec.get("post", "</em>")

        run = _marker(chain, said, count, length, pre, post)
        page = page.withColumn(f"_highlight_{name}", run(F.col(f"_src_{name}").cast("string"))).drop(f"_src_{name}")
    return page


def _marker(chain, said, count: int, length: int, pre: str, post: str):
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fragments(t or "", chain, said, count, length, pre, post))

    return run
