"""Relaxation: an empty search lets go of words. A few driver-side probes; word counts come from one grouped job."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..plans.clauses import And, Boost, Fuse, Nested, Request, Text, Words, walk
from .compiler import Compiler
from .text import loose_hits, read_typed

MOST_WORDS = 32


def swapped(clauses, old: Text, new) -> tuple:
    """The clause tree with one text clause replaced; None takes it out."""
    out = []
    for c in clauses:
        if c is old:
            if new is not None:
                out += new if isinstance(new, (list, tuple)) else [new]
        elif isinstance(c, (And, Boost, Nested)) or type(c).__name__ in {"Or", "Not"}:
            out.append(replace(c, clauses=swapped(c.clauses, old, new)))
        elif isinstance(c, Fuse):
            out.append(replace(c, rankings=tuple(replace(r, clauses=swapped(r.clauses, old, new)) for r in c.rankings)))
        else:
            out.append(c)
    return tuple(out)


def relaxed(index, r: Request) -> tuple[Request, dict] | None:
    text = next(c for c in walk(r.query) if isinstance(c, Text))
    w = text.words
    parts = read_typed(w.text) if w.match == "user" else None
    words = [p.text for p in parts if not p.phrase and not p.exclude] if parts is not None else w.text.split()
    words = list(dict.fromkeys(words))
    if not 2 <= len(words) <= MOST_WORDS:
        return None
    # is anything there without the text at all?
    rows, _, _ = index.matched_rows(r, query=swapped(r.query, text, None))
    if not rows.limit(1).count():
        return None
    held = word_counts(index, r, text, words)

    def attempt(dropped: set[str]):
        left = [x for x in words if x not in dropped]
        if not left:
            return None
        if parts is not None:
            said = " ".join(("-" if p.exclude else "") + (f'"{p.text}"' if p.phrase else p.text) for p in parts if p.phrase or p.exclude or p.text not in dropped)
        else:
            said = " ".join(x for x in w.text.split() if x not in dropped)
        inner = replace(text, words=replace(w, text=said, relax="off", prefix=w.prefix if words[-1] not in dropped else "off"))
        narrow = replace(r, query=swapped(r.query, text, inner))
        got, _, _ = index.matched_rows(narrow)
        if not got.limit(1).count():
            return None
        lifts = [Boost((replace(text, words=replace(w, text=x, match="all", relax="off", prefix="off")),), 1.0) for x in words if x in dropped and held[x]]
        report = {"dropped": [{"word": x, "reason": "unmatched" if not held[x] else "common"} for x in words if x in dropped], "text": said}
        return replace(r, query=swapped(r.query, text, [inner, *lifts])), report

    dropped = {x for x in words if not held[x]}
    if dropped and (got := attempt(dropped)):
        return got
    if w.relax != "words":
        return None
    for x in sorted((x for x in words if x not in dropped), key=lambda x: -held[x]):
        dropped.add(x)
        if len(dropped) == len(words):
            break
        if got := attempt(dropped):
            return got
    return None


def word_counts(index, r: Request, text: Text, words: list[str]) -> dict[str, int]:
    """Documents that hold each word on its own: one job for all words."""
    path = next((c.path for c in walk(r.query) if isinstance(c, Nested) and text in c.clauses), None)
    at = Compiler(index, r.locale, path)
    fields = index.text_fields(text.fields, path, r.locale)
    frames = []
    for i, x in enumerate(words):
        last = i == len(words) - 1
        hits = loose_hits(index, fields, x, Words("", prefix=text.words.prefix if last else "off", typos=text.words.typos), at.keys)
        if hits is not None:
            frames.append(hits.select(*at.keys, F.lit(x).alias("word")))
    held = dict.fromkeys(words, 0)
    if frames:
        rows = frames[0]
        for f in frames[1:]:
            rows = rows.unionByName(f)
        held |= {row["word"]: row["n"] for row in rows.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return held
