"""Explanations: a score tree for one document, a node for each clause and signal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.clauses import And, Boost, FieldClause, Fuse, Knn, Nested, Not, Or, Request, Text
from . import ranking as rk
from .compiler import Compiler, sure


def _named(c) -> dict:
    if isinstance(c, FieldClause):
        return {"type": "field", "field": c.field, "match": type(c.match).__name__.lower()}
    if isinstance(c, Text):
        return {"type": "text", "text": c.words.text}
    if isinstance(c, (Knn,)):
        return {"type": "knn", "field": c.field}
    if isinstance(c, Nested):
        return {"type": "nested", "path": c.path}
    return {"type": type(c).__name__.lower()}


def explained(index, r: Request, key) -> dict:
    """{matched, score, clauses: [...], signals: [...]} of the document with this key; all nodes come from one row."""
    at = Compiler(index, r.locale)
    df = index.frame
    cells, tree = [], []

    def visit(df, c):
        df, p = at.one(df, c)
        i = len(cells)
        cells.append(F.struct(sure(p.match).alias("m"), (p.score if p.score is not None else F.lit(None)).cast("double").alias("s")))
        node = _named(c) | {"at": i, "clauses": []}
        if isinstance(c, (And, Or, Not, Boost)):
            for x in c.clauses:
                df, below = visit(df, x)
                node["clauses"].append(below)
        if isinstance(c, Fuse):
            node["rankings"] = []
            for x in c.rankings:
                inner = []
                for y in x.clauses:
                    df, below = visit(df, y)
                    inner.append(below)
                node["rankings"].append({"weight": x.weight, "clauses": inner})
        return df, node

    for c in (*r.query, *r.filters):
        df, node = visit(df, c)
        tree.append(node)
    signals = rk.signals_of(index, r) if not r.sort else []
    for s in signals:
        cells.append(F.struct(F.lit(True).alias("m"), rk.ranked(at, F.lit(1.0), [s], index.now).alias("s")))
    row = df.where(F.col(index.pk) == F.lit(key)).select(F.array(*cells).alias("x") if cells else F.lit(None).alias("x")).limit(1).collect()
    if not row:
        return {"matched": False, "score": 0.0, "clauses": [], "signals": []}
    got = row[0]["x"] or []

    def fill(node: dict) -> dict:
        cell = got[node.pop("at")]
        node |= {"matched": cell["m"], "score": cell["s"] if cell["s"] is not None else 0.0}
        for x in node["clauses"]:
            fill(x)
        for x in node.get("rankings", []):
            for y in x["clauses"]:
                fill(y)
        return node

    clauses = [fill(n) for n in tree]
    matched = all(n["matched"] for n in clauses)
    scoring = index.scoring(r)
    first = sum(n["score"] for n in clauses) if scoring else 1.0
    factors = [{"field": s.field, "shape": s.shape, "factor": got[len(got) - len(signals) + i]["s"]} for i, s in enumerate(signals)]
    for f in factors:
        first *= f["factor"]
    return {"matched": matched, "score": first if matched else 0.0, "clauses": clauses, "signals": factors}
