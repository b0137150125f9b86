"""What the words of a request find in a text field: a row for each document, made by one pass over the texts.

A need says what of a document's terms counts: ``("is", word)``, ``("starts", word)``, ``("near", word, edits, starts)`` or
``("at", word)``, which keeps the word's positions for phrases. All needs of a request are met by the same pass; what comes
after it reads lengths and counts, never texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIXED_START = 1


@dataclass(frozen=True)
class Evidence:
    """Keys, ``len`` and a column for each need; documents of the field, their average length, and how many meet a need."""

    frame: DataFrame
    columns: dict[tuple, str]
    n: float
    average: float
    held: dict[tuple, int]

    def covers(self, needs) -> bool:
        return set(needs) <= set(self.columns)


def swaps(word: str) -> list[str]:
    """Words that differ by one swap of neighbours."""
    return sorted({word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)} - {word})


def near(term: Column, word: str, edits: int) -> Column:
    """Whether a term is within so many edits, a swap of neighbours being one."""
    close = lambda w, k: (F.levenshtein(term, F.lit(w), k) >= 0) if k else term == w
    tests = [close(word, edits)]
    if edits == 1:
        tests.append(term.isin(swaps(word)) if len(word) > 1 and swaps(word) else F.lit(False))
    elif edits == 2:
        tests += [close(s, 1) for s in swaps(word)]
    return reduce(Column.__or__, tests)


def near_start(term: Column, word: str, edits: int) -> Column:
    """Whether some beginning of a term is within so many edits: a half-typed word takes anything after such a reading."""
    sizes = range(max(1, len(word) - edits), len(word) + edits + 1)
    return reduce(Column.__or__, [(F.length(term) >= k) & near(F.substring(term, 1, k), word, edits) for k in sizes])


def meets(term: Column, need: tuple) -> Column:
    """Whether a term counts for a need."""
    what, word = need[:2]
    if what == "starts":
        return term.startswith(word)
    if what != "near":
        return term == word
    edits, starts = need[2:]
    test = near_start if starts else near
    out = term.startswith(word[:FIXED_START]) & test(term, word, edits) & ~(term.startswith(word) if starts else term == word)
    return out & ~test(term, word, 1) if edits == 2 else out


def any_of(term: Column, needs: list[tuple]) -> Column:
    """Whether a term counts for one of the needs."""
    words = sorted({x[1] for x in needs if x[0] in {"is", "at"}})
    tests = ([term.isin(words)] if words else []) + [meets(term, x) for x in needs if x[0] not in {"is", "at"}]
    return reduce(Column.__or__, tests)


def of_texts(source: DataFrame, keys: list[str], words: Column | None, tokens: Column, needs: list[tuple], names: list[str]) -> DataFrame:
    """Every document's length and needs from its text. ``words`` are the terms where each stands at its own index."""
    placed = words is None or any(x[0] == "at" for x in needs)
    # each step is read more than once by the next, so Spark works it out once
    rows = source.select(*keys, (tokens if words is None else words).alias("_w"))
    of = (lambda x: x["t"]) if placed else (lambda x: x)
    # an index is the term's position
    spots = F.col("_w") if words is None or not placed else F.transform("_w", lambda x, i: F.struct(i.alias("p"), x.alias("t")))
    rows = rows.select(*keys, F.greatest(F.size("_w"), F.lit(0)).alias("_len"), F.filter(spots, lambda x: any_of(of(x), needs)).alias("_held"))

    def met(need: tuple) -> Column:
        kept = F.filter("_held", lambda x: meets(of(x), need))
        return F.transform(kept, lambda x: x["p"]) if need[0] == "at" else F.greatest(F.size(kept), F.lit(0))

    rows = rows.select(*keys, "_len", *(met(x).alias(c) for x, c in zip(needs, names, strict=True)))
    merged = [(F.flatten(F.collect_list(c)) if x[0] == "at" else F.sum(c)).alias(c) for x, c in zip(needs, names, strict=True)]
    return rows.groupBy(*keys).agg(F.sum("_len").alias("len"), *merged).where("len > 0")


def of_postings(postings: DataFrame, terms: DataFrame, lengths: DataFrame, keys: list[str], needs: list[tuple], names: list[str]) -> DataFrame:
    """The same of documents that meet a need, from postings that are there: words are expanded on the dictionary."""
    term = F.col("term")
    if all(x[0] in {"is", "at"} for x in needs):
        rows = postings.where(any_of(term, needs))
    else:
        # a dictionary's matches can be many, so Spark picks the join
        rows = postings.join(terms.where(any_of(term, needs)).select("term"), "term", "left_semi")
    met = [(F.collect_list(F.when(meets(term, x), F.col("pos"))) if x[0] == "at" else F.count_if(meets(term, x))).alias(c) for x, c in zip(needs, names, strict=True)]
    return rows.groupBy(*keys).agg(*met).join(lengths, keys)


def kept(df: DataFrame) -> DataFrame:
    """The rows, worked out once: in the checkpoint folder, or with the executors where there is none."""
    folder = df.sparkSession.sparkContext._jsc.sc().getCheckpointDir()
    return df.checkpoint() if folder.isDefined() else df.localCheckpoint()


def held_by(need: tuple, column: str) -> Column:
    """Whether a row of the evidence meets a need."""
    return F.size(column) > 0 if need[0] == "at" else F.col(column) > 0
