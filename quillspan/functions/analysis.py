"""Analysis chains: char filters, a tokenizer and token filters, as Column expressions and, for query text, in Python.

A chain makes an array of (p, t): the position and the term. Removed stopwords leave their position empty; filters that
add terms put them at the position of the word they come from.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import DefinitionError

STOPWORDS = {
    "en": "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split(),
    "sv": "och det att i en jag hon som han på den med var sig för så till är men ett om hade de av".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "fr": "au aux avec ce ces dans de des du elle en et eux il je la le les leur lui ma mais me un une que qui pour par sur".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más o".split(),
}
#: suffix rules, applied in turn to words of more than four letters; other languages are refused rather than guessed at
STEMS = {
    "en": [("('|’)s$", ""), ("ies$", "y"), ("sses$", "ss"), ("([^su])s$", "$1"), ("(ing|ed)$", "")],
    "sv": [("(arna|erna|orna|ande|ade|ar|er|or|en|et|na|a|n)$", "")],
    "de": [("(ungen|ung|ern|em|en|er|es|e|s|n)$", "")],
    "fr": [("(ements|ement|euses|euse|eux|es|e|s|x)$", "")],
    "es": [("(amente|mente|es|s|os|as|o|a)$", "")],
}
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿšž"
FOLD_TO = "aaaaaaceeeeiiiinoooooouuuuyysz"
TOKENIZERS = {"icu": r"[^\p{L}\p{N}]+", "words": r"[^\p{L}\p{N}]+", "whitespace": r"\s+", "letter": r"[^\p{L}]+", "keyword": None}
PRESETS = {
    "plain": [{"type": "normalize"}],
    "preserve_terms": [{"type": "normalize"}],
    "full_text": [{"type": "normalize"}, {"type": "stopwords"}, {"type": "decompound"}, {"type": "stemming"}],
}
MAX_GRAM = 20


def _java(replacement: str) -> str:
    return re.sub(r"\$(\d)", r"\\\1", replacement)


def _stem(word: str, language: str) -> str:
    if len(word) > 4:
        for pattern, put in STEMS[language]:
            word = re.sub(pattern, _java(put), word)
    return word


def _pieces(word: str, known: frozenset[str]) -> list[str]:
    """The word, and its parts where it splits into known words of three or more letters."""
    for i in range(3, len(word) - 2):
        if word[:i] in known and word[i:] in known:
            return [word, word[:i], word[i:]]
    return [word]


class Chain:
    """One analysis chain. ``query_side`` leaves out what is for the index alone: synonyms and compound parts."""

    def __init__(self, spec: dict | None = None, language: str | None = None):
        spec = spec or {}
        self.language = spec.get("language") or language
        self.char_filters = spec.get("charFilters", [])
        self.tokenizer = spec.get("tokenizer", "icu")
        filters = spec.get("filters")
        if filters is None:
            filters = PRESETS[spec.get("preset", "full_text" if spec.get("language") else "plain")]
        self.filters = [f if isinstance(f, dict) else {"type": f} for f in filters]
        if self.tokenizer not in TOKENIZERS:
            raise DefinitionError("index:analysis:tokenizer_unknown", str(self.tokenizer))
        for f in self.filters:
            kind = f["type"]
            if kind == "stemming" and (f.get("language") or self.language) not in STEMS:
                raise DefinitionError("index:analysis:language_unsupported", f"no stemmer for {f.get('language') or self.language}")
            if kind not in {"normalize", "lowercase", "stopwords", "stemming", "asciiFolding", "edgeNgram", "ngram", "synonyms", "decompound"}:
                raise DefinitionError("index:analysis:filter_unknown", kind)
            if kind in {"edgeNgram", "ngram"} and not 1 <= f.get("min", 1) <= f.get("max", MAX_GRAM):
                raise DefinitionError("index:analysis:gram_invalid", str(f))

    def _nfkc(self) -> bool:
        """Compatibility forms are folded where ``normalize`` asks for it: Spark has no function for that."""
        return any(f["type"] == "normalize" and f.get("form") == "nfkc" for f in self.filters)

    def _stop(self, f: dict) -> list[str]:
        return f.get("words") or STOPWORDS.get(f.get("language") or self.language or "", [])

    def words(self, text: Column) -> Column | None:
        """array<string> of an indexed text where a term's index is its position: a chain that folds case at most."""
        cut = TOKENIZERS[self.tokenizer]
        if self.char_filters or cut is None or self._nfkc() or any(f["type"] not in {"normalize", "lowercase"} for f in self.filters):
            return None
        return F.array_remove(F.split(F.lower(text) if self.filters else text, cut), "")

    def tokens(self, text: Column) -> Column:
        """array<struct<p:int,t:string>> of an indexed text."""
        for f in self.char_filters:
            if f["type"] == "htmlStrip":
                text = strip_html(text)
            elif f["type"] == "mapping":
                # longest keys first, as one alternation would take them
                for k in sorted(f["map"], key=len, reverse=True):
                    text = F.replace(text, F.lit(k), F.lit(f["map"][k]))
            elif f["type"] == "patternReplace":
                text = F.regexp_replace(text, f["pattern"], f.get("replacement", ""))
            else:
                raise DefinitionError("index:analysis:filter_unknown", f["type"])
        if self._nfkc():
            text = nfkc()(text)
        if any(f["type"] in {"normalize", "lowercase"} for f in self.filters):
            text = F.lower(text)
        cut = TOKENIZERS[self.tokenizer]
        words = F.array(text) if cut is None else F.split(text, cut)
        words = F.filter(words, lambda w: w != "")
        out = F.transform(words, lambda w, i: F.struct(i.alias("p"), w.alias("t")))
        put = lambda x, t: F.struct(x["p"].alias("p"), t.alias("t"))
        for f in self.filters:
            kind = f["type"]
            if kind == "stopwords" and (stop := self._stop(f)):
                out = F.filter(out, lambda x: ~x["t"].isin(stop))
            elif kind == "stemming":
                out = F.transform(out, lambda x: put(x, _stem_column(x["t"], f.get("language") or self.language)))
            elif kind == "asciiFolding":
                folded = lambda x: F.translate(x["t"], FOLD_FROM, FOLD_TO)
                if f.get("preserveOriginal"):
                    out = F.flatten(F.transform(out, lambda x: F.array_distinct(F.array(x, put(x, folded(x))))))
                else:
                    out = F.transform(out, lambda x: put(x, folded(x)))
            elif kind in {"edgeNgram", "ngram"}:
                out = F.flatten(F.transform(out, lambda x: _grams(x, f)))
            elif kind == "synonyms":
                pairs = F.create_map(*(c for w, alts in f["map"].items() for c in (F.lit(w), F.array(*map(F.lit, [w, *alts])))))
                out = F.flatten(F.transform(out, lambda x: F.transform(F.coalesce(pairs[x["t"]], F.array(x["t"])), lambda t: put(x, t))))
            elif kind == "decompound" and f.get("words"):
                known = F.array(*map(F.lit, f["words"]))
                cuts = lambda x: F.filter(F.sequence(F.lit(3), F.greatest(F.length(x["t"]) - 3, F.lit(3))), lambda i: F.array_contains(known, F.substring(x["t"], F.lit(1), i)) & F.array_contains(known, F.substring(x["t"], i + 1, F.length(x["t"]))))
                parts = lambda x: F.flatten(F.transform(F.slice(cuts(x), 1, 1), lambda i: F.array(F.substring(x["t"], F.lit(1), i), F.substring(x["t"], i + 1, F.length(x["t"])))))
                out = F.flatten(F.transform(out, lambda x: F.concat(F.array(x), F.transform(parts(x), lambda t: put(x, t)))))
        return out

    def analyze(self, text: str, query_side: bool = True) -> list[tuple[int, str]]:
        """The same for a query's text."""
        for f in self.char_filters:
            if f["type"] == "htmlStrip":
                text = html.unescape(re.sub(r"<[^>]*>", " ", text))
            elif f["type"] == "mapping":
                for k in sorted(f["map"], key=len, reverse=True):
                    text = text.replace(k, f["map"][k])
            else:
                text = re.sub(f["pattern"], _java(f.get("replacement", "")), text)
        if self._nfkc():
            text = unicodedata.normalize("NFKC", text)
        if any(f["type"] in {"normalize", "lowercase"} for f in self.filters):
            text = text.lower()
        cut = TOKENIZERS[self.tokenizer]
        out = list(enumerate(w for w in ([text] if cut is None else regex.split(cut, text)) if w))
        for f in self.filters:
            kind = f["type"]
            if kind == "stopwords":
                stop = set(self._stop(f))
                out = [(p, t) for p, t in out if t not in stop]
            elif kind == "stemming":
                out = [(p, _stem(t, f.get("language") or self.language)) for p, t in out]
            elif kind == "asciiFolding":
                table = str.maketrans(FOLD_FROM, FOLD_TO)
                out = [(p, t.translate(table)) for p, t in out]
            elif not query_side and kind in {"edgeNgram", "ngram"}:
                lo, hi = f.get("min", 1), f.get("max", MAX_GRAM)
                out = [(p, t[s : s + n]) for p, t in out for s in (range(len(t)) if kind == "ngram" else (0,)) for n in range(lo, min(hi, len(t) - s) + 1)]
            elif not query_side and kind == "synonyms":
                out = [(p, a) for p, t in out for a in [t, *f["map"].get(t, [])]]
            elif not query_side and kind == "decompound" and f.get("words"):
                out = [(p, a) for p, t in out for a in _pieces(t, frozenset(f["words"]))]
        return out


def _stem_column(t: Column, language: str) -> Column:
    out = t
    for pattern, put in STEMS[language]:
        out = F.regexp_replace(out, pattern, put)
    return F.when(F.length(t) > 4, out).otherwise(t)


def _grams(x: Column, f: dict) -> Column:
    lo, hi = f.get("min", 1), f.get("max", MAX_GRAM)
    n = F.length(x["t"])
    start = F.lit(1) if f["type"] == "edgeNgram" else n
    sizes = lambda s: F.filter(F.sequence(F.lit(lo), F.lit(hi)), lambda k: k <= n - s + 1)
    return F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(start, F.lit(1))), lambda s: F.transform(sizes(s), lambda k: F.struct(x["p"].alias("p"), F.substring(x["t"], s, k).alias("t")))))


def nfkc():
    """Unicode NFKC, in Arrow batches."""


    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.str.normalize("NFKC")

    return run


def strip_html(text: Column) -> Column:
    """Markup out: scripts, styles and comments with their content, tags as a space, the common entities as characters."""
    out = F.regexp_replace(text, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for name, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(ch))
    return out


def folded(value: str) -> str:
    """Case and Unicode form folded, as prefixes of values are compared."""
    return unicodedata.normalize("NFKC", value).lower()
