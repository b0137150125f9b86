"""Toxicity by a linear-chain conditional random field over words.

Labels mark documents, so tokens are labelled through what documents show: a word, or one of its beginnings of 4 to 6
letters, that toxic documents hold far more often than others (smoothed log-odds) marks the token of a toxic document as
toxic. The labels of one half of the sample come from that half, the features the chain is fitted on from the other, so it
learns how far odds can be trusted and not the threshold that made its labels; scoring takes the odds of both halves.
A feature counts only if chance would hardly give any of all features tested so many toxic documents (Chernoff's bound),
and no oftener than it stands between different neighbours: copies of one text are one place.
The chain has two states, real-valued features (the log-odds of the word and of its beginnings), a bias and transitions,
fitted by gradient ascent. Forward-backward marginals of every token give the document's largest marginal and its
expected number of toxic tokens; a logistic curve over those and the length of the text, fitted on the same sample, is the
score. Offending spans are the runs of tokens whose marginal is at least one half.

Tokens without a feature all have the same factor, so a run of them is one power of a 2x2 matrix: the chain is exact and
costs a step for each token that has a feature. The fit does the same: it sees each text from its first token to its last.

The fit sees at most ``sample`` labelled rows (those with the smallest hashes of doc_id), whatever the input's size, and
has no other bound: the features that reach the driver are words of the sample which pass the test above. The score uses
the text alone. Null and empty texts get the score of a text without toxic tokens. Labels that are null are passed over;
without labels of both kinds, or without a word strong enough to be labelled toxic, every score is 0. Each row is scored by
itself: rows that repeat a doc_id are each reported, equal texts get equal scores, long texts are read whole, and columns
other than doc_id and text, whatever their names, are not read. Labelled rows that tie on the hash of their doc_id are
taken in the order of doc_id and label; a doc_id with several labels or several texts is one row of the sample for each.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .decontaminate import plain

SAMPLE = 20_000
STRONG = 3
BEGINNINGS = (4, 5, 6)
RESULT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("top_marginal", pa.float64()), ("expected_toxic", pa.float64()), ("span_starts", pa.list_(pa.int64())), ("span_ends", pa.list_(pa.int64()))])
WORD = re.compile(r"[^\x20\x09-\x0D]+")


#: counts of documents by half of the sample and label
CELLS = ((0, 0, "cold0"), (0, 1, "hot0"), (1, 0, "cold1"), (1, 1, "hot1"))


def half(text: bytes) -> int:
    """Which half of the sample a text belongs to."""
    return xxhash.xxh3_64_intdigest(text, seed=10) & 1


def hash_of(b: bytes) -> int:
    return xxhash.xxh3_64_intdigest(b) - (1 << 63)


def features(word: bytes) -> list[str]:
    w = plain(word).decode()
    return [f"w:{w}", *(f"{n}:{w[:n]}" if len(w) >= n else "" for n in BEGINNINGS)] if w else []


@dataclass
class Model:
    odds: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(2 + len(BEGINNINGS)))  # bias, word, beginnings
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: np.ndarray | None = None


class Tagger:
    def __init__(self, model: Model):
        self.m = model
        self.values = [np.zeros(1 + len(BEGINNINGS))]
        self.memo: dict[bytes, int] = {}
        self.steps = np.exp(model.trans)
        calm = self.steps * np.array([1.0, np.exp(model.weights[0])])
        self.squares, self.powers = [calm / calm.sum()], {0: np.eye(2)}

    def calm(self, n: int) -> np.ndarray:
        """n steps over tokens without a feature, but for a scale."""
        got = self.powers.get(n)
        if got is None:
            if len(self.powers) > 100_000:
                self.powers = {0: np.eye(2)}
            got = np.eye(2)
            for k in range(n.bit_length()):
                if k == len(self.squares):
                    square = self.squares[-1] @ self.squares[-1]
                    self.squares.append(square / square.sum())
                if n >> k & 1:
                    got = got @ self.squares[k]
                    got = got / got.sum()
            self.powers[n] = got
        return got

    def number(self, words: list[bytes]) -> np.ndarray:
        """0 for a token without a feature, else the row of its values."""
        memo = self.memo
        if len(memo) > 1_000_000:
            memo.clear()
        for w in set(words).difference(memo):
            got = [self.m.odds.get(f, 0.0) for f in features(w)]
            if any(got):
                self.values.append(np.array(got))
                memo[w] = len(self.values) - 1
            else:
                memo[w] = 0
        return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))

    def marginals(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of tokens with features, and their chances of being toxic."""
        at = np.flatnonzero(numbers)
        if not len(at):
            return at, np.empty(0)
        force = [np.array([1.0, np.exp(min(50.0, self.m.weights[0] + float(self.m.weights[1:] @ self.values[n])))]) for n in numbers[at].tolist()]
        gaps = np.diff(at, prepend=-1) - 1
        first = np.array([1.0, np.exp(self.m.weights[0])])
        # before the first token there is no transition
        ahead, a = [], None
        for f, g in zip(force, gaps.tolist(), strict=True):
            if a is None:
                a = f if g == 0 else (first @ self.calm(g - 1)) @ self.steps * f
            else:
                a = (a @ self.calm(g)) @ self.steps * f
            a = a / a.sum()
            ahead.append(a)
        b = self.calm(len(numbers) - 1 - int(at[-1])) @ np.ones(2)
        out = np.empty(len(at))
        for i in range(len(at) - 1, -1, -1):
            p = ahead[i] * b
            out[i] = p[1] / p.sum()
            if i:
                b = self.calm(int(gaps[i])) @ (self.steps @ (force[i] * b))
                b = b / b.sum()
        return at, out

    def document(self, text: str | None) -> tuple[float, float, int, np.ndarray, np.ndarray]:
        """Largest marginal, expected toxic tokens, tokens, and the tokens with features with their marginals."""
        words = (text or "").encode("utf-8", "surrogatepass").split()
        at, p = self.marginals(self.number(words))
        return (float(p.max()), float(p.sum()), len(words), at, p) if len(at) else (0.0, 0.0, len(words), at, p)

    def score(self, top: float, total: float, tokens: int) -> float:
        if self.m.curve is None:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.m.curve @ inputs(top, total, tokens), -50, 50))))


def inputs(top, total, tokens) -> np.ndarray:
    """What the curve sees: one toxic token says more in a short text than in a long one."""
    top = np.asarray(top, float)
    return np.array([np.ones_like(top), top, np.log1p(np.asarray(total, float)), top * np.log1p(np.asarray(tokens, float))])


def spans(text: str, at: np.ndarray, p: np.ndarray) -> tuple[list[int], list[int]]:
    """Code-point offsets of runs of neighbouring tokens that are toxic more likely than not."""
    want = at[p >= 0.5].tolist()
    if not want:
        return [], []
    need, found = set(want), {}
    for i, m in enumerate(WORD.finditer(text)):
        if i in need:
            found[i] = m.span()
    starts, ends = [], []
    for i in want:
        if starts and i - 1 in found and ends[-1] == found[i - 1][1]:
            ends[-1] = found[i][1]
        else:
            starts.append(found[i][0])
            ends.append(found[i][1])
    return starts, ends


def gap_powers(gaps: np.ndarray, step: np.ndarray, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """step to the power of each gap, and its derivatives for the slopes of step; each pair has a scale of its own."""
    out, d_out = np.broadcast_to(np.eye(2), (len(gaps), 2, 2)), np.zeros((len(gaps), len(slope), 2, 2))
    left = gaps.copy()
    while left.any():
        odd = left % 2 == 1
        d_out = np.where(odd[:, None, None, None], d_out @ step + out[:, None] @ slope, d_out)
        out = np.where(odd[:, None, None], out @ step, out)
        scale = out.sum((1, 2))
        out, d_out = out / scale[:, None, None], d_out / scale[:, None, None, None]
        slope, step = slope @ step + step @ slope, step @ step
        slope, step = slope / step.sum(), step / step.sum()
        left = left // 2
    return out, d_out


def fit_chain(chains: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], rounds: int = 150, rate: float = 0.5, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions by Adam on the likelihood of whole texts.

    A chain is the number of its tokens (1 at least), the places of tokens with features, their values and their labels;
    all other tokens have the label 0. Runs of them are powers of one matrix, so a round costs a step for each feature.
    """
    chains = sorted(chains, key=lambda c: (-len(c[1]), c[0], c[1].tobytes(), c[2].tobytes(), c[3].tobytes()))
    n, tokens = np.array([c[0] for c in chains]), np.array([len(c[1]) for c in chains])
    full, longest = int((tokens > 0).sum()), int(tokens[0])
    # feature k of every chain that has one stands in rows[k]: chains are in descending order of their features
    active = [int((tokens > k).sum()) for k in range(longest)]
    rows = [slice(o, o + a) for o, a in zip(np.cumsum([0, *active[:-1]]).tolist(), active, strict=True)]
    at = np.concatenate([[c[1][k] for c in chains[:a]] for k, a in enumerate(active)]).astype(np.int64)
    x = np.concatenate([[c[2][k] for c in chains[:a]] for k, a in enumerate(active)])
    y = np.concatenate([[c[3][k] for c in chains[:a]] for k, a in enumerate(active)]).astype(float)
    before = np.concatenate([np.arange(r.start, r.stop) - p for r, p in zip(rows[1:], active, strict=False)]).astype(np.int64) if longest > 1 else np.empty(0, np.int64)
    later = np.arange(active[0], len(at))
    start = np.cumsum([0, *active])
    last = np.array([start[k - 1] + i for i, k in enumerate(tokens[:full].tolist())])
    # gaps: before the first feature, between two, after the last; chains without one are a first token and a gap
    gaps = np.concatenate([np.maximum(at[: active[0]] - 1, 0), at[later] - at[before] - 1, n[:full] - 1 - at[last], n[full:] - 1])
    kinds, which = np.unique(gaps, return_inverse=True)
    lead, middle, tail, bare = np.split(which, np.cumsum([active[0], len(later), full]))
    inner = at[: active[0]] > 0

    values, total = x.shape[1], int(n.sum())
    seen_w = np.concatenate([[y.sum()], y @ x])
    near = at[later] - at[before] == 1
    both = float((near * y[later] * y[before]).sum())
    into, out_of = float((y * (at > 0)).sum()) - both, float(y.sum() - (y[last] * (at[last] == n[:full] - 1)).sum()) - both
    seen_t = np.array([float((n - 1).sum()) - into - out_of - both, into, out_of, both])
    theta = np.concatenate([[-2.0], np.full(values, 0.3), np.zeros(4)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)

    def shares(left, d, base, right, groups):
        """Derivatives of the log of left @ base @ right, summed over the rows of groups."""
        z = np.einsum("ni,nij,nj->n", left, base[groups], right)
        weight = [[np.bincount(groups, left[:, i] * right[:, j] / z, len(base)) for j in (0, 1)] for i in (0, 1)]
        return np.einsum("gkij,ijg->k", d, np.array(weight))

    for step in range(1, rounds + 1):
        w, t = theta[: 1 + values], theta[1 + values :].reshape(2, 2)
        move, calm = np.exp(t), np.array([1.0, np.exp(np.clip(w[0], -40, 40))])
        d_move = np.zeros((5, 2, 2))
        for k in range(4):
            d_move[k + 1, k // 2, k % 2] = move[k // 2, k % 2]
        d_calm = np.zeros((5, 2))
        d_calm[0, 1] = calm[1]
        power, d_power = gap_powers(kinds, move * calm, d_move * calm + move * d_calm[:, None, :])
        hop, d_hop = power @ move, d_power @ move + power[:, None] @ d_move
        force = np.ones((len(at), 2))
        force[:, 1] = np.exp(np.clip(w[0] + x @ w[1:], -40, 40))
        a, b = np.empty((len(at), 2)), np.empty((len(at), 2))
        a[rows[0]] = np.where(inner[:, None], np.einsum("i,nij->nj", calm, hop[lead]), 1.0) * force[rows[0]]
        a[rows[0]] /= a[rows[0]].sum(1, keepdims=True)
        for k in range(1, longest):
            r = rows[k]
            z = np.einsum("ni,nij->nj", a[rows[k - 1]][: active[k]], hop[middle[r.start - active[0] : r.stop - active[0]]]) * force[r]
            a[r] = z / z.sum(1, keepdims=True)
        b[last] = power[tail].sum(2)
        for k in range(longest - 1, 0, -1):
            r = rows[k]
            z = np.einsum("nij,nj->ni", hop[middle[r.start - active[0] : r.stop - active[0]]], force[r] * b[r])
            b[rows[k - 1].start : rows[k - 1].start + active[k]] = z / z.sum(1, keepdims=True)
        p = a * b
        hot = p[:, 1] / p.sum(1)
        fb = force * b
        rest = shares(a[before], d_hop, hop, fb[later], middle)
        ones = np.ones((len(n), 2))
        rest = rest + shares(a[last], d_power, power, ones[:full], tail)
        first = np.broadcast_to(calm, (len(n), 2))
        rest = rest + shares(first[: int(inner.sum())], d_hop, hop, fb[rows[0]][inner], lead[inner])
        rest = rest + shares(first[full:], d_power, power, ones[full:], bare)
        # the first token of a text, where it has no feature
        z = np.einsum("nij,nj->ni", hop[lead[inner]], fb[rows[0]][inner])
        rest[0] += (z[:, 1] * calm[1] / (z @ calm)).sum()
        z = power[bare].sum(2)
        rest[0] += (z[:, 1] * calm[1] / (z @ calm)).sum()
        want = np.concatenate([[hot.sum() + rest[0]], hot @ x, rest[1:]])
        grad = (np.concatenate([seen_w, seen_t]) - want) / total * 50 - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + rate / (1 + step / 50) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[: 1 + values], theta[1 + values :].reshape(2, 2)


def fit_curve(top: np.ndarray, total: np.ndarray, tokens: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps."""
    x = inputs(top, total, tokens)
    w = np.zeros(len(x))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        h = (x * (p * (1 - p))) @ x.T + 0.1 * np.eye(len(x))
        w = w + np.linalg.solve(h, x @ (y - p) - 0.1 * w)
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows outside the held-out fifth (crc32 of the doc_id's digits mod 5 is 0)."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    known = C.written(known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample), "labelled")
    rows = C.written(C.texts(docs).join(F.broadcast(known), "doc_id").select("text", "toxic"), "sample").repartition(C.parts(spark))

    @C.tidy
    def count(batches):
        C.release()
        # by half of the sample, then by label: copies of a text are in one half
        got = [[Counter(), Counter()], [Counter(), Counter()]]
        for b in batches:
            for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                got[half(raw)][int(y > 0)].update({f for w in set(raw.split()) for f in features(w) if f})
        names = list(set().union(*got[0], *got[1]))
        yield pa.RecordBatch.from_pydict({"f": names} | {c: [got[k][y][f] for f in names] for k, y, c in CELLS}, schema=pa.schema([("f", pa.string()), *((c, pa.int64()) for _, _, c in CELLS)]))

    def sizes(batches):
        for b in batches:
            of = [(half((t.as_py() or "").encode("utf-8", "surrogatepass")), int(y > 0)) for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"k": [k for k, _ in of], "y": [y for _, y in of]}, schema=pa.schema([("k", pa.int32()), ("y", pa.int32())]))

    size = {(r["k"], r["y"]): r["n"] for r in rows.mapInArrow(sizes, "k int, y int").groupBy("k", "y").agg(F.count("*").alias("n")).collect()}
    n = {y: size.get((0, y), 0) + size.get((1, y), 0) for y in (0, 1)}
    if not n[0] or not n[1]:
        return Model()
    doc_counts = rows.mapInArrow(count, "f string, " + ", ".join(f"{c} long" for _, _, c in CELLS)).groupBy("f").agg(*(F.sum(c).alias(c) for _, _, c in CELLS))
    doc_counts = doc_counts.select("f", (F.col("hot0") + F.col("hot1")).alias("hot"), (F.col("cold0") + F.col("cold1")).alias("cold"), *(c for _, _, c in CELLS)).where("hot >= 3")
    doc_counts = C.written(doc_counts, "counts")
    tested, rate = max(1, doc_counts.count()), n[1] / (n[0] + n[1])

    def gain(hot):
        """Chernoff's exponent: the chance of so many toxic documents among those with the feature is at most exp(-gain)."""
        both = hot + F.col("cold")
        q = hot / both
        return F.when(q > rate, both * (q * F.log(q / rate) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - rate))).otherwise(0.0))).otherwise(0.0)

    limit = float(np.log(tested) + 2)
    likely = [r["f"] for r in doc_counts.where(gain(F.col("hot")) > limit).select("f").collect()]
    wanted = spark.sparkContext.broadcast(frozenset(likely))

    def contexts(batches):
        # copies of one text repeat a word with its neighbours; words that toxic texts choose stand in many places
        for b in batches:
            got = set()
            for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                if y > 0:
                    ws = [b"", *(t.as_py() or "").encode("utf-8", "surrogatepass").split(), b""]
                    for i in range(1, len(ws) - 1):
                        got.update((f, hash_of(ws[i - 1] + b" " + ws[i + 1])) for f in features(ws[i]) if f in wanted.value)
            yield pa.RecordBatch.from_pydict({"f": [g[0] for g in got], "c": [g[1] for g in got]}, schema=pa.schema([("f", pa.string()), ("c", pa.int64())]))

    places = rows.mapInArrow(contexts, "f string, c long").distinct().groupBy("f").agg(F.count("*").alias("places"))
    table = doc_counts.join(places, "f").withColumn("seen", F.least("hot", "places")).where(gain(F.col("seen")) > limit)
    odds = F.log((F.col("seen") + 0.5) / (n[1] + 1)) - F.log((F.col("cold") + 0.5) / (n[0] + 1))
    told = table.withColumn("odds", odds).where("odds > 1.5").collect()
    model = Model({r["f"]: min(r["odds"], 6.0) for r in told})

    def alone(k: int) -> Model:
        """The odds of one half of the sample."""
        hot, cold = size.get((k, 1), 0) + 1, size.get((k, 0), 0) + 1
        return Model({r["f"]: min(float(np.log((r[f"hot{k}"] + 0.5) / hot) - np.log((r[f"cold{k}"] + 0.5) / cold)), 6.0) for r in told})

    halves = spark.sparkContext.broadcast((alone(0), alone(1)))

    @C.tidy
    def chains(batches):
        C.release()
        tags = [Tagger(m) for m in halves.value]
        for b in batches:
            out = []
            for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                words, k = raw.split(), half(raw)
                own, other = tags[k].number(words), tags[1 - k].number(words)
                at = np.flatnonzero(own | other)
                if words:
                    strong = [y > 0 and float(tags[k].values[i].max()) >= STRONG for i in own[at].tolist()]
                    out.append({"n": len(words), "at": at.tolist(), "x": np.concatenate([tags[1 - k].values[i] for i in other[at].tolist()]) if len(at) else [], "y": strong})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("n", pa.int64()), ("at", pa.list_(pa.int64())), ("x", pa.list_(pa.float64())), ("y", pa.list_(pa.bool_()))]))

    got = []
    for r in rows.mapInArrow(chains, "n long, at array<long>, x array<double>, y array<boolean>").collect():
        got.append((r["n"], np.array(r["at"], np.int64), np.array(r["x"], float).reshape(-1, 1 + len(BEGINNINGS)), np.array(r["y"], np.int64)))
    if not any(c[3].any() for c in got):
        return Model()
    model.weights, model.trans = fit_chain(got)
    shared = spark.sparkContext.broadcast(model)

    @C.tidy
    def sums(batches):
        C.release()
        tag = Tagger(shared.value)
        for b in batches:
            got = [tag.document(t.as_py())[:3] for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.int64()), b.column(1)], names=["top", "total", "tokens", "toxic"])

    # the sample is bounded; sorted, its sums round alike in every run
    d = np.array(sorted(tuple(r) for r in rows.mapInArrow(sums, "top double, total double, tokens long, toxic int").collect()), float)
    model.curve = fit_curve(d[:, 0], d[:, 1], d[:, 2], (d[:, 3] > 0).astype(float))
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, largest marginal, expected toxic tokens, and the offending spans in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @C.tidy
    def run(batches):
        C.release()
        tag = Tagger(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                out = []
                for t in part.column(1):
                    top, total, tokens, at, p = tag.document(text := t.as_py())
                    out.append((tag.score(top, total, tokens), top, total, *spans(text or "", at, p)))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), list(RESULT)[1:], strict=True))], schema=RESULT)

    return C.texts(docs).mapInArrow(run, C.schema(RESULT))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that score below one half: all columns as they were, in one pass and without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    @C.tidy
    def run(batches):
        C.release()
        tag = Tagger(shared.value)
        for batch in batches:
            keep = [tag.score(*tag.document(None if t.as_py() is None else str(t.as_py()))[:3]) < 0.5 for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
