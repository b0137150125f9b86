"""The fit of the chain on whole texts."""

import random

import numpy as np

from quillspan.llm import toxicity


def on_every_token(chains, rounds):
    """The same fit with a step for each token, by differences of the likelihood."""
    def likelihood(theta):
        w, t, total = theta[:-4], np.exp(theta[-4:].reshape(2, 2)), 0.0
        for n, at, x, y in chains:
            whole, labels = np.zeros((n, x.shape[1])), np.zeros(n, int)
            whole[at], labels[at] = x, y
            force = np.exp(np.stack([np.zeros(n), w[0] + whole @ w[1:]], axis=1))
            a, path = force[0], force[0][labels[0]]
            for i in range(1, n):
                a, path = (a @ t) * force[i], path * t[labels[i - 1], labels[i]] * force[i][labels[i]]
            total += np.log(path / a.sum())
        return total

    size = 1 + chains[0][2].shape[1] + 4
    theta, tokens = np.concatenate([[-2.0], np.full(size - 5, 0.3), np.zeros(4)]), sum(c[0] for c in chains)
    m, v = np.zeros(size), np.zeros(size)
    for step in range(1, rounds + 1):
        grad = np.array([(likelihood(theta + e) - likelihood(theta - e)) / 2e-5 for e in np.eye(size) * 1e-5]) / tokens * 50 - 1e-3 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + 0.5 / (1 + step / 50) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta


def test_fit_sees_every_token():
    r = np.random.default_rng(4)
    chains = []
    for n, at in ((1, []), (7, []), (1, [0]), (6, [0, 1, 5]), (9, [3]), (12, [2, 3, 7, 11]), (5, [4]), (8, [0])):
        x = r.uniform(0, 4, (len(at), 2))
        chains.append((n, np.array(at, np.int64), x, (x.max(axis=1, initial=0) > 2.5).astype(int)))
    weights, trans = toxicity.fit_chain(chains, rounds=8)
    assert np.allclose(np.concatenate([weights, trans.ravel()]), on_every_token(chains, 8), atol=1e-4)


def test_toxic_words_far_into_a_text(spark):
    """The first word with a feature is a mild one; the strong ones stand more than 64 tokens after it."""
    r = random.Random(9)
    vocab = [f"{a}{b}{c}" for a in "bdfgkl" for b in "aeiou" for c in "nrst"]
    rows = []
    for i in range(600):
        ws = [r.choice(vocab) for _ in range(160)]
        if i % 6 == 0 or i % 24 == 1:
            ws[0] = "meh"
        if i % 6 == 0:
            ws[r.randrange(100, 160)] = r.choice(["scumbag", "losers"])
        rows.append((i, " ".join(ws)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert model.odds["w:meh"] < toxicity.STRONG < model.odds["w:scumbag"]
    got = {x["doc_id"]: x["score"] for x in toxicity.scored(docs, model).collect()}
    assert sum((got[i] >= 0.5) == (i % 6 == 0) for i in got) / len(got) > 0.97


def test_gaps_of_any_length_are_exact():
    """A step for each token gives the marginals that powers of one matrix give, over gaps of thousands of tokens too."""
    r = np.random.default_rng(8)
    model = toxicity.Model({"w:bad": 2.5, "w:poor": 1.0}, np.array([-0.4, 1.1, 0.0, 0.0, 0.0]), np.array([[0.3, -0.9], [-0.7, 0.8]]))
    tag = toxicity.Tagger(model)
    words = [b"calm"] * 9000
    for i in (3, 2900, 2901, 8000):
        words[i] = r.choice([b"bad", b"poor"])
    at, p = tag.marginals(tag.number(words))
    force = np.ones((len(words), 2))
    force[:, 1] = [np.exp(model.weights[0] + model.weights[1] * model.odds.get(f"w:{w.decode()}", 0.0)) for w in words]
    step, a, b = np.exp(model.trans), np.empty_like(force), np.ones_like(force)
    a[0] = force[0] / force[0].sum()
    for i in range(1, len(words)):
        a[i] = (a[i - 1] @ step) * force[i]
        a[i] /= a[i].sum()
    for i in range(len(words) - 2, -1, -1):
        b[i] = step @ (force[i + 1] * b[i + 1])
        b[i] /= b[i].sum()
    whole = a * b
    assert at.tolist() == [3, 2900, 2901, 8000] and np.allclose(p, (whole[:, 1] / whole.sum(1))[at], atol=1e-9)
