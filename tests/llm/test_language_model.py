import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from webloom.llm import language_model as lm
from webloom.llm.text import word_chunks

from .cases import awkward, empty


def words(t):
    if not t:
        return []
    return [h for _, w in word_chunks(pa.array([t])) for h in w.hashes.tolist()]


class Brute:
    """The model by dictionaries."""

    def __init__(self, texts):
        c3 = Counter()
        for t in texts:
            ws = words(t)
            if ws:
                s = ["<s>", "<s>", *ws, "</s>"]
                c3.update(zip(s, s[1:], s[2:]))
        left2, left1 = Counter(), Counter()
        for (u, v, w), n in c3.items():
            left2[v, w] += n if u == v == "<s>" else 1
        for v, w in left2:
            left1[w] += 1
        self.d = [lm.discounts([sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]) for c in (left1, left2, c3)]
        self.c = (left1, left2, c3)
        self.follow = [defaultdict(list) for _ in range(3)]
        for k, c in enumerate(self.c):
            for g, n in c.items():
                self.follow[k][() if k == 0 else g[:-1]].append(n)

    def p(self, g):
        k = len(g) - 1
        if k == 0:
            below, counts, n, key = 1 / (len(self.c[0]) + 1), self.follow[0][()], self.c[0].get(g[0], 0), ()
        else:
            below, counts, n = self.p(g[1:]), self.follow[k].get(g[:-1], []), self.c[k].get(g, 0)
        if not counts:
            return below
        d = self.d[k]
        return (max(n - d[min(n, 3)], 0) + sum(d[min(x, 3)] for x in counts) * below) / sum(counts)

    def score(self, t):
        s = ["<s>", "<s>", *words(t), "</s>"]
        return sum(math.log(self.p(g)) for g in zip(s, s[1:], s[2:]))


def texts(seed, n=120, vocabulary=30):
    r = random.Random(seed)
    weights = [1 / (k + 1) for k in range(vocabulary)]
    out = [" ".join(r.choices([f"w{k}" for k in range(vocabulary)], weights, k=r.randrange(1, 60))) for _ in range(n)]
    return [*out, *out[:5], "w0 " * 400, *["w1 w2 w3"] * 300]


@pytest.mark.parametrize("seed,count_words", [(1, 4_000_000), (2, 200)])
def test_equals_dictionaries(spark, monkeypatch, seed, count_words):
    monkeypatch.setattr(lm, "COUNT_WORDS", count_words)
    train, held = texts(seed), [*texts(seed + 10, 20, 45), "never seen words", "w0", "w1 w0 w0 zzz w0"]
    model = lm.train(spark.createDataFrame([(i, t) for i, t in enumerate(train)], "doc_id bigint, text string"))
    brute = Brute(train)
    assert model["words"] == len(brute.c[0])
    for got, want in zip(model["d"], brute.d):
        np.testing.assert_allclose(got, want)
    for r in lm.score(spark.createDataFrame([(i, t) for i, t in enumerate(train[:40] + held)], "doc_id bigint, text string"), model).collect():
        want = brute.score((train[:40] + held)[r.doc_id])
        assert r.log_prob == pytest.approx(want, rel=1e-9)
        assert r.perplexity == pytest.approx(math.exp(-want / r.n_tokens))


def test_pairs_and_followers_are_told_apart():
    """Contexts by a bijection, and a million followers of one context each by itself."""
    for bits in (1, 3, 5):
        a, b = (x.ravel() for x in np.meshgrid(np.arange(1 << bits), np.arange(1 << bits)))
        assert sorted(lm.pair(a, b, bits).tolist()) == list(range(1 << 2 * bits))
    a = np.random.default_rng(0).integers(0, 1 << 32, (2, 100_000), np.uint32)
    assert len(np.unique(lm.pair(a[0], a[1], 32))) == len(np.unique(a, axis=1).T)


@pytest.mark.parametrize("bits", [20, 21, 22, 32])
def test_a_context_of_many_followers(tmp_path, bits):
    place, n = f"file://{tmp_path}", 1_000_000
    r = np.random.default_rng(bits)
    words = np.sort(r.choice((1 << bits) - 8 if bits < 32 else 1 << 31, n, replace=False).astype(np.uint32) + np.uint32(lm.FIRST))
    known, others = words[::2], words[1::2]
    u, v = np.uint32(lm.FIRST), np.uint32(lm.FIRST + 1)
    tok = np.empty(5 * len(known), np.uint32)  # a text of each: BOS, u, v, word, EOS
    tok[0::5], tok[1::5], tok[2::5], tok[3::5], tok[4::5] = lm.BOS, u, v, known, lm.EOS
    blobs = lm.trigram_blobs(tok, np.arange(0, len(tok) + 1, 5), 1, bits)
    lm.add_trigrams([b for _, b in blobs], place, 0, 1, bits)
    at, there = lm.find(place, 0, lm.pair(np.array([u]), np.array([v]), bits), bits)
    assert there.all()
    each = [lm._wide(place, f"ctx-0-{k}", at)[0] for k in ("n1", "n2", "n3")]
    assert each == [len(known), 0, 0]
    k = int(at[0])
    block = k // lm._BLOCK * lm._BLOCK
    start = lm.mapped(place, "ctx-0-first")[k // lm._BLOCK] + sum(lm._wide(place, f"ctx-0-{x}", np.arange(block, k)).sum() for x in ("n1", "n2", "n3"))
    look = lambda w: lm.followers(place, np.zeros(len(w), np.int64), np.full(len(w), start), np.full(len(w), len(known)), w)
    assert (look(known) == 1).all() and not look(others).any()


def test_probabilities_add_up_to_one(spark):
    train = texts(3)
    model = lm.train(spark.createDataFrame([(t,) for t in train], "text string"))
    vocabulary = [f"w{k}" for k in range(30)]
    for context in ("w0 w1", "w2 w0", "zzz w3"):
        docs = [f"{context} {w}" for w in [*vocabulary, "unknown"]]
        tok = [next(lm.tokens(w, model["known"])[0] for _, w in word_chunks(pa.array([d]))) for d in docs]
        total = 0.0
        for t in tok:
            logs, _ = lm.log_probs(model, t, np.array([0, len(t)]))
            total += math.exp(logs[2])
        end = next(lm.tokens(w, model["known"])[0] for _, w in word_chunks(pa.array([context])))
        total += math.exp(lm.log_probs(model, end, np.array([0, len(end)]))[0][2])
        assert total == pytest.approx(1.0)


def test_awkward_tables(spark):
    docs = awkward(spark)
    got = lm.score(docs, lm.train(docs)).collect()
    assert len(got) == docs.count()
    assert got[0].perplexity > 1 and len({(r.log_prob, r.perplexity) for r in got if r.doc_id == 1}) == 1
    assert {(r.n_tokens, r.log_prob, r.perplexity) for r in got if r.doc_id in (2, 3, 5)} == {(0, 0.0, None)}
    none = lm.train(empty(spark))
    assert lm.score(empty(spark), none).count() == 0
    assert lm.score(docs, none).where("doc_id = 1").first().perplexity == pytest.approx(1.0)
