"""The bigram model against a direct implementation of its formulas."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from veilspark.llm import kneser_ney as kn


def tokens(text):
    return re.findall("[^ \t-\r]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")) + ["\n"]


class Direct:
    def __init__(self, texts):
        self.uni, self.big = Counter(), Counter()
        for text in texts:
            words = tokens(text)
            self.uni.update(words)
            self.big.update(zip(["<s>", *words], words))
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.cont = Counter(w for _, w in self.big)
        levels = lambda c: [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
        self.d2, self.d1 = kn.discounts(*levels(self.big)), kn.discounts(*levels(self.cont))
        self.after = defaultdict(list)
        for (v, _), c in self.big.items():
            self.after[v].append(c)

    def cut(self, d, c):
        return d[min(c, 3) - 1] if c else 0.0

    def p1(self, w):
        total = sum(self.cont.values())
        if not total:
            return 1 / (self.v + 1)
        free = sum(self.cut(self.d1, c) for c in self.cont.values())
        return (self.cont[w] - self.cut(self.d1, self.cont[w]) + free / (self.v + 1)) / total

    def p2(self, v, w):
        if not self.after.get(v):
            return self.p1(w)
        c, total = self.big[v, w], sum(self.after[v])
        return (c - self.cut(self.d2, c) + sum(self.cut(self.d2, x) for x in self.after[v]) * self.p1(w)) / total

    def score(self, text):
        words = tokens(text)
        known = [w if w in self.uni else None for w in words]
        base = sum(math.log10((self.uni[w] + 1) / (self.n + self.v + 1)) for w in words)
        model = sum(math.log10(self.p2(v, w)) for v, w in zip(["<s>", *known], known))
        return len(words), sum(w is not None for w in known), self.n, base, model


def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{i}é" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    texts = [" ".join(rng.choices(vocabulary, weights, k=rng.choice([0, 1, 7, 60, 400]))) for _ in range(150)]
    return texts + [None, "", "The THE the", "never seen words here", "w0é " * 20_000]


def test_scores(spark, monkeypatch):
    texts = corpus()
    rows = [(i % 140 if i % 9 else None, t, i, i % 7 == 2, "b") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, out boolean, block string").repartition(4)
    direct = Direct([t for t, r in zip(texts, rows) if not r[3]])
    got = sorted(map(tuple, kn.score_texts(df, F.col("out")).collect()), key=repr)
    want = sorted([(r[0], r[3], *direct.score(r[1])) for r in rows], key=repr)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2], r[5])),
                    sorted(want, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2], r[5]))):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-5, abs=1e-4)
    held = [(g[5], g[6]) for g in got if g[1] and g[2] > 20]
    assert sum(m for _, m in held) > sum(b for b, _ in held) * 1.05


def test_probabilities_add_up():
    direct = Direct([t for t in corpus() if t])
    for context in ("<s>", "w0é", "w399é", "unseen"):
        assert sum(direct.p2(context, w) for w in [*direct.uni, None]) == pytest.approx(1)


def test_no_training_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in kn.score_texts(df, F.lit(True)).collect()}
    assert got[1].n_tokens == 3 and got[2].n_tokens == 1
    assert all(r.n_known == r.train_tokens == 0 and r.base_score == r.score == 0 for r in got.values())
    assert kn.score_texts(df.limit(0), F.lit(False)).count() == 0
