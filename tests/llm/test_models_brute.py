"""Both models told plainly: prediction by partial matching escape by escape, the additive model as a sum of looked-up entries."""

import math
import random
from collections import Counter

import numpy as np

from tramline.llm import language, quality_model


class PlainTree:
    """Contexts of order 0 to 2 of one language, in dictionaries."""

    def __init__(self, texts, least_seen):
        self.orders = [{}, {}, {}]
        for t in texts:
            raw = b"\0\0" + t.encode()
            for i in range(2, len(raw)):
                if raw[i]:
                    for k in range(3):
                        self.orders[k].setdefault(raw[i - k : i], Counter())[raw[i]] += 1
        self.orders[2] = {c: n for c, n in self.orders[2].items() if n.total() >= least_seen}

    def probabilities(self, context, order=2):
        if order == 0:
            seen = self.orders[0].get(b"", Counter())
            total, kinds = seen.total(), max(1, len(seen))
            p = [seen[b] / (total + kinds) if seen[b] else kinds / (total + kinds) / max(1, 256 - len(seen)) for b in range(256)]
            return [x / sum(p) for x in p]
        lower = self.probabilities(context, order - 1)
        seen = self.orders[order].get(context[2 - order :])
        if not seen:
            return lower
        total, kinds = seen.total(), len(seen)
        left = sum(lower[b] for b in range(256) if not seen[b])
        escape = kinds / (total + kinds) if left > 0 else 0.0
        return [(1 - escape) * seen[b] / total if seen[b] else escape * lower[b] / left for b in range(256)]

    def bits(self, text):
        raw = b"\0\0" + text.encode()
        return sum(-math.log2(self.probabilities(raw[i - 2 : i])[raw[i]]) for i in range(2, len(raw)))


def test_code_lengths_as_told_plainly(spark):
    r = random.Random(3)
    make = lambda letters: "".join(r.choice(letters) for _ in range(r.randrange(0, 60)))
    taught = [("aa", make("abc é ")) for _ in range(12)] + [("bb", make("bcd\x00ñ ")) for _ in range(12)] + [(None, "zzz"), ("cc", None), ("dd", "x")]
    texts = ["", "a", "abc é", "dcbñ\x00b", "日本", make("abcdé") * 3]
    for least in (1, language.LEAST_SEEN):
        model = language.train(spark.createDataFrame(taught, "lang string, text string"), least_seen=least)
        assert model.langs == ["aa", "bb", "dd"]
        trees = [PlainTree([t for la, t in taught if la == lang and t is not None], least) for lang in model.langs]
        got = model.code_lengths(texts)
        want = np.array([[tree.bits(t) for tree in trees] for t in texts])
        assert np.allclose(got, want, rtol=1e-5, atol=1e-4)


def test_language_of_awkward_tables(spark):
    model = language.train(spark.createDataFrame([("aa", "abab"), ("bb", "cdcd")], "lang string, text string"))
    rows = [(1, None), (2, ""), (3, "123 ?!"), (4, "ab\x00ab"), (None, "cdc"), (4, "ab\x00ab")]
    got = [(x.doc_id, x.lang_pred, x.score > 0) for x in language.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()]
    assert got == [(1, "und", False), (2, "und", False), (3, "und", False), (4, "aa", True), (None, "bb", True), (4, "aa", True)]
    nothing = language.train(spark.createDataFrame([], "lang string, text string"))
    assert [x.lang_pred for x in language.identify(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), nothing).collect()] == ["und"]
    assert language.identify(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def plain_tree(g, h, leaves, ridge=1.0):
    """The greedy tree over ordered bins, every cut of every leaf tried by summing."""
    worth = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + ridge)
    cuts = [0, len(g)]
    while len(cuts) <= leaves:
        gains = [(worth(a, m) + worth(m, b) - worth(a, b), -m) for a, b in zip(cuts, cuts[1:], strict=False) for m in range(a + 1, b)]
        if not gains or max(gains)[0] <= 1e-9:
            break
        cuts = sorted([*cuts, -max(gains)[1]])
    return [sum(g[a:b]) / (sum(h[a:b]) + ridge) for a, b in zip(cuts, cuts[1:], strict=False) for _ in range(a, b)]


def test_trees_and_scores_as_told_plainly(spark):
    r = np.random.default_rng(4)
    for _ in range(30):
        n = int(r.integers(1, 9))
        g, h = r.normal(size=n), r.random(n)
        assert np.allclose(quality_model._tree(g, h, 3), plain_tree(g.tolist(), h.tolist(), 3))
    names = quality_model.FEATURES
    x = r.random((400, len(names)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_model.fit(x, y, rounds=10, pair_rounds=10)
    some = x[:40]
    table = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(some)], "doc_id long, " + ", ".join(f"{n} double" for n in names))
    got = {s.doc_id: s.score for s in quality_model.score(table, model).collect()}
    for i, row in enumerate(some):
        at = [sum(1 for e in edges if e <= v) for edges, v in zip(model.edges, row, strict=True)]
        logit = model.base + sum(t[k] for t, k in zip(model.tables, at, strict=True)) + sum(t[at[a], at[b]] for (a, b), t in model.pairs.items())
        assert abs(got[i] - 1 / (1 + math.exp(-logit))) < 1e-9
    assert (0, 1) in model.pairs  # only the pair tells the classes apart


def test_quality_of_awkward_labels(spark):
    texts = spark.createDataFrame([(1, "one two three."), (2, None), (3, "")], "doc_id long, text string")
    table = quality_model.feature_table(texts)
    label = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    for rows, low, high in (([], 0.49, 0.51), ([(1, 1), (2, 1)], 0.9, 1.0), ([(None, 1), (1, None)], 0.49, 0.51)):
        scored = quality_model.score(table, quality_model.train(table, label(rows), "doc_id", "quality")).collect()
        assert len(scored) == 3 and all(low <= s.score <= high for s in scored)
    assert quality_model.score(table.limit(0), quality_model.train(table, label([]), "doc_id", "quality")).count() == 0
