"""A generalised additive model with pairwise interactions as quality classifier.

Each feature is cut into quantile bins.  Cyclic boosting visits the features in turn and fits a
shallow tree over the bins to what is still unexplained; the trees of a feature add up to one
lookup table.  Then the pairs of features that explain most of the rest are boosted the same way
into two-way tables.  Scoring adds table entries by bin, vectorised, and applies the logistic
function.

Features come from the text alone, through DataFrame functions.  Null and empty texts have
feature values of an empty text and get a score like any other row.  Training rows without a
label are left out; with no rows, or labels of one kind, the model is a constant.  Equal feature
values share a bin.  Repeated rows weigh as often as they occur; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.quality_rules import CAPITALS, GAP
from tramline.llm.shared import BLANKS, let

#: Labelled rows that a model is fitted on at most (chosen by hash): the bound of what the driver holds.
TRAIN_ROWS = 20_000
FEATURES = ("log_words", "word_length", "symbols", "bars", "capitals", "bangs", "digits", "stops", "line_repeats", "distinct_words")


def features(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    count = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    chars = F.length(F.translate(text, BLANKS, ""))
    words = let(
        F.btrim(text, F.lit(BLANKS)),
        lambda t: F.when(t == "", F.struct(F.lit(0).alias("n"), F.lit(0).alias("u"))).otherwise(let(F.split(t, GAP, -1), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("u")))),
    )
    lines = let(F.split(text, "\n", -1), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("u")))
    raw = {"words": words, "lines": lines, "chars": chars, "symbols": count("#*$%&<>^~@{}"), "bars": count("|"), "capitals": count(CAPITALS), "bangs": count("!?"), "digits": count("0123456789"), "stops": count(".,;:")}
    return raw


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the features, one row a document."""
    kept = docs.select(F.col(id_col), *(c.alias(f"__{k}") for k, c in features(F.col(text_col)).items()))
    n, c = F.greatest(F.col("__words.n"), F.lit(1)), F.greatest(F.col("__chars"), F.lit(1))
    made = {
        "log_words": F.log1p(F.col("__words.n")),
        "word_length": F.col("__chars") / n,
        "symbols": F.col("__symbols") / n,
        "bars": F.col("__bars") / n,
        "capitals": F.col("__capitals") / c,
        "bangs": F.col("__bangs") / n,
        "digits": F.col("__digits") / c,
        "stops": F.col("__stops") / n,
        "line_repeats": 1 - F.col("__lines.u") / F.col("__lines.n"),
        "distinct_words": F.col("__words.u") / n,
    }
    return kept.select(id_col, *(v.cast("double").alias(k) for k, v in made.items()))


@dataclass
class AdditiveModel:
    names: tuple[str, ...]
    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1) if self.edges else np.zeros((len(x), 0), int)

    def logit(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for k, t in enumerate(self.tables):
            out += t[bins[:, k]]
        for (a, b), t in self.pairs.items():
            out += t[bins[:, a], bins[:, b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(self.bins(x)), -40, 40)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float = 1.0) -> np.ndarray:
    """Newton steps by bin of a tree with so many leaves, grown greedily over ordered bins."""
    cg, ch = np.concatenate([[0], g.cumsum()]), np.concatenate([[0], h.cumsum()])
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    cuts = [0, len(g)]
    while len(cuts) <= leaves:
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                m = np.arange(a + 1, b)
                gain = worth(a, m) + worth(m, b) - worth(a, b)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], int(m[k]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _pair_step(g: np.ndarray, h: np.ndarray, shape: tuple[int, int], ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """The best tree of one cut in each feature (four leaves), and its gain."""
    cum = lambda v: np.pad(v.reshape(shape).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    cg, ch = cum(g), cum(h)
    i, j = np.arange(1, shape[0])[:, None], np.arange(1, shape[1])[None, :]
    if not i.size or not j.size:
        return np.zeros(shape), 0.0
    part = lambda c: (c[i, j], c[i, -1] - c[i, j], c[-1, j] - c[i, j], c[-1, -1] - c[i, -1] - c[-1, j] + c[i, j])
    pg, ph = part(cg), part(ch)
    gain = sum(a * a / (b + ridge) for a, b in zip(pg, ph, strict=True))
    at = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty(shape)
    v = [float(np.broadcast_to(a, gain.shape)[at] / (np.broadcast_to(b, gain.shape)[at] + ridge)) for a, b in zip(pg, ph, strict=True)]
    x, y = at[0] + 1, at[1] + 1
    out[:x, :y], out[:x, y:], out[x:, :y], out[x:, y:] = v
    return out, float(gain[at])


def fit(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = FEATURES, max_bins: int = 32, rounds: int = 120, leaves: int = 3, rate: float = 0.15, n_pairs: int = 6, pair_rounds: int = 60) -> AdditiveModel:
    """Cyclic boosting on at most ``TRAIN_ROWS`` rows (see ``train``)."""
    m = AdditiveModel(names)
    if len(y) == 0 or y.min() == y.max():
        m.base = 0.0 if len(y) == 0 else (6.0 if y[0] else -6.0)
        return m
    share = y.mean()
    m.base = float(np.log(share / (1 - share)))
    for k in range(x.shape[1]):
        edges = np.unique(np.quantile(x[:, k], np.linspace(0, 1, max_bins + 1)[1:-1]))
        positive = np.unique(x[x[:, k] > 0, k])
        if len(positive):  # a feature that is mostly zero still needs its positive values parted from zero
            edges = np.unique(np.concatenate([edges, [positive[0]], np.quantile(positive, [0.25, 0.5, 0.75])]))
        m.edges.append(edges)
    bins = m.bins(x)
    size = [len(e) + 1 for e in m.edges]
    m.tables = [np.zeros(s) for s in size]
    f = np.full(len(y), m.base)
    for _ in range(rounds):
        for k in range(x.shape[1]):
            p = 1 / (1 + np.exp(-f))
            step = rate * _tree(np.bincount(bins[:, k], y - p, size[k]), np.bincount(bins[:, k], p * (1 - p), size[k]), leaves)
            m.tables[k] += step
            f += step[bins[:, k]]
    p = 1 / (1 + np.exp(-f))
    codes = {(a, b): bins[:, a] * size[b] + bins[:, b] for a, b in combinations(range(x.shape[1]), 2)}
    held = lambda ab: (size[ab[0]], size[ab[1]])
    gains = {ab: _pair_step(np.bincount(c, y - p, np.prod(held(ab))), np.bincount(c, p * (1 - p), np.prod(held(ab))), held(ab))[1] for ab, c in codes.items()}
    for ab in sorted(gains, key=gains.get)[::-1][:n_pairs]:
        m.pairs[ab] = np.zeros(held(ab))
    for _ in range(pair_rounds):
        for ab in m.pairs:
            p = 1 / (1 + np.exp(-f))
            step = rate * _pair_step(np.bincount(codes[ab], y - p, np.prod(held(ab))), np.bincount(codes[ab], p * (1 - p), np.prod(held(ab))), held(ab))[0]
            m.pairs[ab] += step
            f += step.reshape(-1)[codes[ab]]
    return m


def train(table: DataFrame, labels: DataFrame, id_col: str, label_col: str, max_rows: int = TRAIN_ROWS) -> AdditiveModel:
    """Fit on the labelled rows of a feature table, at most ``max_rows`` of them, chosen by a hash of the id.

    The chosen labels are at most ``max_rows`` narrow rows; only they and their features reach the driver.
    """
    lab = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).filter("__id IS NOT NULL AND __y IS NOT NULL")
    chosen = lab.orderBy(F.xxhash64("__id"), "__id", "__y").limit(max_rows)
    rows = table.join(F.broadcast(chosen), F.col(id_col) == F.col("__id")).select("__id", "__y", *FEATURES)
    got = rows.orderBy("__id", "__y").limit(max_rows).toPandas()
    return fit(got[list(FEATURES)].to_numpy(float), got["__y"].to_numpy(float))


def score(table: DataFrame, model: AdditiveModel, id_col: str = "doc_id", as_col: str = "score") -> DataFrame:
    """The id and the score of every row of a feature table."""
    sent = table.sparkSession.sparkContext.broadcast(model)
    kind = dict(table.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for b in batches:
            yield pd.DataFrame({"id": b[id_col], "score": m.score(b[list(FEATURES)].to_numpy(float))})

    return table.select(id_col, *FEATURES).mapInPandas(run, f"id {kind}, score double").toDF(id_col, as_col)
