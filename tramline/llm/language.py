"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of order 0 to 2 is counted over all training texts.
Frozen, it prices every byte: the longest context that knows the byte codes it, after escapes
(method C, symbols of longer contexts excluded) from those that don't.  A text's score in a
language is its exact code length; the shortest wins.

Null texts, and texts without a letter, are ``und`` with score 0.  Equal code lengths go to the
language that sorts first.  Rows without text or language teach nothing; with nothing learned
every row is ``und``.  Repeated rows count as often as they occur; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Contexts of order 2 that a language has seen less often than this are cut from its tree.
LEAST_SEEN = 4
#: Characters that a task counts at once.
BLOCK_CHARS = 4_000_000
HAS_LETTER = "\\p{L}"


def count_contexts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """How often each language shows each 3-byte string: lang, gram, n.

    Counted over all rows, first within tasks; at most languages x 2^24 rows, and as many as
    distinct byte triples in practice.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, texts in b.groupby("lang", sort=False)["text"]:
                block, held = [], 0
                for t in [*texts, None]:
                    if block and (t is None or held > BLOCK_CHARS):
                        raw = np.frombuffer(("\0\0" + "\0\0".join(block)).encode(), np.uint8).astype(np.uint32)
                        grams = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
                        keys, n = np.unique(grams[raw[2:] != 0], return_counts=True)
                        yield pd.DataFrame({"lang": lang, "gram": keys.astype(np.int32), "n": n.astype(np.int64)})
                        block, held = [], 0
                    if t is not None:
                        block.append(t)
                        held += len(t)

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    return rows.mapInPandas(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _order0(counts: np.ndarray) -> np.ndarray:
    """Bits for each byte without context; unseen bytes share the escape evenly."""
    seen = counts > 0
    total, kinds = counts.sum(), max(1, seen.sum())
    p = np.where(seen, counts / (total + kinds), 0.0)
    unseen = (~seen).sum()
    p[~seen] = kinds / (total + kinds) / max(1, unseen)
    return p / p.sum()


def _deeper(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities one order up; rows are contexts.  Escaped mass goes to the symbols not seen here, as the order below has them."""
    seen = counts > 0
    total, kinds = counts.sum(1, keepdims=True), seen.sum(1, keepdims=True)
    rest = np.where(seen, 0.0, lower)
    left = rest.sum(1, keepdims=True)
    escape = np.where(left > 0, kinds / np.maximum(total + kinds, 1), 0.0)
    known = np.where(total > 0, (1 - escape) * counts / np.maximum(total, 1), 0.0)
    return np.where(total > 0, known + escape * rest / np.where(left > 0, left, 1), lower)


class Model:
    """Frozen prices in bits: ``prices[rows[context], byte, language]``."""

    def __init__(self, langs: list[str], rows: np.ndarray, prices: np.ndarray) -> None:
        self.langs, self.rows, self.prices = langs, rows, prices

    @classmethod
    def freeze(cls, counts: pd.DataFrame, least_seen: int = LEAST_SEEN) -> Model:
        langs = sorted(counts["lang"].unique())
        grams = counts["gram"].to_numpy(np.int64)
        seen = counts["n"].to_numpy(np.int64)
        which = np.searchsorted(langs, counts["lang"].to_numpy(object).astype(str)) if langs else np.zeros(0, int)
        context = grams >> 8
        total = np.zeros((len(langs), 65536), np.int64)
        np.add.at(total, (which, context), seen)
        kept = np.flatnonzero((total >= least_seen).any(0))
        # a row for each kept context of two bytes, then one for each last byte, used where a context was cut
        rows = (len(kept) + np.arange(65536) % 256).astype(np.int32)
        rows[kept] = np.arange(len(kept), dtype=np.int32)
        prices = np.zeros((len(kept) + 256, 256, len(langs)), np.float32)
        for k in range(len(langs)):
            own = which == k
            one = np.zeros((256, 256))
            np.add.at(one, (context[own] & 255, grams[own] & 255), seen[own])
            p1 = _deeper(one, _order0(one.sum(0))[None, :])
            two = np.zeros((len(kept), 256))
            at = rows[context[own]]
            known = (at < len(kept)) & (total[k, context[own]] >= least_seen)
            np.add.at(two, (at[known], grams[own][known] & 255), seen[own][known])
            p2 = _deeper(two, p1[kept & 255])
            prices[:, :, k] = -np.log2(np.concatenate([p2, p1]))
        return cls(langs, rows, prices)

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of each text in each language; a text starts in the context of two zero bytes."""
        out = np.zeros((len(texts), len(self.langs)))
        flat = self.prices.reshape(-1, len(self.langs))
        for i, t in enumerate(texts):
            raw = np.frombuffer(b"\0\0" + t.encode(), np.uint8).astype(np.int32)
            for a in range(0, len(raw) - 2, 1 << 20):  # blocks, so that a huge text needs little memory
                r = raw[a : a + (1 << 20) + 2]
                out[i] += flat[self.rows[r[:-2] << 8 | r[1:-1]] * 256 + r[2:]].sum(0, dtype=np.float64)
        return out


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least_seen: int = LEAST_SEEN) -> Model:
    """Count over all of ``docs``; only the distinct byte triples reach the driver."""
    return Model.freeze(count_contexts(docs, text_col, lang_col).toPandas(), least_seen)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score (the language's share of all two to the minus code length)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most 65,792 rows x 256 prices x 4 bytes = 67 MB a language
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for b in batches:
            ok = b["letter"].to_numpy(bool)
            pred, score = np.full(len(b), "und", object), np.zeros(len(b))
            if m.langs and ok.any():
                bits = m.code_lengths(b["text"][ok].tolist())
                best = bits.argmin(1)
                gap = np.minimum(bits - bits[np.arange(len(bits)), best][:, None], 1000)
                pred[ok] = np.array(m.langs, object)[best]
                score[ok] = 1 / np.exp2(-gap).sum(1)
            yield pd.DataFrame({"id": b["id"], "lang_pred": pred, "score": score})

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("letter", F.col("text").rlike(HAS_LETTER))
    return rows.mapInPandas(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
