"""Benchmark decontamination by suffix arrays over the training texts.

Texts are lower-cased (A-Z) and cut into words.  Each shard, some megabytes of documents, gets a
word suffix array: the sorted places from which a test suffix could match, which leaves out only
places whose first two words begin no test suffix.  Every test suffix is binary-searched in
every shard; the entries between its lower and upper bound are the verbatim matches, and matches
that continue each other join into the longest ones with their locations.

The test set is read in blocks of bounded size, written to the shared folder; a task holds one
block and one shard at a time, so neither side is broadcast or collected whole.

Null or empty texts have no words and cannot match.  Items with the same id count once; items
without an id still contaminate but are not listed.  Repeated documents are judged one by one.
With an empty test set nothing is contaminated.  Other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.shared import filesystem, work_path

WINDOW = 13
#: UTF-8 bytes of test texts in one block, and of documents in one shard.
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 1 << 20
#: Bytes of words stay (digits, a-z, all above ASCII), A-Z are lowered, the rest becomes a space.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


class TestBlock:
    """The suffixes of some test items, by window: word ids, ready to be searched for."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW) -> None:
        texts = [(i, w) for i, w in ((i, words_of(t)) for i, t in items) if w]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for _, ws in texts for w in ws}))}
        rows, lens, item, place = [], [], [], []
        self.item_ids = [i for i, _ in texts]
        for k, (_, ws) in enumerate(texts):
            ids = [self.vocabulary[w] for w in ws]
            n = min(window, len(ids))
            for p in range(len(ids) - n + 1):
                rows.append(ids[p : p + n] + [0] * (window - n))
                lens.append(n)
                item.append(k)
                place.append(p)
        low = np.array(rows, ">u4").reshape(-1, window)
        self.lens, self.item, self.place = np.array(lens, np.int64), np.array(item, np.int64), np.array(place, np.int64)
        high = low.copy()
        high[np.arange(window)[None, :] >= self.lens[:, None]] = 0xFFFFFFFF
        self.low, self.high = _keys(low), _keys(high)
        size = np.int64(len(self.vocabulary) + 1)
        first = low.astype(np.int64)
        self.pairs = np.unique(first[self.lens > 1, 0] * size + first[self.lens > 1, 1]) if len(rows) and window > 1 else np.zeros(0, np.int64)
        self.single = np.unique(first[self.lens == 1, 0]) if len(rows) else np.zeros(0, np.int64)
        self.window, self.size = window, size


def _keys(rows: np.ndarray) -> np.ndarray:
    rows = np.ascontiguousarray(rows)
    return rows.view(f"S{4 * rows.shape[1]}").reshape(-1) if len(rows) else np.zeros(0, f"S{4 * rows.shape[1]}")


def _member(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_set, values)
    return sorted_set[np.minimum(at, len(sorted_set) - 1)] == values


class Shard:
    """The word suffix array of some documents, for the words of one test block."""

    def __init__(self, docs: list[list[bytes]], block: TestBlock) -> None:
        get = block.vocabulary.get
        self.starts = np.cumsum([0] + [len(d) + 1 for d in docs])
        ids = np.zeros(int(self.starts[-1]) + block.window, np.int64)
        for s, d in zip(self.starts[:-1].tolist(), docs, strict=True):
            if d:
                ids[s : s + len(d)] = np.fromiter((get(w, 0) for w in d), np.int64, len(d))
        at = np.flatnonzero(ids[:-1])
        begins = _member(ids[at] * block.size + ids[at + 1], block.pairs) | _member(ids[at], block.single)
        at = at[begins]
        keys = _keys(ids[at[:, None] + np.arange(block.window)].astype(">u4"))
        order = np.argsort(keys, kind="stable")
        self.suffixes, self.keys = at[order], keys[order]

    def search(self, block: TestBlock) -> tuple[np.ndarray, np.ndarray]:
        """(place in the shard, row of the block) of every match of a test suffix's window."""
        low, high = np.searchsorted(self.keys, block.low, "left"), np.searchsorted(self.keys, block.high, "right")
        n = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(n)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.suffixes[low[which] + inside], which


def _longest(doc: np.ndarray, place: np.ndarray, which: np.ndarray, block: TestBlock) -> list[tuple[int, int, int, int, int]]:
    """(document, item, place in item, place in document, words): matches on one diagonal that overlap are one."""
    item, at, n = block.item[which], block.place[which], block.lens[which]
    order = np.lexsort((place, place - at, item, doc))
    doc, item, place, at, n = doc[order], item[order], place[order], at[order], n[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (place[1:] - at[1:] != place[:-1] - at[:-1]) | (place[1:] > place[:-1] + n[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return list(zip(doc[first].tolist(), item[first].tolist(), at[first].tolist(), place[first].tolist(), (place[last] + n[last] - place[first]).tolist(), strict=True))


def write_blocks(tests: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> list[str]:
    """The test set as files in the shared folder; the driver holds one block at a time."""
    items = tests.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).filter("t IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    folder = work_path(tests.sparkSession, "test-blocks")
    system, path = filesystem(folder)
    system.create_dir(path, recursive=True)
    names = []
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).orderBy("i", "t").collect()
        block = TestBlock([(r.i, r.t) for r in rows], window)
        names.append(f"{folder}/{k}.block")
        with system.open_output_stream(f"{path}/{k}.block") as out:
            out.write(pickle.dumps(block, 5))
    return names


def match(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: id, n_words, n_hit (words inside a match), items (sorted), the longest matches, the columns of ``carry``.

    ``matches`` holds item, place in the item, place in the document and length, in words.
    """
    blocks = write_blocks(tests, item_col, item_text_col, window, block_bytes)
    kind = dict(docs.dtypes)[id_col]
    kinds = [(f"__{k}", dict(docs.dtypes)[c]) for k, c in enumerate(carry)]

    def load(name: str) -> TestBlock:
        system, path = filesystem(name)
        with system.open_input_stream(path) as f:
            return pickle.loads(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only = load(blocks[0]) if len(blocks) == 1 else None
        for b in batches:
            texts = b["text"].tolist()
            bounds, held = [0], 0
            for i, t in enumerate(texts):
                held += len(t or "")
                if held >= SHARD_BYTES or i == len(texts) - 1:
                    bounds.append(i + 1)
                    held = 0
            counts = np.zeros(len(texts), np.int64)
            spans: list[list[tuple[int, int]]] = [[] for _ in texts]
            found: list[list[dict]] = [[] for _ in texts]
            items: list[set] = [set() for _ in texts]
            for name in blocks:
                block = only or load(name)
                for lo, hi in zip(bounds, bounds[1:], strict=False):
                    words = [words_of(t) for t in texts[lo:hi]]
                    counts[lo:hi] = [len(w) for w in words]
                    shard = Shard(words, block)
                    place, which = shard.search(block)
                    if not len(place):
                        continue
                    doc = np.searchsorted(shard.starts, place, "right") - 1
                    for d, item, at, p, n in _longest(doc, place, which, block):
                        begin = p - int(shard.starts[d])
                        spans[lo + d].append((begin, begin + n))
                        if block.item_ids[item] is not None:
                            items[lo + d].add(block.item_ids[item])
                        found[lo + d].append({"item": block.item_ids[item], "item_at": at, "doc_at": begin, "words": n})
            yield pd.DataFrame({"id": b["id"], "n_words": counts, "n_hit": [_union(s) for s in spans], "items": [sorted(s) for s in items], "matches": [sorted(m, key=lambda r: (r["doc_at"], r["item"] or "", r["item_at"])) for m in found]} | {c: b[c] for c, _ in kinds})

    schema = f"id {kind}, n_words long, n_hit long, items array<string>, matches array<struct<item: string, item_at: long, doc_at: long, words: long>>"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.col(f"`{c}`").alias(k) for c, (k, _) in zip(carry, kinds, strict=True)))
    out = rows.mapInPandas(run, schema + "".join(f", {c} {t}" for c, t in kinds))
    return out.toDF(id_col, "n_words", "n_hit", "items", "matches", *(f"carried_{c}" if c in (id_col, "n_words", "n_hit", "items", "matches") else c for c in carry))


def clean(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns as they were."""
    row = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))
    names = [f"c{k}" for k in range(len(docs.columns))]
    flat = row.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"), *(F.col(f"__row.`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)))
    found = match(flat, tests, "__id", "__text", item_col, item_text_col, window, carry=tuple(names))
    return found.filter(~contaminated(F.col("n_hit"), F.col("n_words"))).select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))


def _union(spans: list[tuple[int, int]]) -> int:
    """Words covered by spans."""
    total, upto = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, upto))
        upto = max(upto, b)
    return total


def contaminated(n_hit, n_words):
    """At least a twentieth of the words, and at least one, lie in a match."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
