"""SimHash near-duplicates: a binary-trie self-join of the distinct fingerprints.

Two fingerprints at Hamming distance <= b agree on one of b + 1 blocks of their bits (b is 2 where
nothing else is asked for).  So each goes to b + 1 buckets, one for each block's value, and every
bucket holds the trie of its fingerprints.  The self-join walks pairs of trie nodes together, adds up the bits in which the
paths differ, and drops a pair as soon as the sum exceeds the budget.  A bucket with too many
distinct fingerprints is split by the same argument over the bits that are left, twice at most;
after that its size is bounded by the bits left.  A bucket returns a spanning forest of its
links; forests join into components.

Only distinct fingerprints are joined, so copies cost nothing.  Null and word-less texts have
fingerprint zero and link like any other.  ``component_id`` is the smallest non-null id of the
component (null if there is none); repeated rows are returned as often as they came; an empty
table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.components import components
from tramline.llm.shared import numbered, one_of_each, written

BUDGET = 2
SHINGLE = 3
#: Distinct fingerprints that a bucket may hold before it is split further.
BUCKET = 100_000
#: Fingerprints joined at once in a task, and node pairs walked at once.
BATCH, FRONTIER = 200_000, 400_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles (XXH64, seed 42), repeats included."""
    w = (text or "").encode().translate(LOWER).split()
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = [b" ".join(w)] if len(w) < shingle else map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False))
    return majority(np.fromiter((digest(x, 42) for x in joined), np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[a : a + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, fp (the fingerprint's bits as a long)."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b["text"]], np.uint64)
            yield pd.DataFrame({"id": b["id"], "fp": fp.view(np.int64)})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, fp long")


def _blocks(bits: Column, width: int, parts: int) -> tuple[list[tuple[Column, Column]], int]:
    """(block value, the other bits) of the lowest ``width`` bits in ``parts`` blocks, and how many others there are at most."""
    edges = [k * width // parts for k in range(parts + 1)]
    mask = lambda n: F.lit(-1 if n >= 64 else (1 << n) - 1).cast("long")
    out = []
    for a, b in zip(edges, edges[1:], strict=False):
        value = F.shiftrightunsigned(bits, a).bitwiseAND(mask(b - a))
        above = F.shiftrightunsigned(bits, b).bitwiseAND(mask(width - b)) if b < width else F.lit(0).cast("long")
        out.append((value, F.shiftleft(above, a).bitwiseOR(bits.bitwiseAND(mask(a)))))
    return out, width - min(b - a for a, b in zip(edges, edges[1:], strict=False))


def _spread(rows: DataFrame, width: int, parts: int) -> tuple[DataFrame, int]:
    """``parts`` rows for each: the bucket key grows by (block, value), ``rest`` keeps the other bits."""
    blocks, left = _blocks(F.col("rest"), width, parts)
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), v.alias("v"), r.alias("r")) for k, (v, r) in enumerate(blocks))))
    out = rows.select("fp", "key", each.alias("e"))
    return out.select("fp", F.concat("key", F.array(F.col("e.k").cast("long"), F.col("e.v"))).alias("key"), F.col("e.r").alias("rest")), left


def buckets(distinct: DataFrame, budget: int = BUDGET, most: int = BUCKET) -> DataFrame:
    """fp, key: every fingerprint in its buckets; those beyond ``most`` are split by their other bits."""
    rows, width = distinct.select("fp", F.array().cast("array<long>").alias("key"), F.col("fp").alias("rest")), 64
    done = []
    for level in range(3):
        rows, width = _spread(rows, width, budget + 1)
        if level == 2:
            break
        full = written(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("key"), "full-buckets")
        if full.isEmpty():
            break
        done.append(rows.join(full, "key", "left_anti").select("fp", "key"))
        rows = rows.join(full, "key", "left_semi").select("fp", "key", "rest")
    out = rows.select("fp", "key")
    for d in done:
        out = out.unionByName(d)
    return out


def _split(lo: np.ndarray, hi: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return hi - (ones[hi] - ones[lo])


def trie_links(fps: np.ndarray, bounds: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """Links inside the ranges ``bounds`` of ``fps`` (each sorted and distinct), as a spanning forest of places.

    A trie node is a range of sorted fingerprints.  Pairs of nodes go down level by level; a pair
    whose paths differ in more than ``budget`` bits is dropped, small pairs are compared outright.
    """
    n = len(fps)
    ones = [np.concatenate([[0], np.cumsum((fps >> np.uint64(b)) & np.uint64(1), dtype=np.int32)]).astype(np.int32) for b in range(64)]
    root = np.arange(n)

    def join(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal root
        while len(a):
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up

    def leaves(a0, a1, b0, b1) -> None:
        size = (a1 - a0) * (b1 - b0)
        which = np.repeat(np.arange(len(size)), size)
        k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        w = (b1 - b0)[which]
        i, j = a0[which] + k // w, b0[which] + k % w
        ok = (i < j) & (np.bitwise_count(fps[i] ^ fps[j]) <= budget)
        join(i[ok], j[ok])

    def walk(a0, a1, b0, b1, diff, bit) -> None:
        while len(a0):
            small = (a1 - a0) * (b1 - b0) <= 16
            if small.any() or bit < 0:
                small = small | (bit < 0)
                leaves(a0[small], a1[small], b0[small], b1[small])
                a0, a1, b0, b1, diff = (x[~small] for x in (a0, a1, b0, b1, diff))
            if not len(a0):
                return
            if len(a0) > FRONTIER:
                half = len(a0) // 2
                for s in (slice(None, half), slice(half, None)):
                    walk(a0[s], a1[s], b0[s], b1[s], diff[s], bit)
                return
            am, bm = _split(a0, a1, ones[bit]), _split(b0, b1, ones[bit])
            same = a0 == b0
            new = [(a0, am, b0, bm, diff), (am, a1, bm, b1, diff), (a0, am, bm, b1, diff + 1)]
            other = ~same
            new.append((am[other], a1[other], b0[other], bm[other], diff[other] + 1))
            a0, a1, b0, b1, diff = (np.concatenate(x) for x in zip(*new, strict=True))
            live = (a1 > a0) & (b1 > b0) & (diff <= budget)
            live &= ~((a0 == b0) & (a1 - a0 < 2))
            a0, a1, b0, b1, diff = (x[live] for x in (a0, a1, b0, b1, diff))
            bit -= 1

    start, end = bounds[:-1], bounds[1:]
    walk(start, end, start, end, np.zeros(len(start), np.int64), 63)
    child = np.flatnonzero(root != np.arange(n))
    return np.stack([child, root[child]], 1)


def link_fingerprints(fps: DataFrame, budget: int = BUDGET, most: int = BUCKET) -> DataFrame:
    """u, v: fingerprints that link, as spanning forests of the buckets; at most ``budget`` + 1 rows each."""
    placed = buckets(fps.select("fp").distinct(), budget, most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, held, count = [], [], 0

        def flush() -> pd.DataFrame:
            key, fp = np.concatenate(keys), np.concatenate(held).view(np.uint64)
            starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            links = trie_links(fp, starts, budget)
            return pd.DataFrame({"u": fp[links[:, 0]].view(np.int64), "v": fp[links[:, 1]].view(np.int64)})

        for b in batches:
            key, fp = b["k"].to_numpy(object), b["fp"].to_numpy(np.int64)
            if count >= BATCH:  # finish at the last bucket that has ended
                if (cut := np.flatnonzero(key != keys[-1][-1])).size:
                    keys.append(key[: cut[0]])
                    held.append(fp[: cut[0]])
                    yield flush()
                    keys, held, count, key, fp = [], [], 0, key[cut[0] :], fp[cut[0] :]
            keys.append(key)
            held.append(fp)
            count += len(key)
        if count:
            yield flush()

    rows = placed.select("fp", F.array_join(F.col("key").cast("array<string>"), ":").alias("k"))
    flipped = F.col("fp").bitwiseXOR(F.lit(-(1 << 63)))  # sorts as unsigned
    return rows.repartition("k").sortWithinPartitions("k", flipped).mapInPandas(run, "u long, v long")


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, most: int = BUCKET) -> DataFrame:
    """Every row's id, fingerprint (16 hex digits) and component_id."""
    fps = written(fingerprints(docs, id_col, text_col), "fingerprints")
    least = fps.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(link_fingerprints(fps, budget, most)).select(F.col("node").alias("fp"), "root")
    linked = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(ids, "root").select("fp", "component_id")
    out = fps.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    return out


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """One row of each group: that with the smallest id, of those the first; rows without an id come last."""
    rows, number = numbered(docs)
    roots = group(rows.select(number, text_col), number, text_col, budget).select(F.col(number).alias("row"), F.col("component_id").alias("root"))
    return one_of_each(rows, number, roots, id_col)
