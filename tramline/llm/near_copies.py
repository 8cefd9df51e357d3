"""Near copies: SimHash links first, then every other link, all confirmed by exact similarity.

Texts are alike where their sets of five-word shingles have Jaccard >= 4/5.  Links are found in
steps, and only confirmed ones count:

1. The trie self-join of 64-bit SimHashes over the same shingles (``simhash``) proposes the
   closest pairs as spanning forests, and each bucket of a shared shingle proposes its members
   with its first row: as many pairs as rows, however large a group of copies is.
2. SimHash misses most pairs near the similarity (they differ in 4 to 11 bits), so in buckets whose
   rows are still in different components each row of the smaller ones is paired with the nearest
   row outside its own, which again is linear, and then, once more in what is still apart, with all
   of them.  Rows that links already join are never paired again, so no group makes all pairs.

Nothing is lost: all shingles have one order, the frequent ones last, and two sets that reach the
similarity share one of the first n - ceil(4n/5) + 1 of each (prefix filter); such a pair is in
one bucket, and is either joined by links or tested there.  A pair goes untested only if the
sizes, or the parities of the shingles in 256 cells (then in cells sized by the sets), already show more differences than
(n + m) / 9; the others are decided by their whole sets.  A pair that shares several shingles is
proposed by the first of them that both have among their first four, else by each.

Words are parted and lowered as in ``simhash``; a text of fewer words is one shingle, and all
texts without words are alike.  Equal sets are paired once for all.  A shingle is its XXH64.
Null texts are texts without words.  Rows that repeat an id are told apart by a stored number.
An empty table gives an empty one; other columns are carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.components import components
from tramline.llm.shared import SENT, by_bytes, drop_written, numbered, one_of_each, without, written
from tramline.llm.simhash import LOWER, link_fingerprints, majority

SHINGLE = 5
#: Frequent shingles that are put last; any number gives the same pairs.
LAST = 100_000
#: Pairs compared at once in a task, and pairs decided together in one.
AT_ONCE, SETS = 1_000_000, 2_000
#: Least number of blocks of pairs that are decided together.
PARTS = 64
#: Rows of a bucket that are looked at in one task; larger buckets are split.
BUCKET = 20_000
PARITY = ("p0", "p1", "p2", "p3")
#: The first of a row's first shingles, which tell in a bucket whether a pair has met in an earlier one.
HEADS = ("h0", "h1", "h2", "h3")
#: Cells of a row's own parity sketch for each of its shingles; a power of two in all.
CELLS = 8


def hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of a text's word shingles, repeats included."""
    w = (text or "").encode().translate(LOWER).split()
    digest = xxhash.xxh64_intdigest
    joined = [b" ".join(w)] if len(w) < shingle else map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False))
    return np.fromiter((digest(x, 42) for x in joined), np.uint64)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted."""
    return np.unique(hashes(text, shingle))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard >= 4/5, in whole numbers."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def frequent(docs: DataFrame, most: int = LAST) -> pd.DataFrame:
    """h, n: the most frequent of the shingles that a batch of texts holds more than once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                h, n = np.unique(np.concatenate([shingles(t) for t in b["text"]]), return_counts=True)
                yield pd.DataFrame({"h": h[n > 1].view(np.int64), "n": n[n > 1]})

    found = docs.select("text").mapInPandas(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return found.orderBy(F.desc("n"), "h").limit(most).toPandas()


def prefixes(docs: DataFrame, often: pd.DataFrame) -> DataFrame:
    """row, same (one value for equal sets), fp (SimHash), n, parity (p0 to p3), first (the shingles that a partner may share)."""
    h = often["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    shared = docs.sparkSession.sparkContext.broadcast((h[order], np.log2(np.maximum(often["n"].to_numpy(np.float64), 1))[order].astype(np.int8) + 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, rank = shared.value
        for b in batches:
            out = []
            for row, text in zip(b["row"], b["text"], strict=True):
                every = hashes(text)
                s = np.unique(every)
                rare = np.zeros(len(s), np.int8)
                if len(last):
                    at = np.minimum(np.searchsorted(last, s), len(last) - 1)
                    rare = np.where(last[at] == s, rank[at], 0)
                n = len(s)
                first = s[np.lexsort((s, rare))][: n - -(-4 * n // 5) + 1]
                odd = np.packbits((np.bincount((s & np.uint64(255)).astype(np.int64), minlength=256) & 1).astype(np.uint8)).view(np.int64)
                fp = int(np.uint64(majority(every)).astype(np.int64))
                heads = [*first[: len(HEADS)].view(np.int64).tolist(), 0, 0, 0, 0][: len(HEADS)]
                out.append((row, xxhash.xxh3_128_hexdigest(s.tobytes()), fp, n, *odd.tolist(), *heads, first.view(np.int64)))
            yield pd.DataFrame(out, columns=["row", "same", "fp", "n", *PARITY, *HEADS, "first"])

    kinds = ", ".join(f"{p} long" for p in (*PARITY, *HEADS))
    return docs.select("row", "text").mapInPandas(run, f"row long, same string, fp long, n long, {kinds}, first array<long>")


def may_be_alike(a: str, b: str) -> Column:
    """Whether sizes and parities of the structs ``a`` and ``b`` allow the similarity."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = sum((F.bit_count(F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}"))) for p in PARITY), F.lit(0))
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * apart <= n + m)


def simhash_pairs(reps: DataFrame) -> DataFrame:
    """u, v: rows of one fingerprint with its first row, and the first rows of fingerprints that the trie links."""
    least = written(reps.groupBy("fp").agg(F.min("row").alias("row"), F.count("*").alias("n")), "first-of-fingerprint")
    same = reps.select("fp", F.col("row").alias("u")).join(least.filter("n > 1").select("fp", F.col("row").alias("v")), "fp").select("u", "v")
    first = lambda c: least.select(F.col("fp").alias(c), F.col("row").alias(f"row_{c}"))
    linked = link_fingerprints(least.select("fp")).join(first("u"), "u").join(first("v"), "v")
    return same.unionByName(linked.select(F.col("row_u").alias("u"), F.col("row_v").alias("v"))).filter("u <> v")


def bucket_rows(reps: DataFrame) -> DataFrame:
    """h, row, pos: the first shingles that two rows or more share, who has them, and as which of theirs."""
    each = reps.select("row", F.posexplode("first").alias("pos", "h"))
    return each.join(each.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1").select("h"), "h")


def pivot_pairs(buckets: DataFrame) -> DataFrame:
    """u < v: every row of a bucket with the bucket's first row, where they may be alike."""
    sketch = F.struct("row", "n", *PARITY)
    pivots = buckets.groupBy("h").agg(F.min(sketch).alias("a"))
    both = buckets.select("h", sketch.alias("b")).join(pivots, "h").filter("a.row < b.row").filter(may_be_alike("a", "b"))
    return both.select(F.col("a.row").alias("u"), F.col("b.row").alias("v"))


def _across(edge: np.ndarray, n: np.ndarray, odd: np.ndarray, group: np.ndarray, minor: np.ndarray, mine: np.ndarray, nearest: bool) -> Iterator[np.ndarray]:
    """Places (i, j) in one bucket (``edge``: where buckets begin), of different groups, i minor, whose sizes and
    parities allow the similarity; two minors once, in the part that the first of them is dealt to (``mine``).  ``nearest`` keeps for each i the j
    with the fewest differences for its size."""
    size = np.diff(edge)
    begin, wide = np.repeat(edge[:-1], size), np.repeat(size, size)
    major = np.repeat(np.add.reduceat(~minor, edge[:-1], dtype=np.int64), size) if len(size) else size
    met = np.where(mine, wide, major)  # the largest component's rows come first in a bucket
    who = np.flatnonzero(minor & (met > 0))
    ends = np.cumsum(met[who])
    at = 0
    while at < len(who):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        own = who[at:upto]
        x = np.repeat(own, met[own])
        y = np.repeat(begin[own], met[own]) + np.arange(len(x)) - np.repeat(np.cumsum(met[own]) - met[own], met[own])
        both = minor[y] & ((nearest & (x != y)) | (x < y)) & mine[x]
        ok = (group[x] != group[y]) & (~minor[y] | both) & (5 * np.minimum(n[x], n[y]) >= 4 * np.maximum(n[x], n[y]))
        x, y = x[ok], y[ok]
        apart = np.bitwise_count(odd[x] ^ odd[y]).sum(1, dtype=np.int64)
        ok = 9 * apart <= n[x] + n[y]
        x, y = x[ok], y[ok]
        if nearest and len(x):
            o = np.lexsort((apart[ok] / (n[x] + n[y]), x))
            x, y = x[o], y[o]
            new = np.concatenate([[True], x[1:] != x[:-1]])
            x, y = x[new], y[new]
        yield np.stack([x, y], 1)
        at = upto


def _first_meeting(pairs: np.ndarray, heads: np.ndarray, pos: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the bucket's shingle may be the first that a pair of places shares and the pair alike.

    Not if they share a head before it: they meet in that head's bucket as well.  Not if too few shingles are left from it
    on: alike sets share 4/9 of both sizes together, all of them from their first common one on.
    """
    x, y = pairs[:, 0], pairs[:, 1]
    enough = 9 * np.minimum(n[x] - pos[x], n[y] - pos[y]) >= 4 * (n[x] + n[y])
    met = np.zeros(len(pairs), bool)
    for i in range(heads.shape[1]):
        for j in range(heads.shape[1]):
            met |= (heads[x, i] == heads[y, j]) & (pos[x] > i) & (pos[y] > j)
    return enough & ~met


def other_pairs(buckets: DataFrame, roots: DataFrame, most: int | None = None, nearest: bool = False) -> DataFrame:
    """u, v: rows of one bucket that may be alike and that no links join yet; with ``nearest`` at most one for each row of a part.

    A bucket's largest component is dealt over parts by hash; the rows of its smaller ones go to every part, and
    meet each other in the part of the first, so that no part compares more than about ``most`` squared pairs.
    """
    most = most or BUCKET
    if HEADS[0] not in buckets.columns:
        buckets = buckets.withColumns({c: F.lit(0).cast("long") for c in ("pos", *HEADS)})
    placed = written(buckets.join(roots, "row", "left").withColumn("root", F.coalesce("root", "row")), "bucket-roots")
    sizes = placed.groupBy("h", "root").agg(F.count("*").alias("k"))
    mixed = sizes.groupBy("h").agg(F.count("*").alias("kinds"), F.sum("k").alias("m"), F.max(F.struct("k", "root")).alias("major")).filter("kinds > 1")
    work = F.col("m") * (F.col("m") - F.col("major.k")) / (float(most) * most)  # comparisons of its smaller components' rows
    mixed = mixed.select("h", F.ceil(F.greatest(F.col("m") / most, work)).cast("int").alias("parts"), F.col("major.root").alias("major"))
    own = placed.join(mixed, "h").withColumn("minor", F.col("root") != F.col("major"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    home = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    rows = own.select("h", "row", "n", *PARITY, *HEADS, "pos", "root", "minor", home.alias("home"), F.explode(F.when(F.col("minor"), every).otherwise(F.array(home))).alias("part"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def pairs(b: pd.DataFrame) -> pd.DataFrame:
            h, part, row, n, root, home = (b[c].to_numpy(np.int64) for c in ("h", "part", "row", "n", "root", "home"))
            minor = b["minor"].to_numpy(bool)
            odd = b[list(PARITY)].to_numpy(np.int64).view(np.uint64)
            edge = np.concatenate([[0], np.flatnonzero((h[1:] != h[:-1]) | (part[1:] != part[:-1])) + 1, [len(h)]])
            heads, pos = b[list(HEADS)].to_numpy(np.int64), b["pos"].to_numpy(np.int64)
            found = [row[p[_first_meeting(p, heads, pos, n)]] for p in _across(edge, n, odd, root, minor, part == home, nearest)]
            uv = np.unique(np.sort(np.concatenate(found), axis=1), axis=0) if found else np.empty((0, 2), np.int64)
            return pd.DataFrame({"u": uv[:, 0], "v": uv[:, 1]})

        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            if len(held):
                h, part = held["h"].to_numpy(), held["part"].to_numpy()
                open_ = (h == h[-1]) & (part == part[-1])
                if not open_.all():
                    yield pairs(held[~open_])
                    held = held[open_].reset_index(drop=True)
        if held is not None and len(held):
            yield pairs(held)

    return rows.repartition("h", "part").sortWithinPartitions("h", "part", "minor", "row").mapInPandas(run, "u long, v long")


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, text, blocks) to (block, row, n, cells): the parities of a text's shingles in about ``CELLS`` cells for each."""
    for b in (part for whole in batches for part in by_bytes(whole, "text")):
        out = []
        for row, text, blocks in zip(b.column("row").to_pylist(), b.column("text").to_pylist(), b.column("blocks").to_pylist(), strict=True):
            s = shingles(text)
            cells = 1 << max(8, (CELLS * len(s) - 1).bit_length())
            odd = np.packbits((np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1).astype(np.uint8), bitorder="little").tobytes()
            out += [(block, row, len(s), odd) for block in blocks]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["block", "row", "n", "cells"])


def _near(n: int, a: np.ndarray, m: int, b: np.ndarray) -> bool:
    """Whether sizes and sketches allow the similarity; the larger sketch is folded to the smaller."""
    if len(a) > len(b):
        a, b = b, a
    b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return 5 * min(n, m) >= 4 * max(n, m) and 9 * int(np.bitwise_count(a ^ b).sum(dtype=np.int64)) <= n + m


def _asked(docs: DataFrame, pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Pairs dealt into blocks by u, those of a u with many partners by v as well, and the texts that each block needs (row, text, blocks).

    Few rows asked for are sent to the texts; many meet them in a shuffle.
    """
    parts = max(PARTS, pairs.count() // SETS)
    many = pairs.groupBy("u").agg(F.ceil(F.count("*") / SETS).alias("k")).filter("k > 1")
    blocks = pairs.join(many, "u", "left").select("u", "v", F.xxhash64(F.pmod(F.xxhash64("u"), F.lit(parts)), F.when(F.col("k").isNotNull(), F.struct("u", F.pmod(F.xxhash64("v"), F.col("k"))))).alias("block"))
    blocks = written(blocks, f"{name}-blocks")
    wanted = blocks.select("block", F.col("u").alias("row")).unionByName(blocks.select("block", F.col("v").alias("row"))).distinct()
    asked = written(wanted.groupBy("row").agg(F.collect_list("block").alias("blocks")), f"{name}-rows")
    asked = F.broadcast(asked) if asked.count() <= SENT else asked
    return blocks, docs.select("row", "text").join(asked, "row").select("row", "text", "blocks")


def confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) whose whole sets are alike.

    First sketches sized by their sets, a sixth of a text, go to the blocks of their pairs and rule out nearly all that are not
    alike; then the texts of the rest.
    """
    blocks, held = _asked(docs, pairs, "sifted")

    def sift(uv: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        s = {r: (n, np.frombuffer(c, np.uint8)) for r, n, c in zip(own["row"], own["n"], own["cells"], strict=True)}
        return uv.loc[[_near(*s[u], *s[v]) for u, v in zip(uv["u"], uv["v"], strict=True)], ["u", "v"]]

    sketches = held.mapInArrow(_sketched, "block long, row long, n long, cells binary")
    left = written(blocks.groupBy("block").cogroup(sketches.groupBy("block")).applyInPandas(sift, "u long, v long"), "sifted-pairs")
    blocks, held = _asked(docs, left, "pair")

    def decide(uv: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        s = {r: shingles(t) for r, t in zip(own["row"], own["text"], strict=True)}
        return uv.loc[[alike(s[u], s[v]) for u, v in zip(uv["u"], uv["v"], strict=True)], ["u", "v"]]

    texts = held.select(F.explode("blocks").alias("block"), "row", "text")
    return blocks.groupBy("block").cogroup(texts.groupBy("block")).applyInPandas(decide, "u long, v long")


def group(docs: DataFrame) -> DataFrame:
    """docs (row, text) to row, root: one value for all rows that similar pairs join."""
    firsts = written(prefixes(docs, frequent(docs)), "prefixes")
    same = firsts.groupBy("same").agg(F.min("row").alias("row"))
    copies = written(firsts.select("row").join(same.select("row"), "row", "left_anti"), "copies")
    reps = written(without(firsts, copies, "row"), "distinct-sets")
    firsts = firsts.select("row", "same")
    buckets = written(bucket_rows(reps).join(reps.select("row", "n", *PARITY, *HEADS), "row"), "buckets")
    ordered = lambda p: p.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    pairs, joined = simhash_pairs(reps).unionByName(pivot_pairs(buckets)), None
    for step in ("proposed", "nearest", "others"):
        if joined is not None:
            pairs = other_pairs(buckets, joined.select(F.col("node").alias("row"), "root"), nearest=step == "nearest")
        pairs = written(ordered(pairs), f"{step}-pairs")
        links = confirmed(docs, pairs)
        if joined is not None:
            links = links.unionByName(joined.select(F.col("node").alias("u"), F.col("root").alias("v")))
        joined = written(components(links), "joined")
        drop_written(pairs)
    drop_written(buckets, reps)
    done = joined.select(F.col("node").alias("least"), "root")
    rows = firsts.select("row", "same").join(same.withColumnRenamed("row", "least"), "same")
    return rows.join(done, "least", "left").select("row", F.coalesce("root", "least").alias("root"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies: that with the smallest id, of those the first; rows without an id come last."""
    rows, number = numbered(docs)
    return one_of_each(rows, number, group(rows.select(F.col(number).alias("row"), F.col(text_col).alias("text"))), id_col)
