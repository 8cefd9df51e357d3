"""Hard negatives by a pivot table.

A row x becomes (x, sqrt(M - |x|^2)) with M the largest squared length, an anchor q becomes (q, 0): then the squared distance
of the two is |q|^2 + M - 2 <q, x>, so near means a large inner product.  Every row stores its distances to a
few pivots; by the triangle inequality they bracket a row's distance to an anchor, and so its score.  Rows
lie in blocks by their nearest pivot and their distance to it, and a block's least and largest pivot distances bracket all of it.
Anchors meet only blocks, and in them only tiles of ``TILE`` rows, whose bracket reaches the scores in question; the rows
of these get their exact integer scores, many anchors in one product of matrices.

First every anchor meets its own block, which gives a score that its last positive has at least; then the blocks
that may hold a better one; then, for each positive's score, its own block again, which gives a score that its last negative has
at least, and the blocks that may hold better ones in its band.  Anchors of one vector and label ask once: they share all rows but themselves.
Nothing is approximate: the pivots, fitted on at most ``SAMPLE`` rows, only decide how much is pruned.

Rows take no part whose label or vector is null or that hold a null or non-finite component; of vectors of
different sizes the shorter count as padded with zeros.  Null ids come last among ties, rows of one
id in an order that is stored.  Repeated rows are rows of their own.  An anchor without other rows of its label, or a
positive without negatives in its band, has no rows; so has an empty table.  Columns other than the three named are
not read.  Scores of 2^62 or more are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.llm.shared import written

#: Pivots, rows that they are chosen from, rows in a block, asks that meet one block in a task, block brackets in a row.
PIVOTS, SAMPLE, BLOCK, ASKED, PACK = 8, 2000, 2048, 20_000, 1024
#: Rows that share brackets inside a block, and asks that are scored together.
TILE, TOGETHER = 128, 256
#: Blocks, near each other in order, that asks meet together: where brackets rule out little, asks travel once for so many blocks.
SHELF = 8
#: Distances are known to this share of the largest length.
SLACK = 1e-6
NONE = -(1 << 62)
_INDEX = "row long, id long, label long, vec binary, norm long, dist array<double>"


def vectors(rows: DataFrame, id_col: str, vec_col: str, label_col: str, scale: float = 256.0) -> DataFrame:
    """(row, id, label, vec, norm): usable rows with components floor(scale * x), eight bytes each; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            good = np.bincount(owner[~np.isfinite(flat)], minlength=len(sizes)) == 0
            whole = np.floor(scale * np.where(np.isfinite(flat), flat, 0.0))
            if len(whole) and np.abs(whole).max() >= 1 << 31:
                raise ValueError("a component is too large for exact scores")
            whole = whole.astype("<i8")
            norms = np.bincount(owner, whole.astype(np.float64) ** 2, len(sizes))
            if len(norms) and norms.max() >= 1 << 62:
                raise ValueError("a vector is too long for exact scores")
            ends = np.cumsum(sizes)
            vecs = pa.array([whole[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary())
            exact = [int(x @ x) for x in np.split(whole, ends[:-1])] if len(sizes) else []
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), vecs, pa.array(exact, pa.int64())], ["row", "id", "label", "vec", "norm"])
            yield out.filter(pa.array(good))

    own = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    own = own.filter("label IS NOT NULL AND vec IS NOT NULL").select(F.monotonically_increasing_id().alias("row"), "id", "label", "vec")
    table = written(own.mapInArrow(run, "row long, id long, label long, vec binary, norm long"), "vectors")
    low, high = table.agg(F.min(F.octet_length("vec")), F.max(F.octet_length("vec"))).first()
    return table if low == high else table.withColumn("vec", F.rpad("vec", F.lit(high), F.lit(b"\0")))


def _matrix(vecs, kind=np.float64) -> np.ndarray:
    """Packed vectors as a matrix of whole numbers."""
    raw = vecs if isinstance(vecs, list) else vecs.to_pylist()
    flat = np.frombuffer(b"".join(raw), "<i8")
    return flat.reshape(len(raw), len(flat) // max(len(raw), 1)).astype(kind)


def _lists(matrix: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, matrix.size + 1, matrix.shape[1]), pa.int32()), pa.array(matrix.reshape(-1)))


def anchors_of(index: DataFrame, condition: Column, longest: int, pivots: np.ndarray) -> DataFrame:
    """The index rows of a condition as anchors, whose further coordinate is 0: (ask, anchor, id, home, label, vec, norm, dist), written."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                norm = b.column(6).to_numpy().astype(np.float64)
                dist = np.sqrt(np.maximum(norm[:, None] + longest - 2.0 * (_matrix(b.column(5)) @ pivots.T), 0))
                yield pa.RecordBatch.from_arrays([*b.columns, _lists(dist)], [*b.schema.names, "dist"])

    own = index.filter(condition).select(F.col("row").alias("ask"), F.col("row").alias("anchor"), "id", F.col("block").alias("home"), "label", "vec", "norm")
    return written(own.mapInArrow(place, "ask long, anchor long, id long, home long, label long, vec binary, norm long, dist array<double>"), "anchors")


def choose_pivots(table: DataFrame, longest: int, pivots: int = PIVOTS, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Pivots (vectors and their further coordinate), each the farthest from those before it, out of a bounded sample."""
    some = table.select("vec", "norm").orderBy(F.xxhash64("id", "row")).limit(sample).collect()
    v = _matrix([bytes(r.vec) for r in some])
    more = np.sqrt(np.maximum(longest - np.array([r.norm for r in some], np.float64), 0))
    chosen, gap = [0], np.full(len(v), np.inf)
    while len(chosen) < min(pivots, len(v)):
        gap = np.minimum(gap, longest - v @ v[chosen[-1]] - more * more[chosen[-1]])
        chosen.append(int(gap.argmax()))
    return v[chosen], more[chosen]


def build_index(table: DataFrame, block: int = BLOCK, pivots: int = PIVOTS) -> tuple[DataFrame, int, np.ndarray]:
    """``vectors`` with pivot distances, in blocks of rows that are near each other, written; the largest squared length; the pivots."""
    longest, count = table.agg(F.coalesce(F.max("norm"), F.lit(0)), F.count("*")).first()
    pv, pm = choose_pivots(table, longest, pivots) if count else (np.zeros((1, 1)), np.zeros(1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            norm = b.column(4).to_numpy().astype(np.float64)
            more = np.sqrt(np.maximum(longest - norm, 0))
            dist = np.sqrt(np.maximum(2.0 * longest - 2.0 * (_matrix(b.column(3)) @ pv.T + more[:, None] * pm), 0))
            yield pa.RecordBatch.from_arrays([*b.columns, _lists(dist), pa.array(dist.argmin(1), pa.int64()), pa.array(dist.min(1))], [*b.schema.names, "dist", "cell", "near"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, part = 0, TaskContext.get().partitionId()
        for b in batches:
            own = (part << 32) + (n + np.arange(b.num_rows)) // block
            n += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own)], [*b.schema.names, "block"])

    parts = max(1, -(-count // (8 * block)))
    placed = table.mapInArrow(place, f"{_INDEX}, cell long, near double").repartitionByRange(parts, "cell", "near", "row").sortWithinPartitions("cell", "near", "row")
    return written(placed.drop("cell", "near").mapInArrow(number, f"{_INDEX}, block long"), "vector-blocks"), longest, pv


def _bracketed(asks: DataFrame, longest: int) -> DataFrame:
    """``asks`` (with least and most, the scores in question) with the distances that these are: at most far, at least close."""
    apart = lambda score: F.sqrt(F.greatest(F.lit(0.0), F.col("norm") + F.lit(float(longest)) - 2.0 * F.col(score)))
    slack = SLACK * (float(longest) ** 0.5 + 1)
    return asks.withColumn("far", apart("least") + slack).withColumn("close", apart("most") - slack)


def _pairs(asks: DataFrame, blocks: DataFrame, k: int, n_blocks: int) -> DataFrame:
    """(home, block): the blocks whose brackets reach what some ask of a home block is after."""
    each = lambda f, c: F.array(*(f(F.col(c)[j]) for j in range(k)))
    tiles = blocks.groupBy("block").agg(each(F.min, "dist").alias("low"), each(F.max, "dist").alias("high"))
    packs = max(1, -(-n_blocks // PACK))
    packed = tiles.groupBy(F.pmod(F.xxhash64("block"), F.lit(packs)).alias("pack")).agg(F.collect_list(F.struct("block", "low", "high")).alias("tiles"))
    groups = asks.groupBy("home").agg(each(F.min, "dist").alias("a"), each(F.max, "dist").alias("b"), F.max("far").alias("far"), F.min("close").alias("close"))
    groups = groups.withColumn("pack", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(packs - 1).cast("long"))))
    met = groups.join(packed, "pack").select("home", "a", "b", "far", "close", F.explode("tiles").alias("t"))
    gaps = [g for j in range(k) for g in (F.col("t.low")[j] - F.col("b")[j], F.col("a")[j] - F.col("t.high")[j])]
    reach = [F.col("b")[j] + F.col("t.high")[j] for j in range(k)]
    least = lambda xs: F.array_min(F.array(*xs))
    return met.filter(F.array_max(F.array(*gaps)) <= F.col("far")).filter(least(reach) >= F.col("close")).select("home", F.col("t.block").alias("block"))


def search(asks: DataFrame, pairs: DataFrame, blocks: DataFrame, longest: int, same: bool, top: int, n_asks: int) -> DataFrame:
    """(ask, row, id, score): for each ask its best ``top`` rows of every shelf of blocks it meets, with the anchor's label or another.

    ``asks``: ask (a key), home, label, vec, norm, dist, least, most, far, close.  ``pairs`` (home, block) are read twice.
    A task holds the blocks of one shelf and at most about ``ASKED`` asks; rows go only where asks meet their shelf.
    """
    slices = max(1, -(-n_asks // ASKED))
    kind = np.float64 if longest < 1 << 53 else np.int64

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"ask": [], "row": [], "id": [], "score": []}
        if left.num_rows and right.num_rows:
            column = lambda t, c: t.column(c).to_numpy()
            lists = lambda t: np.asarray(t.column("dist").combine_chunks().flatten()).reshape(t.num_rows, -1)
            ids = right.column("id").fill_null((1 << 63) - 1).to_numpy()
            row, label, dist, vecs = column(right, "row"), column(right, "label"), lists(right), _matrix(right.column("vec"), kind)
            asked, own = _matrix(left.column("vec"), kind), lists(left)
            far, close, least, most = (column(left, c) for c in ("far", "close", "least", "most"))
            labels, keys = column(left, "label"), column(left, "ask")
            cuts = np.arange(0, right.num_rows, TILE)
            low, high = np.minimum.reduceat(dist, cuts), np.maximum.reduceat(dist, cuts)
            step = max(1, TOGETHER * BLOCK // max(BLOCK, right.num_rows))  # scores held at once are as many as of one block
            for begin in range(0, left.num_rows, step):
                some = slice(begin, begin + step)
                mine = own[some]
                apart = np.zeros((len(cuts), len(mine)))
                reach = np.full((len(cuts), len(mine)), np.inf)
                for j in range(mine.shape[1]):  # brackets of a tile's rows by each pivot
                    np.maximum(apart, np.maximum(low[:, j, None] - mine[:, j], mine[:, j] - high[:, j, None]), out=apart)
                    np.minimum(reach, high[:, j, None] + mine[:, j], out=reach)
                alive = (apart <= far[some]) & (reach >= close[some])
                asks_in = np.flatnonzero(alive.any(0))
                tiles = np.flatnonzero(alive[:, asks_in].any(1)) if len(asks_in) else asks_in
                if not len(tiles):
                    continue
                at = np.concatenate([np.arange(cuts[t], min(cuts[t] + TILE, right.num_rows)) for t in tiles])
                which = begin + asks_in
                score = ((vecs if len(at) == len(vecs) else vecs[at]) @ asked[which].T).astype(np.int64).T
                fits = (score >= least[which, None]) & (score <= most[which, None]) & ((label[at] == labels[which, None]) == same)
                for i in np.flatnonzero(fits.any(1)):
                    hit = np.flatnonzero(fits[i])
                    points = score[i, hit]
                    if len(hit) > top:
                        keep = points >= np.partition(points, -top)[-top]
                        hit, points = hit[keep], points[keep]
                    hit = at[hit]
                    best = np.lexsort((row[hit], ids[hit], -points))[:top]
                    out["ask"] += [keys[which[i]]] * len(best)
                    out["row"] += row[hit[best]].tolist()
                    out["id"] += [None if x == (1 << 63) - 1 else x for x in ids[hit[best]].tolist()]
                    out["score"] += points[best].tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    slice_ = F.pmod(F.xxhash64("home"), F.lit(slices)).alias("slice")
    shelf = F.expr(f"block div {SHELF}").alias("shelf")
    pairs = pairs.select("home", shelf).distinct()
    left = pairs.join(asks, "home").select("shelf", slice_, "ask", "label", "vec", "dist", "least", "most", "far", "close")
    right = blocks.select(shelf, "row", "id", "label", "vec", "dist").join(pairs.select("shelf", slice_).distinct(), "shelf")
    return left.groupBy("shelf", "slice").cogroup(right.groupBy("shelf", "slice")).applyInArrow(meet, "ask long, row long, id long, score long")


def _best(found: DataFrame, key: str, top: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _raised(asks: DataFrame, found: DataFrame, top: int) -> DataFrame:
    """``asks`` whose least score is that of the last of ``top`` rows found already: only rows that are as good can still be among the best."""
    last = found.groupBy("ask").agg(F.count("*").alias("n"), F.min("score").alias("last")).filter(F.col("n") >= top).select("ask", "last")
    return asks.join(last, "ask", "left").withColumn("least", F.greatest("least", "last")).drop("last")


def mine(rows: DataFrame, anchors: Column, id_col: str, vec_col: str, label_col: str, positives: int = 5, negatives: int = 5, band: tuple[int, int] = (80, 100), block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """Hard negatives of every anchor (a condition on ``id``) and each of its best rows of one label.

    Columns: anchor_id, positive_id, rank from 1, negative_id, positive_score, negative_score; a negative's score is at least
    ``band[0] / band[1]`` of the positive's and at most the positive's.
    """
    low, high = band
    index, longest, chosen = build_index(vectors(rows, id_col, vec_col, label_col), block, pivots)
    n_blocks = index.select("block").distinct().count()
    k = len(chosen)
    own = anchors_of(index, anchors, longest, chosen)
    kinds = own.groupBy("label", "vec").agg(F.min("ask").alias("kind"))
    members = written(own.join(kinds, ["label", "vec"]).select("anchor", F.col("id").alias("anchor_id"), "kind"), "members")
    own = written(own.join(members.select(F.col("kind").alias("ask")).distinct(), "ask", "left_semi"), "kinds")
    n, first = own.count(), positives + 1  # one of them may be the anchor itself
    home = own.select("home", F.col("home").alias("block")).distinct()
    wide = _bracketed(own.withColumn("least", F.lit(NONE)).withColumn("most", F.lit(-NONE)), longest)
    asks = written(_bracketed(_raised(own.withColumn("least", F.lit(NONE)).withColumn("most", F.lit(-NONE)), search(wide, home, index, longest, True, first, n), first), longest), "positive-asks")
    found = _best(search(asks, written(_pairs(asks, index, k, n_blocks), "positive-pairs"), index, longest, True, first, n), "ask", first)
    each = found.drop("rank").withColumnRenamed("ask", "kind").join(members, "kind").filter("row <> anchor")
    found = written(_best(each, "anchor", positives), "positives")
    bands = found.filter("score >= 0").select(F.col("kind").alias("ask"), F.col("score").alias("most")).distinct()
    bands = bands.withColumn("least", F.expr(f"{low} * (most div {high}) + ({low} * (most % {high}) + {high} - 1) div {high}"))
    bands = written(own.join(bands, "ask").withColumnRenamed("ask", "kind").withColumn("ask", F.monotonically_increasing_id()), "bands")
    n = bands.count()
    asks = written(_bracketed(_raised(bands, search(_bracketed(bands, longest), home, index, longest, False, negatives, n), negatives), longest), "negative-asks")
    others = _best(search(asks, written(_pairs(asks, index, k, n_blocks), "negative-pairs"), index, longest, False, negatives, n), "ask", negatives)
    named = found.select("kind", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("most")).join(bands.select("ask", "kind", "most"), ["kind", "most"])
    return others.join(named, "ask").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("most").alias("positive_score"), F.col("score").alias("negative_score")
    )
