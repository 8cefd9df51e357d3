"""Size-balanced sharding by sampled splitters.  DataFrame functions only.

A size-weighted sample of the keys gives quantile boundaries; rows are range-partitioned at
these, ranges that hold too much are sampled again and subdivided, and exact counts of the
ranges then place every row: its shard is where its first byte falls when all rows are laid
end to end in key order.  Shards thus differ by less than one row's size, whatever the sample.

Keys order rows (null first).  Rows with one key are told apart by a number given once and
stored, so a key may hold any share of the rows and still be split.  Empty tables give no rows;
with fewer rows than shards some shards stay empty.  Other columns are carried along untouched
unless they clash with the three that are added (``shard``, ``slot``, ``law``), which win.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.llm.shared import json_literal, written

#: Rows that a range should hold at most; windows over ranges never see many more.
RANGE_ROWS = 200_000
#: Sampled keys for each range.
SAMPLES = 32


def _below(bounds: list[list], key: Column) -> Column:
    """How many sorted boundaries are <= key: binary search over one literal."""
    if not bounds:
        return F.lit(0)
    array = json_literal([{"k": k, "t": t} for k, t in bounds], "array<struct<k:bigint,t:bigint>>")
    n, steps = len(bounds), len(bounds).bit_length()
    jumps = F.array(*(F.lit(1 << s) for s in range(steps - 1, -1, -1)))

    def step(low: Column, jump: Column) -> Column:
        to = low + jump
        return F.when((to <= n) & (F.get(array, to - 1) <= key), to).otherwise(low)

    return F.aggregate(jumps, F.lit(0), step)


def _splitters(rows: DataFrame, weight: int, parts: int) -> list[list]:
    """Quantiles of a size-weighted sample of about ``parts * SAMPLES`` keys; only boundaries reach the driver."""
    wanted = parts * SAMPLES
    share = F.col("__size") * wanted / F.lit(float(weight))
    chance = F.shiftrightunsigned(F.xxhash64("__k", "__t", F.lit(20)), 11) / F.lit(float(1 << 53))
    sample = rows.filter(chance < share).select("__k", "__t", F.greatest(share, F.lit(1.0)).alias("w"))
    run = Window.orderBy("__k", "__t").rowsBetween(Window.unboundedPreceding, 0)  # over the bounded sample
    cut = sample.withColumn("upto", F.sum("w").over(run)).withColumn("part", F.floor(F.col("upto") * parts / (F.lit(1.0) * wanted)))
    first = cut.groupBy("part").agg(F.min(F.struct("__k", "__t")).alias("b")).filter("part > 0")
    return [[r.b["__k"], r.b["__t"]] for r in first.collect()]


def _order(b: list) -> tuple:
    return (b[0] is not None, b[0] or 0, b[1])


def assign_shards(rows: DataFrame, shards: int, key_col: str, size_col: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with ``law``, ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 within a shard).

    ``key_col`` and ``size_col`` are longs.  The rows are written once, with a number that
    tells equal keys apart; everything later reads that table, so a lost task finds the same
    numbers again.
    """
    keep = [c for c in rows.columns if c not in ("law", "shard", "slot")]
    numbered = rows.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{key_col}`").cast("long").alias("__k"), F.monotonically_increasing_id().alias("__t"), F.col(f"`{size_col}`").cast("long").alias("__size"))
    stored = written(numbered, "shard-rows")
    n, total = stored.agg(F.count("*"), F.coalesce(F.sum("__size"), F.lit(0))).first()
    key = F.struct(F.col("__k").alias("k"), F.col("__t").alias("t"))
    bounds: list[list] = []
    if n:
        parts = max(4 * shards, -(-n // range_rows) * 2)
        bounds = sorted(_splitters(stored, max(total, 1), parts), key=_order)
    while True:
        ranged = stored.withColumn("__range", _below(bounds, key))
        counts = {r[0]: (r[1], r[2]) for r in ranged.groupBy("__range").agg(F.count("*"), F.sum("__size")).collect()}
        full = [k for k, (m, _) in counts.items() if m > range_rows]
        more: list[list] = []
        if full:
            inside = ranged.filter(F.col("__range").isin(full))
            share = sum(counts[k][1] for k in full)
            more = _splitters(inside, max(share, 1), 2 * -(-sum(counts[k][0] for k in full) // range_rows) + 2)
        known = {tuple(b) for b in bounds}
        more = [b for b in more if tuple(b) not in known]
        if not more:
            break
        bounds = sorted([*bounds, *more], key=_order)
    row_offset, byte_offset, at, upto = [], [], 0, 0
    for k in range(len(bounds) + 1):
        row_offset.append(at)
        byte_offset.append(upto)
        m, b = counts.get(k, (0, 0))
        at, upto = at + m, upto + b
    within = Window.partitionBy("__range").orderBy("__k", "__t")
    before = lambda xs: F.get(json_literal(xs, "array<bigint>"), F.col("__range"))
    placed = (
        ranged.withColumn("__row", before(row_offset) + F.row_number().over(within) - 1)
        .withColumn("__start", before(byte_offset) + F.sum("__size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size"))
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"__start * {shards} div {max(total, 1)}")).cast("int"))
    )
    placed = written(placed.drop("__k", "__t", "__size", "__range", "__start"), "shard-places")
    first = [0] * shards
    for r in placed.groupBy("shard").agg(F.min("__row")).collect():
        first[r[0]] = r[1]
    slot = F.col("__row") - F.get(json_literal(first, "array<bigint>"), F.col("shard"))
    return placed.select(*(F.col(f"`{c}`") for c in keep), F.lit("bytes").alias("law"), "shard", slot.alias("slot"))
