import math
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tramline.llm import hard_negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, every, scale=256):
    """All scores of every anchor, sorted."""
    use = []
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            use.append((i, [math.floor(scale * float(np.float32(x))) for x in v], label))
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for a, (i, q, label) in enumerate(use):
        if i is None or i % every:
            continue
        scores = [(sum(x * y for x, y in zip(q, v)), j, other == label) for b, (j, v, other) in enumerate(use) if b != a]  # noqa: B905
        for s, j, _ in sorted((x for x in scores if x[2]), key=order)[:5]:
            fits = sorted((x for x in scores if not x[2] and 80 * s <= 100 * x[0] <= 100 * s), key=order)[:5]
            out += [(i, j, n, x[1], s, x[0]) for n, x in enumerate(fits, 1)]
    return sorted(out, key=str)


def rows(seed, n, dim=6, labels=4, spread=0.3):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(labels * 2)]
    out = []
    for i in range(n):
        c = r.choice(centres)
        out.append((i, [float(np.float32(x + r.gauss(0, spread))) for x in c], r.randrange(labels) if r.random() < 0.3 else centres.index(c) % labels))
    return out


def mined(spark, own, every, **more):
    df = spark.createDataFrame(own, SCHEMA).repartition(4).withColumns({c: F.lit("clash") for c in ("row", "id", "norm", "block")})
    got = hard_negatives.mine(df, F.col("id") % every == 0, "vec_id", "embedding", "label", **more)
    assert got.columns == COLUMNS
    return sorted((tuple(x) for x in got.collect()), key=str)


def test_mining_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ASKED", 10)
    monkeypatch.setattr(hard_negatives, "PACK", 4)
    own = rows(1, 700)
    want = brute(own, 20)
    assert want and mined(spark, own, 20, block=40) == want
    assert mined(spark, own, 20, block=1000, pivots=1) == want


def test_awkward_rows(spark):
    own = rows(2, 150)
    same = own[0][1]
    own += [(1000 + k, same, k % 3) for k in range(60)]  # ties: one vector many times
    own += [(2000, None, 1), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (2002, [math.nan] * 6, 1), (2003, [math.inf] * 6, 2), (2004, same, None), (None, same, 0)]
    own += [(2020, [0.5, 0.5], 1), (2040, [], 2), (2060, [0.0] * 6, 3), (2080, [-x for x in same], 0), (2100, same, 77)]
    assert mined(spark, own, 20, block=32) == brute(own, 20)


def test_repeated_rows_are_rows_of_their_own(spark):
    own = rows(3, 60) + rows(3, 60)[:30]
    got, want = mined(spark, own, 20, block=16), brute(own, 20)
    assert [(x[0], *x[2:]) for x in got] == [(x[0], *x[2:]) for x in want]


def test_empty_table_and_large_components(spark):
    assert mined(spark, [], 20) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1)], 1) == []
    big = [(i, [2.0**22 - 3 * i, 2.0**21 + i, 5.0 * i], i % 3) for i in range(40)]
    assert mined(spark, big, 10, block=8) == brute(big, 10)


def test_brackets_prune_whole_blocks(spark):
    index, longest, pivots = hard_negatives.build_index(hard_negatives.vectors(spark.createDataFrame(rows(4, 2000, spread=0.02), SCHEMA), "vec_id", "embedding", "label"), 50)
    own = hard_negatives.anchors_of(index, F.col("id") % 50 == 0, longest, pivots).withColumn("least", F.col("norm") - 2000).withColumn("most", F.lit(1 << 60))
    n = index.select("block").distinct().count()
    pairs = hard_negatives._pairs(hard_negatives._bracketed(own, longest), index, hard_negatives.PIVOTS, n).count()
    assert pairs < 0.5 * own.select("home").distinct().count() * n


def test_query_as_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = queries.op13_hard_negatives(spark, sf)
    assert sorted(tuple(r) for r in got.collect()) == sorted(db.execute(queries.OP13_SQL).fetchall())


def test_more_anchors_than_are_scored_together(spark):
    """Every row an anchor: the borders of tiles and of the anchors scored together lie inside one block."""
    own = rows(9, 400)
    assert len(own) > hard_negatives.TOGETHER > hard_negatives.TILE
    assert mined(spark, own, 1) == brute(own, 1)


def test_anchors_of_one_vector_and_label_ask_once(spark, monkeypatch):
    """And asks meet shelves of blocks: no more rows for each ask than there are shelves, also where nothing is ruled out."""
    met = []
    search = hard_negatives.search

    def counted(asks, pairs, blocks, *more):
        shelves = blocks.selectExpr(f"block div {hard_negatives.SHELF} AS s").distinct().count()
        met.append((asks.count(), shelves, blocks.select("block").distinct().count()))
        found = search(asks, pairs, blocks, *more)
        assert found.groupBy("ask").count().filter(F.col("count") > 6 * shelves).count() == 0
        return found

    monkeypatch.setattr(hard_negatives, "search", counted)
    same = rows(6, 40)
    own = [(40 * c + i, v, label) for c in range(20) for i, v, label in same]  # twenty copies
    assert mined(spark, own, 20, block=16) == brute(own, 20)
    assert met[0][0] == 2 and met[0][1] * 4 < met[0][2]  # forty anchors of two vectors
