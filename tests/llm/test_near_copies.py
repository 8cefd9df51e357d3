import random

import corpus_pipeline
from tests.llm import data
from tramline.llm import near_copies, simhash, shared


def brute_groups(texts):
    """Root of each text by comparing all pairs."""
    own = []
    for t in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in __import__("re").split("[ \t-\r]+", low) if x]
        own.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(own)))
    for i in range(len(own)):
        for j in range(i):
            if 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def brute_kept(rows):
    best = {}
    for k, (i, r) in enumerate(zip((x[0] for x in rows), brute_groups([x[1] for x in rows]), strict=True)):
        best[r] = min(best.get(r, (True, 0, k)), (i is None, i or 0, k)) if r in best else (i is None, i or 0, k)
    return sorted(((rows[k][0], rows[k][1]) for _, _, k in best.values()), key=str)


def near_rows(seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    boiler = [word() for _ in range(60)]
    rows = []
    for _ in range(25):
        base = [word() for _ in range(r.randint(20, 250))] + (boiler if r.random() < 0.5 else [])
        for _ in range(r.randint(1, 5)):
            w = list(base)
            for _ in range(r.randint(0, 8)):
                w[r.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w), "en", "s", 1))
    return rows + data.rows(5, 30)


def test_stage_removes_near_copies_as_brute_force(spark):
    rows = near_rows()
    df = spark.createDataFrame(rows, data.SCHEMA)
    kept = corpus_pipeline.near_duplicate_stage(spark, df, "")
    assert kept.columns == df.columns
    want = brute_kept(rows)
    assert len(want) < len(rows) - 20
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == want
    assert corpus_pipeline.near_duplicate_stage(spark, df.limit(0), "").count() == 0


def test_order_of_shingles_and_blocks_change_nothing(spark, monkeypatch):
    rows = near_rows(6)
    df = spark.createDataFrame(rows, data.SCHEMA)
    monkeypatch.setattr(near_copies, "SETS", 7)
    monkeypatch.setattr(near_copies, "frequent", lambda docs, f=near_copies.frequent: f(docs, 20))
    got = near_copies.keep_first(df)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == brute_kept(rows)


def test_large_groups_make_no_pairs_of_all_rows(spark):
    """Chains and a large group of near copies: every link is kept, pairs stay far below the square."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120)]
    texts = []
    for _ in range(300):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = word()
        texts.append(" ".join(w))
    chain = [word() for _ in range(100)]
    for k in range(40):
        chain = chain[3:] + [word(), word(), word()]
        texts.append(" ".join(chain))
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, data.SCHEMA)
    docs = df.selectExpr("doc_id AS row", "text")
    firsts = near_copies.written(near_copies.prefixes(docs, near_copies.frequent(docs)), "t")
    buckets = near_copies.bucket_rows(firsts).join(firsts.select("row", "n", *near_copies.PARITY), "row")
    assert near_copies.pivot_pairs(buckets).distinct().count() < 340 * 20
    root = {x.row: x.root for x in near_copies.group(docs).collect()}
    want = brute_groups(texts)
    first = {}
    assert all(first.setdefault(w, root[k]) == root[k] for k, w in enumerate(want))
    assert len(set(root.values())) == len(set(want))


def test_split_buckets_lose_no_pair(spark, monkeypatch):
    rows = near_rows(7)
    df = spark.createDataFrame(rows, data.SCHEMA)
    docs = df.selectExpr("doc_id AS row", "text")
    reps = near_copies.written(near_copies.prefixes(docs, near_copies.frequent(docs)), "t")
    buckets = near_copies.bucket_rows(reps).join(reps.select("row", "n", *near_copies.PARITY), "row")
    nothing = spark.createDataFrame([], "row long, root long")
    pairs = lambda most: {(min(x), max(x)) for x in near_copies.other_pairs(buckets, nothing, most).collect()}
    assert pairs(2) == pairs(100_000) != set()
    monkeypatch.setattr(near_copies, "BUCKET", 2)
    assert sorted(((r.doc_id, r.text) for r in near_copies.keep_first(df).collect()), key=str) == brute_kept(rows)


def test_awkward_rows(spark):
    df = data.frame(spark, 5, 30, awkward=True)
    kept = near_copies.keep_first(df)
    assert kept.columns == df.columns
    own = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == brute_kept(own)


def test_sent_and_shuffled_rows_are_the_same(spark, monkeypatch):
    rows = near_rows(9)
    df = spark.createDataFrame(rows, data.SCHEMA)
    monkeypatch.setattr(shared, "SENT", 0)
    monkeypatch.setattr(near_copies, "SENT", 0)
    assert sorted(((r.doc_id, r.text) for r in near_copies.keep_first(df).collect()), key=str) == brute_kept(rows)


def test_a_bucket_of_single_rows_is_dealt_over_parts(spark):
    """Rows of one bucket that no links join yet: the same pairs in one part and in many, each part with its share of the work."""
    kinds = ", ".join(f"{p} long" for p in near_copies.PARITY)
    rows = [(7, k, 100 + k % 40, k % 3, 0, 0, k % 2) for k in range(120)]
    buckets = spark.createDataFrame(rows, f"h long, row long, n long, {kinds}")
    roots = spark.createDataFrame([(k, 0) for k in range(0, 30)], "row long, root long")
    for nearest in (False, True):
        one = {(min(x), max(x)) for x in near_copies.other_pairs(buckets, roots, 1000, nearest).collect()}
        many = {(min(x), max(x)) for x in near_copies.other_pairs(buckets, roots, 20, nearest).collect()}
        assert one and many == one if not nearest else {x for p in one for x in p if x >= 30} <= {x for p in many for x in p}


def test_a_column_named_as_the_row_number_is_carried(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 5), (2, "a b c d e f", 6)], "doc_id long, text string, __row long")
    for module in (near_copies, simhash):
        assert [tuple(r) for r in module.keep_first(df).collect()] == [(1, "a b c d e f", 5)]
