import random

import numpy as np
import xxhash

from tests.llm import data
from tramline.llm import simhash as sh


def brute_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[ \t-\r]+", lower) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, budget=2):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def clustered(seed, n):
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(12)]
    out = []
    for _ in range(n):
        x = r.choice(centres)
        for _ in range(r.randint(0, 6)):
            x ^= 1 << r.randrange(64)
        out.append(x)
    return sorted(set(out))


def test_trie_join_as_brute_force():
    for seed in range(4):
        fps = np.array(clustered(seed, 700), np.uint64)
        links = sh.trie_links(fps, np.array([0, len(fps)]))
        assert (np.bitwise_count(fps[links[:, 0]] ^ fps[links[:, 1]]) >= 1).all()
        root = np.arange(len(fps))
        for _ in range(len(fps)):
            root[links[:, 0]] = np.minimum(root[links[:, 0]], root[links[:, 1]])
        want = brute_components([int(x) for x in fps])
        assert root.tolist() == want


def test_links_over_buckets(spark):
    fps = clustered(9, 900)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    want = brute_components(fps)
    for most in (100_000, 40, 5):
        got = sh.components(sh.link_fingerprints(df, most=most)).collect()
        root = {r.node: r.root for r in got}
        signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
        mine = {}
        for k, x in enumerate(signed):
            mine.setdefault(root.get(x, x), set()).add(k)
        theirs = {}
        for k, w in enumerate(want):
            theirs.setdefault(w, set()).add(k)
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values())), most


def test_other_budgets(spark):
    fps = clustered(4, 300)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    for budget in (0, 1, 3, 5):
        want = brute_components(fps, budget)
        root = {r.node: r.root for r in sh.components(sh.link_fingerprints(df, budget)).collect()}
        signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
        mine, theirs = {}, {}
        for k, x in enumerate(signed):
            mine.setdefault(root.get(x, x), set()).add(k)
            theirs.setdefault(want[k], set()).add(k)
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values())), budget


def test_group_as_brute_force(spark):
    df = data.frame(spark, 2, awkward=True)
    own = [(r.doc_id, r.text) for r in df.collect()]
    fps = [brute_fingerprint(t) for _, t in own]
    root = brute_components(fps)
    least = {}
    for (i, _), r in zip(own, root, strict=True):
        least[r] = min(least.get(r, i) if least.get(r) is not None else i, i) if i is not None and least.get(r) is not None else (i if i is not None else least.get(r))
    want = sorted(((i, f"{f:016x}", least[r]) for (i, _), f, r in zip(own, fps, root, strict=True)), key=str)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in sh.group(df).collect()), key=str)
    assert got == want


def test_keep_first_and_empty(spark):
    df = data.frame(spark, 2)
    groups = {r.component_id for r in sh.group(df).collect()}
    kept = sh.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(groups)
    assert sh.keep_first(df.limit(0)).count() == 0
    assert sh.group(df.limit(0)).count() == 0
    again = sh.keep_first(df.unionByName(df))
    assert sorted(r.doc_id for r in again.collect()) == sorted(groups)


def test_keep_first_keeps_one_row_of_each_group(spark):
    r = random.Random(3)
    prose = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(40))
    a, b, c, d, e = (prose() for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (3, e), (None, e), (5, c)]
    kept = sh.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((x.doc_id, x.text) for x in kept.collect()), key=str) == sorted([(None, a), (None, b), (5, c), (7, d), (3, e)], key=str)
    df = data.frame(spark, 2, awkward=True)
    fps = brute_components([brute_fingerprint(x.text) for x in df.collect()])
    assert sh.keep_first(df).count() == len(set(fps))
